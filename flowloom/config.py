"""All constants of the engine, in one frozen dataclass."""

from __future__ import annotations

from dataclasses import dataclass

# They must equal the values results are compared with.
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")
DAY_ORDER = {d: i + 1 for i, d in enumerate(DAYS)}
DAY_PARTITION = {"Monday": "train", "Tuesday": "train", "Wednesday": "val", "Thursday": "test", "Friday": "test"}
CLASSES = (
    "BENIGN", "DoS Hulk", "PortScan", "DDoS", "DoS GoldenEye", "FTP-Patator", "SSH-Patator", "DoS slowloris", "DoS Slowhttptest",
    "Bot", "Web Attack - Brute Force", "Web Attack - XSS", "Web Attack - Sql Injection", "Infiltration", "Heartbleed",
)
TOKENS = (
    "CONNECTION_ATTEMPT", "SESSION_ESTABLISHED", "AUTH_FAIL", "AUTH_SUCCESS", "SCAN_ACTIVITY",
    "DATA_TRANSFER", "CONNECTION_TERMINATION", "FORCED_TERMINATION", "DOS_INDICATOR", "POST_AUTH_ACTIVITY",
)
AUTH_PORTS = (21, 22, 23, 3389, 3306, 5432, 1433)
IDENTIFIER_COLUMNS = ("flow_id", "source_ip", "src_ip", "source_port", "src_port", "destination_ip", "dst_ip", "timestamp")
PROVENANCE_COLUMNS = ("day", "day_order", "source_file", "partition", "session_key", "session_id", "label", "token", "record_id", "loaded_at")


@dataclass(frozen=True)
class Settings:
    """Numeric defaults; pass another instance to change one."""

    seed: int = 42
    outlier_percentile: float = 99.0
    variance_floor: float = 1e-4
    class_weight_cap: float = 50.0
    smote_min_count: int = 50
    smote_k: int = 5
    smote_clean_k: int = 3
    smote_ratio: float = 0.10
    session_gap_s: int = 60
    session_cap_s: int = 3600
    small_bytes: int = 500
    large_bytes: int = 5000
    flood_rate: float = 500.0
    short_flow_us: int = 100_000
    tree_count: int = 200
    boost_rounds: int = 300
    boost_depth: int = 8
    boost_step: float = 0.1
    sequence_length: int = 128
    fusion_grid: tuple[float, ...] = (0.0, 0.05, 0.10, 0.15)
    itemset_support: float = 0.02
    sequence_support: float = 0.02
    max_gap_s: float = 900.0
    max_pattern_length: int = 6
    max_patterns: int = 200
    rho: float = 0.9
    novel_weight: float = 0.05
    lambdas: tuple[float, ...] = (0.001, 0.01, 0.05, 0.1, 1.0)
    single_event_score: float = 0.5
    tier_suspicious: float = 0.35
    tier_attack: float = 0.75
    gap_epsilon: float = 1e-3
    stream_window_s: int = 60
    stream_stride_s: int = 10
    explain_top_k: int = 5


SETTINGS = Settings()
