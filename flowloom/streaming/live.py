"""Sessions of a live flow stream.

Flows are tokenised without state, those sent again (equal but for their number and arrival) dropped within the
watermark, and grouped by day and key. Flows of one instant are taken in the order of their numbers. Per group
the state holds flows the watermark hasn't passed and the open session; flows are taken in time order once it has, so
the result equals the batch table of the same flows. A session is emitted when the watermark passes its end plus gap
(event-time timeout) or a flow opens the next. Flows older than the watermark are dropped by Spark and counted in its
progress.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowloom.config import SETTINGS
from flowloom.operators.tokens import token
from flowloom.runtime import row_hash

OUT = "day string, session_key string, start_us bigint, end_us bigint, n_flows bigint, last_token string"
STATE = "waiting_us array<bigint>, waiting_end array<bigint>, waiting_token array<string>, waiting_seq array<bigint>, start bigint, prev_us bigint, prev_end bigint, n bigint, last_token string"


def _take(key: tuple, flows: list[tuple[int, int, str, int]], open_: list | None, gap_us: int, cap_us: int) -> tuple[list[tuple], list | None]:
    """Applies flows in time order to the open session [start, prev_us, prev_end, n, token]; finished sessions and the open one."""
    done = []
    for us, end, name, _ in flows:
        if open_ is None or us - open_[2] > gap_us or us - open_[0] > cap_us:
            if open_ is not None:
                done.append((*key, open_[0], open_[1], open_[3], open_[4]))
            open_ = [us, us, end, 0, name]
        open_ = [open_[0], us, end, open_[3] + 1, name]
    return done, open_


def _step(gap_us: int, cap_us: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, open_ = [], None
        if state.exists:
            a, b, c, d, start, prev_us, prev_end, n, name = state.get
            waiting = list(zip(a, b, c, d, strict=True))
            open_ = [start, prev_us, prev_end, n, name] if n else None
        for pdf in batches:
            waiting += list(zip(pdf["us"].tolist(), pdf["end_us"].tolist(), pdf["token"].tolist(), pdf["seq_no"].tolist(), strict=True))
        mark = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda x: (x[0], x[3]))
        ready = [f for f in waiting if f[0] < mark]
        waiting = waiting[len(ready) :]
        done, open_ = _take(key, ready, open_, gap_us, cap_us)
        if open_ is not None and not waiting and open_[2] + gap_us < mark:
            done.append((*key, open_[0], open_[1], open_[3], open_[4]))
            open_ = None
        if open_ is None and not waiting:
            state.remove()
        else:
            o = open_ or [0, 0, 0, 0, ""]
            state.update(([f[0] for f in waiting], [f[1] for f in waiting], [f[2] for f in waiting], [f[3] for f in waiting], *o))
            wake = max((open_[2] + gap_us) if open_ else 0, waiting[-1][0] if waiting else 0) // 1000 + 1
            state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=[c.split()[0] for c in OUT.split(", ")])

    return run


def live_sessions(flows: DataFrame, gap_s: float = SETTINGS.session_gap_s, cap_s: float = SETTINGS.session_cap_s, late: str = "2 minutes", id_col: str = "record_id", ignore: tuple[str, ...] = ("loaded_at",)) -> DataFrame:
    """Finished sessions of a stream of flows (timestamp, flow_duration, day, session_key, counts)."""
    named = flows.where("timestamp IS NOT NULL AND session_key IS NOT NULL AND day IS NOT NULL").withColumn("token", token(flows.columns)).withColumn("event_time", F.col("timestamp").cast("timestamp"))
    us = F.unix_micros("event_time")
    h1, h2 = row_hash([c for c in flows.columns if c not in (id_col, *ignore)])
    slim = named.select(F.col(id_col).cast("bigint").alias("seq_no"), h1.alias("h1"), h2.alias("h2"), "event_time", "day", "session_key", us.alias("us"), (us + F.greatest(F.coalesce("flow_duration", F.lit(0)), F.lit(0))).cast("bigint").alias("end_us"), "token")
    once = slim.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["h1", "h2"])
    return once.groupBy("day", "session_key").applyInPandasWithState(_step(int(gap_s * 1e6), int(cap_s * 1e6)), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def live_window_counts(flows: DataFrame, window_s: int = SETTINGS.stream_window_s, stride_s: int = SETTINGS.stream_stride_s, late: str = "2 minutes") -> DataFrame:
    """Flows by hopping window and token."""
    named = flows.withColumn("token", token(flows.columns)).withColumn("event_time", F.col("timestamp").cast("timestamp"))
    return named.withWatermark("event_time", late).groupBy(F.window("event_time", f"{window_s} seconds", f"{stride_s} seconds"), "token").agg(F.count("*").alias("n_flows"))
