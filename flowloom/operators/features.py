"""Feature groups, scaling parameters fitted on training rows, mutual information."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.config import IDENTIFIER_COLUMNS, PROVENANCE_COLUMNS, SETTINGS
from flowloom.operators.clean import numeric_columns

BUCKETS = 1024
# Name parts that put a feature into a group, tried in this order.
GROUPS = {
    "A": (
        "packet_length", "pkt_len", "iat_mean", "iat_std", "iat_max", "iat_min", "iat_total", "flow_bytes_s", "flow_packets_s", "fwd_packets_s", "bwd_packets_s",
        "total_length_of_fwd_packets", "total_length_of_bwd_packets", "average_packet_size", "avg_fwd_segment_size", "avg_bwd_segment_size", "down_up_ratio", "total_fwd_packets", "total_backward_packets", "bulk",
    ),
    "B": ("destination_port", "protocol", "psh_flags", "urg_flags", "header_length", "init_win_bytes", "act_data_pkt_fwd", "min_seg_size_forward", "subflow"),
    "C": ("flow_duration", "idle_mean", "idle_std", "idle_max", "idle_min", "active_mean", "active_std", "active_max", "active_min"),
    "D": ("fin_flag_count", "syn_flag_count", "rst_flag_count", "psh_flag_count", "ack_flag_count", "urg_flag_count", "cwe_flag_count", "ece_flag_count"),
}


def candidate_features(df: DataFrame) -> list[str]:
    skip = {*IDENTIFIER_COLUMNS, *PROVENANCE_COLUMNS}
    return [c for c in numeric_columns(df) if c not in skip]


def feature_groups(columns: list[str]) -> dict[str, str]:
    """Group of each feature: the first with a matching name part, A if none has."""
    return {c: next((g for g, parts in GROUPS.items() if any(p in c for p in parts)), "A") for c in columns}


def model_feature_sets(columns: list[str]) -> dict[str, list[str]]:
    """Forest: A and B; boosting: B and D; token context: C."""
    g = feature_groups(columns)
    pick = lambda *gs: [c for c in columns if g[c] in gs]
    return {"forest": pick("A", "B"), "boosting": pick("B", "D"), "context": pick("C")}


def _long(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(c, x): the values of all columns that are not null, c the column's place: one small expression, however many columns there are."""
    values = F.array(*[x.cast("double") for x in columns.values()])
    return df.select(F.posexplode(values).alias("c", "x")).where("x IS NOT NULL")


def order_statistics(df: DataFrame, columns: dict[str, Column], ranks: dict[str, Callable[[int], list[int]]]) -> dict[str, tuple[int, list[float]]]:
    """(n, values at the wanted 0-based ranks) of each column, exactly; nulls don't count.

    Each round counts the values of every interval that still holds a wanted rank in BUCKETS parts (logarithmic first,
    then linear), all intervals in one scan with partial aggregation, and keeps the part that holds the rank, until its
    least and greatest value are equal. Nothing grows with the data: a round returns BUCKETS rows an interval at most.
    """
    names, long = list(columns), _long(df, columns)
    ends = {names[r["c"]]: r for r in long.groupBy("c").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()}  # one row a column
    size = {c: ends[c]["n"] if c in ends else 0 for c in names}
    out = {c: (size[c], [None] * len(ranks[c](size[c]))) for c in names}
    todo = [(c, i, r, ends[c]["a"], ends[c]["b"]) for c in ends for i, r in enumerate(ranks[c](size[c]))]
    log, first = (lambda v: math.copysign(math.log1p(abs(v)), v)), True
    while True:
        for c, i, _, a, b in todo:
            if a == b:
                out[c][1][i] = a
        todo = [t for t in todo if t[3] != t[4]]
        if not todo:
            return out
        spans = sorted({(c, a, b) for c, _, _, a, b in todo})
        # where an interval is too narrow for its logarithm, or in later rounds, parts are even
        curved = [first and log(a) < log(b) for _, a, b in spans]
        table = [(k, names.index(c), a, b, curve, *((log(a), log(b)) if curve else (a, b))) for k, ((c, a, b), curve) in enumerate(zip(spans, curved, strict=True))]
        spans_df = df.sparkSession.createDataFrame(table, "k int, sc int, a double, b double, curved boolean, ga double, gb double")
        g = F.when(F.col("curved"), F.signum("x") * F.log1p(F.abs("x"))).otherwise(F.col("x"))
        part = F.least(F.lit(BUCKETS - 1), F.greatest(F.lit(0), F.floor((g - F.col("ga")) / (F.col("gb") - F.col("ga")) * BUCKETS))).cast("int")
        inside = long.join(F.broadcast(spans_df), (F.col("c") == F.col("sc")) & F.col("x").between(F.col("a"), F.col("b")))  # a row a wanted rank at most
        by = {}
        for r in inside.groupBy("k", part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect():
            by.setdefault(r["k"], []).append(r)
        new = []
        for c, i, rank, a, b in todo:
            left = rank
            for r in sorted(by[spans.index((c, a, b))], key=lambda r: r["a"]):
                if left < r["n"]:
                    new.append((c, i, left, r["a"], r["b"]))
                    break
                left -= r["n"]
        todo, first = new, False


def clipped_to(x: Column, lo: float, hi: float) -> Column:
    """x within lo..hi; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def _between(n: int, q: float) -> tuple[int, int, float]:
    """The two ranks a quantile lies between, and how far along."""
    at = max(0, n - 1) * q
    return math.floor(at), math.ceil(at), at - math.floor(at)


def fit_scaler(train: DataFrame, columns: list[str], percentile: float = SETTINGS.outlier_percentile, floor: float = SETTINGS.variance_floor) -> DataFrame:
    """(feature, lo, hi, median, variance, low, high, kept): exact clip bounds, then what the clipped values have.

    Clipping keeps the order, so the median of the clipped values comes from the same order statistics as the bounds.
    Missing values take that median; variance is that of the population.
    """
    x = {c: F.when(F.abs(F.col(c).cast("double")) < F.lit(float("inf")), F.col(c).cast("double")) for c in columns}
    low = (100 - percentile) / 100
    wanted = lambda n: [r for q in (low, 1 - low, 0.5) for r in _between(n, q)[:2]]
    found = order_statistics(train, x, dict.fromkeys(columns, wanted))
    bound, med = {}, {}
    for c in columns:
        n, v = found[c]
        if not n:
            bound[c], med[c] = (0.0, 0.0), None
            continue
        mix = lambda i, q, f=float: f(v[2 * i]) + (f(v[2 * i + 1]) - f(v[2 * i])) * _between(n, q)[2]  # noqa: B023, E731
        bound[c] = (mix(0, low), mix(1, 1 - low))
        clipped = [min(max(y, bound[c][0]), bound[c][1]) for y in v[4:]]
        med[c] = clipped[0] + (clipped[1] - clipped[0]) * _between(n, 0.5)[2]
    filled = {c: F.coalesce(x[c], F.lit(float("nan"))) for c in columns}  # a missing value takes the median below
    table = [(i, float(bound[c][0]), float(bound[c][1]), float(med[c]) if med[c] is not None else 0.0) for i, c in enumerate(columns)]
    known = F.broadcast(train.sparkSession.createDataFrame(table, "sc int, lo double, hi double, med double"))  # one row a column
    full = F.when(F.isnan("x"), F.col("med")).otherwise(F.least(F.greatest(F.col("x"), F.col("lo")), F.col("hi")))
    rest = {columns[r["c"]]: r for r in _long(train, filled).join(known, F.col("c") == F.col("sc")).groupBy("c").agg(F.var_pop(full).alias("v"), F.min(full).alias("a"), F.max(full).alias("b")).collect()}  # one row a column
    of = lambda c, k: rest[c][k] if c in rest else None
    rows = [(c, float(bound[c][0]), float(bound[c][1]), med[c], of(c, "v"), of(c, "a"), of(c, "b"), (of(c, "v") or 0.0) > floor) for c in columns]
    return train.sparkSession.createDataFrame(rows, "feature string, lo double, hi double, median double, variance double, low double, high double, kept boolean")


def scale(df: DataFrame, params: list, keep: list[str]) -> DataFrame:
    """keep and the scaled kept features: clipped, filled, (x - low) / (high - low), a zero range divides by 1."""
    out = []
    for p in params:
        if p["kept"]:
            x = F.col(p["feature"]).cast("double")
            v = F.coalesce(clipped_to(F.when(F.abs(x) < F.lit(float("inf")), x), p["lo"], p["hi"]), F.lit(p["median"]))
            out.append(((v - p["low"]) / ((p["high"] - p["low"]) or 1.0)).alias(p["feature"]))
    return df.select(*keep, *out)


def mutual_information(df: DataFrame, columns: list[str], label: str, bins: int = 16) -> DataFrame:
    """(feature, mi): of 2-logarithm bins of each feature with the label, one aggregate over all features; highest first."""
    log2 = lambda c: F.when(F.abs(F.col(c).cast("double")) < F.lit(float("inf")), F.least(F.lit(float(bins)), F.floor(F.log2(F.abs(F.col(c).cast("double")) + 1) / 2)) * F.signum(F.col(c).cast("double")))
    long = df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), log2(c).cast("int").alias("b")) for c in columns])).alias("x"))
    cells = long.groupBy("x.feature", "x.b", "y").agg(F.count("*").alias("n"))
    f, fb, fy = Window.partitionBy("feature"), Window.partitionBy("feature", "b"), Window.partitionBy("feature", "y")
    total, nb, ny = F.sum("n").over(f), F.sum("n").over(fb), F.sum("n").over(fy)
    term = F.col("n") / total * F.log(F.col("n") * total / (nb * ny))
    return cells.select("feature", term.alias("t")).groupBy("feature").agg(F.greatest(F.sum("t"), F.lit(0.0)).alias("mi")).orderBy(F.desc("mi"), F.desc("feature"))
