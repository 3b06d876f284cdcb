"""Behaviour tokens of flows, sequences of sessions and their transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.config import AUTH_PORTS, SETTINGS, TOKENS
from flowloom.functions.net import no_nan

SLICE_S = 3600
# What each token means, in the order the rules are tried.
RULES = (
    ("DOS_INDICATOR", "high packet rate without any reply"),
    ("SCAN_ACTIVITY", "short opening without reply and hardly any bytes"),
    ("FORCED_TERMINATION", "reset after few packets"),
    ("AUTH_FAIL", "short exchange on an authentication port that ends early"),
    ("AUTH_SUCCESS", "acknowledged exchange of some size on an authentication port"),
    ("POST_AUTH_ACTIVITY", "large exchange on an authentication port"),
    ("DATA_TRANSFER", "two-way exchange of some size elsewhere"),
    ("SESSION_ESTABLISHED", "opened and acknowledged with few bytes"),
    ("CONNECTION_TERMINATION", "orderly end"),
    ("CONNECTION_ATTEMPT", "anything else"),
)


def _one(columns: list[str], *names: str) -> Column:
    """The first of the names that the table has, NaN as null; 0 if it has none."""
    have = next((n for n in names if n in columns), None)
    return no_nan(F.col(have).cast("double")) if have else F.lit(0.0)


def token(columns: list[str]) -> Column:
    """The first rule that holds; a comparison with a missing number doesn't hold."""
    c = lambda *n: _one(columns, *n)
    fwd, bwd, duration = c("total_fwd_packets"), c("total_backward_packets", "total_bwd_packets"), c("flow_duration")
    size = c("total_length_of_fwd_packets", "total_length_fwd_packets") + c("total_length_of_bwd_packets", "total_length_bwd_packets")
    syn, ack, rst, fin = c("syn_flag_count"), c("ack_flag_count"), c("rst_flag_count"), c("fin_flag_count")
    rate = c("flow_packets_s", "fwd_packets_s")
    auth = F.coalesce(c("destination_port", "dst_port").isin(*map(float, AUTH_PORTS)), F.lit(False))
    s = SETTINGS
    return (
        F.when((rate > s.flood_rate) & (bwd == 0) & (fwd > 5), "DOS_INDICATOR")
        .when((syn > 0) & (bwd == 0) & (size < 50) & (duration < s.short_flow_us) & (fwd <= 3), "SCAN_ACTIVITY")
        .when((rst > 0) & (bwd <= 1) & (fwd <= 3), "FORCED_TERMINATION")
        .when(auth & (fwd <= 10) & (bwd <= 10) & (size < s.small_bytes) & (F.coalesce(rst > 0, F.lit(False)) | F.coalesce(fin > 0, F.lit(False))), "AUTH_FAIL")
        .when(auth & (ack > 0) & (bwd > 0) & (size >= s.small_bytes) & (size < s.large_bytes), "AUTH_SUCCESS")
        .when(auth & (size >= s.large_bytes), "POST_AUTH_ACTIVITY")
        .when(~auth & (bwd > 0) & (fwd > 0) & (size >= s.small_bytes), "DATA_TRANSFER")
        .when((syn > 0) & (ack > 0) & (bwd > 0) & (size < s.small_bytes), "SESSION_ESTABLISHED")
        .when(fin > 0, "CONNECTION_TERMINATION")
        .otherwise("CONNECTION_ATTEMPT")
    )


def encode_events(df: DataFrame) -> DataFrame:
    return df.withColumn("token", token(df.columns))


def rule_table(spark) -> DataFrame:
    return spark.createDataFrame([(i + 1, t, p) for i, (t, p) in enumerate(RULES)], "rule int, token string, meaning string")


def sequences(steps: DataFrame) -> DataFrame:
    """(session, seq): steps (session, us, seq_no, token) in order; a session's length is capped where sessions are made."""
    return steps.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("us", "seq_no", "token"))).alias("seq"))


def last_steps(steps: DataFrame, most: int = SETTINGS.sequence_length) -> DataFrame:
    """The last `most` steps of each session; Spark limits each group before the shuffle."""
    newest = Window.partitionBy("session").orderBy(F.desc("us"), F.desc("seq_no"))
    return steps.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= most).drop("__r")


def last_indices(tokens: Column, most: int = SETTINGS.sequence_length) -> Column:
    """Ids 0..9 of the last `most` tokens."""
    ids = F.transform(tokens, lambda t: F.array_position(F.lit(list(TOKENS)), t) - 1)
    return F.when(F.size(ids) > most, F.slice(ids, -most, most)).otherwise(ids)


def transitions(steps: DataFrame, slice_s: int = SLICE_S) -> DataFrame:
    """(session, pos, src, dst, dt_s, us): each pair of neighbouring steps of a session.

    Steps are ordered within slices of time, so a session of any size is many tasks; the last step of a slice is followed
    by the first of the session's next slice, which comes from one row per slice. Both use one shuffle of the steps.
    """
    rows = steps.select("session", "us", "seq_no", "token", F.floor(F.col("us") / F.lit(slice_s * 1_000_000)).alias("z")).repartition("session", "z")
    w = Window.partitionBy("session", "z").orderBy("us", "seq_no")
    inside = rows.select("session", "z", "us", (F.row_number().over(w) - 1).alias("i"), F.col("token").alias("src"), F.lead(F.struct("us", "token")).over(w).alias("next"))
    heads = rows.groupBy("session", "z").agg(F.min(F.struct("us", "seq_no", "token")).alias("head"), F.count("*").alias("n"))
    along = Window.partitionBy("session").orderBy("z")
    after = heads.select(F.col("session").alias("s"), F.col("z").alias("zz"), F.lead("head").over(along).alias("head"), F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    both = inside.join(after, (F.col("session") == F.col("s")) & (F.col("z") == F.col("zz")))
    nxt = F.coalesce(F.col("next"), F.struct(F.col("head.us").alias("us"), F.col("head.token").alias("token")))
    pairs = both.select("session", "us", (F.col("before") + F.col("i")).alias("pos"), "src", nxt["token"].alias("dst"), ((nxt["us"] - F.col("us")) / 1e6).alias("dt_s"))
    return pairs.where("dst IS NOT NULL")
