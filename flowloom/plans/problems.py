"""Queries of the general data problems (sessions, timestamps, drift)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.config import PROVENANCE_COLUMNS, SETTINGS
from flowloom.operators import drift, sweep, timestamps
from flowloom.runtime import micros
from flowloom.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    flows = table(spark, folder, "flow_records").withColumn("__us", micros("timestamp"))
    found = sweep.sweep_sessions(flows, ["day", "session_key"], "__us", "flow_duration", "record_id", SETTINGS.session_gap_s, SETTINGS.session_cap_s, ("loaded_at",))
    return found.withColumnRenamed("n_rows", "n_flows")


def p3_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return p3_found(spark, folder).withColumn("duration_us", F.col("end_us") - F.col("start_us"))


def p5_normalized(spark: SparkSession, folder: str) -> DataFrame:
    flows = table(spark, folder, "raw_flow_records")
    return timestamps.normalize_timestamps(flows, "timestamp", table(spark, folder, "sensors"), "sensor_id", "tz_name", "received_at")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_normalized(spark, folder).select("record_id", "utc_us").where("utc_us IS NOT NULL")


def p5_unread(spark: SparkSession, folder: str) -> DataFrame:
    """Shapes of texts that name no instant, with their number."""
    left = p5_normalized(spark, folder).where("utc_us IS NULL")
    return left.groupBy(timestamps.shape(timestamps.bare(F.col("timestamp"))).alias("shape")).agg(F.count("*").alias("n_records"))


def _fields(spark: SparkSession, folder: str) -> dict[str, str]:
    """Measured fields of the flow table, with their types, text for what lines hold as text."""
    flows = table(spark, folder, "flow_records")
    return {c: t if t in ("bigint", "double") else "string" for c, t in flows.dtypes if c not in PROVENANCE_COLUMNS or c == "label"}


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.schema_changes(table(spark, folder, "capture_lines"), list(_fields(spark, folder)))


def p7_table(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "capture_lines")
    one = drift.unify(lines, _fields(spark, folder))
    return one.withColumn("extra", F.to_json("extra"))


QUERIES = {"p3_found": p3_found, "p3_sessions": p3_sessions, "p5_found": p5_found, "p5_unread": p5_unread, "p7_found": p7_found, "p7_table": p7_table}

SQL = {
    "p3_found": """
WITH RECURSIVE once AS (
  SELECT min(record_id) AS record_id, * EXCLUDE (record_id, loaded_at) FROM flow_records WHERE "timestamp" IS NOT NULL AND session_key IS NOT NULL AND day IS NOT NULL GROUP BY ALL
), base AS (
  SELECT day, session_key, epoch_us("timestamp") AS us, epoch_us("timestamp") + greatest(coalesce(flow_duration, 0), 0) AS e, row_number() OVER (PARTITION BY day, session_key ORDER BY "timestamp", record_id) AS i FROM once
), walk AS (
  SELECT day, session_key, i, us, e, us AS first_us FROM base WHERE i = 1
  UNION ALL
  SELECT b.day, b.session_key, b.i, b.us, b.e, CASE WHEN b.us - w.e > 60000000 OR b.us - w.first_us > 3600000000 THEN b.us ELSE w.first_us END
  FROM walk w JOIN base b ON b.day = w.day AND b.session_key = w.session_key AND b.i = w.i + 1
)
SELECT day, session_key, first_us AS start_us, max(us) AS end_us, count(*) AS n_flows FROM walk GROUP BY day, session_key, first_us
""",
}
SQL["p3_sessions"] = f"SELECT *, end_us - start_us AS duration_us FROM ({SQL['p3_found'].strip()})"
