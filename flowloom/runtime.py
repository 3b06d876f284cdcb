"""What operators need of the running session: shared folder, size-checked broadcasts, stable hashes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 20_000
_cleared: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A folder all executors share: spark.checkpoint.dir of the session.

    Only a session whose executors are this machine's own threads may do without; it gets a temporary folder. On a
    cluster each executor would write to a disk of its own and a reader see a part of it, so the lack of one raises.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='flowloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def _own_folder(spark: SparkSession):
    """This application's part of the shared folder, as a Hadoop path with its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/flowloom/{spark.sparkContext.applicationId}")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it: survives lost executors and keeps columnar statistics.

    What an application has stored is removed when it ends, or by clear_stored().
    """
    spark = df.sparkSession
    folder, files = _own_folder(spark)
    if not files.exists(folder):
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    path = f"{folder.toString()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_with(df: DataFrame, **values: Column) -> tuple[DataFrame, dict]:
    """stored(), and aggregates of the rows taken while they are written."""
    seen = Observation()
    out = stored(df.observe(seen, *[c.alias(n) for n, c in values.items()]))
    return out, seen.get


def clear_stored(spark: SparkSession) -> None:
    """Removes what stored() wrote for this application, once nothing reads it any more."""
    folder, files = _own_folder(spark)
    files.delete(folder, True)
    _cleared.append(spark.sparkContext.applicationId)


def generation(spark: SparkSession) -> tuple[str, int]:
    """Changes whenever stored tables have gone: what was made of them before must be made again."""
    return spark.sparkContext.applicationId, len(_cleared)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast only if it is proven to have at most so many rows; beyond that it is joined by shuffle, whatever its size is estimated at."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', {ts})") if isinstance(ts, str) else F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), ts)


def row_hash(columns: list[str]) -> list[Column]:
    """Two 64-bit hashes of a row in which nulls count: equal rows have equal pairs, others differ but for chance of 2^-128."""
    nulls = [F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns])] if columns else []
    cols = [F.col(c) for c in columns]
    return [F.xxhash64(*nulls, *cols), F.xxhash64(F.lit(7), *cols, *nulls)]
