"""Day files of flows as CSV."""

from __future__ import annotations

import csv as csv_lines
import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.config import DAY_ORDER
from flowloom.operators import clean
from flowloom.runtime import if_small, stored

log = logging.getLogger(__name__)
# What the bytes 0x80 to 0x9F mean in the Western code page when read as ISO 8859-1.
WESTERN = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Full names of the CSV files of a folder, of any file system Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listStatus(path) if files.exists(path) else []
    return sorted(s.getPath().toString() for s in found if s.isFile() and s.getPath().getName().lower().endswith(".csv"))


def discover_day_files(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """CSV files by the first weekday their name contains, days in their order; files without one are skipped with a warning."""
    files = _names(spark, folder)
    if not files:
        raise FileNotFoundError(f"no CSV files in {folder}")
    found: dict[str, list[str]] = {d: [] for d in DAY_ORDER}
    for f in files:
        day = next((d for d in DAY_ORDER if d.lower() in f.rsplit("/", 1)[-1].lower()), None)
        if day is None:
            log.warning("no weekday in the name of %s", f)
        else:
            found[day].append(f)
    for d in DAY_ORDER:
        if not found[d]:
            log.warning("no file for %s", d)
    return {d: fs for d, fs in found.items() if fs}


def probe(spark: SparkSession, files: list[str]) -> dict[str, tuple[str, bool]]:
    """(header line, whether all of it is UTF-8) of each file: one distributed pass, one row a file on the driver."""
    lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    found = lines.groupBy("file").agg(F.min_by("value", "at").alias("head"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    rows = found.select("file", F.when(F.col("utf8"), F.col("head")).otherwise(F.decode(F.col("head").cast("binary"), "ISO-8859-1")).alias("head"), "utf8").collect()
    return {r["file"]: (r["head"].lstrip("\ufeff"), r["utf8"]) for r in rows}


def read_files(spark: SparkSession, files: list[str], day_of: dict[str, str]) -> DataFrame:
    """All files, columns as text under normalized names, with day and source_file; one scan for each different header and encoding.

    A file that isn't UTF-8 is read in the Western code page; of columns equal after normalization the first stays; files
    without a column give null there.
    """
    seen, out = probe(spark, files), None
    groups: dict[tuple[str, bool], list[str]] = {}
    for f, kind in seen.items():
        groups.setdefault(kind, []).append(f)
    days = spark.createDataFrame([(f.rsplit("/", 1)[-1], d) for f, d in day_of.items()], "source_file string, day string")
    for (head, utf8), same in sorted(groups.items()):
        headers = next(csv_lines.reader([head]), [])
        schema = T.StructType([T.StructField(f"__{i}", T.StringType()) for i in range(len(headers))])
        raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("encoding", "UTF-8" if utf8 else "ISO-8859-1").option("ignoreLeadingWhiteSpace", False).csv(same)
        raw = raw.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__start"))
        raw = raw.withColumn("__at", F.monotonically_increasing_id())
        df = clean.normalize_columns(raw, [*headers, "source file", "file start", "file at"])
        if not utf8:
            controls = bytes(range(0x80, 0xA0)).decode("latin-1")
            df = df.select(*[F.translate(c, controls, WESTERN).alias(c) if c not in ("source_file", "file_start", "file_at") else F.col(c) for c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.join(F.broadcast(days), "source_file")  # one row a file


def numbered(df: DataFrame) -> DataFrame:
    """df with row_seq in place of file_start and file_at; rows are numbered within a piece of a file, pieces by running totals."""
    df = stored(clean.tag_day(df).withColumn("__piece", F.shiftright("file_at", 33)))
    piece = ["day_order", "source_file", "file_start", "__piece"]
    sizes = df.groupBy(*piece).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")  # one row a piece
    inside = df.withColumn("__in", F.row_number().over(Window.partitionBy(*piece).orderBy("file_at")) - 1)
    return inside.join(if_small(before), piece).withColumn("row_seq", F.col("__before") + F.col("__in")).drop("__in", "__before", "__piece", "file_start", "file_at")


TEXT = {"flow_id", "source_ip", "src_ip", "destination_ip", "dst_ip", "timestamp", "label", "day", "source_file"}
MISSING = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None")


def load_flows(spark: SparkSession, folder: str, rows_per_file: int | None = None, timestamp_mode: str = "coalesce") -> DataFrame:
    """All day files as one table: types, times (parsed, synthetic or imputed), labels resolved to the 15 classes, partition.

    A column is numeric if every value in it is a number; files without a column give null there. row_seq numbers the
    rows without gaps, by day, file and place in the file.
    """
    by_day = discover_day_files(spark, folder)
    df = read_files(spark, [f for fs in by_day.values() for f in fs], {f: d for d, fs in by_day.items() for f in fs})
    if "label" not in df.columns:
        raise KeyError("no label column")
    df = numbered(df)
    if rows_per_file is not None:
        df = clean.first_rows_per_file(df, "source_file", "row_seq", rows_per_file)
    open_ = [c for c in df.columns if c not in TEXT and c not in ("row_seq", "day_order", "partition")]
    value = {c: F.when(~F.trim(c).isin(*MISSING), F.trim(c)) for c in open_}
    good = df.agg(*[F.count_if(value[c].isNotNull() & value[c].try_cast("double").isNull()).alias(c) for c in open_]).first()
    df = df.select(*[c for c in df.columns if c not in open_], *[(value[c].try_cast("double") if good[c] == 0 else F.col(c)).alias(c) for c in open_])
    if "timestamp" in df.columns:
        df = clean.parse_times(df.withColumnRenamed("timestamp", "__text"), "__text", "timestamp", timestamp_mode, "row_seq").drop("__text")
        df = clean.impute_times(df, "row_seq")
    else:
        df = clean.synthetic_clock(df, "row_seq")
    return clean.known_labels(df)


def write_day_files(df: DataFrame, folder: str) -> None:
    """Flows as CSV, one folder per day."""
    df.write.mode("overwrite").option("header", True).partitionBy("day").csv(folder)
