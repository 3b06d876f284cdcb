"""Labels, times, cleaning and splits of the flow table.

All functions keep other columns. Defined results: see each function for nulls; empty tables give empty results.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.config import CLASSES, DAY_ORDER, DAY_PARTITION, SETTINGS
from flowloom.functions.names import normalize_name

# Other spellings of the classes, by lower-case text with spaced hyphens.
ALIASES = {
    "benign": "BENIGN", "bot": "Bot", "ddos": "DDoS", "dos goldeneye": "DoS GoldenEye", "dos hulk": "DoS Hulk", "dos slowhttptest": "DoS Slowhttptest",
    "dos slowloris": "DoS slowloris", "heartbleed": "Heartbleed", "infiltration": "Infiltration", "portscan": "PortScan",
    "web attack - brute force": "Web Attack - Brute Force", "web attack - xss": "Web Attack - XSS", "web attack - sql injection": "Web Attack - Sql Injection", "web attack sql injection": "Web Attack - Sql Injection",
}


def normalize_columns(df: DataFrame, headers: list[str] | None = None) -> DataFrame:
    """Lower snake-case names (of `headers`, else the columns' own); of names equal after that the first column stays."""
    names = [normalize_name(c) for c in headers or df.columns]
    unique = [f"__{i}" for i in range(len(names))]
    return df.toDF(*unique).select(*[F.col(unique[i]).alias(n) for i, n in enumerate(names) if names.index(n) == i])


def lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*values.items())])[key]


def normalize_label(label: Column) -> Column:
    """The class a raw label stands for.

    null gives MISSING_LABEL; white space is collapsed, en dashes and U+0096 become hyphens; then a known spelling, else
    the first class that contains the text or is contained in it (so the empty text is BENIGN), else the cleaned text.
    """
    text = F.regexp_replace(F.regexp_replace(label, r"(?U)\s+", " "), "[–\u0096]", "-")
    text = F.regexp_replace(text, "^ +| +$", "")
    key = F.regexp_replace(F.lower(text), r"\s*-\s*", " - ")
    fuzzy = reduce(lambda w, c: w.when(F.contains(F.lit(c.lower()), F.lower(text)) | F.contains(F.lower(text), F.lit(c.lower())), c), CLASSES, F.when(label.isNull(), "MISSING_LABEL"))
    return F.when(label.isNull(), "MISSING_LABEL").otherwise(F.coalesce(lookup(ALIASES, key), fuzzy, text))


def known_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows whose label resolves to one of the classes, with that class."""
    return df.withColumn(label, normalize_label(F.col(label))).where(F.col(label).isin(*CLASSES))


def tag_day(df: DataFrame, day: str = "day") -> DataFrame:
    return df.withColumn("day_order", lookup(DAY_ORDER, F.col(day))).withColumn("partition", lookup(DAY_PARTITION, F.col(day)))


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint")]


def clean_data(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which every one of the columns is a finite number."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < F.lit(float("inf"))) for c in columns], F.lit(True)))


def synthetic_clock(df: DataFrame, seq: str, time: str = "timestamp") -> DataFrame:
    """Times for a table without any: 1970 plus day_order days plus the row's place in its day, in seconds.

    The place within a day is counted over blocks of the sequence, so a day is never one task's.
    """
    placed = place_in_group(df, ["day_order"], seq, "__at")
    return placed.withColumn(time, F.expr("timestamp_ntz'1970-01-01'") + F.make_dt_interval(F.col("day_order"), F.lit(0), F.lit(0), F.col("__at").cast("decimal(18,6)"))).drop("__at")


def place_in_group(df: DataFrame, group: list[str], seq: str, out: str, blocks: int = 1024, by: Column | None = None) -> DataFrame:
    """0-based place of each row in its group by seq (or by `by`, then seq): rows of a block are ranked, and the counts
    of earlier blocks added, so a group of any size is spread over its blocks (`blocks` values of the order each)."""
    order = F.col(seq) if by is None else by
    rows = df.withColumn("__order", order).withColumn("__block", F.floor(F.col("__order") / F.lit(blocks)))
    counts = rows.groupBy(*group, "__block").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "__block"]])
    inside = rows.withColumn("__in", F.row_number().over(Window.partitionBy(*group, "__block").orderBy("__order", seq)) - 1)
    return inside.alias("l").join(before.alias("r"), same).select(*[F.col(f"l.{c}") for c in df.columns], (F.col("__before") + F.col("__in")).cast("bigint").alias(out))


def impute_times(df: DataFrame, seq: str, time: str = "timestamp") -> DataFrame:
    """Missing times become 1970 plus day_order days plus seq milliseconds."""
    made = F.expr("timestamp_ntz'1970-01-01'") + F.make_dt_interval(F.coalesce("day_order", F.lit(0)), F.lit(0), F.lit(0), (F.col(seq) / 1000).cast("decimal(18,6)"))
    return df.withColumn(time, F.coalesce(time, made))


TIME_FORMATS = ("d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm")


def guessed_format(first: str | None) -> str:
    """The format a column's first value suggests: month first where that is possible, with seconds if it has them."""
    m = re.match(r"\s*(\d{1,2})/(\d{1,2})/\d{4}(?:[ T]+\d{1,2}:\d{2}(:\d{2})?)?", first or "")
    if not m:
        return "M/d/yyyy H:mm:ss"
    order = "d/M/yyyy" if int(m[1]) > 12 else "M/d/yyyy"
    return f"{order} H:mm:ss" if m[3] else f"{order} H:mm"


def parse_times(df: DataFrame, text: str, out: str, mode: str = "coalesce", seq: str | None = None) -> DataFrame:
    """Times of a text column. coalesce: each row by the first format that fits; reference: one format for the whole
    column, guessed from its first value (by `seq`, else the least text); if more than half stay null, the first of the
    known formats that leaves fewer nulls."""
    as_time = lambda f: F.try_to_timestamp(F.col(text), F.lit(f)).cast("timestamp_ntz")
    if mode == "coalesce":
        return df.withColumn(out, F.coalesce(*[as_time(f) for f in TIME_FORMATS]))
    first = df.where(F.col(text).isNotNull()).agg(F.min_by(text, seq or text).alias("t")).first()["t"]
    guess = (guessed_format(first), *TIME_FORMATS)
    nulls = df.agg(F.count("*").alias("n"), *[F.count_if(as_time(f).isNull()).alias(f"n{i}") for i, f in enumerate(guess)]).first()
    best = 0
    if nulls["n"] and nulls["n0"] > nulls["n"] / 2:
        for i in range(1, len(guess)):
            best = i if nulls[f"n{i}"] < nulls[f"n{best}"] else best
    return df.withColumn(out, as_time(guess[best]))


def first_rows_per_file(df: DataFrame, file: str, seq: str, n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(file).orderBy(seq))).where(F.col("__n") <= n).drop("__n")


def zero_shot_classes(train: DataFrame, label: str = "label") -> DataFrame:
    """(class_index, label): classes without a training row, in class order; the row aggregate stays one row a class."""
    classes = train.sparkSession.createDataFrame([(i, c) for i, c in enumerate(CLASSES)], "class_index int, label string")
    return classes.join(F.broadcast(train.select(F.col(label).alias("__l")).where(F.col("__l").isin(*CLASSES)).distinct()), F.col("label") == F.col("__l"), "left_anti")  # 15 rows at most


def hash_order(seq: str, salt: int = 0) -> Column:
    """A pseudo-random order any engine computes alike."""
    return F.pmod((F.col(seq) + F.lit(salt)) * F.lit(2654435761), F.lit(4294967296))


def stratified_split(df: DataFrame, label: str, seq: str, test: float = 0.20, val: float = 0.15) -> DataFrame:
    """`partition` by label: in hash order the first `test` share, then `val` of the rest, both rounded up.

    A class of fewer than three rows can't be in all three parts and raises. The largest class is spread over blocks of
    the hash order.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("__total"))
    small = [r[0] for r in sizes.where("__total < 3").limit(20).collect()]
    if small:
        raise ValueError(f"classes with fewer than 3 rows can't be split: {small}; drop them or join them to others")
    placed = place_in_group(df, [label], seq, "__at", 1 << 22, hash_order(seq))
    total, at = F.col("__total"), F.col("__at") + 1
    n_test = F.ceil(total * F.lit(test))
    n_val = F.ceil((total - n_test) * F.lit(val))
    counted = placed.alias("p").join(F.broadcast(sizes.alias("s")), F.col(f"p.{label}").eqNullSafe(F.col(f"s.{label}"))).select("p.*", "s.__total")  # one row a class
    return counted.withColumn("partition", F.when(at <= n_test, "test").when(at <= n_test + n_val, "val").otherwise("train")).drop("__at", "__total")


def seed_zero_shot(df: DataFrame, label: str, seq: str, most: int = 500) -> DataFrame:
    """Validation rows of classes without a training row move to train, up to `most` a class in hash order."""
    here = df.where("partition = 'train'").select(F.col(label).alias("__l")).distinct()
    lacking = df.where("partition = 'val'").join(here, F.col(label) == F.col("__l"), "left_anti")
    moved = lacking.withColumn("__n", F.row_number().over(Window.partitionBy(label).orderBy(hash_order(seq), seq))).where(F.col("__n") <= most).select(F.col(seq).alias("__s"))
    return df.join(moved, F.col(seq) == F.col("__s"), "left").withColumn("partition", F.when(F.col("__s").isNotNull(), "train").otherwise(F.col("partition"))).drop("__s")


def class_weights(train: DataFrame, label: str = "label", cap: float = SETTINGS.class_weight_cap) -> DataFrame:
    """(label, weight): min(N / (15 n), cap); classes without rows 1."""
    classes = train.sparkSession.createDataFrame([(c,) for c in CLASSES], "label string")
    counts = train.where(F.col(label).isin(*CLASSES)).groupBy(F.col(label).alias("__l")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"))
    return classes.join(F.broadcast(counts), F.col("label") == F.col("__l"), "left").join(F.broadcast(whole)).select("label", F.when(F.col("n").isNull(), 1.0).otherwise(F.least(F.col("total") / (F.lit(len(CLASSES)) * F.col("n")), F.lit(cap))).alias("weight"))  # 15 and 1 rows


def class_weight_array(weights: DataFrame) -> list[float]:
    """Weights in class order (15 rows)."""
    by = {r["label"]: r["weight"] for r in weights.collect()}
    return [by.get(c, 1.0) for c in CLASSES]


def sample_rows(df: DataFrame, seq: str, n: int, salt: int = SETTINGS.seed) -> DataFrame:
    """n rows in hash order: the same ones at every run and on any engine."""
    return df.orderBy(hash_order(seq, salt), seq).limit(n)
