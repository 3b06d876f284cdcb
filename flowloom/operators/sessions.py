"""Rows tagged with their session, session summaries.

Sessions come from the sweep (see sweep.py), so a hot key is spread over time slices; rows find theirs by an equal
join on (group, slice) with the sessions' slices. With termination flags two rows of one instant may lie in different
sessions; then rows are numbered one by one, also within slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.config import SETTINGS
from flowloom.operators.sweep import SLICE_S, US, part_of_run, sweep_sessions
from flowloom.runtime import if_small, stored


def session_name(day: str | Column, key: str | Column, number: str | Column) -> Column:
    return F.concat(day if isinstance(day, Column) else F.col(day), F.lit("||"), F.col(key) if isinstance(key, str) else key, F.lit("__s"), (F.col(number) if isinstance(number, str) else number).cast("string"))


def tag_sessions(df: DataFrame, us: str, duration: str, seq: str, gap_s: float = SETTINGS.session_gap_s, cap_s: float = SETTINGS.session_cap_s, day: str = "day", key: str = "session_key") -> DataFrame:
    """df's rows with day, key and time, and their session_id (`<day>||<key>__s<n>`, n from 0 in each group)."""
    base = df.where(F.col(us).isNotNull() & F.col(day).isNotNull() & F.col(key).isNotNull())
    found = sweep_sessions(base.select(day, key, us, duration, seq), [day, key], us, duration, seq, gap_s, cap_s, distinct=False)
    numbered = found.withColumn("__n", F.row_number().over(Window.partitionBy(day, key).orderBy("start_us")) - 1)
    size = F.lit(SLICE_S * US)
    spans = numbered.select(F.col(day).alias("__d"), F.col(key).alias("__k"), "start_us", "end_us", "__n", F.explode(F.sequence(F.floor(F.col("start_us") / size), F.floor(F.col("end_us") / size))).alias("__z"))
    rows = base.withColumn("__slice", F.floor(F.col(us) / size))
    on = (F.col(day) == F.col("__d")) & (F.col(key) == F.col("__k")) & (F.col("__slice") == F.col("__z")) & F.col(us).between(F.col("start_us"), F.col("end_us"))
    return rows.join(spans, on).select(*[rows[c] for c in df.columns if c != "session_id"], session_name(day, key, "__n").alias("session_id"))


def tag_sessions_terminated(df: DataFrame, us: str, duration: str, seq: str, gap_s: float = SETTINGS.session_gap_s, cap_s: float = SETTINGS.session_cap_s, day: str = "day", key: str = "session_key") -> DataFrame:
    """(seq, session_id): a row after one with FIN or RST also opens a session.

    Breaks are found within time slices; between slices they come from one row a slice, whose running sums number the
    runs. Runs longer than the cap are cut as in the sweep.
    """
    flag = lambda c: F.coalesce(F.col(c) > 0, F.lit(False)) if c in df.columns else F.lit(False)
    gap_us, cap_us, g, z = int(gap_s * US), int(cap_s * US), ["__d", "__k"], ["__d", "__k", "__z"]
    rows = df.where(F.col(us).isNotNull() & F.col(day).isNotNull() & F.col(key).isNotNull()).select(
        F.col(day).alias("__d"), F.col(key).alias("__k"), F.floor(F.col(us) / F.lit(SLICE_S * US)).alias("__z"), F.col(us).alias("__us"), F.col(seq).alias("__seq"),
        (F.col(us) + F.greatest(F.coalesce(F.col(duration), F.lit(0)), F.lit(0))).alias("__end"), (flag("fin_flag_count") | flag("rst_flag_count")).alias("__over"),
    ).repartition(*z)
    w = Window.partitionBy(*z).orderBy("__us", "__seq")
    split = lambda over, end, start: (over | (start - end > gap_us)).cast("int")
    inside = rows.withColumn("__new", F.coalesce(split(F.lag("__over").over(w), F.lag("__end").over(w), F.col("__us")), F.lit(0))).withColumn("__c", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = stored(inside.select(*z, "__us", "__seq", "__end", "__over", "__c"))
    last = F.max_by(F.struct("__over", "__end"), F.struct("__us", "__seq"))
    slices = inside.groupBy(*z).agg(F.min("__us").alias("__head"), last.alias("__tail"), F.max("__c").alias("__n"))
    along = Window.partitionBy(*g).orderBy("__z")
    opens = F.coalesce(split(F.lag("__tail").over(along)["__over"], F.lag("__tail").over(along)["__end"], F.col("__head")), F.lit(1))
    base = slices.withColumn("__open", opens).withColumn("__base", F.sum("__open").over(along) + F.coalesce(F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(*z, "__base")
    placed = inside.join(base, z).select(*g, (F.col("__base") + F.col("__c")).alias("__run"), "__us", "__seq")
    runs = placed.groupBy(*g, "__run").agg((F.max("__us") - F.min("__us") > cap_us).alias("__far"))
    keys = [*g, "__run"]
    marked = placed.join(if_small(runs.where("__far")), keys, "left")
    far = stored(marked.where("__far").drop("__far").withColumnRenamed("__us", "__t"))
    cut = part_of_run(far, keys, cap_us).withColumnRenamed("__t", "__us")
    parts = stored(cut.unionByName(marked.where("__far IS NULL").drop("__far").withColumn("__part", F.lit(0))))
    sizes = parts.groupBy(*keys).agg((F.max("__part") + 1).alias("__m"))
    first = sizes.withColumn("__first", F.coalesce(F.sum("__m").over(Window.partitionBy(*g).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__m")
    return parts.join(first, keys).select(F.col("__seq").alias(seq), session_name(F.col("__d"), F.col("__k"), F.col("__first") + F.col("__part")).alias("session_id"))


def session_summary(df: DataFrame, session: str, us: str, seq: str, token: str | None = None) -> DataFrame:
    """(session_id, day, partition, n_flows, start_us, end_us, label, duration_seconds), with a token column also (items, first_seq).

    The label is the most frequent one, of equally frequent ones the one seen first; null labels don't vote. items are the
    session's different tokens, first_seq its least row number.
    """
    first = F.struct(us, seq)
    more = [F.collect_set(token).alias("items"), F.min(seq).alias("first_seq")] if token else []  # as many as there are tokens
    votes = df.groupBy(session, "label").agg(F.count("*").alias("n"), F.min(first).alias("f"), F.min_by(F.struct("day", "partition"), first).alias("p"), F.min(us).alias("a"), F.max(us).alias("b"), *more)
    vote = F.when(F.col("label").isNotNull(), F.struct(F.col("n").alias("n"), (-F.col(f"f.{us}")).alias("t"), (-F.col(f"f.{seq}")).alias("s")))
    more = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.min("first_seq").alias("first_seq")] if token else []
    out = votes.groupBy(F.col(session).alias("session_id")).agg(F.min_by("p", "f").alias("p"), F.sum("n").alias("n_flows"), F.min("a").alias("start_us"), F.max("b").alias("end_us"), F.max_by("label", vote).alias("label"), *more)
    return out.select("session_id", "p.day", "p.partition", "n_flows", "start_us", "end_us", "label", ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_seconds"), *(["items", "first_seq"] if token else []))


def flow_level(df: DataFrame, seq: str) -> DataFrame:
    """Every flow as a session of its own."""
    return df.withColumn("session_id", F.concat(F.lit("flow_"), F.col(seq).cast("string")))
