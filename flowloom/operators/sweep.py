"""Sessions by a sweep line, in time slices that spread a hot key over many tasks.

Rule: rows of one group in time order; a row opens a session if it starts more than `gap` after the end of the row
just before it (its own start plus duration, not the furthest end so far), or more than `cap` after the session's
first start. Both limits are strict.

1. Repeated rows (equal but for the columns named) are dropped and rows of one instant folded into one point, within
   the shuffle by (group, time slice): a key that holds a third of all rows is spread over its slices.
2. In each slice every point puts +1 at its start and -1 at its end plus gap, or at the next start if that is
   earlier; where the running sum falls to zero a fragment closes. A slice has at most slice/gap + 1 fragments, so
   what follows is bounded by time, not by rows.
3. A running sum over the fragments of a group joins those that touch across slices into runs.
4. Only runs longer than cap need the greedy cut (see cut_points): from the least and greatest time of every tenth of
   a second of a run come short windows in which its sessions must begin; only points within those are walked one
   after the other, and the cuts found are given back to all points. What one task gets is bounded by time, not rows.

Defined results: rows with null group or time are left out; null and negative durations count as 0; an empty table
gives no session; ties in time are ordered by the load order, so the last one's end counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.runtime import row_hash, stored

US = 1_000_000
SLICE_S = 900
BUCKET_US = 100_000
END = (1 << 63) - 1


def _points(df: DataFrame, group: list[str], time_us: str, duration_us: str, order: str, ignore: list[str], slice_us: int, distinct: bool = True) -> DataFrame:
    """One row for each group, slice and instant: t, end (of the last row), n (distinct rows)."""
    same = [c for c in df.columns if c not in {*group, *ignore}] if distinct else [order]
    h1, h2 = row_hash(same)
    rows = df.where(F.col(time_us).isNotNull()).where(" AND ".join(f"`{c}` IS NOT NULL" for c in group)).select(
        *[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col(time_us).alias("__t"), F.floor(F.col(time_us) / F.lit(slice_us)).alias("__slice"),
        F.greatest(F.coalesce(F.col(duration_us), F.lit(0)), F.lit(0)).cast("long").alias("__d"), F.col(order).alias("__o"), h1.alias("__h1"), h2.alias("__h2"),
    )
    g = [f"__g{i}" for i in range(len(group))]
    spread = rows.repartition(*g, "__slice")
    once = spread.groupBy(*g, "__slice", "__t", "__h1", "__h2").agg(F.min("__o").alias("__o"), F.first("__d").alias("__d"))
    return once.groupBy(*g, "__slice", "__t").agg(F.count("*").alias("__n"), (F.col("__t") + F.max_by("__d", F.struct("__o", "__h1", "__h2"))).alias("__end"))


def _swept(points: DataFrame, g: list[str], gap_us: int) -> DataFrame:
    """The points with the number of their fragment in the slice, from the zero crossings of the sweep."""
    part = [*g, "__slice"]
    nxt = F.lead("__t").over(Window.partitionBy(*part).orderBy("__t"))
    stop = F.least(F.col("__end") + gap_us, F.coalesce(nxt, F.col("__end") + gap_us))
    deltas = points.withColumn("__stop", stop).select(
        *part, "__n", "__end", F.col("__t").alias("__start"), F.explode(F.array(F.struct(F.col("__t").alias("at"), F.lit(1).alias("step")), F.struct(F.col("__stop").alias("at"), F.lit(-1).alias("step")))).alias("__e")
    )
    sweep = Window.partitionBy(*part).orderBy("__e.at", F.desc("__e.step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_now = deltas.withColumn("__open", F.sum("__e.step").over(sweep))
    return open_now.withColumn("__frag", F.sum(F.when(F.col("__open") == 0, 1).otherwise(0)).over(sweep)).where("__e.step = 1").select(*part, "__n", "__end", F.col("__start").alias("__t"), "__frag")


def _by_run(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Pieces of runs in order, from rows sorted by run."""
    for pdf in batches:
        if len(pdf):
            new = np.zeros(len(pdf), dtype=bool)
            for c in keys:
                v = pdf[c].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            at = [0, *np.flatnonzero(new), len(pdf)]
            for i, j in zip(at, at[1:], strict=False):
                yield tuple(pdf[c].iloc[i] for c in keys), pdf.iloc[i:j]


def _windows(cap_us: int, keys: list[str]):
    """For each run, from its buckets (first and last time) in order: bounds of where its second, third, ... session begins."""

    def close(key: tuple, low: list[int], high: list[int]) -> pd.DataFrame:
        ends = [*high, *[END] * (len(low) - len(high))]
        return pd.DataFrame([(*key, a, b) for a, b in zip(low[1:], ends[1:], strict=True)], columns=[*keys, "__lo", "__hi"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, low, high = None, [], []
        for key, part in _by_run(batches, keys):
            first, last = part["__a"].to_numpy(), part["__b"].to_numpy()
            if key != at:
                if at is not None:
                    yield close(at, low, high)
                at, low, high = key, [int(first[0])], [int(first[0])]
            for chain, inside in ((low, lambda x, i: x + 1), (high, lambda x, i: int(last[i]))):  # noqa: B023 - used at once
                while (i := int(np.searchsorted(last, chain[-1] + cap_us, side="right"))) < len(last):
                    x = chain[-1] + cap_us
                    chain.append(int(first[i]) if first[i] > x else inside(x, i))
        if at is not None:
            yield close(at, low, high)

    return run


def _walk(cap_us: int, keys: list[str]):
    """For each run, from its first point and the points within its windows in order: the starts of its sessions after the first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, starts = None, []
        close = lambda: pd.DataFrame([(*at, np.array(starts[1:], dtype=np.int64))], columns=[*keys, "__cuts"])
        for key, part in _by_run(batches, keys):
            t = part["__t"].to_numpy()
            if key != at:
                if at is not None:
                    yield close()
                at, starts = key, [int(t[0])]
            while (i := int(np.searchsorted(t, starts[-1] + cap_us, side="right"))) < len(t):
                starts.append(int(t[i]))
        if at is not None:
            yield close()

    return run


def cut_points(points: DataFrame, keys: list[str], cap_us: int, bucket_us: int = BUCKET_US) -> DataFrame:
    """(keys, __cuts): the starts of a run's sessions after its first, by the rule that a session ends before the first
    point more than cap after its start; points (keys, __t), read more than once.

    The next start depends on the last one, but never falls when that one rises. So bounds of it follow from bounds of
    the last start and the buckets alone; they grow by a bucket a session at most.
    """
    types = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    head = ", ".join(f"`{c}` {types[c]}" for c in keys)
    buckets = points.groupBy(*keys, F.floor(F.col("__t") / F.lit(bucket_us)).alias("__bucket")).agg(F.min("__t").alias("__a"), F.max("__t").alias("__b"))
    windows = buckets.repartition(*keys).sortWithinPartitions(*keys, "__a").mapInPandas(_windows(cap_us, keys), f"{head}, __lo bigint, __hi bigint")
    size, last = F.lit(SLICE_S * US), points.groupBy(*keys).agg(F.max("__t").alias("__last"), F.min("__t").alias("__t"))
    spread = windows.join(last.drop("__t"), keys).withColumn("__z", F.explode(F.sequence(F.floor(F.col("__lo") / size), F.floor(F.least("__hi", "__last") / size))))
    spread = spread.select(*[F.col(c).alias(f"__w{i}") for i, c in enumerate(keys)], "__z", "__lo", "__hi")
    same = [F.col(c) == F.col(f"__w{i}") for i, c in enumerate(keys)]
    on = reduce(lambda a, b: a & b, same) & (F.floor(F.col("__t") / size) == F.col("__z")) & F.col("__t").between(F.col("__lo"), F.col("__hi"))
    near = points.join(spread, on, "left_semi").select(*keys, "__t").unionByName(last.select(*keys, "__t")).distinct()
    return near.repartition(*keys).sortWithinPartitions(*keys, "__t").mapInPandas(_walk(cap_us, keys), f"{head}, __cuts array<bigint>")


def part_of_run(points: DataFrame, keys: list[str], cap_us: int) -> DataFrame:
    """points with __part: the number of the session within its run; points are read more than once."""
    cuts = cut_points(points.select(*keys, "__t"), keys, cap_us)  # one row a run, with a time a cap
    return points.join(cuts, keys).withColumn("__part", F.size(F.filter("__cuts", lambda c: c <= F.col("__t")))).drop("__cuts")


def sweep_sessions(df: DataFrame, group: list[str], time_us: str, duration_us: str, order: str, gap_s: float, cap_s: float, ignore: tuple[str, ...] = (), slice_s: int = SLICE_S, distinct: bool = True) -> DataFrame:
    """(group..., start_us, end_us, n_rows): one row per session; columns in `ignore` don't make a row different, without `distinct` each row counts."""
    gap_us, cap_us = int(gap_s * US), int(cap_s * US)
    g = [f"__g{i}" for i in range(len(group))]
    frags = stored(_swept(_points(df, group, time_us, duration_us, order, [order, *ignore], slice_s * US, distinct), g, gap_us))  # read by both paths below
    parts = frags.groupBy(*g, "__slice", "__frag").agg(F.min("__t").alias("__a"), F.max("__t").alias("__b"), F.sum("__n").alias("__n"), F.max_by("__end", "__t").alias("__end"))
    along = Window.partitionBy(*g).orderBy("__a")
    opens = F.coalesce((F.col("__a") - F.lag("__end").over(along) > gap_us).cast("int"), F.lit(1))
    runs = parts.withColumn("__new", opens).withColumn("__run", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = Window.partitionBy(*g, "__run")
    runs = runs.withColumn("__long", F.max("__b").over(whole) - F.min("__a").over(whole) > cap_us)
    short = runs.where(~F.col("__long")).groupBy(*g, "__run").agg(F.min("__a").alias("start_us"), F.max("__b").alias("end_us"), F.sum("__n").alias("n_rows")).drop("__run")
    far = stored(frags.join(runs.where("__long").select(*g, "__slice", "__frag", "__run"), [*g, "__slice", "__frag"]).select(*g, "__run", "__t", "__n"))
    cut = part_of_run(far, [*g, "__run"], cap_us).groupBy(*g, "__run", "__part").agg(F.min("__t").alias("start_us"), F.max("__t").alias("end_us"), F.sum("__n").alias("n_rows")).drop("__run", "__part")
    return short.unionByName(cut).select(*[F.col(a).alias(b) for a, b in zip(g, group, strict=True)], "start_us", "end_us", "n_rows")
