"""Ordered patterns with any gaps that occur in many sequences of a group, with their support.

1. Single steps are counted in SQL. A step that is frequent in no group can be part of no frequent pattern and is left
   out from then on; the others get a number, whatever their count.
2. Rows are folded into one text per (group, sequence): within slices of time, so that no task gets a whole long
   sequence, and in each slice every step is dropped that no pattern of up to `longest` steps can need (a step at
   depth x from the left and y from the right is needless if x + y > longest + 1); what remains of a slice is bounded
   by its different steps, whatever its rows. Slices are joined in order and reduced again.
3. Levels 2 to `longest`: frequent patterns of one step less that overlap are joined to candidates per group, those
   with an infrequent part are pruned, and each sequence is walked once down its group's hash tree by its next
   occurrences. Up to TREE_PATTERNS candidates (counted first) the trees of all groups are broadcast; beyond that a
   group's tree goes only where texts of the group are, in pieces of TEXTS texts, so a group of any size is many
   tasks. Both give the same counts, combined before the shuffle.

Defined results: rows with null step are no step, but their sequence counts; null group or sequence rows are left
out; steps at one time are in the order of `order`; rows equal in all but `order` count once; sequence ids are
compared without letter case and surrounding white space; an empty table gives no pattern.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.runtime import if_small, micros, row_hash, stored

SLICE_ROWS_S = 3600
TREE_PATTERNS, TEXTS = 200_000, 20_000
# Numbers of steps as characters: the code points of Unicode without the surrogates.
SURROGATES = (0xD800, 0xE000)


def symbol(i: int) -> str:
    return chr(i + 0x61 if i + 0x61 < SURROGATES[0] else i + 0x61 + SURROGATES[1] - SURROGATES[0])


def number(c: str) -> int:
    return ord(c) - 0x61 - (SURROGATES[1] - SURROGATES[0] if ord(c) >= SURROGATES[1] else 0)


def reduce_steps(steps: str, longest: int) -> str:
    """A subsequence with the same subsequences of up to `longest` steps (each step is one character)."""
    depth, at = [], {c: 1 for c in set(steps)}
    for c in steps:
        x = at[c]
        depth.append(x)
        at = {d: x + 1 if d == c else min(v, x + 1) for d, v in at.items()}
    kept = []
    at = dict.fromkeys(at, 1)
    for c, x in zip(reversed(steps), reversed(depth), strict=True):
        y = at[c]
        if x + y > longest + 1:
            continue
        kept.append(c)
        at = {d: y + 1 if d == c else min(v, y + 1) for d, v in at.items()}
    return "".join(reversed(kept))


def _reduce_rows(keys: list[str], longest: int):
    """Streams rows sorted by key and time; one reduced text per key, the buffer reduced whenever it grows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, buffer, first = None, [], None
        for pdf in batches:
            out = []
            for *k, t, c in pdf.itertuples(index=False, name=None):
                if k != at:
                    if at is not None:
                        out.append((*at, first, reduce_steps("".join(buffer), longest)))
                    at, buffer, first = k, [], t
                buffer.append(symbol(c))
                if len(buffer) >= 4096:
                    buffer = list(reduce_steps("".join(buffer), longest))
            yield pd.DataFrame(out, columns=[*keys, "t", "steps"])
        if at is not None:
            yield pd.DataFrame([(*at, first, reduce_steps("".join(buffer), longest))], columns=[*keys, "t", "steps"])

    return run


def same_id(c: str) -> Column:
    """An id without regard to letter case and surrounding white space."""
    return F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))


def _once(df: DataFrame, group: str, sequence: str, time: str, step: str, order: str) -> DataFrame:
    """(g, s, z, t, step, o): rows that differ in more than `order`, spread over slices of time."""
    other = [c for c in df.columns if c not in (order, group, sequence, time, step)]
    rows = df.where(F.col(group).isNotNull() & F.col(sequence).isNotNull()).select(
        F.col(group).alias("g"), same_id(sequence).alias("s"), micros(time).alias("t"), F.col(step).cast("string").alias("step"), F.col(order).alias("o"), *[h.alias(f"h{i}") for i, h in enumerate(row_hash(other))]
    )
    slice_no = F.coalesce(F.floor(F.col("t") / F.lit(SLICE_ROWS_S * 1_000_000)), F.lit(-1))
    return rows.withColumn("z", slice_no).repartition("g", "s", "z").groupBy("g", "s", "z", "t", "step", "h0", "h1").agg(F.min("o").alias("o"))


def step_texts(once: DataFrame, numbers: DataFrame, longest: int) -> DataFrame:
    """(g, s, steps): one reduced text for each sequence, one character a step; numbers (step, i)."""
    # a slice is a sequence's own key part: texts of different slices must not run together
    known = once.where("step IS NOT NULL AND t IS NOT NULL").join(if_small(numbers.withColumnRenamed("step", "__step")), F.col("step") == F.col("__step"))
    parts = known.select("g", "s", "z", "t", "o", "i").repartition("g", "s", "z").sortWithinPartitions("g", "s", "z", "t", "o").select("g", "s", "z", "t", "i")
    reduced = parts.mapInPandas(_reduce_rows(["g", "s", "z"], longest), f"g {once.schema['g'].dataType.simpleString()}, s string, z bigint, t bigint, steps string")
    return reduced.groupBy("g", "s").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", "steps"))), lambda x: x["steps"]), "").alias("steps"))


class Tree:
    """Candidates of one length in nested dictionaries, hashed by step."""

    def __init__(self, patterns: list[str]):
        self.root: dict = {}
        for p in patterns:
            node = self.root
            for c in p:
                node = node.setdefault(c, {})

    def found(self, steps: str) -> list[str]:
        out, walk = [], [("", -1, self.root)]
        while walk:
            seen, at, node = walk.pop()
            for c, below in node.items():
                if (i := steps.find(c, at + 1)) >= 0:
                    if below:
                        walk.append((seen + c, i, below))
                    else:
                        out.append(seen + c)
        return out


def candidates(frequent: list[str]) -> list[str]:
    """Joins of patterns that overlap in all but the ends, without those that have an infrequent part."""
    known, by_head = set(frequent), {}
    for p in frequent:
        by_head.setdefault(p[:-1], []).append(p)
    joined = (p + q[-1] for p in frequent for q in by_head.get(p[1:], ()))
    return sorted(c for c in joined if all(c[:i] + c[i + 1 :] in known for i in range(len(c))))


def _counted(trees_of) -> object:
    """Counts of found patterns by group and pattern, over batches of (g, steps)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, seen = trees_of(), {}
        flush = lambda: pd.DataFrame([(g, p, n) for (g, p), n in seen.items()], columns=["g", "p", "n_here"])
        for pdf in batches:
            for g, text in zip(pdf["g"], pdf["steps"], strict=True):
                for p in trees[g].found(text) if g in trees else ():
                    seen[g, p] = seen.get((g, p), 0) + 1
            if len(seen) > 200_000:
                yield flush()
                seen.clear()
        yield flush()

    return run


def _count_level(spark: SparkSession, texts: DataFrame, level: DataFrame, tree_patterns: int) -> DataFrame:
    """(g, p, n_here): how many texts of a group hold each of its candidates; level (g, p)."""
    schema = f"g {texts.schema['g'].dataType.simpleString()}, p string, n_here bigint"
    few = level.limit(tree_patterns + 1).count() <= tree_patterns
    if few:
        by: dict[object, list[str]] = {}
        for g, p in level.collect():  # tree_patterns rows at most
            by.setdefault(g, []).append(p)
        trees = spark.sparkContext.broadcast({g: Tree(ps) for g, ps in by.items()})
        return texts.select("g", "steps").mapInPandas(_counted(lambda: trees.value), schema)
    sizes = texts.groupBy("g").agg(F.ceil(F.count("*") / F.lit(TEXTS)).cast("int").alias("pieces"))
    mine = texts.join(sizes, "g").select("g", "steps", F.pmod(F.xxhash64("s"), F.col("pieces")).cast("int").alias("piece"))
    spread = level.join(sizes, "g").select("g", "p", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))

    def of_group(some: pd.DataFrame, patterns: pd.DataFrame) -> pd.DataFrame:
        trees = {patterns["g"].iloc[0]: Tree(patterns["p"].tolist())} if len(patterns) else {}
        return pd.concat(list(_counted(lambda: trees)(iter([some[["g", "steps"]]]))))

    return mine.groupBy("g", "piece").cogroup(spread.groupBy("g", "piece")).applyInPandas(of_group, schema)


def frequent_patterns(df: DataFrame, group: str, sequence: str, time: str, step: str, order: str, share: float, least: int, shortest: int, longest: int, tree_patterns: int = TREE_PATTERNS) -> DataFrame:
    """(group, pattern, support): patterns of shortest..longest steps joined by `>`."""
    spark = df.sparkSession
    once = stored(_once(df, group, sequence, time, step, order))
    sizes = stored(once.select("g", "s").distinct().groupBy("g").agg(F.count("*").alias("n")))
    enough = (F.col("support") >= least) & (F.col("support") >= F.col("n") * share)
    singles = once.where("step IS NOT NULL AND t IS NOT NULL").select("g", "s", "step").distinct().groupBy("g", "step").agg(F.count("*").alias("support"))
    singles = stored(singles.join(sizes, "g").where(enough).select("g", "step", "support"))
    steps = singles.select("step").distinct()
    ranked = steps.withColumn("b", F.pmod(F.xxhash64("step"), F.lit(1024)))
    before = ranked.groupBy("b").agg(F.count("*").alias("c")).select("b", F.coalesce(F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbers = stored(ranked.join(F.broadcast(before), "b").select("step", (F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("step")) - 1).alias("i")))  # 1,024 rows at most
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work: not to be put together
    texts = stored(step_texts(once, numbers, longest).repartition(tasks, "s"))
    g_type = once.schema["g"].dataType.simpleString()
    letter = F.udf(symbol)
    kept = singles.join(if_small(numbers), "step").select("g", letter("i").alias("p"), "support")  # one row a group and step
    found = None
    for k in range(1, longest + 1):
        if k > 1:
            joined = kept.select("g", "p").groupBy("g").applyInPandas(lambda pdf: pd.DataFrame({"g": pdf["g"].iloc[0], "p": candidates(pdf["p"].tolist())}), f"g {g_type}, p string")
            counts = _count_level(spark, texts, stored(joined), tree_patterns).groupBy("g", "p").agg(F.sum("n_here").alias("support"))
            kept = stored(counts.join(sizes, "g").where(enough).select("g", "p", "support"))
        if k >= shortest:
            found = kept if found is None else found.unionByName(kept)
    if found is None:
        found = spark.createDataFrame([], f"g {g_type}, p string, support bigint")
    places = F.udf(lambda p: [number(c) for c in p], "array<bigint>")
    at = found.select("g", "p", "support", F.posexplode(places("p")).alias("k", "i")).join(if_small(numbers), "i")
    words = at.groupBy("g", "p", "support").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "step"))), lambda x: x["step"]), ">").alias("pattern"))
    return words.select(F.col("g").alias(group), "pattern", "support")
