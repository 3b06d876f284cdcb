"""Frequent itemsets and gap-limited sequential patterns of sessions, and how well a session matches them."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth, PrefixSpan
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.config import SETTINGS


def itemsets(tokens: DataFrame, min_support: float = SETTINGS.itemset_support) -> DataFrame:
    """(items, freq, support): tokens (session, items array of distinct tokens)."""
    n = tokens.count()
    model = FPGrowth(itemsCol="items", minSupport=min_support).fit(tokens)
    return model.freqItemsets.select(F.sort_array("items").alias("items"), "freq", (F.col("freq") / F.lit(max(n, 1))).alias("support"))


def fp_match(steps: DataFrame, min_support: float = SETTINGS.itemset_support) -> DataFrame:
    """(session, fp_score): support falls with size, so the best itemset within a session is its best frequent token."""
    once = steps.select("session", "token").distinct()
    n = steps.agg(F.countDistinct("session").alias("n"))
    support = once.groupBy("token").agg(F.count("*").alias("f")).join(F.broadcast(n)).select("token", (F.col("f") / F.col("n")).alias("support"))  # one row, and one a token
    return once.join(F.broadcast(support), "token").groupBy("session").agg(F.max(F.when(F.col("support") >= min_support, F.col("support")).otherwise(0.0)).alias("fp_score"))


def item_scores(sessions: DataFrame, min_support: float = SETTINGS.itemset_support) -> DataFrame:
    """sessions (with items, the different tokens of each) and `fp_score`, the same as fp_match gives."""
    n = sessions.agg(F.count("*").alias("n"))
    support = sessions.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("f")).join(F.broadcast(n)).where(F.col("f") / F.col("n") >= min_support)  # one row, and one a token
    known = support.agg(F.map_from_entries(F.collect_list(F.struct("token", (F.col("f") / F.col("n")).alias("s")))).alias("__support"))
    best = F.array_max(F.transform("items", lambda t: F.coalesce(F.try_element_at("__support", t), F.lit(0.0))))
    return sessions.join(F.broadcast(known)).withColumn("fp_score", F.coalesce(best, F.lit(0.0))).drop("__support")  # one row


def gap_match(seq: Column, pattern: list[str] | Column, size: Column, max_gap_s: float) -> Column:
    """Greedy scan: a step that is the next one wanted within max_gap of the last matched one advances; a later one
    starts anew if it is the pattern's first step, else clears the state. seq: array of (us, token)."""
    want = pattern if isinstance(pattern, Column) else F.lit(pattern)
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("t"))

    def step(s: Column, x: Column) -> Column:
        hit = (s["i"] < size) & (x["token"] == F.get(want, s["i"]))
        late = (s["i"] > 0) & ((x["us"] - s["t"]) > F.lit(int(max_gap_s * 1e6)))
        again = x["token"] == F.get(want, F.lit(0))
        return (
            F.when(~hit, s)
            .when(~late, F.struct((s["i"] + 1).alias("i"), x["us"].alias("t")))
            .when(again, F.struct(F.lit(1).alias("i"), x["us"].alias("t")))
            .otherwise(start)
        )

    return F.aggregate(seq, start, step)["i"] >= size


def sequence_patterns(seqs: DataFrame, min_support: float = SETTINGS.sequence_support, max_gap_s: float = SETTINGS.max_gap_s, longest: int = SETTINGS.max_pattern_length, most: int = SETTINGS.max_patterns) -> DataFrame:
    """(pattern, freq, support): the `most` most frequent order-only patterns of 2..longest steps (ties by pattern)
    whose support with the gap limit still reaches min_support; seqs (session, seq)."""
    n = seqs.count()
    if n == 0:
        return seqs.sparkSession.createDataFrame([], "pattern array<string>, freq bigint, support double")
    items = seqs.select(F.transform("seq", lambda x: F.array(x["token"])).alias("sequence"))
    found = PrefixSpan(minSupport=min_support, maxPatternLength=longest).findFrequentSequentialPatterns(items)
    top = found.where(F.size("sequence") >= 2).select(F.transform("sequence", lambda x: x[0]).alias("pattern"), "freq").where(F.col("freq") >= max(1, math.ceil(min_support * n))).orderBy(F.desc("freq"), "pattern").limit(most)
    few = [r["pattern"] for r in top.select("pattern").collect()]  # `most` rows
    held = seqs.select(F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(few) - 1)), lambda i: _holds(F.col("seq"), few, i, max_gap_s))).alias("i")) if few else None
    if held is None:
        return top.select("pattern", "freq", F.lit(0.0).alias("support")).where("false")
    counted = held.groupBy("i").agg(F.count("*").alias("m")).select(F.get(F.lit(few), F.col("i")).alias("p"), "m")
    return top.join(F.broadcast(counted), F.col("pattern") == F.col("p")).select("pattern", "freq", (F.col("m") / F.lit(n)).alias("support")).where(F.col("support") >= min_support)  # `most` rows


def _holds(seq: Column, patterns: list[list[str]], i: Column, max_gap_s: float) -> Column:
    pattern = F.get(F.lit(patterns), i)
    return gap_match(seq, pattern, F.size(pattern), max_gap_s)


def sequence_match(seqs: DataFrame, patterns: DataFrame, max_gap_s: float = SETTINGS.max_gap_s) -> DataFrame:
    """(session, seq_score): the greatest support of a pattern the session holds, 0 without one; patterns are few (<= 200)."""
    rows = patterns.select("pattern", "support").orderBy(F.desc("support"), "pattern").collect()  # the patterns kept, a top-k
    if not rows:
        return seqs.select("session", F.lit(0.0).alias("seq_score"))
    few, support = [r["pattern"] for r in rows], [r["support"] for r in rows]
    hits = F.transform(F.sequence(F.lit(0), F.lit(len(few) - 1)), lambda i: F.when(_holds(F.col("seq"), few, i, max_gap_s), F.get(F.lit(support), i)).otherwise(0.0))
    return seqs.select("session", F.array_max(hits).alias("seq_score"))


def sp_t(fp: DataFrame, seq: DataFrame) -> DataFrame:
    """(session, sp_t): half the itemset score plus half the sequence score, within 0..1."""
    both = fp.join(seq, "session", "full")
    return both.select("session", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 * F.coalesce("fp_score", F.lit(0.0)) + 0.5 * F.coalesce("seq_score", F.lit(0.0)))).alias("sp_t"))
