"""Sources combined to target shares of all tokens.

1. Pages are counted in tokens and laid end to end per source in a pseudo-random order; a two-level running sum
   (buckets, then pages of a bucket) gives each page its stretch, so a source with a third of all pages is spread.
   Every `block` tokens of a stretch are one block (the last of a source may be shorter).
2. Each output shard draws how many of its slots each source gets from a multinomial with a generator of its own
   seed. Running totals number the slots of a source; numbers beyond the source's quota (its share of all slots, but
   no more than its blocks times max_repeats) go to sources that drew less than theirs.
3. Number q of a source is block permutation[q div blocks](q mod blocks), a keyed Feistel permutation for each
   round through the source: no token is used more than max_repeats times, and none again before all others once.
4. Slots join blocks by (source, block number), which spreads any source over all tasks.

The only rows on the driver are one for each source of the targets, a list written by hand that doesn't grow with the pages.
Defined results: pages with null, empty or unlisted source or without tokens give nothing; a listed source without
pages gets no slot; slots that no source may fill stay out and the report shows the shortfall; repeated pages are
pages of their own; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.bpe import count_tokens, encode_column
from flowloom.runtime import if_small, stored

BUCKETS, STRETCH, AT_ONCE = 1024, 1024, 1024
MIX = "shard bigint, slot bigint, source string, block bigint, round int"


@dataclass(frozen=True)
class Plan:
    """What each source may give, in slots."""

    names: list[str]
    shares: np.ndarray
    blocks: np.ndarray
    quota: np.ndarray
    slots: int
    per_shard: int
    seed: int


def permuted(j: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudo-random permutation of 0..n-1 at j: a 6-round Feistel network, walked until it is inside."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out, todo = j.astype(np.uint64), np.ones(len(j), dtype=bool)
    keys = np.random.SeedSequence([key & 0xFFFFFFFF, key >> 32, n & 0xFFFFFFFF]).generate_state(6, np.uint64)
    while todo.any():
        x = out[todo]
        a, b = x >> np.uint64(half), x & mask
        for k in keys:
            m = (b ^ k) * np.uint64(0x9E3779B97F4A7C15)
            m = (m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((m >> np.uint64(32)) & mask)
        out[todo] = (a << np.uint64(half)) | b
        todo &= out >= np.uint64(n)
    return out.astype(np.int64)


def block_pieces(pages: DataFrame, block: int) -> DataFrame:
    """(source, block, doc_id, tok_from, tok_to): the stretches of pages that make each block; pages (doc_id, source, n_tokens)."""
    order = F.xxhash64("doc_id")
    rows = pages.where("n_tokens > 0").withColumn("__o", order).withColumn("__b", F.pmod(F.shiftrightunsigned("__o", 40), F.lit(BUCKETS)))
    totals = rows.groupBy("source", "__b").agg(F.sum("n_tokens").alias("__s"))
    before = totals.select("source", "__b", F.coalesce(F.sum("__s").over(Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("source", "__b").orderBy("__o", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = rows.withColumn("__in", inside).join(if_small(before), ["source", "__b"]).withColumn("__a", F.col("__before") + F.col("__in"))
    size = F.lit(block)
    cut = at.withColumn("block", F.explode(F.sequence(F.floor(F.col("__a") / size), F.floor((F.col("__a") + F.col("n_tokens") - 1) / size))))
    return cut.select("source", "block", "doc_id", F.greatest(F.col("block") * size - F.col("__a"), F.lit(0)).alias("tok_from"), F.least((F.col("block") + 1) * size - F.col("__a"), F.col("n_tokens")).alias("tok_to"))


def make_plan(totals: DataFrame, targets: DataFrame, block: int, per_shard: int, total_tokens: int | None, seed: int) -> Plan:
    rows = targets.where("source IS NOT NULL").join(totals, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens")).orderBy("source").collect()  # the targets
    shares = np.array([r["target_share"] or 0.0 for r in rows])
    shares = shares / (shares.sum() or 1.0)
    tokens = np.array([r["tokens"] for r in rows], dtype=np.int64)
    blocks = -(-tokens // block)
    slots = int((total_tokens if total_tokens is not None else tokens.sum()) // block)
    quota = np.minimum(np.rint(shares * slots).astype(np.int64), blocks * np.array([r["max_repeats"] or 0 for r in rows], dtype=np.int64))
    return Plan([r["source"] for r in rows], shares, blocks, quota, slots, per_shard, seed)


def draw_slots(spark, plan: Plan) -> DataFrame:
    """One row for each filled slot (see MIX)."""
    shards = -(-plan.slots // plan.per_shard)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for shard in pdf["id"]:
                size = min(plan.per_shard, plan.slots - shard * plan.per_shard)
                n = np.random.default_rng([plan.seed, shard]).multinomial(size, plan.shares)
                out.append(pd.DataFrame({"shard": shard, "s": np.arange(len(n)), "n": n, "first_slot": np.cumsum(n) - n}))
            yield pd.concat(out) if out else pd.DataFrame({"shard": [], "s": [], "n": [], "first_slot": []}).astype("int64")

    drawn = spark.range(shards).mapInPandas(draw, "shard bigint, s int, n bigint, first_slot bigint").where("n > 0")
    total = np.zeros(len(plan.names), dtype=np.int64)
    for r in drawn.groupBy("s").agg(F.sum("n").alias("n")).collect():
        total[r["s"]] = r["n"]
    # shards are numbered within stretches, and stretches by their totals, so that no task has all shards of a source
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = drawn.withColumn("stretch", F.floor(F.col("shard") / F.lit(STRETCH)))
    before = placed.groupBy("s", "stretch").agg(F.sum("n").alias("n")).select("s", "stretch", earlier("n", Window.partitionBy("s").orderBy("stretch")).alias("before"))
    inside = placed.withColumn("inside", earlier("n", Window.partitionBy("s", "stretch").orderBy("shard")))
    numbered = inside.join(if_small(before), ["s", "stretch"]).select("shard", "s", "n", "first_slot", (F.col("before") + F.col("inside")).alias("first"))
    spare_at = np.cumsum(np.maximum(total - plan.quota, 0)) - np.maximum(total - plan.quota, 0)
    lack = np.maximum(plan.quota - total, 0)
    lack_end = np.cumsum(lack)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array(plan.names, dtype=object)
        for pdf in (pdf.iloc[i : i + AT_ONCE] for pdf in batches for i in range(0, len(pdf), AT_ONCE)):  # a row is per_shard slots at most
            n = pdf["n"].to_numpy()
            rep = lambda c: np.repeat(pdf[c].to_numpy(), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            s, q, shard, slot = rep("s").astype(np.int64), rep("first") + step, rep("shard"), rep("first_slot") + step
            over = q >= plan.quota[s]
            spare = np.where(over, spare_at[s] + q - plan.quota[s], 0)
            to = np.searchsorted(lack_end, spare, side="right")
            fits = ~over | (to < len(lack))
            to = np.minimum(to, len(lack) - 1)
            q = np.where(over, total[to] + spare - (lack_end[to] - lack[to]), q)
            s = np.where(over, to, s)
            s, q, shard, slot = s[fits], q[fits], shard[fits], slot[fits]
            turn = q // np.maximum(plan.blocks[s], 1)
            block = np.zeros(len(q), dtype=np.int64)
            pair = s * (int(turn.max(initial=0)) + 1) + turn
            order = np.argsort(pair, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1) if len(order) else ():
                i, t = int(s[at[0]]), int(turn[at[0]])
                block[at] = permuted(q[at] % plan.blocks[i], int(plan.blocks[i]), (plan.seed << 40) + (i << 16) + t)
            yield pd.DataFrame({"shard": shard, "slot": slot, "source": names[s], "block": block, "round": turn})

    return numbered.mapInPandas(place, MIX)


def mix(docs: DataFrame, targets: DataFrame, block: int = 512, per_shard: int = 1024, total_tokens: int | None = None, seed: int = 42, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix, pages): rows (shard, slot, source, block, round, doc_id, tok_from, tok_to), and tokens by page."""
    spark = docs.sparkSession
    listed = targets.where("source IS NOT NULL").dropDuplicates(["source"])
    names = listed.select(F.col("source").alias("__source"))
    wanted = docs.select("doc_id", "source", "text").join(if_small(names), F.col("source") == F.col("__source"), "left_semi")
    pages = stored(count_tokens(wanted, ["doc_id", "source"], "text", vocabulary))
    totals = pages.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    plan = make_plan(totals, listed, block, per_shard, total_tokens, seed)
    return draw_slots(spark, plan).join(block_pieces(pages, block), ["source", "block"]), pages


def packed(mixed: DataFrame, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(shard, slot, source, ids): the token ids of each filled slot, its pieces in the order of their block."""
    ids = encode_column(docs.join(mixed.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "text", *([vocabulary] if vocabulary else [])).select(F.col("doc_id").alias("__doc"), "ids")
    pieces = mixed.join(ids, F.col("doc_id") == F.col("__doc")).withColumn("part", F.expr("slice(ids, int(tok_from + 1), int(tok_to - tok_from))"))
    order = F.struct(F.xxhash64("doc_id").alias("o"), "doc_id", "part")
    slots = pieces.withColumn("__b", F.pmod(F.shiftrightunsigned(F.xxhash64("doc_id"), 40), F.lit(BUCKETS))).groupBy("shard", "slot", "source").agg(F.sort_array(F.collect_list(F.struct("__b", order.alias("x")))).alias("parts"))  # a block's pieces
    return slots.select("shard", "slot", "source", F.flatten(F.transform("parts", lambda p: p["x"]["part"])).alias("ids"))


def report(mixed: DataFrame, pages: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per listed source: target and actual share of all tokens, tokens in and out, most uses of a token and of a page.

    A page is used once for each round through its source that takes any of it, in however many slots its pieces lie.
    """
    rounds = mixed.groupBy("source", "doc_id").agg(F.countDistinct("round").alias("n"))
    page_uses = rounds.groupBy("source").agg(F.max("n").alias("most_page_uses"))
    uses = mixed.groupBy("source", "doc_id", "tok_from", "tok_to").agg(F.count("*").alias("n"))
    out = uses.groupBy("source").agg(F.sum(F.col("n") * (F.col("tok_to") - F.col("tok_from"))).alias("out_tokens"), F.max("n").alias("most_uses"))
    had = pages.groupBy("source").agg(F.count("*").alias("n_pages"), F.sum("n_tokens").alias("n_tokens"))
    rows = targets.where("source IS NOT NULL").dropDuplicates(["source"]).join(had, "source", "left").join(out, "source", "left").join(page_uses, "source", "left").na.fill(0, ["n_pages", "n_tokens", "out_tokens", "most_uses", "most_page_uses"])
    everything = F.sum("out_tokens").over(Window.partitionBy(F.lit(1)))  # over the sources of the targets
    return rows.select("source", "target_share", F.round(F.coalesce(F.try_divide("out_tokens", everything), F.lit(0.0)), 6).alias("actual_share"), "n_pages", "n_tokens", "out_tokens", "most_uses", "most_page_uses", "max_repeats")
