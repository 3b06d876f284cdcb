"""Queries over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.llm import abuse, bpe, labels, mixing, mojibake, sequences, splits
from flowloom.runtime import shared_dir
from flowloom.sources.tables import table


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_column(table(spark, folder, "documents"), "doc_id", "text")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    flows = table(spark, folder, "tagged_flows")
    found = sequences.frequent_patterns(flows, "capture_id", "session_id", "timestamp", "token", "record_id", share=0.1, least=8, shortest=3, longest=5)
    return found.withColumn("capture_id", F.col("capture_id").cast("bigint"))


def _components(spark: SparkSession, folder: str, parts: list[DataFrame] | None = None) -> splits.ComponentStore:
    """The components of sessions and session keys, in a store of this run; given batch by batch where there are parts."""
    store = splits.ComponentStore(spark, f"{shared_dir(spark)}/flowloom/{spark.sparkContext.applicationId}/components-{uuid.uuid4().hex}", ["session_id", "session_key"])
    for part in parts or [table(spark, folder, "tagged_flows")]:
        store.update(part, "day")
    return store


def _in_two(spark: SparkSession, folder: str) -> list[DataFrame]:
    """The first days' records, then the later ones and those without a day."""
    flows = table(spark, folder, "tagged_flows")
    early = F.coalesce("day_order", F.lit(5)) <= 3
    return [flows.where(early), flows.where(~early)]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _components(spark, folder).torn().select(F.col("entity").alias("session_id"))


def p6_splits(spark: SparkSession, folder: str) -> DataFrame:
    return _components(spark, folder).assign(table(spark, folder, "tagged_flows")).select("record_id", "session_id", "split")


def p6_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Records and components of each split after two batches."""
    both = _components(spark, folder, _in_two(spark, folder)).table()
    return both.groupBy("split").agg(F.sum("n_records").alias("n_records"), F.countDistinct("component").alias("n_components"))


def p6_components(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, component): the least session of each session's component after two batches, joined in conflicts or not."""
    store = _components(spark, folder, _in_two(spark, folder))
    tops = store.conflicts().select("component", F.col("root").alias("top"))
    own = store.table().select("entity", "component")
    marked = own.join(tops, "component", "left").withColumn("top", F.coalesce("top", F.regexp_replace("component", f"^{splits.QUARANTINE}:[0-9]+:", "")))
    sessions = marked.where(F.col("entity").startswith("0:")).select(F.expr("substring(entity, 3)").alias("session_id"), "top")
    least = sessions.groupBy("top").agg(F.min("session_id").alias("component"))
    return sessions.join(least, "top").select("session_id", "component")


def p6_kept_apart(spark: SparkSession, folder: str) -> DataFrame:
    """One row: sessions in two splits, keys in two splits, and whether each share is within two points of its target (all as promised: 0, 0, true)."""
    store = _components(spark, folder)
    rows = store.assign(table(spark, folder, "tagged_flows")).where(F.col("split") != splits.QUARANTINE)
    two = lambda c: rows.where(F.col(c).isNotNull()).groupBy(sequences.same_id(c)).agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias(f"torn_{c}"))
    total = rows.count()
    near = rows.groupBy("split").agg((F.count("*") / F.lit(max(total, 1))).alias("share")).agg(F.bool_and(F.abs(F.col("share") - F.element_at(F.create_map(*[F.lit(x) for kv in splits.SHARES for x in kv]), F.col("split"))) <= 0.02).alias("shares_met"))
    return two("session_id").join(F.broadcast(two("session_key"))).join(F.broadcast(near))  # one row each


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "mix_targets")
    return mixing.report(*mixing.mix(table(spark, folder, "documents"), targets), targets)


def p9_checks(spark: SparkSession, folder: str) -> DataFrame:
    """One row of what the mix promises: no token and no page beyond max_repeats, no more tokens than those allow, shares within a point where the source has enough."""
    r = p9_report(spark, folder)
    enough = F.col("n_tokens") * F.col("max_repeats") >= 1.1 * F.col("target_share") * F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))  # one row a source
    at_least = F.col("actual_share") >= F.col("target_share") - 0.01
    rows = r.withColumn("ok", ~enough | at_least)
    return rows.agg(F.bool_and(F.col("most_uses") <= F.col("max_repeats")).alias("tokens_within"), F.bool_and(F.col("most_page_uses") <= F.col("max_repeats")).alias("pages_within"), F.bool_and(F.col("out_tokens") <= F.col("n_tokens") * F.col("max_repeats")).alias("sizes_within"), F.bool_and("ok").alias("shares_met"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return labels.map_values(table(spark, folder, "flow_records"), "record_id", "label", table(spark, folder, "class_list"), "class_id", "class_name")


def p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Values that fit no class, with their number of records."""
    flows = table(spark, folder, "flow_records").select("record_id", "label")
    return p1_found(spark, folder).where(F.col("class_id") == labels.UNMATCHED).join(flows, "record_id").groupBy("label").agg(F.count("*").alias("n_records"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.find_garbled(table(spark, folder, "flow_records"), "record_id", "label", "source_file").select("record_id", "restored")


def p2_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Records by source and encoding chain."""
    flows = table(spark, folder, "flow_records")
    found = mojibake.find_garbled(flows, "record_id", "label", "source_file")
    return found.join(flows.select("record_id", "source_file"), "record_id").groupBy("source_file", "chain").agg(F.count("*").alias("n_records"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return abuse.score_documents(docs, abuse.fit_chain(docs, table(spark, folder, "review_labels")), ("doc_id", "source"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).where("flagged").select("doc_id")


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.rates(_scored(spark, folder))


QUERIES = {"p1_found": p1_found, "p1_unmatched": p1_unmatched, "p2_found": p2_found, "p2_chains": p2_chains, "p4_found": p4_found, "p6_found": p6_found, "p6_splits": p6_splits, "p6_shares": p6_shares, "p6_components": p6_components, "p6_kept_apart": p6_kept_apart, "p9_mix": p9_mix, "p9_report": p9_report, "p9_checks": p9_checks, "p10_found": p10_found, "p10_rates": p10_rates, "p8_ids": p8_ids}
