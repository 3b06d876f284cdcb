"""The transition graph of tokens: closed-form moving averages, edge weights and what sessions get from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.config import SETTINGS, TOKENS
from flowloom.operators.tokens import transitions

UNIT = 4096  # transitions of a session that are ranked together


def graph_edges(steps: DataFrame, rho: float = SETTINGS.rho, pairs: DataFrame | None = None, begins: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight), at most 100 rows: the sum of (1 - rho) * rho^(k-1) over the k-th last transitions from src.

    Build order is sessions by first time, then session, then position. Transitions are ranked within units of UNIT
    positions of a session, units by running counts within an hour of session starts, hours by running counts of all
    earlier ones: every transition counts at its exact rank, and no task sorts all those of a source or a session.
    `pairs`: the transitions of the steps, `begins`: (session, begin), if they are at hand.
    """
    begin = steps.groupBy("session").agg(F.min("us").alias("begin")) if begins is None else begins
    placed = (transitions(steps) if pairs is None else pairs).join(begin, "session").withColumn("unit", F.floor(F.col("pos") / UNIT)).withColumn("hour", F.floor(F.col("begin") / F.lit(3_600_000_000)))
    unit = ["src", "hour", "begin", "session", "unit"]
    k = F.row_number().over(Window.partitionBy(*unit).orderBy(F.desc("pos"))) - 1
    faded = placed.withColumn("k", k).groupBy(*unit, "dst").agg(F.sum(F.pow(F.lit(rho), F.col("k"))).alias("s"), F.count("*").alias("n"))
    units = faded.groupBy(*unit).agg(F.sum("n").alias("n"))
    hours = units.groupBy("src", "hour").agg(F.sum("n").alias("n"))
    until = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after_hours = hours.select("src", "hour", until(Window.partitionBy("src").orderBy(F.desc("hour"))).alias("after_hour"))
    after_units = units.select(*unit, until(Window.partitionBy("src", "hour").orderBy(F.desc("begin"), F.desc("session"), F.desc("unit"))).alias("after_unit"))
    ranked = faded.join(after_units, unit).join(after_hours, ["src", "hour"])
    return ranked.groupBy("src", "dst").agg(F.sum(F.lit(1 - rho) * F.pow(F.lit(rho), F.col("after_hour") + F.col("after_unit")) * F.col("s")).alias("weight"))


def update_edges(edges: DataFrame, new: DataFrame, rho: float = SETTINGS.rho) -> DataFrame:
    """The graph after the transitions of later sessions (steps `new`): old weights fade by rho^m, m the source's new transitions."""
    fresh = graph_edges(new, rho)
    m = transitions(new).groupBy("src").agg(F.count("*").alias("m"))
    old = edges.join(F.broadcast(m), "src", "left").select("src", "dst", (F.col("weight") * F.pow(F.lit(rho), F.coalesce("m", F.lit(0)))).alias("weight"))  # one row a token
    return old.unionByName(fresh).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def edge_weight(pairs: DataFrame, edges: DataFrame, novel: float = SETTINGS.novel_weight) -> DataFrame:
    """pairs with `weight`: the edge's, 0 for an unseen target of a seen source, `novel` for an unseen source."""
    seen = edges.groupBy(F.col("src").alias("__src")).agg(F.map_from_entries(F.collect_list(F.struct("dst", "weight"))).alias("__to"))
    return pairs.join(F.broadcast(seen), F.col("src") == F.col("__src"), "left").withColumn("weight", F.when(F.col("__to").isNull(), F.lit(novel)).otherwise(F.coalesce(F.try_element_at("__to", F.col("dst")), F.lit(0.0)))).drop("__src", "__to")  # one row a token


def session_scores(steps: DataFrame, edges: DataFrame, lambdas: tuple[float, ...] = SETTINGS.lambdas, single: float = SETTINGS.single_event_score, pairs: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(session, n, g_w, mean_gap_s, tc_0.. one for each lambda): one pass; sessions of one step get `single`."""
    weighted = edge_weight(transitions(steps) if pairs is None else pairs, edges)
    decay = [F.avg(F.col("weight") * F.exp(F.lit(-x) * F.greatest("dt_s", F.lit(0.0)))).alias(f"__tc{i}") for i, x in enumerate(lambdas)]
    scores = weighted.groupBy("session").agg(F.avg("weight").alias("__g"), F.avg("dt_s").alias("__gap"), *decay)
    sizes = steps.groupBy("session").agg(F.count("*").alias("n")) if sizes is None else sizes
    return sizes.join(scores, "session", "left").select("session", "n", F.coalesce("__g", F.lit(single)).alias("g_w"), F.coalesce("__gap", F.lit(0.0)).alias("mean_gap_s"), *[F.coalesce(f"__tc{i}", F.lit(single)).alias(f"tc_{i}") for i in range(len(lambdas))])


def paths(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(session, path): `src -> dst(w=0.12)` joined by `; ` in order."""
    weighted = edge_weight(transitions(steps), edges)
    text = F.format_string("%s -> %s(w=%.2f)", "src", "dst", "weight")
    return weighted.groupBy("session").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", text.alias("t")))), lambda x: x["t"]), "; ").alias("path"))


def aucs(df: DataFrame, scores: dict[str, str], positive: Column) -> DataFrame:
    """(name, auc, n_pos, n_neg), one row for each of `scores` (name: column): rank-sum area with average ranks, null if one class.

    Counted by distinct score; the running count of negatives is a two-level sum over 256 ranges of the scores. All
    scores go through one shuffle.
    """
    rows = df.select(positive.alias("y"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("s")) for n, c in scores.items()])).alias("x"))
    by = rows.groupBy("x.name", "x.s").agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("q")).withColumn("z", F.floor(F.col("s") * 256))
    ranges = by.groupBy("name", "z").agg(F.sum("q").alias("zq"))
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = ranges.select("name", "z", earlier("zq", Window.partitionBy("name").orderBy("z")).alias("before"))
    inside = by.withColumn("inside", earlier("q", Window.partitionBy("name", "z").orderBy("s")))
    wins = inside.join(before, ["name", "z"]).groupBy("name").agg(F.sum(F.col("p") * (F.col("before") + F.col("inside") + F.col("q") / 2)).alias("w"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    return wins.select("name", F.try_divide(F.col("w"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"), "n_pos", "n_neg")


def select_lambda(scored: DataFrame, positive: Column, lambdas: tuple[float, ...] = SETTINGS.lambdas) -> float:
    """The lambda whose tc column separates best, the first on ties; the middle one if only one class occurs."""
    found = {r["name"]: r["auc"] for r in aucs(scored, {str(i): f"tc_{i}" for i in range(len(lambdas))}, positive).collect()}  # one row a lambda
    best = max((i for i in range(len(lambdas)) if found.get(str(i)) is not None), key=lambda i: (found[str(i)], -i), default=None)
    return lambdas[len(lambdas) // 2 if best is None else best]


def full_graph(spark, edges: DataFrame) -> DataFrame:
    """Seen sources times all tokens, as the matrix view has them."""
    seen = edges.select("src").distinct()
    grid = seen.withColumn("dst", F.explode(F.lit(list(TOKENS))))
    return grid.join(edges, ["src", "dst"], "left").select("src", "dst", F.coalesce("weight", F.lit(0.0)).alias("weight"))
