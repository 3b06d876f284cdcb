"""Train, validation and test splits in which records that share an entity stay together.

A `ComponentStore` is a table in a folder that all executors share. It grows batch by batch and is never rewritten:
each batch adds the entities it met (component, records, days) and the components that are new or merged (root, split);
a mark with what it gave to each split completes it.

1. The records of a batch link the values of their key columns. Values that were met before stand for the root of
   their component, so only components the batch touches are linked, whatever the size of the table.
2. Minimum labels: each node takes the least label among its neighbours, pointer jumping brings every node to the end
   of its chain, and the links are contracted to the roots (links within one component drop out) until none is left.
   Every round at least halves the nodes with links. Each step is a table in the shared folder.
3. A component that has a split keeps it, and a new value linked to it follows. New components are put in a
   pseudo-random order and laid out over the splits' deficits by a two-level running sum (buckets, then rows within a
   bucket), so each split is filled to within one component; a component with a third of all rows is one row here.
4. Records that would merge components of different splits can't keep both promises. The components stay as they are,
   each in its split; the values that are new in that merge go to `quarantine`, as do the records whose values lie in
   different splits, and the components are listed in `conflicts`.

Defined results: null keys link nothing; records without any key are left out and get no split; ids are compared
without letter case and surrounding white space; repeated rows count as records of their component; an empty batch
changes nothing; a batch given twice counts twice but moves nothing.
"""

from __future__ import annotations

import json
import urllib.parse

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.llm.sequences import same_id
from flowloom.runtime import if_small, stored, stored_with

QUARANTINE = "quarantine"
SHARES = (("train", 0.70), ("validation", 0.15), ("test", 0.15))
BUCKETS = 1024
# What a store holds: its tables and their columns; each batch is a folder of its own within a table.
TABLES = {
    "entities": "entity string, component string, n_records bigint, days array<string>, top string, split string, own_split string, met_before boolean",
    "components": "component string, root string, split string",
}


def _jumped(parent: DataFrame) -> DataFrame:
    """(v, p): every node brought to the end of its chain; parent (v, p), roots point to themselves."""
    moved = True
    while moved:
        two = parent.join(parent.select(F.col("v").alias("w"), F.col("p").alias("pp")), F.col("p") == F.col("w")).select("v", "pp")
        four = two.join(two.select(F.col("v").alias("w"), F.col("pp").alias("p")), F.col("pp") == F.col("w")).select("v", "p", (F.col("p") != F.col("pp")).alias("moved"))
        new, seen = stored_with(four, n=F.count_if("moved"))
        parent, moved = new.select("v", "p"), seen["n"]
    return parent


def connect(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest value of each value's component; edges (a, b) without direction."""
    several = lambda a, b: stored_with(edges_of(a, b).distinct(), n=F.count("*"))
    edges_of = lambda a, b: edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    links, seen = several("a", "b")
    label = None
    while label is None or seen["n"]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = _jumped(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("near")).select("v", F.least("v", "near").alias("p")))
        label = parent.withColumnRenamed("p", "root") if label is None else stored(label.join(parent.select(F.col("v").alias("w"), "p"), F.col("root") == F.col("w"), "left").select("v", F.coalesce("p", "root").alias("root")))
        ends = [parent.select(F.col("v").alias(f"v{c}"), F.col("p").alias(f"p{c}")) for c in "ab"]
        edges = links.join(ends[0], F.col("a") == F.col("va")).join(ends[1], F.col("b") == F.col("vb"))
        links, seen = several("pa", "pb")
    return label


def _laid_out(new: DataFrame, deficits: list[tuple[str, float]]) -> DataFrame:
    """Gives each new component (root, n) the split whose stretch of the running total its middle lies in."""
    rows = new.withColumn("__o", F.xxhash64("root")).withColumn("__b", F.pmod(F.shiftrightunsigned("__o", 40), F.lit(BUCKETS)))
    totals = rows.groupBy("__b").agg(F.sum("n").alias("__s"))
    before = totals.withColumn("__before", F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).select("__b", F.coalesce("__before", F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("__b").orderBy("__o", "root").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = rows.withColumn("__in", inside).join(F.broadcast(before), "__b").withColumn("__at", F.col("__before") + F.col("__in") + F.col("n") / 2)  # BUCKETS rows at most
    choice, edge = None, 0.0
    for name, size in deficits:
        edge += size
        choice = F.when(F.col("__at") <= edge, name) if choice is None else choice.when(F.col("__at") <= edge, name)
    return at.select("root", choice.otherwise(deficits[-1][0]).alias("split"))


class ComponentStore:
    """Entities, components and splits at `path`, for one list of key columns."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], shares: tuple[tuple[str, float], ...] = SHARES):
        self.spark, self.path, self.keys, self.shares = spark, path.rstrip("/"), keys, shares

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def done(self) -> list[dict]:
        """What the mark of each complete batch says; a batch that was broken off has none and is written anew."""
        path, files = self._files()
        names = sorted(n for s in files.listStatus(path) if (n := s.getPath().getName()).startswith("done-")) if files.exists(path) else []
        return [json.loads(urllib.parse.unquote(n.split("-", 2)[2])) for n in names]

    def read(self, name: str) -> DataFrame:
        """All rows of a table, with the number of their batch."""
        at = [f"{self.path}/{name}/batch={i}" for i in range(len(self.done()))]
        schema = TABLES[name] + ", batch int"
        return self.spark.read.option("basePath", f"{self.path}/{name}").schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def conflicts(self) -> DataFrame:
        """(root, component, split): the components that records of a batch would have merged, one row each."""
        kept = self.read("entities").where((F.col("split") == QUARANTINE) & F.col("met_before"))
        return kept.select(F.col("top").alias("root"), "component", F.col("own_split").alias("split")).distinct()

    def _write(self, name: str, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def roots(self) -> DataFrame:
        """(component, root, split) of every component as of now: the newest row of each, followed to the end of its chain."""
        done = self.done()
        if len(done) == 1:  # every component is its own root
            return self.read("components").select("component", "root", "split")
        newest = self.read("components").groupBy("component").agg(F.max_by(F.struct("root", "split"), "batch").alias("x")).select("component", "x.*")
        if not any(d["merged"] for d in done):
            return newest
        ends = _jumped(newest.select(F.col("component").alias("v"), F.col("root").alias("p")))
        split = newest.select(F.col("component").alias("p"), "split")
        return ends.join(split, "p").select(F.col("v").alias("component"), F.col("p").alias("root"), "split")

    def entity(self, i: int) -> Column:
        """The value of the i-th key column, marked with the key's number."""
        return F.concat(F.lit(f"{i}:"), same_id(self.keys[i]))

    def _values(self, batch: DataFrame, *more: Column) -> DataFrame:
        return batch.select(F.array_compact(F.array(*[self.entity(i) for i in range(len(self.keys))])).alias("k"), *more).where("size(k) > 0")

    def update(self, batch: DataFrame, day: str | None = None) -> None:
        """Adds the records of a batch."""
        done = self.done()
        number = len(done)
        rows = self._values(batch, (F.col(day) if day else F.lit(None)).cast("string").alias("d"))
        seen = rows.select(F.explode("k").alias("entity"), F.col("k")[0].alias("first"), "d")
        met = seen.groupBy("entity").agg(F.count_if(F.col("entity") == F.col("first")).alias("n_records"), F.array_sort(F.array_compact(F.collect_set("d"))).alias("days"))
        met = met.select("entity", F.col("n_records").cast("bigint"), "days")
        none = F.lit(None).cast("string")
        if number:
            met = stored(met)
            old = self.read("entities").join(if_small(met.select("entity")), "entity", "left_semi").groupBy("entity").agg(F.min_by("component", "batch").alias("component"))
            old = old.join(self.roots(), "component").select("entity", "root", "split")
            known = stored(met.join(old, "entity", "left").withColumn("node", F.coalesce("root", "entity")))
        else:
            known = stored(met.select("*", none.alias("root"), none.alias("split"), F.col("entity").alias("node")))
        pairs = rows.where("size(k) > 1").select(F.col("k")[0].alias("x"), F.explode(F.slice("k", 2, len(self.keys))).alias("y")).distinct()
        ends = [known.select(F.col("entity").alias(c), F.col("node").alias(n)) for c, n in (("x", "a"), ("y", "b"))]
        joined = connect(pairs.join(ends[0], "x").join(ends[1], "y").select("a", "b"))
        placed = known.join(joined.select(F.col("v").alias("node"), F.col("root").alias("top")), "node", "left").withColumn("top", F.coalesce("top", "node"))
        tops = placed.groupBy("top").agg(F.sum(F.when(F.col("root").isNull(), F.col("n_records")).otherwise(0)).alias("n_new"), F.sum("n_records").alias("n"), F.min("split").alias("a"), F.max("split").alias("b"))
        tops = tops.withColumn("kept", F.when(F.col("a") != F.col("b"), QUARANTINE).otherwise(F.col("a")))
        kinds = [None, QUARANTINE, *[name for name, _ in self.shares]]
        tops, seen = stored_with(tops, **{f"n{i}": F.coalesce(F.sum(F.when(F.col("kept").eqNullSafe(F.lit(k)), F.col("n"))), F.lit(0)) for i, k in enumerate(kinds)})
        given = {k: seen[f"n{i}"] for i, k in enumerate(kinds)}
        held = {name: sum(d["totals"].get(name, 0) for d in done) + given[name] for name, _ in self.shares}
        total = sum(held.values()) + given[None]
        room = [(name, max(0.0, share * total - held[name])) for name, share in self.shares]
        scale = given[None] / (sum(r for _, r in room) or 1)
        new = _laid_out(tops.where("kept IS NULL").select(F.col("top").alias("root"), "n"), [(name, r * scale) for name, r in room])
        splits = tops.where("kept IS NOT NULL").select("top", F.col("kept").alias("to")).unionByName(new.select(F.col("root").alias("top"), F.col("split").alias("to")))
        out = placed.join(splits, "top")
        met_before = F.col("root").isNotNull()
        # in a conflict old components stay what they are; what is new in it gets a component of its own
        own = F.when(met_before, F.col("root")).when(F.col("to") == QUARANTINE, F.concat(F.lit(f"{QUARANTINE}:{number}:"), F.col("top"))).otherwise(F.col("top"))
        out = out.select("entity", own.alias("component"), "n_records", "days", "top", F.col("to").alias("split"), F.when(met_before, F.col("split")).otherwise(F.col("to")).alias("own_split"), met_before.alias("met_before"))
        taken = Observation()
        sums = {f"n{i}": F.coalesce(F.sum(F.when(F.col("own_split") == k, F.col("n_records"))), F.lit(0)) for i, k in enumerate(kinds[1:])}
        merged = F.count_if(F.col("met_before") & (F.col("split") != QUARANTINE) & (F.col("component") != F.col("top")))
        self._write("entities", out.observe(taken, merged.alias("merged"), *[c.alias(n) for n, c in sums.items()]), number)
        here = self.spark.read.schema(TABLES["entities"]).parquet(f"{self.path}/entities/batch={number}")
        root = F.when(F.col("split") == QUARANTINE, F.col("component")).otherwise(F.col("top"))
        rows = here.where(~(F.col("met_before") & (F.col("split") == QUARANTINE))).select("component", root.alias("root"), "split")
        if taken.get["merged"]:  # the top itself is a row too, so that a chain ends with its split
            rows = rows.unionByName(rows.select(F.col("root").alias("component"), "root", "split"))
        self._write("components", rows.distinct(), number)
        mark = {"merged": bool(taken.get["merged"]), "totals": {k: taken.get[f"n{i}"] for i, k in enumerate(kinds[1:])}}
        _, files = self._files()
        files.create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done-{number:06d}-{urllib.parse.quote(json.dumps(mark))}")).close()

    def table(self) -> DataFrame:
        """(entity, component, split, n_records, days): one row an entity, over all batches."""
        all_of = self.read("entities").groupBy("entity").agg(F.min_by("component", "batch").alias("component"), F.sum("n_records").cast("bigint").alias("n_records"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("days")))).alias("days"))
        return all_of.join(self.roots(), "component").select("entity", F.col("root").alias("component"), "split", "n_records", "days")

    def assign(self, df: DataFrame) -> DataFrame:
        """df with `split`: that of its values, quarantine if they lie in different ones, null without any."""
        table = if_small(self.table().select(F.col("entity").alias("__entity"), F.col("split").alias("__split")))
        out = df.drop("split")
        for i in range(len(self.keys)):
            at = table.select(F.col("__entity").alias(f"__e{i}"), F.col("__split").alias(f"__s{i}"))
            out = out.join(at, self.entity(i) == F.col(f"__e{i}"), "left")
        found = [F.col(f"__s{i}") for i in range(len(self.keys))]
        differ = F.array_max(F.array(*found)) != F.array_min(F.array(*found))
        return out.select(*[c for c in df.columns if c != "split"], F.when(differ, QUARANTINE).otherwise(F.coalesce(*found)).alias("split"))

    def torn(self, i: int = 0) -> DataFrame:
        """(entity, n_days): values of the i-th key whose records a split by day would tear."""
        mine = self.table().where(F.col("entity").startswith(f"{i}:") & (F.size("days") > 1))
        return mine.select(F.expr(f"substring(entity, {len(str(i)) + 2})").alias("entity"), F.size("days").alias("n_days"))
