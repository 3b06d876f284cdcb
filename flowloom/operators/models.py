"""Classifiers of flows and sessions, and oversampling.

Forest and boosting are histogram trees (trees.py), the token model is a bidirectional recurrent net (recurrent.py).
Each is fitted on a bounded sample of the labelled rows (`most_rows`, see sample_rows_to_fit), whose weights restore
the classes' true shares; scoring is one pass over all rows in Arrow batches. All return arrays over the 15 classes.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.config import CLASSES, SETTINGS
from flowloom.operators import tokens, trees
from flowloom.operators.clean import hash_order, lookup
from flowloom.operators.nearest import _squares, own_class_share
from flowloom.operators.recurrent import Recurrent, RecurrentConfig
from flowloom.runtime import stored

INDEX = {c: i for i, c in enumerate(CLASSES)}
MOST_ROWS, MOST_SEQUENCES = 20_000, 5_000
UNLIMITED = 64  # levels no tree on MOST_ROWS rows comes near


def with_index(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn("class_index", lookup(INDEX, F.col(label)).cast("double")).where("class_index IS NOT NULL")


def sample_rows_to_fit(df: DataFrame, columns: list[str], most: int, weight: str | None = None) -> pd.DataFrame:
    """columns, class_index and weight of about `most` rows, the same ones at every run.

    Classes are taken at one rate, but each at least with its even part of half the rows, so rare ones are whole; what a
    row stands for goes into its weight.
    """
    counts = {r["class_index"]: r["n"] for r in df.groupBy("class_index").agg(F.count("*").alias("n")).collect()}  # 15 at most
    total, floor = sum(counts.values()), most / (2 * max(1, len(counts)))
    rate = {c: min(1.0, max(most / 2 / total, floor / n) if total > most else 1.0) for c, n in counts.items()}
    key = F.xxhash64(*([F.col("seq_no")] if "seq_no" in df.columns else [F.col(c) for c in dict.fromkeys([*columns, "class_index"])]))
    part = lookup(rate, F.col("class_index")) if rate else F.lit(0.0)
    chosen = df.select(*columns, F.col("class_index").cast("int").alias("class_index"), ((F.col(weight) if weight else F.lit(1.0)) / part).alias("weight"), key.alias("__key"))
    chosen = chosen.where(F.pmod("__key", F.lit(1 << 30)) < lookup(rate, F.col("class_index").cast("double")) * (1 << 30)) if rate else chosen.where("false")
    out = chosen.toPandas()  # about `most` rows
    return out.sort_values(["__key", "class_index"], kind="stable", ignore_index=True).drop(columns="__key")


def _scored(df: DataFrame, inputs: list[str], out: str, out_type: T.DataType, score: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """df with `out`: score(batch with the inputs), in Arrow batches."""
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), score(b)], names=[*kept, out])

    return df.select(*kept).mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), T.StructField(out, out_type)]))


PROBABILITIES = T.ArrayType(T.DoubleType())
TOP = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType())]))


def _matrix(b: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names]) if names else np.zeros((b.num_rows, 0))


def _over_classes(p: np.ndarray, seen: list[int]) -> pa.Array:
    whole = np.zeros((len(p), len(CLASSES)))
    whole[:, seen] = p
    return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * len(CLASSES), pa.int32()), pa.array(whole.ravel()))


@dataclass
class _Trees:
    """A tree ensemble on named features."""

    features: list[str]
    model: object = None
    seen: list[int] = field(default_factory=list)

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        shared, names, seen = df.sparkSession.sparkContext.broadcast(self.model), self.features, self.seen  # bounded by the sample
        return _scored(df, names, out, PROBABILITIES, lambda b: _over_classes(shared.value.predict(_matrix(b, names)), seen))

    def explain(self, df: DataFrame, out: str = "top", k: int = SETTINGS.explain_top_k, class_index: int | None = None) -> DataFrame:
        """df with `out`: the k largest path attributions (name, value) of each row, ties by name.

        A feature's attribution is the sum of what its splits on the row's path changed in the class's value. The class is
        the one given, else the one whose attributions are the largest in total.
        """
        shared, names, seen = df.sparkSession.sparkContext.broadcast(self.model), self.features, self.seen

        def top(b: pa.RecordBatch) -> pa.Array:
            x, found = _matrix(b, names), []
            for i in range(0, len(x), 512):
                parts = shared.value.attributions(x[i : i + 512])
                which = np.full(len(parts), seen.index(class_index)) if class_index in seen else np.abs(parts).sum(axis=1).argmax(axis=1)
                for row in parts[np.arange(len(parts)), :, which]:
                    best = sorted(range(len(names)), key=lambda j: (-abs(row[j]), names[j]))[:k]  # noqa: B023 - used at once
                    found.append([{"name": names[j], "value": float(row[j])} for j in best])
            return pa.array(found, pa.list_(pa.struct([("name", pa.string()), ("value", pa.float64())])))

        return _scored(df, names, out, TOP, top)

    def _sample(self, df: DataFrame, weight: str | None, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = sample_rows_to_fit(df, self.features, most, weight)
        self.seen = sorted(int(c) for c in rows["class_index"].unique())
        return rows[self.features].to_numpy(dtype=float), rows["class_index"].map({c: i for i, c in enumerate(self.seen)}).to_numpy(dtype=np.int64), rows["weight"].to_numpy(dtype=float)


@dataclass
class Forest(_Trees):
    """Random forest: bootstraps, the root of the number of features tried at each node, no limit of depth."""

    trees: int = SETTINGS.tree_count
    depth: int = UNLIMITED

    def fit(self, df: DataFrame, weight: str | None = None, most_rows: int = MOST_ROWS) -> Forest:
        """Trees are grown in parallel, each in one task on the sample."""
        spark = df.sparkSession
        x, y, w = self._sample(df, weight, most_rows)
        cuts = trees.thresholds(x)
        shared, depth, seed, k = spark.sparkContext.broadcast((trees.binned(x, cuts), y, w)), self.depth, SETTINGS.seed, len(self.seen)

        def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"number": pdf["id"], "tree": [pickle.dumps(trees.grow_forest_tree(*shared.value, k, depth, seed, int(i))) for i in pdf["id"]]})

        tasks = min(self.trees, 4 * spark.sparkContext.defaultParallelism)
        grown = spark.range(0, self.trees, 1, tasks).mapInPandas(grow, "number bigint, tree binary").toPandas().sort_values("number")
        self.model = trees.ForestModel(cuts, k, [pickle.loads(t) for t in grown["tree"]])
        return self

    def predict(self, df: DataFrame, out: str = "p_a") -> DataFrame:
        return super().predict(df, out)


@dataclass
class Boosting(_Trees):
    """Soft-max gradient boosting."""

    rounds: int = SETTINGS.boost_rounds
    depth: int = SETTINGS.boost_depth

    def fit(self, df: DataFrame, weight: str | None = None, most_rows: int = MOST_ROWS) -> Boosting:
        """One task fits on the sample."""
        spark = df.sparkSession
        x, y, w = self._sample(df, weight, most_rows)
        shared, k, rounds, depth = spark.sparkContext.broadcast((x, y, w)), len(self.seen), self.rounds, self.depth
        self.model = _in_a_task(spark, lambda: trees.fit_boosted(*shared.value, k, rounds, depth, SETTINGS.boost_step))
        return self

    def predict(self, df: DataFrame, out: str = "p_c") -> DataFrame:
        return super().predict(df, out)


def _in_a_task(spark: SparkSession, make: Callable[[], object]) -> object:
    """What make() returns, made by an executor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            yield pd.DataFrame({"made": [pickle.dumps(make())]})

    return pickle.loads(spark.range(1).coalesce(1).mapInPandas(run, "made binary").first()["made"])


def index_sequences(steps: DataFrame, most: int = SETTINGS.sequence_length) -> DataFrame:
    """(session, ids): the ids of each session's last tokens in order."""
    return tokens.sequences(tokens.last_steps(steps, most)).select("session", tokens.last_indices(F.transform("seq", lambda x: x["token"]), most).cast("array<int>").alias("ids"))


@dataclass
class TokenModel:
    """A recurrent net over the token ids of sessions."""

    config: RecurrentConfig = field(default_factory=RecurrentConfig)
    model: Recurrent | None = None

    def fit(self, df: DataFrame, class_weights: list[float] | None = None, most_rows: int = MOST_SEQUENCES) -> TokenModel:
        """df (ids, class_index); class weights in class order, 1 without. One task fits on the sample."""
        rows = sample_rows_to_fit(df, ["ids"], most_rows)
        shared, config = df.sparkSession.sparkContext.broadcast(([list(map(int, s)) for s in rows["ids"]], rows["class_index"].to_numpy())), self.config
        weight = np.asarray(class_weights or [1.0] * len(CLASSES))
        self.model = _in_a_task(df.sparkSession, lambda: Recurrent(config).fit(*shared.value, weight, SETTINGS.seed))
        return self

    def predict(self, df: DataFrame, out: str = "p_b", ids: str = "ids") -> DataFrame:
        shared, every = df.sparkSession.sparkContext.broadcast(self.model), list(range(len(CLASSES)))
        return _scored(df, [ids], out, PROBABILITIES, lambda b: _over_classes(shared.value.predict([s or [] for s in b.column(ids).to_pylist()]), every))

    def explain(self, df: DataFrame, out: str = "token_attributions", ids: str = "ids", class_index: str = "class_index") -> DataFrame:
        """df with `out`: gradient times input of each step, in order, for the row's class_index."""
        shared = df.sparkSession.sparkContext.broadcast(self.model)

        def parts(b: pa.RecordBatch) -> pa.Array:
            seqs = [s or [] for s in b.column(ids).to_pylist()]
            found = shared.value.attributions(seqs, [int(c) for c in b.column(class_index).to_pylist()])
            last = self_longest
            return pa.array([[{"name": tokens.TOKENS[i], "value": float(v)} for i, v in zip(s[-last:], f, strict=False)] for s, f in zip(seqs, found, strict=True)], pa.list_(pa.struct([("name", pa.string()), ("value", pa.float64())])))

        self_longest = self.config.longest
        return _scored(df, [ids, class_index], out, TOP, parts)


def save_model(spark: SparkSession, model: object, path: str) -> None:
    """A fitted model as a one-row table at any path Spark can write."""
    spark.createDataFrame([(type(model).__name__, bytearray(pickle.dumps(model)))], "kind string, model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> object:
    """A model saved by save_model; unpickled, so only from folders that are trusted."""
    return pickle.loads(bytes(spark.read.parquet(path).first()["model"]))


def smote_targets(df: DataFrame, label: str = "label", least: int = SETTINGS.smote_min_count, k: int = SETTINGS.smote_k, ratio: float = SETTINGS.smote_ratio) -> DataFrame:
    """(label, n, target): classes that are oversampled and to what number."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("most"))
    target = F.least(F.floor(F.col("most") * ratio), F.col("n") * (k + 1)).cast("bigint")
    return counts.join(F.broadcast(top)).where((F.col("n") >= least) & (F.col("n") < F.col("most"))).withColumn("target", target).where("target > n").select(label, "n", "target")  # one row


def _made(features: list[str], k: int, clean_k: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n = pdf[features].to_numpy(dtype=float), len(pdf)
        need = int(pdf["__need"].iloc[0])
        if n < 2 or need <= 0:
            return pd.DataFrame(columns=[*features, "label"])
        rng = np.random.default_rng([seed, int(pdf["__block"].iloc[0]), n])
        apart = _squares(x, x)
        np.fill_diagonal(apart, -1.0)  # a row comes first among its own neighbours, also where others equal it
        near = np.argsort(apart, axis=1, kind="stable")[:, 1 : k + 1]
        base = rng.integers(0, n, need)
        other = near[base, rng.integers(0, near.shape[1], need)]
        new = x[base] + rng.random((need, 1)) * (x[other] - x[base])
        return pd.DataFrame(new, columns=features).assign(label=pdf["label"].iloc[0])

    return run


def smote(df: DataFrame, features: list[str], seq: str, label: str = "label", k: int = SETTINGS.smote_k, clean_k: int = SETTINGS.smote_clean_k, block: int = 512, seed: int = SETTINGS.seed) -> DataFrame:
    """df's features and label, and made rows between neighbours of a class that borderline cleaning keeps.

    Rows are made among `block` rows of a class in hash order, so a class of any size stays in tasks of bounded size;
    with fewer rows than a block they are all of them. Cleaning looks at the nearest of all rows, real and made.
    """
    targets = smote_targets(df, label, k=k)
    rows = df.select(seq, F.col(label).alias("label"), *[F.col(f).cast("double").alias(f) for f in features]).join(F.broadcast(targets.withColumnRenamed(label, "__l")), F.col("label") == F.col("__l"))  # one row a class
    blocks = F.ceil(F.col("n") / F.lit(block))
    placed = rows.withColumn("__block", F.pmod(hash_order(seq), blocks)).withColumn("__need", F.floor((F.col("target") - F.col("n")) / blocks) + (F.col("__block") < F.pmod(F.col("target") - F.col("n"), blocks)).cast("int"))
    schema = ", ".join(f"`{f}` double" for f in features) + ", label string"
    made = placed.groupBy("label", "__block").applyInPandas(_made(features, k, clean_k, seed), schema)
    whole = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).alias("label")).where("label IS NOT NULL")
    fixed = stored(made.withColumn("__id", F.monotonically_increasing_id()))
    share = own_class_share(fixed, whole.unionByName(fixed.drop("__id")), features, clean_k + 1)
    kept = fixed.join(share.where("share >= 0.5"), "__id").select(*features, "label")
    return whole.unionByName(kept)
