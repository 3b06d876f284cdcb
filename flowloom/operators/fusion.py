"""Probabilities of three models fused with evidence, risk and tiers."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.config import CLASSES, SETTINGS


@dataclass(frozen=True)
class FusionWeights:
    """Weights of the models A, B, C and of the pattern and time scores."""

    a: float = 1 / 3
    b: float = 1 / 3
    c: float = 1 / 3
    s: float = 0.0
    t: float = 0.0

    def as_dict(self) -> dict[str, float]:
        return asdict(self)


EQUAL = FusionWeights()


def fuse(pa: Column, pb: Column, pc: Column, sp: Column, tc: Column, w: FusionWeights) -> Column:
    """Weighted sum per class; the scores add the same to every class."""
    both = F.zip_with(pa, pb, lambda x, y: w.a * x + w.b * y)
    return F.zip_with(both, pc, lambda x, y: x + w.c * y + w.s * sp + w.t * tc)


def first_best(scores: Column) -> Column:
    """The class of the greatest score, the first on ties."""
    return F.get(F.lit(list(CLASSES)), (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def add_predictions(df: DataFrame, w: FusionWeights) -> DataFrame:
    """df (p_a, p_b, p_c arrays, sp_t, tc_t) with r, r_max and predicted_class."""
    r = df.withColumn("r", fuse(F.col("p_a"), F.col("p_b"), F.col("p_c"), F.col("sp_t"), F.col("tc_t"), w))
    return r.withColumn("r_max", F.array_max("r")).withColumn("predicted_class", first_best(F.col("r")))


def present_macro_f1(counts: list[tuple[str, str, int]]) -> float:
    """Mean F1 over the classes that occur in truth or prediction; counts (truth, prediction, n)."""
    seen = sorted({x for t, p, _ in counts for x in (t, p)})
    f1 = []
    for c in seen:
        tp = sum(n for t, p, n in counts if t == p == c)
        rest = sum(n for t, p, n in counts if (t == c) != (p == c))
        f1.append(2 * tp / (2 * tp + rest) if tp else 0.0)
    return sum(f1) / len(f1) if f1 else 0.0


def calibrate(df: DataFrame, label: str = "label", grid: tuple[float, ...] = SETTINGS.fusion_grid) -> FusionWeights:
    """Model weights in proportion to their F1 on df, the grid point with the best fused F1 (the first on ties).

    One scan counts the confusions of the three models and of all grid points (at most 225 cells each).
    """
    single = {m: first_best(F.col(m)) for m in ("p_a", "p_b", "p_c")}
    counted = df.select(label, F.explode(F.array(*[F.struct(F.lit(m).alias("m"), x.alias("p")) for m, x in single.items()])).alias("x")).groupBy("x.m", label, "x.p").agg(F.count("*").alias("n")).collect()
    f1 = {m: present_macro_f1([(r[label], r["p"], r["n"]) for r in counted if r["m"] == m and r[label] is not None]) for m in single}
    total = sum(f1.values()) or 1.0
    points = [(s, t) for s in grid for t in grid]
    made = [FusionWeights(*(f1[m] / total * (1 - s - t) if sum(f1.values()) else (1 - s - t) / 3 for m in single), s, t) for s, t in points]
    best = df.select(label, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), first_best(fuse(F.col("p_a"), F.col("p_b"), F.col("p_c"), F.col("sp_t"), F.col("tc_t"), w)).alias("p")) for i, w in enumerate(made)])).alias("x")).groupBy("x.i", label, "x.p").agg(F.count("*").alias("n")).collect()
    score = [present_macro_f1([(r[label], r["p"], r["n"]) for r in best if r["i"] == i and r[label] is not None]) for i in range(len(made))]
    return made[max(range(len(made)), key=lambda i: (score[i], -i))]


def normalized_gap(gap: Column, mean: Column, eps: float = SETTINGS.gap_epsilon) -> Column:
    return F.greatest(mean, F.lit(eps)) / (gap + F.lit(eps))


def meta_features(r_max: Column, sp: Column, tc: Column, g: Column, gap: Column) -> Column:
    return F.array(r_max, sp, tc, g, gap)


def tier(risk: Column, suspicious: float = SETTINGS.tier_suspicious, attack: float = SETTINGS.tier_attack) -> Column:
    return F.when(risk >= attack, "ATTACK").when(risk >= suspicious, "SUSPICIOUS").otherwise("BENIGN")


def fit_risk(df: DataFrame, label: str = "is_attack"):
    """Logistic regression on `meta` (array), penalty as C = 1; a single class raises instead of giving no intercept."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    n = df.groupBy(label).count().collect()
    if len([r for r in n if r[label] is not None]) < 2:
        raise ValueError("risk needs rows of both classes")
    rows = df.select(array_to_vector("meta").alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(regParam=1.0 / sum(r["count"] for r in n), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-9).fit(rows)


def predict_risk(model, df: DataFrame) -> DataFrame:
    """df with risk and tier."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    out = model.transform(df.withColumn("features", array_to_vector("meta")))
    return out.withColumn("risk", vector_to_array("probability")[1]).withColumn("tier", tier(F.col("risk"))).select(*df.columns, "risk", "tier")


def mean_probabilities(df: DataFrame, session: str, column: str) -> Column:
    """Aggregate: mean of each of the 15 probabilities."""
    return F.array(*[F.avg(F.col(column)[i]) for i in range(len(CLASSES))])
