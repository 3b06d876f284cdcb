"""Quality of predictions. Confusions are counted in Spark (at most 225 cells); what follows is arithmetic on them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.config import CLASSES, SETTINGS


def _classes(spark, name: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CLASSES], f"{name} string")


def confusion(df: DataFrame, truth: str = "label", predicted: str = "predicted_class") -> DataFrame:
    """(truth, predicted, n) for all 15 x 15 pairs; other classes and nulls are left out."""
    counts = df.where(F.col(truth).isin(*CLASSES) & F.col(predicted).isin(*CLASSES)).groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    grid = _classes(df.sparkSession, "truth").withColumn("predicted", F.explode(F.lit(list(CLASSES))))
    return grid.join(F.broadcast(counts), (F.col("truth") == F.col("t")) & (F.col("predicted") == F.col("p")), "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))  # 225 rows at most


def class_report(df: DataFrame, truth: str = "label", predicted: str = "predicted_class") -> DataFrame:
    """(class, precision, recall, f1, support) of all classes, 0 where nothing is divided, and MACRO_AVG."""
    cells = confusion(df, truth, predicted)
    rows = cells.select(F.explode(F.array(F.struct(F.col("truth").alias("class"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("shown")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("shown")))).alias("x")).select("x.*")
    by = rows.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("shown").alias("shown"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    one = by.select("class", zero(F.try_divide(F.col("tp").cast("double"), F.col("shown"))).alias("precision"), zero(F.try_divide(F.col("tp").cast("double"), F.col("support"))).alias("recall"), zero(F.try_divide(F.lit(2.0) * F.col("tp"), F.col("shown") + F.col("support"))).alias("f1"), "support")
    mean = one.agg(F.lit("MACRO_AVG").alias("class"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    return one.unionByName(mean)


def macro_f1(df: DataFrame, truth: str = "label", predicted: str = "predicted_class") -> DataFrame:
    """One row: mean F1 over all 15 classes."""
    return class_report(df, truth, predicted).where("class = 'MACRO_AVG'").select(F.col("f1").alias("macro_f1"))


def macro_f1_present(df: DataFrame, truth: str = "label", predicted: str = "predicted_class") -> DataFrame:
    """One row: mean F1 over the classes that occur in truth or prediction."""
    seen = class_report(df, truth, predicted).where("class <> 'MACRO_AVG'")
    shown = confusion(df, truth, predicted).where("n > 0").select(F.explode(F.array("truth", "predicted")).alias("c")).distinct()
    return seen.join(F.broadcast(shown), F.col("class") == F.col("c")).agg(F.avg("f1").alias("macro_f1_present"))  # 15 rows at most


def false_positive_rate(df: DataFrame, truth: str = "label", predicted: str = "predicted_class") -> DataFrame:
    """One row: share of BENIGN rows predicted otherwise; 0 without BENIGN rows."""
    benign = F.col(truth) == "BENIGN"
    return df.agg(F.coalesce(F.try_divide(F.count_if(benign & (F.col(predicted) != "BENIGN")).cast("double"), F.count_if(benign & F.col(predicted).isNotNull())), F.lit(0.0)).alias("fpr"))


def average_precision(df: DataFrame, scores: str, truth: str = "label") -> DataFrame:
    """(class, ap): step-wise area under precision and recall of each class, null without positives; ties in a score count together.

    Scores are first counted by class and distinct value, so a class is never sorted row by row.
    """
    long = df.select(F.col(truth).alias("t"), F.posexplode(scores).alias("i", "s")).withColumn("class", F.get(F.lit(list(CLASSES)), F.col("i")))
    by = long.groupBy("class", "s").agg(F.count_if(F.col("t") == F.col("class")).alias("p"), F.count("*").alias("n"))
    z = by.withColumn("z", F.floor(F.col("s") * 64))
    zt = z.groupBy("class", "z").agg(F.sum("p").alias("zp"), F.sum("n").alias("zn"))
    above = Window.partitionBy("class").orderBy(F.desc("z")).rowsBetween(Window.unboundedPreceding, -1)
    before = zt.select("class", "z", F.coalesce(F.sum("zp").over(above), F.lit(0)).alias("bp"), F.coalesce(F.sum("zn").over(above), F.lit(0)).alias("bn"), F.sum("zp").over(Window.partitionBy("class")).alias("all_p"))
    inside = Window.partitionBy("class", "z").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = z.withColumn("cp", F.sum("p").over(inside)).withColumn("cn", F.sum("n").over(inside)).join(before, ["class", "z"])
    return run.groupBy("class").agg(F.sum(F.try_divide(F.col("p").cast("double"), F.col("all_p")) * (F.col("bp") + F.col("cp")) / (F.col("bn") + F.col("cn"))).alias("ap"))


def mcnemar(df: DataFrame, truth: str, a: str, b: str) -> DataFrame:
    """One row (b, c, statistic, p_value): exact two-sided below 25 disagreements, else chi-square with correction."""
    n = df.agg(F.count_if((F.col(a) == F.col(truth)) & (F.col(b) != F.col(truth))).alias("b"), F.count_if((F.col(a) != F.col(truth)) & (F.col(b) == F.col(truth))).alias("c")).first()
    return df.sparkSession.createDataFrame([(n["b"], n["c"], *mcnemar_test(n["b"], n["c"]))], "b bigint, c bigint, statistic double, p_value double")


def mcnemar_test(b: int, c: int) -> tuple[float, float]:
    n = b + c
    if n == 0:
        return 0.0, 1.0
    if n < 25:
        return float(min(b, c)), min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n)
    statistic = (abs(b - c) - 1) ** 2 / n
    return statistic, math.erfc(math.sqrt(statistic / 2))


def bootstrap_ci(df: DataFrame, truth: str = "label", predicted: str = "predicted_class", n: int = 1000, alpha: float = 0.05, seed: int = SETTINGS.seed) -> DataFrame:
    """One row (mean, low, high) of macro F1: resampling rows is one multinomial draw over the confusion's cells."""
    cells = np.array([r["n"] for r in confusion(df, truth, predicted).orderBy("truth", "predicted").collect()], dtype=np.int64)  # 225 numbers
    order = sorted(CLASSES)
    k, total = len(order), int(cells.sum())
    if not total:
        return df.sparkSession.createDataFrame([(None, None, None)], "mean double, low double, high double")
    draws = np.random.default_rng(seed).multinomial(total, cells / total, size=n).reshape(n, k, k)
    tp, t, p = np.diagonal(draws, axis1=1, axis2=2), draws.sum(axis=2), draws.sum(axis=1)
    f1 = np.where(t + p > 0, 2 * tp / np.maximum(t + p, 1), 0.0).mean(axis=1)
    low, high = np.percentile(f1, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return df.sparkSession.createDataFrame([(float(f1.mean()), float(low), float(high))], "mean double, low double, high double")
