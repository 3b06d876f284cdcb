"""Runs with a part left out, side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators import fusion, metrics
from flowloom.operators.sessions import flow_level  # noqa: F401 - the first ablation: every flow a session


def without_patterns(df: DataFrame) -> DataFrame:
    return df.withColumn("sp_t", F.lit(0.0))


def without_graph(df: DataFrame) -> DataFrame:
    return df.withColumn("tc_t", F.lit(0.0)).withColumn("g_w", F.lit(0.0))


def refuse(df: DataFrame, weights: fusion.FusionWeights, risk_model=None) -> DataFrame:
    """Fused again, and with a fitted risk model scored again; nothing is trained."""
    fused = fusion.add_predictions(df.drop("r", "r_max", "predicted_class", "risk", "tier", "meta"), weights)
    if risk_model is None:
        return fused
    meta = fusion.meta_features(F.col("r_max"), F.col("sp_t"), F.col("tc_t"), F.col("g_w"), F.col("inv_dt_norm"))
    return fusion.predict_risk(risk_model, fused.withColumn("meta", meta))


def compare(runs: dict[str, DataFrame]) -> DataFrame:
    """(run, macro_f1, fpr, heartbleed_f1, infiltration_f1), one row a run."""
    out = None
    for name, df in runs.items():
        report = metrics.class_report(df)
        f1 = lambda c: F.max(F.when(F.col("class") == c, F.col("f1")))  # noqa: B023, E731
        row = report.agg(F.lit(name).alias("run"), f1("MACRO_AVG").alias("macro_f1"), f1("Heartbleed").alias("heartbleed_f1"), f1("Infiltration").alias("infiltration_f1")).join(F.broadcast(metrics.false_positive_rate(df)))  # one row
        out = row if out is None else out.unionByName(row)
    return out.select("run", "macro_f1", "fpr", "heartbleed_f1", "infiltration_f1")
