"""The whole run: flows to sessions, evidence, fused classes and risk."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.config import CLASSES, SETTINGS, Settings
from flowloom.operators import clean, explain, features, fusion, graph, mining, models, sessions, tokens
from flowloom.runtime import micros, stored


@dataclass
class Artifacts:
    """Fitted objects and the three session tables."""

    forest: models.Forest
    token_model: models.TokenModel
    boosting: models.Boosting
    scaler: list
    edges: DataFrame
    patterns: DataFrame
    mean_gap: float
    decay: float
    weights: fusion.FusionWeights
    risk_model: object
    tables: dict[str, DataFrame] = field(default_factory=dict)
    flows: dict[str, DataFrame] = field(default_factory=dict)

    def save(self, spark: SparkSession, path: str) -> None:
        """What was fitted, at any path Spark can write; the tables are not part of it."""
        fitted = {"forest": self.forest, "token_model": self.token_model, "boosting": self.boosting, "scaler": [r.asDict() for r in self.scaler], "mean_gap": self.mean_gap, "decay": self.decay, "weights": self.weights}
        models.save_model(spark, fitted, f"{path}/fitted")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")
        self.patterns.write.mode("overwrite").parquet(f"{path}/patterns")
        self.risk_model.write().overwrite().save(f"{path}/risk")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Artifacts:
        from pyspark.ml.classification import LogisticRegressionModel

        fitted = models.load_model(spark, f"{path}/fitted")
        return Artifacts(**fitted, edges=spark.read.parquet(f"{path}/edges"), patterns=spark.read.parquet(f"{path}/patterns"), risk_model=LogisticRegressionModel.load(f"{path}/risk"))


def prepare(flows: DataFrame, settings: Settings = SETTINGS) -> tuple[DataFrame, list[str]]:
    """Clean flows with session, token and times in µs, and the feature names; flows are loaded ones (record_id as order)."""
    seq = "record_id" if "record_id" in flows.columns else "row_seq"
    columns = features.candidate_features(flows.drop(seq))
    known = clean.clean_data(clean.known_labels(flows), columns).withColumnRenamed(seq, "seq_no").withColumn("us", micros("timestamp"))
    tagged = sessions.tag_sessions(known, "us", "flow_duration", "seq_no", settings.session_gap_s, settings.session_cap_s)
    return stored(tokens.encode_events(tagged)), columns


def prepare_stratified(flows: DataFrame, test: float = 0.20, val: float = 0.15, settings: Settings = SETTINGS) -> tuple[DataFrame, list[str]]:
    """As prepare, with a stratified split in place of the one by weekday."""
    seq = "record_id" if "record_id" in flows.columns else "row_seq"
    return prepare(clean.stratified_split(clean.known_labels(flows), "label", seq, test, val), settings)


def steps_of(flows: DataFrame) -> DataFrame:
    return flows.select(F.col("session_id").alias("session"), "us", "seq_no", "token")


def pooled_mean_gap(steps: DataFrame) -> float:
    """Mean over all gaps of all sessions, 1 without any."""
    return tokens.transitions(steps).agg(F.coalesce(F.avg("dt_s"), F.lit(1.0)).alias("m")).first()["m"]


META = ("r_max", "sp_t", "tc_t", "g_w", "inv_dt_norm")


def session_table(flows: DataFrame, a: Artifacts, settings: Settings = SETTINGS) -> DataFrame:
    """One row a session: mean probabilities of the three models (0 where a model has none), pattern and graph scores, times, label, is_attack."""
    st = steps_of(flows)
    scaled = features.scale(flows, a.scaler, ["session_id"])
    proba = a.boosting.predict(a.forest.predict(scaled)).groupBy("session_id").agg(fusion.mean_probabilities(scaled, "session_id", "p_a").alias("p_a"), fusion.mean_probabilities(scaled, "session_id", "p_c").alias("p_c"))
    by_token = a.token_model.predict(models.index_sequences(st, settings.sequence_length)).select(F.col("session").alias("session_id"), "p_b")
    pairs = stored(tokens.transitions(st))
    base = stored(sessions.session_summary(flows, "session_id", "us", "seq_no", "token"))
    evidence = graph.session_scores(st, a.edges, settings.lambdas, pairs=pairs, sizes=base.select(F.col("session_id").alias("session"), F.col("n_flows").alias("n"))).drop("n")
    fp = mining.item_scores(base, settings.itemset_support).select(F.col("session_id").alias("session"), "fp_score")
    seq = mining.sequence_match(tokens.sequences(st), a.patterns, settings.max_gap_s)
    which = list(settings.lambdas).index(a.decay)
    scores = evidence.join(mining.sp_t(fp, seq), "session").select(F.col("session").alias("session_id"), "sp_t", F.col(f"tc_{which}").alias("tc_t"), *[f"tc_{i}" for i in range(len(settings.lambdas))], "g_w", fusion.normalized_gap(F.col("mean_gap_s"), F.lit(a.mean_gap)).alias("inv_dt_norm"))
    rows = base.drop("items", "first_seq").join(proba, "session_id", "left").join(by_token, "session_id", "left").join(scores, "session_id", "left")
    none = F.array_repeat(F.lit(0.0), len(CLASSES))
    filled = rows.select(*[F.coalesce(c, none).alias(c) if c in ("p_a", "p_b", "p_c") else F.coalesce(c, F.lit(0.0)).alias(c) if c in scores.columns and c != "session_id" else F.col(c) for c in rows.columns])
    return stored(filled.withColumn("is_attack", (F.col("label") != "BENIGN").cast("int")))


def score(table: DataFrame, a: Artifacts) -> DataFrame:
    """A session table with fused scores, class, risk and tier."""
    fused = fusion.add_predictions(table, a.weights).withColumn("meta", fusion.meta_features(*[F.col(c) for c in META]))
    return fused if a.risk_model is None else fusion.predict_risk(a.risk_model, fused)


def reports(a: Artifacts, part: str, tiers: tuple[str, ...] = ("ATTACK", "SUSPICIOUS")) -> DataFrame:
    """(session_id, report) of a partition's sessions in the given tiers; features are those of a session's first flow."""
    risky = a.tables[part].where(F.col("tier").isin(*tiers)).select("session_id", "risk", "tier", "predicted_class", "sp_t", "tc_t")
    flows = a.flows[part].join(risky.select("session_id"), "session_id", "left_semi")
    scaled = features.scale(flows, a.scaler, ["session_id", "us", "seq_no"])
    firsts = scaled.withColumn("__r", F.row_number().over(Window.partitionBy("session_id").orderBy("us", "seq_no"))).where("__r = 1").drop("__r", "us", "seq_no")
    top = a.boosting.explain(a.forest.explain(firsts, "forest_top"), "boosting_top").select("session_id", "forest_top", "boosting_top")
    st = steps_of(flows)
    classes = risky.select(F.col("session_id").alias("session"), clean.lookup(models.INDEX, F.col("predicted_class")).alias("class_index"))
    by_step = a.token_model.explain(models.index_sequences(st).join(classes, "session"), "token_top").select(F.col("session").alias("session_id"), "token_top")
    path = graph.edge_weight(tokens.transitions(st), a.edges).groupBy(F.col("session").alias("session_id")).agg(F.sort_array(F.collect_list(F.struct("pos", "src", "dst", "weight"))).alias("path"))  # a session's, within the cap
    rows = risky.join(top, "session_id", "left").join(by_step, "session_id", "left").join(path, "session_id", "left")
    empty = F.array().cast("array<struct<pos:bigint,src:string,dst:string,weight:double>>")
    return explain.alert_report(rows.withColumn("path", F.coalesce("path", empty)))


def run(flows: DataFrame, settings: Settings = SETTINGS, resample: bool = False, trees: int | None = None, rounds: int | None = None) -> Artifacts:
    """Fits on train, chooses on validation, scores all three partitions."""
    ready, columns = prepare(flows, settings)
    part = {p: ready.where(F.col("partition") == p) for p in ("train", "val", "test")}
    train = part["train"]
    params = features.fit_scaler(train, columns, settings.outlier_percentile, settings.variance_floor).collect()  # one row a feature
    kept = [p["feature"] for p in params if p["kept"]]
    sets = {k: [c for c in v if c in kept] for k, v in features.model_feature_sets(columns).items()}
    weights = clean.class_weights(train)
    scaled = stored(features.scale(train, params, ["seq_no", "session_id", "label"]))
    fit = lambda names: models.with_index((models.smote(scaled, names, "seq_no") if resample else scaled).join(F.broadcast(weights.withColumnRenamed("label", "__l")), F.col("label") == F.col("__l")))  # noqa: E731 - 15 rows
    forest = models.Forest(sets["forest"], trees=trees or settings.tree_count).fit(fit(sets["forest"]), "weight")
    boosting = models.Boosting(sets["boosting"], rounds=rounds or settings.boost_rounds, depth=settings.boost_depth).fit(fit(sets["boosting"]), "weight")
    st = steps_of(train)
    labelled = models.index_sequences(st, settings.sequence_length).join(sessions.session_summary(train, "session_id", "us", "seq_no").select(F.col("session_id").alias("session"), "label"), "session")
    token_model = models.TokenModel().fit(models.with_index(labelled), clean.class_weight_array(weights))
    patterns = stored(mining.sequence_patterns(tokens.sequences(st), settings.sequence_support, settings.max_gap_s, settings.max_pattern_length, settings.max_patterns))
    pairs = stored(tokens.transitions(st))
    edges = stored(graph.graph_edges(st, settings.rho, pairs))
    mean_gap = pairs.agg(F.coalesce(F.avg("dt_s"), F.lit(1.0)).alias("m")).first()["m"]
    a = Artifacts(forest, token_model, boosting, params, edges, patterns, mean_gap, settings.lambdas[len(settings.lambdas) // 2], fusion.EQUAL, None, flows=part)
    val = session_table(part["val"], a, settings)
    a.decay = graph.select_lambda(val, F.col("is_attack") == 1, settings.lambdas)
    val = val.withColumn("tc_t", F.col(f"tc_{list(settings.lambdas).index(a.decay)}"))
    a.weights = fusion.calibrate(val.where(F.col("label").isin(*CLASSES)), grid=settings.fusion_grid)
    a.risk_model = fusion.fit_risk(score(val, a))
    a.tables = {p: score(val if p == "val" else session_table(part[p], a, settings), a) for p in part}
    return a
