"""The engine's own operators over the driver's flow tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.config import CLASSES, SETTINGS, TOKENS
from flowloom.functions.net import session_key
from flowloom.operators import ablation, clean, explain, features, fusion, graph, metrics, mining, models, sessions, tokens
from flowloom.plans import pipeline
from flowloom.runtime import generation, micros, stored
from flowloom.sources.schema import FEATURES
from flowloom.sources.tables import table
from flowloom.streaming import replay

WEIGHTS = fusion.FusionWeights(0.30, 0.35, 0.25, 0.05, 0.05)
GAP_S = 900.0


def r6(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def flows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "flow_records").withColumn("us", micros("timestamp"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return clean.known_labels(flows(spark, folder))


def tagged(spark: SparkSession, folder: str) -> DataFrame:
    """Steps of tagged sessions; session ids without letter case and surrounding white space."""
    t = table(spark, folder, "tagged_flows")
    name = F.lower(F.regexp_replace("session_id", r"(?U)^\s+|\s+$", ""))
    return t.where("session_id IS NOT NULL AND timestamp IS NOT NULL AND token IS NOT NULL").select(name.alias("session"), micros("timestamp").alias("us"), F.col("record_id").alias("seq_no"), "token", "label", "day", "partition", "destination_port")


def summary(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.session_summary(tagged(spark, folder), "session", "us", "seq_no")


def pseudo(seed: Column, m: int) -> Column:
    """Made-up probabilities of model m that any engine computes alike."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(len(CLASSES) - 1)), lambda k: F.pmod(seed * (7 + m) + k * 31 + m * 13, F.lit(97)) + 1)
    total = F.aggregate(raw, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.transform(raw, lambda x: x.cast("double") / total.cast("double"))


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions with summary and evidence: the steps are read twice, once for transitions and once for sessions."""
    steps = tagged(spark, folder)
    pairs = stored(tokens.transitions(steps))
    base = stored(sessions.session_summary(steps, "session", "us", "seq_no", "token"))
    own = base.select(F.col("session_id").alias("session"), F.col("start_us").alias("begin"), F.col("n_flows").alias("n"))
    edges = stored(graph.graph_edges(steps, pairs=pairs, begins=own.drop("n")))
    scores = graph.session_scores(steps, edges, pairs=pairs, sizes=own.drop("begin")).withColumnRenamed("session", "session_id").drop("n")
    return mining.item_scores(base).withColumnRenamed("fp_score", "sp_t").withColumnRenamed("first_seq", "seed").join(scores, "session_id")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions with made-up probabilities and real evidence."""
    rows = evidence(spark, folder).withColumn("tc_t", F.col("tc_0"))
    return stored(rows.withColumn("p_a", pseudo(F.col("seed"), 0)).withColumn("p_b", pseudo(F.col("seed"), 1)).withColumn("p_c", pseudo(F.col("seed"), 2)))


def fused(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.add_predictions(scored(spark, folder), WEIGHTS)


def fixed_risk(df: DataFrame) -> DataFrame:
    """A fixed linear risk in place of a fitted one."""
    risk = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.pmod(F.col("seed") * 37, F.lit(101)) / 100.0))
    return df.withColumn("risk", risk).withColumn("tier", fusion.tier(risk))


# projections, filters, counts


def flow_end_time(spark, d):
    return flows(spark, d).where("us IS NOT NULL").select("record_id", (F.col("us") + F.greatest(F.coalesce("flow_duration", F.lit(0)), F.lit(0))).alias("end_us"))


def session_key_symmetric(spark, d):
    t = table(spark, d, "flow_records")
    return t.select("record_id", session_key(t.columns).alias("built_key"))


def normalize_labels(spark, d):
    return flows(spark, d).groupBy(clean.normalize_label(F.col("label")).alias("class")).agg(F.count("*").alias("n"))


def unresolved_label_drop(spark, d):
    return flows(spark, d).groupBy(clean.normalize_label(F.col("label")).isin(*CLASSES).alias("kept")).agg(F.count("*").alias("n"))


def ts_multi_format(spark, d):
    raw = table(spark, d, "raw_flow_records")
    return clean.parse_times(raw, "timestamp", "parsed").select("record_id", micros("parsed").alias("us")).where("us IS NOT NULL")


def ts_whole_column(spark, d):
    raw = table(spark, d, "raw_flow_records")
    return clean.parse_times(raw, "timestamp", "parsed", "reference", "record_id").select("record_id", micros("parsed").alias("us"))


def ts_impute_clock(spark, d):
    t = clean.impute_times(table(spark, d, "flow_records").select("record_id", "day_order", "timestamp"), "record_id")
    return t.select("record_id", micros("timestamp").alias("us"))


def synthetic_clock(spark, d):
    t = table(spark, d, "flow_records").select("record_id", "day_order")
    return clean.synthetic_clock(t, "record_id").select("record_id", micros("timestamp").alias("us"))


def clean_inf_nan(spark, d):
    return clean.clean_data(flows(spark, d), list(FEATURES)).groupBy("day").agg(F.count("*").alias("n"), F.sum("record_id").cast("bigint").alias("ids"))


def split_counts(spark, d):
    return clean.tag_day(table(spark, d, "flow_records")).groupBy("day", "day_order", "partition").agg(F.count("*").alias("n"))


def label_day_counts(spark, d):
    return labelled(spark, d).groupBy("label", "day").agg(F.count("*").alias("n"))


def zero_shot_classes(spark, d):
    return clean.zero_shot_classes(labelled(spark, d).where("partition = 'train'"))


def limit_per_file(spark, d):
    return clean.first_rows_per_file(table(spark, d, "flow_records"), "source_file", "record_id", 100).select("source_file", "record_id")


def stratified_split_counts(spark, d):
    return clean.stratified_split(labelled(spark, d), "label", "record_id").groupBy("label", "partition").agg(F.count("*").alias("n"), F.sum("record_id").cast("bigint").alias("ids"))


def seeded_rows(spark, d):
    return clean.seed_zero_shot(labelled(spark, d), "label", "record_id").groupBy("label", "partition").agg(F.count("*").alias("n"), F.sum("record_id").cast("bigint").alias("ids"))


def class_weights(spark, d):
    return clean.class_weights(labelled(spark, d).where("partition = 'train'")).select("label", r6("weight").alias("weight"))


# sessions


def _spans(df):
    return df.groupBy("session_id").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n_flows"))


def sessions_with_cap(spark, d):
    return _spans(sessions.tag_sessions(flows(spark, d), "us", "flow_duration", "record_id"))


def sessions_gap_only(spark, d):
    return _spans(sessions.tag_sessions(flows(spark, d), "us", "flow_duration", "record_id", cap_s=10**9))


def sessions_fin_rst(spark, d):
    f = flows(spark, d)
    return _spans(sessions.tag_sessions_terminated(f, "us", "flow_duration", "record_id").join(f.select("record_id", "us"), "record_id"))


def session_size_hist(spark, d):
    return sessions_with_cap(spark, d).groupBy("n_flows").agg(F.count("*").alias("n_sessions"))


def sessions_flow_level(spark, d):
    return sessions.flow_level(table(spark, d, "flow_records"), "record_id").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("n_sessions"), F.min("session_id").alias("first_id"))


def session_summary(spark, d):
    return summary(spark, d).select("session_id", "day", "partition", "n_flows", "start_us", "end_us", "label", r6("duration_seconds").alias("duration_seconds"))


# tokens, transitions, graph


def tokens_encode(spark, d):
    return tokens.encode_events(table(spark, d, "flow_records")).select("record_id", "token")


def token_counts(spark, d):
    return tokens_encode(spark, d).groupBy("token").agg(F.count("*").alias("n"))


def token_rule_table(spark, d):
    return tokens.rule_table(spark)


def session_sequences(spark, d):
    return tokens.sequences(tagged(spark, d)).select("session", F.array_join(F.transform("seq", lambda x: x["token"]), ">").alias("tokens"))


def seq_last_n_indices(spark, d):
    return models.index_sequences(tagged(spark, d)).select("session", F.array_join("ids", ",").alias("ids"))


def transitions(spark, d):
    return tokens.transitions(tagged(spark, d)).select("session", "pos", "src", "dst", r6("dt_s").alias("dt_s"))


def transition_counts(spark, d):
    return tokens.transitions(tagged(spark, d)).groupBy("src", "dst").agg(F.count("*").alias("n"))


def _edges(spark, d, part=None):
    steps = tagged(spark, d)
    return graph.graph_edges(steps.where(F.col("partition") == part) if part else steps)


def graph_edges_ema(spark, d):
    return _edges(spark, d, "train").select("src", "dst", r6("weight").alias("weight"))


def graph_edges_incremental(spark, d):
    """Built on earlier sessions, then brought up to date with later ones."""
    steps = tagged(spark, d)
    begin = steps.groupBy(F.col("session").alias("s")).agg(F.min("us").alias("begin"))
    cut = begin.agg(F.avg("begin").cast("bigint").alias("cut"))
    marked = steps.join(begin.join(F.broadcast(cut)), F.col("session") == F.col("s")).withColumn("late", F.col("begin") > F.col("cut"))  # one row
    names = ("session", "us", "seq_no", "token")
    old = graph.graph_edges(marked.where(~F.col("late")).select(*names))
    return graph.update_edges(old, marked.where("late").select(*names)).select("src", "dst", r6("weight").alias("weight"))


def graph_full(spark, d):
    return graph.full_graph(spark, _edges(spark, d, "train")).select("src", "dst", r6("weight").alias("weight"))


def edge_weight_lookup(spark, d):
    """The weights of all pairs of tokens, and of one no session has."""
    grid = spark.createDataFrame([(t,) for t in (*TOKENS, "NEVER_SEEN")], "src string").withColumn("dst", F.explode(F.lit(list(TOKENS))))
    return graph.edge_weight(grid, _edges(spark, d, "train")).select("src", "dst", r6("weight").alias("weight"))


def _scores(spark, d):
    return graph.session_scores(tagged(spark, d), _edges(spark, d))


def tc_t(spark, d):
    return _scores(spark, d).select("session", r6("tc_2").alias("tc_t"))


def tc_t_lambda_sweep(spark, d):
    return _scores(spark, d).select("session", *[r6(f"tc_{i}").alias(f"tc_{i}") for i in range(5)])


def g_w(spark, d):
    return _scores(spark, d).select("session", r6("g_w").alias("g_w"))


def graph_paths(spark, d):
    return graph.paths(tagged(spark, d), _edges(spark, d))


def lambda_auc(spark, d):
    rows = evidence(spark, d).where("label IS NOT NULL")
    areas = graph.aucs(rows, {str(x): f"tc_{i}" for i, x in enumerate(SETTINGS.lambdas)}, F.col("label") != "BENIGN")
    return areas.select(F.col("name").cast("double").alias("decay"), r6("auc").alias("auc"), "n_pos", "n_neg")


def mean_gap(spark, d):
    return _scores(spark, d).select("session", F.round("mean_gap_s", 3).alias("mean_gap_s"))


def pooled_gap(spark, d):
    return tokens.transitions(tagged(spark, d)).agg(r6(F.coalesce(F.avg("dt_s"), F.lit(1.0))).alias("pooled_gap"))


def inv_dt_norm(spark, d):
    pooled = tokens.transitions(tagged(spark, d).where("partition = 'train'")).agg(F.coalesce(F.avg("dt_s"), F.lit(1.0)).alias("m"))
    return _scores(spark, d).join(F.broadcast(pooled)).select("session", r6(fusion.normalized_gap(F.col("mean_gap_s"), F.col("m"))).alias("inv_dt_norm"))  # one row


# features


def _params(spark, d):
    return features.fit_scaler(table(spark, d, "flow_records").where("partition = 'train'"), list(FEATURES))


def clip_bounds(spark, d):
    return _params(spark, d).select("feature", r6("lo").alias("lo"), r6("hi").alias("hi"))


def scaler_params(spark, d):
    return _params(spark, d).select("feature", r6("median").alias("median"), r6("low").alias("low"), r6("high").alias("high"))


def variance_filter(spark, d):
    return _params(spark, d).select("feature", "kept")


def scaled_features(spark, d):
    """All features, those that are not kept as null."""
    out = features.scale(table(spark, d, "flow_records"), _params(spark, d).collect(), ["record_id"])
    return out.select("record_id", *[r6(c).alias(c) if c in out.columns else F.lit(None).cast("double").alias(c) for c in FEATURES])


def feature_groups(spark, d):
    g = features.feature_groups(features.candidate_features(table(spark, d, "flow_records")))
    sets = features.model_feature_sets(list(g))
    return spark.createDataFrame([(c, x, c in sets["forest"], c in sets["boosting"]) for c, x in g.items()], "feature string, grp string, forest boolean, boosting boolean")


def mi_binned(spark, d):
    out = features.mutual_information(labelled(spark, d), list(FEATURES), "label")
    return out.select("feature", r6("mi").alias("mi"))


# mining


def fp_singletons(spark, d):
    s = tagged(spark, d)
    n = s.agg(F.countDistinct("session").alias("n"))
    return s.select("session", "token").distinct().groupBy("token").agg(F.count("*").alias("freq")).join(F.broadcast(n)).select("token", "freq", r6(F.col("freq") / F.col("n")).alias("support"))  # one row


def fp_itemsets_all(spark, d):
    items = tagged(spark, d).groupBy("session").agg(F.collect_set("token").alias("items"))  # 10 tokens at most
    return mining.itemsets(items).select(F.array_join("items", ",").alias("items"), "freq", r6("support").alias("support"))


def fp_match_score(spark, d):
    return mining.fp_match(tagged(spark, d), SETTINGS.itemset_support).select("session", r6("fp_score").alias("fp_score"))


def seq_pairs_support(spark, d):
    s = tagged(spark, d).select("session", "token", F.struct("us", "seq_no").alias("at")).groupBy("session", "token").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    both = s.select("session", F.col("token").alias("a"), "first").join(s.select("session", F.col("token").alias("b"), "last"), "session").where("first < last")
    return both.groupBy("a", "b").agg(F.count("*").alias("freq"))


def gap_match(spark, d):
    seqs = tokens.sequences(tagged(spark, d))
    want = ["SESSION_ESTABLISHED", "DATA_TRANSFER", "CONNECTION_TERMINATION"]
    return seqs.select("session", mining.gap_match(F.col("seq"), want, F.lit(3), 60.0).alias("matched"))


def prefixspan_full(spark, d):
    found = mining.sequence_patterns(tokens.sequences(tagged(spark, d)), SETTINGS.sequence_support, GAP_S)
    return found.select(F.array_join("pattern", ">").alias("pattern"), "freq", r6("support").alias("support"))


def sp_t(spark, d):
    steps = tagged(spark, d)
    seqs = tokens.sequences(steps)
    found = mining.sequence_patterns(seqs, SETTINGS.sequence_support, GAP_S)
    return mining.sp_t(mining.fp_match(steps), mining.sequence_match(seqs, found, GAP_S)).select("session", r6("sp_t").alias("sp_t"))


# fusion and risk


def prob_mean_by_session(spark, d):
    p = tagged(spark, d).withColumn("p", pseudo(F.col("seq_no"), 0))
    means = p.groupBy("session").agg(*[r6(F.avg(F.col("p")[i])).alias(f"p_{i}") for i in range(len(CLASSES))])
    return means


def fuse_scores(spark, d):
    return fused(spark, d).select("session_id", *[r6(F.col("r")[i]).alias(f"r_{i}") for i in range(len(CLASSES))])


def fused_prediction(spark, d):
    return fused(spark, d).select("session_id", r6("r_max").alias("r_max"), "predicted_class")


def fusion_grid(spark, d):
    w = fusion.calibrate(scored(spark, d).where(F.col("partition") == "val"))
    return spark.createDataFrame([tuple(round(x, 6) for x in (w.a, w.b, w.c, w.s, w.t))], "a double, b double, c double, s double, t double")


def risk_meta_features(spark, d):
    pooled = tokens.transitions(tagged(spark, d)).agg(F.coalesce(F.avg("dt_s"), F.lit(1.0)).alias("m"))
    f = fused(spark, d).join(F.broadcast(pooled))  # one row
    meta = fusion.meta_features(F.col("r_max"), F.col("sp_t"), F.col("tc_t"), F.col("g_w"), fusion.normalized_gap(F.col("mean_gap_s"), F.col("m")))
    return f.select("session_id", *[r6(meta[i]).alias(f"m_{i}") for i in range(5)])


def risk_tiers(spark, d):
    return fixed_risk(scored(spark, d)).groupBy("tier").agg(F.count("*").alias("n"))


def smote_targets(spark, d):
    return models.smote_targets(labelled(spark, d).where("partition = 'train'"))


# metrics


def confusion(spark, d):
    return metrics.confusion(fused(spark, d))


def per_class_report(spark, d):
    return metrics.class_report(fused(spark, d)).select("class", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), F.col("support").cast("bigint").alias("support"))


def macro_f1(spark, d):
    return metrics.macro_f1(fused(spark, d)).select(r6("macro_f1").alias("macro_f1"))


def macro_f1_present(spark, d):
    return metrics.macro_f1_present(fused(spark, d)).select(r6("macro_f1_present").alias("macro_f1_present"))


def fpr(spark, d):
    return metrics.false_positive_rate(fused(spark, d)).select(r6("fpr").alias("fpr"))


def pr_auc(spark, d):
    return metrics.average_precision(scored(spark, d).where("label IS NOT NULL"), "p_a").select("class", r6("ap").alias("ap"))


def mcnemar(spark, d):
    s = scored(spark, d).where("label IS NOT NULL").withColumn("a", fusion.first_best(F.col("p_a"))).withColumn("b", fusion.first_best(F.col("p_b")))
    return metrics.mcnemar(s, "label", "a", "b").select("b", "c", r6("statistic").alias("statistic"), r6("p_value").alias("p_value"))


def bootstrap_ci(spark, d):
    return metrics.bootstrap_ci(fused(spark, d))


# streaming, explanations, ablation


def _replayed(spark, d):
    s = summary(spark, d)
    risk = tagged(spark, d).groupBy(F.col("session").alias("session_id")).agg(F.min("seq_no").alias("seed")).withColumn("risk", F.pmod(F.col("seed") * 37, F.lit(101)) / 100.0)
    return replay.replay(s, risk)


def stream_assign_windows(spark, d):
    return replay.assign_windows(summary(spark, d)).select("session_id", "window_start_us")


def stream_window_counts(spark, d):
    return replay.assign_windows(summary(spark, d)).groupBy("window_start_us").agg(F.count("*").alias("n_sessions"))


def stream_n_windows(spark, d):
    return replay.window_count(summary(spark, d))


def early_detection(spark, d):
    return replay.early_detection(_replayed(spark, d)).select(F.round("mean_latency", 3).alias("mean_latency"), F.round("median_latency", 3).alias("median_latency"), "n_detected")


def missed_sessions(spark, d):
    return replay.missed(summary(spark, d), _replayed(spark, d)).select("session_id")


def _explained(spark, d):
    steps = tagged(spark, d)
    edges = graph.graph_edges(steps)
    path = graph.edge_weight(tokens.transitions(steps), edges).groupBy(F.col("session").alias("session_id")).agg(F.sort_array(F.collect_list(F.struct("pos", "src", "dst", "weight"))).alias("path"))
    f = fixed_risk(fused(spark, d)).join(path, "session_id", "left")
    empty = F.array().cast("array<struct<pos:bigint,src:string,dst:string,weight:double>>")
    top = lambda name, v: F.array(F.struct(F.lit(name).alias("name"), v.alias("value")))
    return f.select("session_id", "risk", "tier", "predicted_class", top("flow_duration", F.col("risk") - 0.5).alias("forest_top"), top("syn_flag_count", 0.25 - F.col("risk")).alias("boosting_top"), top(TOKENS[0], F.col("risk")).alias("token_top"), F.coalesce("path", empty).alias("path"), "sp_t", "tc_t")


def alert_report_text(spark, d):
    return explain.alert_report(_explained(spark, d))


def ablation_compare(spark, d):
    s = scored(spark, d)
    runs = {"full": fusion.add_predictions(s, WEIGHTS), "no_patterns": ablation.refuse(ablation.without_patterns(s), WEIGHTS), "no_graph": ablation.refuse(ablation.without_graph(s), WEIGHTS), "equal_weights": ablation.refuse(s, fusion.EQUAL)}
    out = ablation.compare(runs)
    return out.select("run", *[r6(c).alias(c) for c in out.columns if c != "run"])


def attack_alerts(spark, d):
    return fixed_risk(scored(spark, d)).where("tier = 'ATTACK'").select("session_id", r6("risk").alias("risk"))


def sample_rows(spark, d):
    return clean.sample_rows(table(spark, d, "flow_records"), "record_id", 250).select("record_id")


def top_attributions(spark, d):
    """The two largest attributions of each flow, of three made ones."""
    t = table(spark, d, "flow_records")
    made = F.create_map(F.lit("fwd"), F.col("total_fwd_packets") - 5.0, F.lit("bwd"), F.col("total_backward_packets") - 4.0, F.lit("win"), F.coalesce("init_win_bytes_backward", F.lit(0)) / 4096.0 - 1.0)
    return t.select("record_id", explain.listed(explain.top_attributions(made, 2)).alias("top"))


# fitted models (checked by invariants)


def _trained(spark, d):
    ready, columns = pipeline.prepare(flows(spark, d).drop("us"))
    train = ready.where("partition = 'train'")
    params = features.fit_scaler(train, columns).collect()
    kept = [p["feature"] for p in params if p["kept"]]
    return ready, columns, params, kept


def _proba(df, column, keep):
    return df.select(*keep, *[r6(F.col(column)[i]).alias(f"p_{i}") for i in range(len(CLASSES))])


def _forest(spark, d, kind):
    """A model of flows with class weights, fitted on train, and the scaled flows."""
    ready, _, params, kept = _trained(spark, d)
    names = features.model_feature_sets(kept)["forest" if kind is models.Forest else "boosting"]
    weights = clean.class_weights(ready.where("partition = 'train'")).withColumnRenamed("label", "__l")
    scaled = stored(features.scale(ready, params, ["seq_no", "label", "partition"]))
    rows = models.with_index(scaled.where("partition = 'train'")).join(F.broadcast(weights), F.col("label") == F.col("__l"))  # 15 rows
    return kind(names).fit(rows, "weight"), scaled


def rf_probs(spark, d):
    model, scaled = _forest(spark, d, models.Forest)
    return _proba(model.predict(scaled.select("seq_no", *model.features), "p_a"), "p_a", ["seq_no"])


def gbt_probs(spark, d):
    model, scaled = _forest(spark, d, models.Boosting)
    return _proba(model.predict(scaled.select("seq_no", *model.features), "p_c"), "p_c", ["seq_no"])


def token_model_probs(spark, d):
    rows = models.index_sequences(tagged(spark, d)).join(summary(spark, d).select(F.col("session_id").alias("session"), "label", "partition"), "session")
    train = rows.where("partition = 'train'")
    model = models.TokenModel().fit(models.with_index(train), clean.class_weight_array(clean.class_weights(train)))
    return _proba(model.predict(rows), "p_b", ["session"])


def logistic_risk(spark, d):
    f = fused(spark, d).where("label IS NOT NULL").withColumn("is_attack", (F.col("label") != "BENIGN").cast("int")).withColumn("meta", fusion.meta_features(F.col("r_max"), F.col("sp_t"), F.col("tc_t"), F.col("g_w"), F.lit(1.0) / (F.col("mean_gap_s") + 1)))
    return fusion.predict_risk(fusion.fit_risk(f), f).select("session_id", r6("risk").alias("risk"), "tier")


def smote_rows(spark, d):
    rows = clean.clean_data(labelled(spark, d).where("partition = 'train'"), list(FEATURES))
    return models.smote(rows, list(FEATURES), "record_id").groupBy("label").agg(F.count("*").alias("n"))


def tree_explain(spark, d):
    model, scaled = _forest(spark, d, models.Forest)
    return model.explain(scaled.select("seq_no", *model.features)).select("seq_no", explain.listed(F.col("top")).alias("top"))


_last_run: dict = {}


def _run(spark, d):
    """The run over a folder's flows; the queries below are views of one run, so the last one is kept while its tables are."""
    key = (*generation(spark), d)
    if key not in _last_run:
        made = pipeline.run(flows(spark, d).drop("us"))
        _last_run.clear()
        _last_run[key] = made
    artifacts = _last_run[key]
    parts = [t.withColumn("partition", F.lit(p)) for p, t in artifacts.tables.items()]
    return artifacts, parts[0].unionByName(parts[1]).unionByName(parts[2])


def pipeline_run(spark, d):
    """The whole run with the settings' models and supports over all three partitions."""
    return _run(spark, d)[1].select("session_id", "partition", "predicted_class", r6("risk").alias("risk"), "tier")


def pipeline_checks(spark, d):
    """One row of what must hold for the whole run: sessions once each, probabilities and fusion add up, tiers follow risk, the risk model's gradient is zero."""
    a, rows = _run(spark, d)
    w = a.weights
    one = lambda c: F.abs(F.aggregate(c, F.lit(0.0), lambda s, x: s + x) - 1) < 1e-6
    again = fusion.fuse(F.col("p_a"), F.col("p_b"), F.col("p_c"), F.col("sp_t"), F.col("tc_t"), w)
    same = F.forall(F.zip_with(again, F.col("r"), lambda x, y: F.abs(x - y) < 1e-9), lambda x: x)
    val = rows.where("partition = 'val'")
    off = val.select(*[((F.col("risk") - F.col("is_attack")) * m).alias(f"g{i}") for i, m in enumerate([F.lit(1.0), F.col("r_max"), F.col("sp_t"), F.col("tc_t"), F.col("g_w"), F.col("inv_dt_norm")])])
    slope = off.agg(*[F.sum(c).alias(c) for c in off.columns]).first()
    coef = [0.0, *a.risk_model.coefficients.toArray().tolist()]
    flat = all(abs(slope[f"g{i}"] + coef[i]) < 1e-3 * max(1, val.count()) for i in range(6))
    return rows.agg(
        (F.count("*") == F.countDistinct("session_id")).alias("sessions_once"), F.bool_and(one("p_a") & one("p_b") & one("p_c")).alias("probabilities_add_up"), F.bool_and(same).alias("fusion_adds_up"),
        F.bool_and(F.col("r_max") == F.array_max("r")).alias("greatest_chosen"), F.bool_and(F.col("tier") == fusion.tier(F.col("risk"))).alias("tiers_follow"), F.bool_and(F.col("risk").between(0, 1) & F.col("sp_t").between(0, 1)).alias("within_bounds"), F.lit(flat).alias("risk_fitted"),
    )


def pipeline_sessions(spark, d):
    """Sessions, flows and attacks of each partition in the run's tables."""
    return _run(spark, d)[1].groupBy("partition").agg(F.count("*").alias("n_sessions"), F.sum("n_flows").cast("bigint").alias("n_flows"), F.sum("is_attack").cast("bigint").alias("n_attacks"))


def pipeline_reports(spark, d):
    """Reports of the run's sessions of the upper two tiers, from the fitted models."""
    artifacts, _ = _run(spark, d)
    return pipeline.reports(artifacts, "test")


NAMES = (
    "flow_end_time session_key_symmetric normalize_labels unresolved_label_drop ts_multi_format ts_whole_column ts_impute_clock synthetic_clock clean_inf_nan split_counts label_day_counts zero_shot_classes "
    "limit_per_file stratified_split_counts seeded_rows class_weights sessions_with_cap sessions_gap_only sessions_fin_rst session_size_hist sessions_flow_level session_summary tokens_encode token_counts "
    "token_rule_table session_sequences seq_last_n_indices transitions transition_counts graph_edges_ema graph_edges_incremental graph_full edge_weight_lookup tc_t tc_t_lambda_sweep g_w graph_paths lambda_auc mean_gap pooled_gap "
    "inv_dt_norm clip_bounds scaler_params variance_filter scaled_features feature_groups mi_binned fp_singletons fp_itemsets_all fp_match_score seq_pairs_support gap_match prefixspan_full sp_t "
    "prob_mean_by_session fuse_scores fused_prediction fusion_grid risk_meta_features risk_tiers smote_targets confusion per_class_report macro_f1 macro_f1_present fpr pr_auc mcnemar bootstrap_ci "
    "stream_assign_windows stream_window_counts stream_n_windows early_detection missed_sessions alert_report_text attack_alerts sample_rows top_attributions ablation_compare rf_probs gbt_probs token_model_probs logistic_risk smote_rows tree_explain pipeline_run pipeline_checks pipeline_sessions pipeline_reports"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
