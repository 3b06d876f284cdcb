"""Hand goldens of the engine's semantics."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowloom.config import CLASSES
from flowloom.functions.names import normalize_name
from flowloom.functions.net import session_key
from flowloom.operators import clean, features, fusion, graph, metrics, mining, models, sessions, tokens
from flowloom.plans import flow_queries
from flowloom.streaming import replay
from tests.conftest import DATA, rows

US = 1_000_000


def flows(spark, starts, durations=None, flags=None, key="k"):
    durations = durations or [0] * len(starts)
    data = [(i, "Monday", key, s * US, d * US, (flags or {}).get(i, 0), 0) for i, (s, d) in enumerate(zip(starts, durations, strict=True))]
    return spark.createDataFrame(data, "record_id long, day string, session_key string, us long, flow_duration long, rst_flag_count long, fin_flag_count long")


def numbers(df):
    return [int(r["session_id"].rsplit("__s", 1)[1]) for r in df.orderBy("record_id").collect()]


def test_names():
    assert normalize_name("  Destination Port ") == "destination_port"
    assert normalize_name("Flow Bytes/s") == "flow_bytes_s"
    assert normalize_name(None) == ""


def test_duplicate_names_keep_the_first(spark):
    df = clean.normalize_columns(spark.createDataFrame([(1, 2, 3)], ["A b", "a_B", "c"]))
    assert df.columns == ["a_b", "c"] and df.first()[0] == 1


def test_labels(spark):
    raw = ["FTP-Patator", "Web Attack – XSS", "dos", "", "Web Attack XSS", None, "web attack sql injection", "botnet", "Web Attack \x96 Brute Force"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "label string").select(clean.normalize_label(F.col("label"))).collect()]
    assert got == ["FTP-Patator", "Web Attack - XSS", "DoS Hulk", "BENIGN", "Web Attack XSS", "MISSING_LABEL", "Web Attack - Sql Injection", "Bot", "Web Attack - Brute Force"]
    assert clean.known_labels(spark.createDataFrame([(x,) for x in raw], "label string")).count() == 7


def test_session_key_is_symmetric(spark):
    df = spark.createDataFrame([("10.0.0.1", "10.0.0.2", 5000, 22, 6), ("10.0.0.2", "10.0.0.1", 22, 5000, 6), ("fe80::1", None, 1, 2, 6)], "source_ip string, destination_ip string, source_port long, destination_port long, protocol long")
    got = [r[0] for r in df.select(session_key(df.columns)).collect()]
    assert got[0] == got[1] == "167772161_167772162_6_22_5000" and got[2]
    with pytest.raises(KeyError):
        session_key(["source_ip"])
    six = spark.createDataFrame([("2001:DB8::1", "::ffff:10.0.0.1", 1, 2, 6), ("::ffff:10.0.0.1", "2001:db8:0:0:0:0:0:1", 2, 1, 6), ("1::2::3", ":::", 1, 2, 6)], df.schema)
    got = [r[0] for r in six.select(session_key(six.columns)).collect()]
    assert got[0] == got[1] == "00000000000000000000ffff0a000001_20010db8000000000000000000000001_6_1_2" and got[2].count("_") == 4


def test_sessions(spark):
    tag = lambda *a, **k: numbers(sessions.tag_sessions(flows(spark, *a), "us", "flow_duration", "record_id", **k))
    assert tag([0, 60, 121, 150]) == [0, 0, 1, 1]
    assert tag([0, 100, 200], [95, 1, 0]) == [0, 0, 1]
    assert tag([0, 10, 100], [500, 1, 0]) == [0, 0, 1]
    assert tag([0, 1000, 3000, 3700, 7200, 7400], gap_s=10**6) == [0, 0, 0, 1, 1, 2]


def test_resets_split_only_with_the_flag(spark):
    df = flows(spark, list(range(0, 80, 10)), flags={i: 1 for i in range(5)})
    assert set(numbers(sessions.tag_sessions(df, "us", "flow_duration", "record_id"))) == {0}
    assert numbers(sessions.tag_sessions_terminated(df, "us", "flow_duration", "record_id")) == [0, 1, 2, 3, 4, 5, 5, 5]


def naive(points, gap, cap):
    out, start, end, n = [], None, None, -1
    for t, d in points:
        if start is None or t - end > gap or t - start > cap:
            start, n = t, n + 1
        end = t + max(d, 0)
        out.append(n)
    return out


def test_sessions_against_the_loop(spark):
    rnd = random.Random(5)
    data, want, i = [], {}, 0
    for g in range(40):
        t, pts = 0, []
        for _ in range(rnd.randint(1, 40)):
            t += rnd.choice([0, 0, 5, 30, 60, 61, 200, 900])
            pts.append((t * US, rnd.choice([0, -5, 10, 100, 2000]) * US))
        for (a, d), n in zip(pts, naive(pts, 60 * US, 1800 * US), strict=True):
            data.append((i, "d", f"g{g}", a, d))
            want[i] = n
            i += 1
    df = spark.createDataFrame(data, "record_id long, day string, session_key string, us long, flow_duration long")
    a = sessions.tag_sessions(df, "us", "flow_duration", "record_id", 60, 1800)
    b = sessions.tag_sessions_terminated(df, "us", "flow_duration", "record_id", 60, 1800)
    for out in (a, b):
        assert {r["record_id"]: int(r["session_id"].rsplit("__s", 1)[1]) for r in out.collect()} == want


def token_of(spark, **v):
    base = dict(total_fwd_packets=0, total_backward_packets=0, total_length_of_fwd_packets=0, total_length_of_bwd_packets=0, syn_flag_count=0, ack_flag_count=0, rst_flag_count=0, fin_flag_count=0, flow_packets_s=0.0, destination_port=80, flow_duration=10**6)
    df = spark.createDataFrame([tuple((base | v).values())], ", ".join(f"{k} {'double' if k == 'flow_packets_s' else 'long'}" for k in base))
    return tokens.encode_events(df).first()["token"]


def test_token_rules(spark):
    assert token_of(spark, rst_flag_count=1, total_fwd_packets=1, destination_port=22) == "FORCED_TERMINATION"
    assert token_of(spark, rst_flag_count=1, total_fwd_packets=1, destination_port=22, syn_flag_count=1, flow_duration=50_000) == "SCAN_ACTIVITY"
    assert token_of(spark, destination_port=22, total_fwd_packets=5, total_backward_packets=5, ack_flag_count=1, total_length_of_fwd_packets=500) == "AUTH_SUCCESS"
    assert token_of(spark, flow_packets_s=float("nan"), total_fwd_packets=9) == "CONNECTION_ATTEMPT"
    assert token_of(spark, destination_port=None, total_fwd_packets=1, total_backward_packets=1, total_length_of_fwd_packets=600) == "DATA_TRANSFER"


def seq(spark, *pairs):
    return spark.createDataFrame([([(t * US, i, c) for i, (c, t) in enumerate(pairs)],)], "seq array<struct<us: long, seq_no: int, token: string>>")


def test_gap_match_is_greedy(spark):
    hit = lambda pat, *p: seq(spark, *p).select(mining.gap_match(F.col("seq"), list(pat), F.lit(len(pat)), 900)).first()[0]
    assert not hit("AB", ("A", 0), ("A", 1000), ("B", 1100))
    assert hit("AA", ("A", 0), ("A", 1000), ("A", 1100))
    assert hit("AB", ("A", 0), ("B", 900))
    assert not hit("AB", ("B", 0))


def steps(spark, sess):
    return spark.createDataFrame([(s, i * 10 * US, i, t) for s, ts in sess.items() for i, t in enumerate(ts)], "session string, us long, seq_no long, token string")


def test_moving_average(spark):
    edges = {(r["src"], r["dst"]): r["weight"] for r in graph.graph_edges(steps(spark, {"s1": "axax"[:2], "s2": ["a", "y"], "s3": ["a", "x"]})).collect()}
    del edges  # three sessions of one transition each, ordered by begin and session
    w = {(r["src"], r["dst"]): r["weight"] for r in graph.graph_edges(steps(spark, {"s1": ["a", "x"], "s2": ["a", "y"], "s3": ["a", "x"]})).collect()}
    assert w["a", "x"] == pytest.approx(0.181) and w["a", "y"] == pytest.approx(0.09)


def test_moving_average_has_no_end(spark):
    """At a slow decay the 400th last transition still counts, and an edge last seen long ago keeps its row."""
    rnd = random.Random(3)
    sess = {f"s{i:03d}": [rnd.choice("abc") for _ in range(rnd.choice([2, 40]))] for i in range(60)}
    sess = {"s": ["a", "z"]} | sess
    data = [(s, i * 10**9 + j, j, t) for i, (s, ts) in enumerate(sess.items()) for j, t in enumerate(ts)]
    got = {(r["src"], r["dst"]): r["weight"] for r in graph.graph_edges(spark.createDataFrame(data, "session string, us long, seq_no long, token string"), 0.99).collect()}
    want = {}
    for ts in sess.values():
        for a, b in zip(ts, ts[1:], strict=False):
            want = {k: v * 0.99 if k[0] == a else v for k, v in want.items()}
            want[a, b] = want.get((a, b), 0) + 0.01
    assert got == pytest.approx(want) and got["a", "z"] > 0


def test_edge_weights_and_scores(spark):
    e = spark.createDataFrame([("a", "b", 0.2), ("b", "c", 0.4)], "src string, dst string, weight double")
    p = spark.createDataFrame([("z", "a"), ("a", "z"), ("a", "b")], "src string, dst string")
    assert [r["weight"] for r in graph.edge_weight(p, e).orderBy("src", "dst").collect()] == [0.2, 0.0, 0.05]
    st = spark.createDataFrame([("s", 0, 0, "a"), ("s", 0, 1, "b"), ("s", 10 * US, 2, "c"), ("one", 0, 3, "a")], "session string, us long, seq_no long, token string")
    got = {r["session"]: r for r in graph.session_scores(st, e, (0.1,)).collect()}
    assert got["s"]["tc_0"] == pytest.approx(0.173576, abs=1e-6) and got["s"]["g_w"] == pytest.approx(0.3)
    assert (got["one"]["tc_0"], got["one"]["g_w"], got["one"]["mean_gap_s"]) == (0.5, 0.5, 0.0)


def test_class_weights(spark):
    df = spark.createDataFrame([("BENIGN",)] * 90 + [("Bot",)] * 10, "label string")
    w = {r["label"]: r["weight"] for r in clean.class_weights(df).collect()}
    assert w["BENIGN"] == pytest.approx(0.074074, abs=1e-6) and w["Bot"] == pytest.approx(0.666667, abs=1e-6) and w["DDoS"] == 1.0
    rare = spark.range(2998).select(F.lit("BENIGN").alias("label")).union(spark.createDataFrame([("Bot",)] * 2, "label string"))
    assert {r["label"]: r["weight"] for r in clean.class_weights(rare).collect()}["Bot"] == 50


def test_smote_targets(spark):
    n = {"BENIGN": 10000, "Bot": 200, "DDoS": 50, "PortScan": 49}
    df = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("n")) for k, v in n.items()])).alias("x")).select("x.label", F.explode(F.sequence(F.lit(1), F.col("x.n"))))
    assert {r["label"]: r["target"] for r in models.smote_targets(df).collect()} == {"Bot": 1000, "DDoS": 300}


def test_cleaning_sees_the_whole_pool(spark):
    wide = spark.range(6000).select("id", F.lit("BENIGN").alias("label"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    rare = spark.range(60).select((F.col("id") + 6000).alias("id"), F.lit("Bot").alias("label"), (F.rand(3) + 100).alias("x"), F.rand(4).alias("y"))
    got = models.smote(wide.unionByName(rare), ["x", "y"], "id", block=8).groupBy("label").count()
    assert {r["label"]: r["count"] for r in got.collect()} == {"BENIGN": 6000, "Bot": 360}


@pytest.mark.parametrize("cell", [40, 4096])
def test_own_class_share_against_brute_force(spark, cell):
    import numpy as np

    from flowloom.operators.nearest import own_class_share

    rnd = random.Random(5)
    pool = [(rnd.choice("aab"), float(rnd.choice([0, 0, rnd.gauss(0, 1), rnd.randint(0, 3)])), float(rnd.choice([0, rnd.gauss(0, 50)])), float(rnd.randint(0, 2))) for _ in range(900)]
    asked = [(i, *r) for i, r in enumerate(pool[:250])]
    df = spark.createDataFrame(pool, "label string, x double, y double, z double").repartition(3)
    got = own_class_share(spark.createDataFrame(asked, "__id long, label string, x double, y double, z double"), df, ["x", "y", "z"], 4, cell)
    p, labels = np.array([r[1:] for r in pool]), np.array([r[0] for r in pool])
    want = {}
    for i, c, *q in asked:
        d = ((p - np.array(q)) ** 2).sum(axis=1)
        want[i] = (labels[np.lexsort((labels != c, d))[:4]] == c).mean()
    assert {r["__id"]: r["share"] for r in got.collect()} == want and len(set(want.values())) > 2


def test_tiers_windows_mcnemar(spark):
    got = [r[0] for r in spark.createDataFrame([(0.3499,), (0.35,), (0.75,)], "r double").select(fusion.tier(F.col("r"))).collect()]
    assert got == ["BENIGN", "SUSPICIOUS", "ATTACK"]
    s = spark.createDataFrame([("a", 0, 0), ("b", 65 * US, 65 * US), ("c", 130 * US, 130 * US)], "session_id string, start_us long, end_us long")
    assert [r["window_start_us"] // US for r in replay.assign_windows(s).orderBy("session_id").collect()] == [0, 10, 80]
    assert metrics.mcnemar_test(0, 0) == (0.0, 1.0) and metrics.mcnemar_test(30, 10)[0] == pytest.approx(9.025)


def test_itemset_score(spark):
    st = steps(spark, {"1": ["a", "b"], "2": ["a"], "3": ["c"]})
    assert {r["session"]: r["fp_score"] for r in mining.fp_match(st, 0.3).collect()}["1"] == pytest.approx(2 / 3)


def test_fusion_grid_cannot_change_the_class(spark):
    rnd = random.Random(2)
    data = [(CLASSES[i % 4], *[[rnd.random() for _ in CLASSES] for _ in range(3)], rnd.random(), rnd.random()) for i in range(60)]
    df = spark.createDataFrame(data, "label string, p_a array<double>, p_b array<double>, p_c array<double>, sp_t double, tc_t double")
    w = fusion.calibrate(df)
    assert (w.s, w.t) == (0.0, 0.0) and w.a + w.b + w.c == pytest.approx(1)


def test_feature_groups():
    from flowloom.sources.schema import FEATURES

    g = features.feature_groups([f for f in FEATURES if f != "fwd_header_length_1"])
    assert {x: list(g.values()).count(x) for x in "ABCD"} == {"A": 39, "B": 16, "C": 9, "D": 8}


def test_scaling_within_bounds(spark):
    df = spark.createDataFrame([(float(i),) for i in range(200)] + [(None,), (float("inf"),), (float("nan"),)], "x double")
    p = features.fit_scaler(df, ["x"]).collect()
    got = [r["x"] for r in features.scale(df, p, []).collect()]
    assert all(0 <= v <= 1 for v in got)


def test_sequence_patterns_against_brute_force(spark):
    from collections import Counter
    from itertools import combinations

    rnd = random.Random(7)
    sess = {f"s{i}": [(rnd.choice("abc"), 0) for _ in range(rnd.randint(1, 7))] for i in range(25)}
    data, times = [], {}
    for s, toks in sess.items():
        t = 0
        times[s] = []
        for c, _ in toks:
            t += rnd.choice([100, 800, 1000])
            times[s].append((t, c))
            data.append((s, t * US, len(data), c))
    seqs = tokens.sequences(spark.createDataFrame(data, "session string, us long, seq_no long, token string"))

    def matched(seq, pat):
        p, last = 0, 0
        for t, c in seq:
            if p < len(pat) and c == pat[p]:
                if p and t - last > 900:
                    p, last = (1, t) if c == pat[0] else (0, 0)
                else:
                    p, last = p + 1, t
        return p == len(pat)

    freq = Counter()
    for seq in times.values():
        freq.update({tuple(c for _, c in x) for k in (2, 3) for x in combinations(seq, k)})
    top = sorted(((-n, p) for p, n in freq.items() if n >= 8))[:10]
    want = {(p, -n, sum(matched(s, p) for s in times.values()) / 25) for n, p in top}
    want = {w for w in want if w[2] >= 0.3}
    found = mining.sequence_patterns(seqs, 0.3, 900, 3, 10)
    assert {(tuple(r["pattern"]), r["freq"], r["support"]) for r in found.collect()} == want and want
    best = {r["session"]: r["seq_score"] for r in mining.sequence_match(seqs, found, 900).collect()}
    assert best == {s: max([w[2] for w in want if matched(seq, w[0])], default=0.0) for s, seq in times.items()}


def tagged_table(spark, folder, sessions):
    """tagged_flows of sessions, each a list of tokens a second apart."""
    data = [(i * 1000 + j, f"s{i}", datetime(2017, 7, 3, 9, j // 60, j % 60), t, "BENIGN", "Monday", "train", 80) for i, seq in enumerate(sessions) for j, t in enumerate(seq)]
    columns = "record_id long, session_id string, timestamp timestamp_ntz, token string, label string, day string, partition string, destination_port int"
    spark.createDataFrame(data, columns).write.parquet(f"{folder}/tagged_flows.parquet")
    return str(folder)


def test_queries_mine_at_the_support_of_the_settings(spark, tmp_path):
    d = tagged_table(spark, tmp_path, [["SCAN_ACTIVITY", "DOS_INDICATOR"]] * 2 + [["AUTH_FAIL", "AUTH_SUCCESS"]] + [["DATA_TRANSFER"]] * 57)
    q = flow_queries.QUERIES
    assert {r["pattern"]: r["support"] for r in q["prefixspan_full"](spark, d).collect()} == {"SCAN_ACTIVITY>DOS_INDICATOR": pytest.approx(2 / 60, abs=1e-6)}
    want = {"s0": 2 / 60, "s2": 0.0, "s3": 57 / 60}
    got = {r["session"]: r["fp_score"] for r in q["fp_match_score"](spark, d).collect()}
    assert {s: got[s] for s in want} == pytest.approx(want, abs=1e-6)
    got = {r["session"]: r["sp_t"] for r in q["sp_t"](spark, d).collect()}
    assert {s: got[s] for s in want} == pytest.approx(want | {"s3": 57 / 120}, abs=1e-6)


def test_index_sequences_have_the_length_of_the_settings(spark, tmp_path):
    d = tagged_table(spark, tmp_path, [["AUTH_FAIL"] * 5 + ["SCAN_ACTIVITY"] * 127 + ["DATA_TRANSFER"], ["AUTH_FAIL"] + ["DATA_TRANSFER"] * 19])
    got = {r["session"]: r["ids"].split(",") for r in flow_queries.QUERIES["seq_last_n_indices"](spark, d).collect()}
    assert got == {"s0": ["4"] * 127 + ["5"], "s1": ["2"] + ["5"] * 19}


def test_models_have_full_size_and_know_their_classes(spark):
    import numpy as np

    assert (models.Forest([]).trees, models.Forest([]).depth, models.Boosting([]).rounds, models.Boosting([]).depth) == (200, models.UNLIMITED, 300, 8)
    rng = np.random.default_rng(3)
    data = [(float(x), float(y), float(z), 0.0 if x < 0.5 else 4.0 if y < 0.5 else 8.0, 1.0) for x, y, z in rng.random((900, 3))]
    df = spark.createDataFrame(data, "x double, y double, z double, class_index double, weight double")
    for kind, more in ((models.Forest, {"trees": 20}), (models.Boosting, {"rounds": 30})):
        m = kind(["x", "y", "z"], **more).fit(df.where("z < 0.7"), "weight")
        out = m.predict(df.where("z >= 0.7"), "p").collect()
        right = np.mean([int(np.argmax(r["p"])) == r["class_index"] for r in out])
        assert right > 0.97 and all(abs(sum(r["p"]) - 1) < 1e-9 and len(r["p"]) == len(CLASSES) for r in out)
        top = m.explain(df.limit(50), k=3).collect()
        assert all({e["name"] for e in r["top"]} == {"x", "y", "z"} and abs(r["top"][0]["value"]) >= abs(r["top"][2]["value"]) for r in top)
        x = np.array([r[:3] for r in data[:20]])
        base = np.mean([t.value[0] for t in m.model.trees], axis=0) if kind is models.Forest else m.model.step * np.array([[t.value[0, 0] for t in r] for r in m.model.rounds]).sum(axis=0)
        whole = m.model.predict(x) if kind is models.Forest else m.model.margins(x)
        assert np.allclose(m.model.attributions(x).sum(axis=1) + base, whole, atol=1e-3)
    few = models.sample_rows_to_fit(df, ["x"], 100)
    assert 60 < len(few) < 170 and abs(few["weight"].sum() - 900) < 200


def test_recurrent_net(spark):
    import numpy as np

    from flowloom.operators.recurrent import Recurrent, RecurrentConfig

    small = RecurrentConfig(embedding=4, hidden=5, classes=3, epochs=1, longest=6)
    net = Recurrent(small).start(0)
    net.weights = {k: v.astype(float) for k, v in net.weights.items()}
    seqs = [[1, 2, 3], [4, 5, 6, 7, 8], [2]]
    parts = net.attributions(seqs, [0, 1, 2])
    assert [len(p) for p in parts] == [3, 5, 1]
    row, k = net.weights["E"][5].copy(), 1  # gradient times input is the slope along the input itself
    net.weights["E"][5] = row * 1.0001
    up = net._logits([seqs[1]])[0][0, k]
    net.weights["E"][5] = row * 0.9999
    down = net._logits([seqs[1]])[0][0, k]
    assert parts[1][1] == pytest.approx((up - down) / 0.0002, rel=1e-4)
    rnd = random.Random(1)
    data = [([rnd.randint(0, 9) for _ in range(rnd.randint(1, 12))],) for _ in range(500)]
    data = [(s, 1.0 if 3 in s else 0.0) for (s,) in data] + [([], 0.0)]
    df = spark.createDataFrame(data, "ids array<int>, class_index double")
    model = models.TokenModel(RecurrentConfig(hidden=32, epochs=12, rate=1e-2)).fit(df)
    out = model.predict(df).collect()
    assert np.mean([np.argmax(r["p_b"]) == r["class_index"] for r in out]) > 0.9
    assert len(model.explain(df.limit(3)).first()["token_attributions"]) == len(data[0][0])


def test_a_query_runs_the_pipeline_as_set(spark, monkeypatch):
    asked = []
    part = spark.createDataFrame([("s", "BENIGN", 0.25, "BENIGN")], "session_id string, predicted_class string, risk double, tier string")
    made = type("Made", (), {"tables": dict.fromkeys(("train", "val", "test"), part)})
    monkeypatch.setattr(flow_queries.pipeline, "run", lambda df, *a, **k: asked.append((a, k)) or made)
    assert flow_queries.QUERIES["pipeline_run"](spark, DATA).count() == 3 and asked == [((), {})]


def test_sparse_windows_miss_sessions(spark):
    s = spark.createDataFrame([("a", 0, 0), ("b", 700 * US, 700 * US), ("c", 950 * US, 950 * US)], "session_id string, start_us long, end_us long").withColumn("label", F.lit("Bot"))
    out = replay.replay(s, s.select("session_id", F.lit(0.9).alias("risk")), window_s=600, stride_s=900)
    assert rows(replay.missed(s, out).select("session_id")) == [("b",)]
    got = replay.early_detection(out).first()
    assert (got["mean_latency"], got["median_latency"], got["n_detected"]) == (0.0, 0.0, 3)
    assert replay.early_detection(out.where("false")).first()["median_latency"] is None
    timed = replay.timed_replay(s.withColumn("n_flows", F.lit(2)), s.select("session_id", F.lit(0.9).alias("risk")))
    assert timed.per_session.count() == 3 and timed.n_windows == 96 and timed.throughput_flows_per_s > 0 and timed.latency_ms_per_flow > 0


def test_shared_folder_is_asked_for_on_a_cluster():
    from flowloom.runtime import shared_dir

    class Conf:
        def get(self, *_):
            return None

    fake = type("Session", (), {"conf": Conf(), "sparkContext": type("Context", (), {"master": "yarn"})})
    with pytest.raises(RuntimeError):
        shared_dir(fake)


def test_order_statistics(spark):
    import numpy as np

    rnd = random.Random(11)
    vals = [rnd.choice([0.0, 1.0, -3.5, rnd.gauss(0, 1e-9), rnd.expovariate(1e-6), 1e15 + rnd.random()]) for _ in range(3000)]
    df = spark.createDataFrame([(v, None if i % 3 else v, None) for i, v in enumerate(vals)], "x double, y double, z double")
    p = {r["feature"]: r for r in features.fit_scaler(df, ["x", "y", "z"]).collect()}
    for c, v in (("x", vals), ("y", vals[::3])):
        lo, hi = np.percentile(v, [1, 99])
        assert p[c]["lo"] == pytest.approx(lo) and p[c]["hi"] == pytest.approx(hi) and p[c]["median"] == pytest.approx(np.median(np.clip(v, lo, hi)))
    assert p["z"]["median"] is None and not p["z"]["kept"]


def test_empty_tables(spark):
    none = flows(spark, [0]).where("false")
    assert sessions.tag_sessions(none, "us", "flow_duration", "record_id").count() == 0
    assert sessions.tag_sessions_terminated(none, "us", "flow_duration", "record_id").count() == 0
    st = steps(spark, {"a": ["x"]}).where("false")
    assert graph.graph_edges(st).count() == 0 and mining.fp_match(st).count() == 0
    assert rows(mining.sequence_patterns(tokens.sequences(st))) == []
    lab = spark.createDataFrame([], "label string, predicted_class string")
    assert metrics.macro_f1(lab).first()[0] == 0 and metrics.bootstrap_ci(lab).first()[0] is None
    assert clean.zero_shot_classes(lab).count() == len(CLASSES)


def test_clock(spark):
    df = spark.createDataFrame([(i, 1 + i % 2) for i in range(3000)], "seq long, day_order int")
    got = {r["seq"]: r["timestamp"] for r in clean.synthetic_clock(df, "seq").collect()}
    assert got[0] == datetime(1970, 1, 2) and got[2999] == datetime(1970, 1, 3, 0, 24, 59)


def test_whole_column_times(spark):
    df = spark.createDataFrame([("03/07/2017 08:55:58",), ("4/7/2017 8:54",), ("4/7/2017 8:55",)], "t string")
    got = [r[0] for r in clean.parse_times(df, "t", "p", "reference").select("p").collect()]
    assert got == [None, datetime(2017, 7, 4, 8, 54), datetime(2017, 7, 4, 8, 55)]
    one = spark.createDataFrame([("3/7/2017 08:00:01",)], "t string")
    assert clean.parse_times(one, "t", "p", "reference").first()["p"] == datetime(2017, 3, 7, 8, 0, 1)
