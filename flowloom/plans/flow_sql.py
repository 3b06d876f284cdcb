"""SQL (DuckDB) that gives the rows of flow_queries, written apart from the Spark plans."""

from __future__ import annotations

from flowloom.config import AUTH_PORTS, CLASSES, DAY_ORDER, SETTINGS, TOKENS
from flowloom.operators.features import GROUPS
from flowloom.operators.tokens import RULES
from flowloom.sources.schema import FEATURES



def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CLASS_ROWS = ", ".join(f"({i}, {text(c)})" for i, c in enumerate(CLASSES))
CLASS_LIST = "[" + ", ".join(map(text, CLASSES)) + "]"
K = len(CLASSES)

# building blocks, to follow WITH

_TRIM = r"lower(regexp_replace(session_id, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g'))"
STEPS = f"""steps AS (
  SELECT {_TRIM} AS session, epoch_us("timestamp") AS us, record_id AS seq_no, token, label, day, "partition"
  FROM tagged_flows WHERE session_id IS NOT NULL AND "timestamp" IS NOT NULL AND token IS NOT NULL)"""

_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(label, '[\s\x{00A0}]+', ' ', 'g'), '[–' || chr(150) || ']', '-', 'g'), '^ +| +$', '', 'g')"
LABELLED = f"""cleaned AS (SELECT *, epoch_us("timestamp") AS us, {_CLEAN} AS t FROM flow_records),
keyed AS (SELECT *, regexp_replace(lower(t), '\\s*-\\s*', ' - ', 'g') AS k FROM cleaned),
classed AS (SELECT * EXCLUDE (label), CASE WHEN label IS NULL THEN 'MISSING_LABEL' ELSE coalesce(
  CASE {" ".join(f"WHEN k = {text(c.lower())} THEN {text(c)}" for c in CLASSES)} WHEN k = 'web attack sql injection' THEN 'Web Attack - Sql Injection' END,
  CASE {" ".join(f"WHEN contains({text(c.lower())}, lower(t)) OR contains(lower(t), {text(c.lower())}) THEN {text(c)}" for c in CLASSES)} END, t) END AS label FROM keyed),
labelled AS (SELECT * FROM classed WHERE list_contains({CLASS_LIST}, label))"""

TRANS = """ordered AS (SELECT *, row_number() OVER w - 1 AS pos, lead(token) OVER w AS dst, lead(us) OVER w AS next_us FROM steps WINDOW w AS (PARTITION BY session ORDER BY us, seq_no)),
trans AS (SELECT session, pos, token AS src, dst, (next_us - us) / 1e6 AS dt_s, "partition" FROM ordered WHERE dst IS NOT NULL),
begins AS (SELECT session, min(us) AS begin FROM steps GROUP BY session)"""


def edges(where: str = "") -> str:
    """The moving average of each source's transitions, newest first."""
    return f"""edges AS (SELECT src, dst, sum((1 - 0.9::DOUBLE) * pow(0.9::DOUBLE, r - 1)) AS weight FROM (
  SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY begin DESC, session DESC, pos DESC) AS r FROM trans JOIN begins USING (session) {where}) GROUP BY src, dst)"""


WEIGHTED = """weighted AS (SELECT t.session, t.pos, t.src, t.dst, t.dt_s, CASE WHEN t.src NOT IN (SELECT src FROM edges) THEN 0.05 ELSE coalesce(e.weight, 0) END AS weight
  FROM trans t LEFT JOIN edges e ON e.src = t.src AND e.dst = t.dst)"""
SCORES = "scores AS (SELECT session, count(*) AS n, coalesce(any_value(g), 0.5) AS g_w, coalesce(any_value(gap), 0) AS mean_gap_s" + "".join(f", coalesce(any_value(c{i}), 0.5) AS tc_{i}" for i in range(5)) + """ FROM steps LEFT JOIN (
  SELECT session AS s2, avg(weight) AS g, avg(dt_s) AS gap""" + "".join(f", avg(weight * exp(-{x}::DOUBLE * greatest(dt_s, 0))) AS c{i}" for i, x in enumerate(SETTINGS.lambdas)) + """ FROM weighted GROUP BY session) ON s2 = session GROUP BY session)"""
SUMMARY = """votes AS (SELECT session, label, count(*) AS n, min((us, seq_no)) AS f FROM steps GROUP BY session, label),
won AS (SELECT session, label FROM votes WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session ORDER BY n DESC, f) = 1),
summary AS (SELECT s.session AS session_id, first(s.day ORDER BY s.us, s.seq_no) AS day, first(s."partition" ORDER BY s.us, s.seq_no) AS "partition", count(*) AS n_flows, min(s.us) AS start_us, max(s.us) AS end_us,
  any_value(won.label) AS label, (max(s.us) - min(s.us)) / 1e6 AS duration_seconds FROM steps s LEFT JOIN won ON won.session = s.session GROUP BY s.session)"""
GRAPH = f"{STEPS}, {TRANS}, {edges()}, {WEIGHTED}, {SCORES}"
N = "(SELECT count(DISTINCT session) FROM steps)"
SUPPORT = f"support AS (SELECT token, count(DISTINCT session) AS freq, count(DISTINCT session) / {N}::DOUBLE AS support FROM steps GROUP BY token)"


def pseudo(seed: str, m: int) -> str:
    raw = f"list_transform(range({K}), lambda k: ({seed} * {7 + m} + k * 31 + {m * 13}) % 97 + 1)"
    return f"list_transform({raw}, lambda x: x::DOUBLE / list_sum({raw})::DOUBLE)"


SCORED = f"""{GRAPH}, {SUMMARY}, {SUPPORT},
fp AS (SELECT session, max(CASE WHEN support >= 0.02 THEN support ELSE 0 END) AS sp_t FROM (SELECT DISTINCT session, token FROM steps) JOIN support USING (token) GROUP BY session),
seeds AS (SELECT session, min(seq_no) AS seed FROM steps GROUP BY session),
scored AS (SELECT m.*, sc.tc_0 AS tc_t, sc.g_w, sc.mean_gap_s, fp.sp_t, seeds.seed, {pseudo("seeds.seed", 0)} AS p_a, {pseudo("seeds.seed", 1)} AS p_b, {pseudo("seeds.seed", 2)} AS p_c
  FROM summary m JOIN scores sc ON sc.session = m.session_id JOIN fp ON fp.session = m.session_id JOIN seeds ON seeds.session = m.session_id)"""


def fused(a: float, b: float, c: float, s: float, t: float, name: str = "fused", sp: str = "sp_t", tc: str = "tc_t") -> str:
    score = f"(({a}::DOUBLE * p_a[k] + {b}::DOUBLE * p_b[k]) + {c}::DOUBLE * p_c[k] + {s}::DOUBLE * {sp} + {t}::DOUBLE * {tc})"
    return f"""{name}_r AS (SELECT *, list_transform(range(1, {K + 1}), lambda k: {score}) AS r FROM scored),
{name} AS (SELECT *, list_max(r) AS r_max, ({CLASS_LIST})[list_position(r, list_max(r))] AS predicted_class FROM {name}_r)"""


FUSED = f"{SCORED}, {fused(0.30, 0.35, 0.25, 0.05, 0.05)}"


def report(name: str = "fused") -> str:
    return f"""classes(i, class) AS (VALUES {CLASS_ROWS}),
{name}_rep AS (SELECT class, (SELECT count(*) FROM {name} WHERE label = class AND list_contains({CLASS_LIST}, predicted_class)) AS support, (SELECT count(*) FROM {name} WHERE predicted_class = class AND list_contains({CLASS_LIST}, label)) AS shown,
  (SELECT count(*) FROM {name} WHERE predicted_class = class AND label = class) AS tp FROM classes),
{name}_f AS (SELECT class, CASE WHEN shown > 0 THEN tp / shown::DOUBLE ELSE 0 END AS "precision", CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS recall, CASE WHEN shown + support > 0 THEN 2.0::DOUBLE * tp / (shown + support) ELSE 0 END AS f1, support, shown FROM {name}_rep)"""


def naive_sessions(gap: int, cap: int, flags: bool) -> str:
    over = "coalesce(fin_flag_count > 0, false) OR coalesce(rst_flag_count > 0, false)" if flags else "false"
    return f"""WITH RECURSIVE base AS (
  SELECT day, session_key, epoch_us("timestamp") AS us, epoch_us("timestamp") + greatest(coalesce(flow_duration, 0), 0) AS e, {over} AS over_, row_number() OVER (PARTITION BY day, session_key ORDER BY "timestamp", record_id) AS i
  FROM flow_records WHERE day IS NOT NULL AND session_key IS NOT NULL AND "timestamp" IS NOT NULL
), walk AS (
  SELECT day, session_key, i, us, e, over_, us AS first_us, 0 AS n FROM base WHERE i = 1
  UNION ALL
  SELECT b.day, b.session_key, b.i, b.us, b.e, b.over_,
    CASE WHEN w.over_ OR b.us - w.e > {gap}000000 OR b.us - w.first_us > {cap}000000 THEN b.us ELSE w.first_us END,
    CASE WHEN w.over_ OR b.us - w.e > {gap}000000 OR b.us - w.first_us > {cap}000000 THEN w.n + 1 ELSE w.n END
  FROM walk w JOIN base b ON b.day = w.day AND b.session_key = w.session_key AND b.i = w.i + 1
), spans AS (SELECT day || '||' || session_key || '__s' || n AS session_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_flows FROM walk GROUP BY day, session_key, n)
"""


_F = "CASE WHEN isnan({0}::DOUBLE) THEN NULL ELSE {0}::DOUBLE END"
_size = "(total_length_of_fwd_packets + total_length_of_bwd_packets)"
_rate = _F.format("flow_packets_s")
_auth = f"coalesce(destination_port IN ({', '.join(map(str, AUTH_PORTS))}), false)"
_TOKEN = f"""CASE WHEN {_rate} > 500 AND total_backward_packets = 0 AND total_fwd_packets > 5 THEN 'DOS_INDICATOR'
  WHEN syn_flag_count > 0 AND total_backward_packets = 0 AND {_size} < 50 AND flow_duration < 100000 AND total_fwd_packets <= 3 THEN 'SCAN_ACTIVITY'
  WHEN rst_flag_count > 0 AND total_backward_packets <= 1 AND total_fwd_packets <= 3 THEN 'FORCED_TERMINATION'
  WHEN {_auth} AND total_fwd_packets <= 10 AND total_backward_packets <= 10 AND {_size} < 500 AND (rst_flag_count > 0 OR fin_flag_count > 0) THEN 'AUTH_FAIL'
  WHEN {_auth} AND ack_flag_count > 0 AND total_backward_packets > 0 AND {_size} >= 500 AND {_size} < 5000 THEN 'AUTH_SUCCESS'
  WHEN {_auth} AND {_size} >= 5000 THEN 'POST_AUTH_ACTIVITY'
  WHEN NOT {_auth} AND total_backward_packets > 0 AND total_fwd_packets > 0 AND {_size} >= 500 THEN 'DATA_TRANSFER'
  WHEN syn_flag_count > 0 AND ack_flag_count > 0 AND total_backward_packets > 0 AND {_size} < 500 THEN 'SESSION_ESTABLISHED'
  WHEN fin_flag_count > 0 THEN 'CONNECTION_TERMINATION' ELSE 'CONNECTION_ATTEMPT' END"""
_ip = lambda c: "(" + " + ".join(f"split_part({c}, '.', {i + 1})::BIGINT * {256 ** (3 - i)}" for i in range(4)) + ")"
_TOKEN_ID = "CASE token " + " ".join(f"WHEN {text(t)} THEN {i}" for i, t in enumerate(TOKENS)) + " END"

_fin = lambda c: f"CASE WHEN isfinite({c}::DOUBLE) THEN {c}::DOUBLE END"
_per_feature = " UNION ALL ".join(
    f"""SELECT {text(c)} AS feature, lo, hi, median(x) AS median, var_pop(f) AS variance, min(f) AS low, max(f) AS high FROM (
  SELECT x, coalesce(x, median(x) OVER ()) AS f, lo, hi FROM (SELECT CASE WHEN {_fin(c)} IS NOT NULL THEN least(greatest({_fin(c)}, lo), hi) END AS x, lo, hi FROM train,
    (SELECT quantile_cont({_fin(c)}, 0.01) AS lo, quantile_cont({_fin(c)}, 0.99) AS hi FROM train))) GROUP BY lo, hi"""
    for c in FEATURES
)
PARAMS = f"""train AS (SELECT * FROM flow_records WHERE "partition" = 'train'), params AS ({_per_feature})"""
_scaled = ", ".join(
    f"""CASE WHEN ps[{text(c)}].variance > 1e-4 THEN round((coalesce(CASE WHEN {_fin("r." + c)} IS NOT NULL THEN least(greatest({_fin("r." + c)}, ps[{text(c)}].lo), ps[{text(c)}].hi) END, ps[{text(c)}].median) - ps[{text(c)}].low) / (CASE WHEN ps[{text(c)}].high = ps[{text(c)}].low THEN 1 ELSE ps[{text(c)}].high - ps[{text(c)}].low END), 6) + 0.0::DOUBLE END AS {c}"""
    for c in FEATURES
)
_group = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(f, {text(p)})' for p in parts)} THEN {text(g)}" for g, parts in GROUPS.items()) + " ELSE 'A' END"
_mi = list(FEATURES)
_bins = " UNION ALL ".join(f"SELECT {text(c)} AS feature, label AS y, CASE WHEN isfinite({c}::DOUBLE) THEN CAST(least(16, floor(log2(abs({c}::DOUBLE) + 1) / 2)) * sign({c}::DOUBLE) AS INTEGER) END AS b FROM labelled" for c in _mi)
_want = ["SESSION_ESTABLISHED", "DATA_TRANSFER", "CONNECTION_TERMINATION"]
_next = f"({'[' + ', '.join(map(text, _want)) + ']'})[w.p + 1]"

STRAT = """WITH {lab}, placed AS (SELECT label, record_id, "partition" AS old, row_number() OVER (PARTITION BY label ORDER BY (record_id * 2654435761) % 4294967296, record_id) AS pl, count(*) OVER (PARTITION BY label) AS total FROM labelled)
SELECT label, CASE WHEN pl <= ceil(total * 0.2::DOUBLE) THEN 'test' WHEN pl <= ceil(total * 0.2::DOUBLE) + ceil((total - ceil(total * 0.2::DOUBLE)) * 0.15::DOUBLE) THEN 'val' ELSE 'train' END AS "partition", count(*) AS n, CAST(sum(record_id) AS BIGINT) AS ids FROM placed GROUP BY 1, 2"""
_risk = "((seed * 37) % 101) / 100.0::DOUBLE"
_tier = f"CASE WHEN {_risk} >= 0.75 THEN 'ATTACK' WHEN {_risk} >= 0.35 THEN 'SUSPICIOUS' ELSE 'BENIGN' END"
PLACED = """t0 AS (SELECT min(start_us) AS t0 FROM summary),
placed AS (SELECT s.*, t0, greatest(0, CAST(floor((start_us - t0 - {w}000000) / {s}000000.0::DOUBLE) AS BIGINT) + 1) AS k FROM summary s, t0),
windows AS (SELECT *, CASE WHEN k * {s}000000 <= start_us - t0 THEN t0 + k * {s}000000 END AS window_start_us FROM placed)"""

SQL = {
    "flow_end_time": "SELECT record_id, epoch_us(\"timestamp\") + greatest(coalesce(flow_duration, 0), 0) AS end_us FROM flow_records WHERE \"timestamp\" IS NOT NULL",
    "session_key_symmetric": f"SELECT record_id, concat_ws('_', least(a, b), greatest(a, b), protocol, least(source_port, destination_port), greatest(source_port, destination_port)) AS built_key FROM (SELECT *, {_ip('source_ip')} AS a, {_ip('destination_ip')} AS b FROM flow_records)",
    "normalize_labels": f"WITH {LABELLED} SELECT label AS class, count(*) AS n FROM classed GROUP BY label",
    "unresolved_label_drop": f"WITH {LABELLED} SELECT list_contains({CLASS_LIST}, label) AS kept, count(*) AS n FROM classed GROUP BY 1",
    "ts_multi_format": """SELECT * FROM (SELECT record_id, epoch_us(coalesce(try_strptime("timestamp", '%d/%m/%Y %H:%M:%S'), try_strptime("timestamp", '%d/%m/%Y %H:%M'), try_strptime("timestamp", '%m/%d/%Y %H:%M:%S'), try_strptime("timestamp", '%m/%d/%Y %H:%M'))) AS us
FROM raw_flow_records WHERE regexp_matches("timestamp", '^\\d{1,2}/\\d{1,2}/\\d{4} \\d{1,2}:\\d{2}(:\\d{2})?$')) WHERE us IS NOT NULL""",
    "ts_impute_clock": "SELECT record_id, coalesce(epoch_us(\"timestamp\"), coalesce(day_order, 0) * 86400000000 + record_id * 1000) AS us FROM flow_records",
    "synthetic_clock": "SELECT record_id, day_order * 86400000000 + (row_number() OVER (PARTITION BY day_order ORDER BY record_id) - 1) * 1000000 AS us FROM flow_records",
    "clean_inf_nan": f"SELECT day, count(*) AS n, CAST(sum(record_id) AS BIGINT) AS ids FROM flow_records WHERE {' AND '.join(f'isfinite({c}::DOUBLE)' for c in FEATURES)} GROUP BY day",
    "split_counts": "SELECT day, day_order, \"partition\", count(*) AS n FROM flow_records GROUP BY ALL",
    "label_day_counts": f"WITH {LABELLED} SELECT label, day, count(*) AS n FROM labelled GROUP BY label, day",
    "zero_shot_classes": f"WITH {LABELLED}, classes(class_index, label) AS (VALUES {CLASS_ROWS}) SELECT class_index, label FROM classes WHERE label NOT IN (SELECT label FROM labelled WHERE \"partition\" = 'train')",
    "limit_per_file": "SELECT source_file, record_id FROM flow_records QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY record_id) <= 100",
    "stratified_split_counts": STRAT.format(lab=LABELLED),
    "seeded_rows": f"""WITH {LABELLED}, lacking AS (SELECT record_id FROM labelled WHERE "partition" = 'val' AND label NOT IN (SELECT label FROM labelled WHERE "partition" = 'train')
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY (record_id * 2654435761) % 4294967296, record_id) <= 500)
SELECT label, CASE WHEN record_id IN (SELECT record_id FROM lacking) THEN 'train' ELSE "partition" END AS "partition", count(*) AS n, CAST(sum(record_id) AS BIGINT) AS ids FROM labelled GROUP BY 1, 2""",
    "class_weights": f"WITH {LABELLED}, tr AS (SELECT label FROM labelled WHERE \"partition\" = 'train'), classes(i, label) AS (VALUES {CLASS_ROWS}) SELECT c.label, round(CASE WHEN n IS NULL THEN 1 ELSE least((SELECT count(*) FROM tr) / ({K}.0::DOUBLE * n), 50) END, 6) AS weight FROM classes c LEFT JOIN (SELECT label, count(*) AS n FROM tr GROUP BY label) t ON t.label = c.label",
    "sessions_with_cap": naive_sessions(60, 3600, False) + "SELECT * FROM spans",
    "sessions_gap_only": naive_sessions(60, 10**9, False) + "SELECT * FROM spans",
    "sessions_fin_rst": naive_sessions(60, 3600, True) + "SELECT * FROM spans",
    "session_size_hist": naive_sessions(60, 3600, False) + "SELECT n_flows, count(*) AS n_sessions FROM spans GROUP BY n_flows",
    "sessions_flow_level": "SELECT count(*) AS n, count(DISTINCT record_id) AS n_sessions, min('flow_' || record_id) AS first_id FROM flow_records",
    "session_summary": f"WITH {STEPS}, {SUMMARY} SELECT session_id, day, \"partition\", n_flows, start_us, end_us, label, round(duration_seconds, 6) AS duration_seconds FROM summary",
    "tokens_encode": f"SELECT record_id, {_TOKEN} AS token FROM flow_records",
    "token_counts": f"SELECT {_TOKEN} AS token, count(*) AS n FROM flow_records GROUP BY 1",
    "token_rule_table": "SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, {text(t)}, {text(m)})" for i, (t, m) in enumerate(RULES)) + ") AS v(rule, token, meaning)",
    "session_sequences": f"WITH {STEPS} SELECT session, string_agg(token, '>' ORDER BY us, seq_no) AS tokens FROM steps GROUP BY session",
    "seq_last_n_indices": f"WITH {STEPS}, last AS (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY session ORDER BY us DESC, seq_no DESC) <= 128) SELECT session, string_agg(({_TOKEN_ID})::VARCHAR, ',' ORDER BY us, seq_no) AS ids FROM last GROUP BY session",
    "transitions": f"WITH {STEPS}, {TRANS} SELECT session, pos, src, dst, round(dt_s, 6) AS dt_s FROM trans",
    "transition_counts": f"WITH {STEPS}, {TRANS} SELECT src, dst, count(*) AS n FROM trans GROUP BY src, dst",
    "graph_edges_ema": f"WITH {STEPS.replace('token IS NOT NULL)', 'token IS NOT NULL AND \"partition\" = ' + text('train') + ')')}, {TRANS}, {edges()} SELECT src, dst, round(weight, 6) AS weight FROM edges",
    "graph_full": f"WITH {STEPS.replace('token IS NOT NULL)', 'token IS NOT NULL AND \"partition\" = ' + text('train') + ')')}, {TRANS}, {edges()}, tokens(t) AS (VALUES {', '.join(f'({text(t)})' for t in TOKENS)}) SELECT s.src, t AS dst, round(coalesce(e.weight, 0), 6) AS weight FROM (SELECT DISTINCT src FROM edges) s CROSS JOIN tokens LEFT JOIN edges e ON e.src = s.src AND e.dst = t",
    "edge_weight_lookup": f"""WITH {STEPS.replace('token IS NOT NULL)', 'token IS NOT NULL AND "partition" = ' + text('train') + ')')}, {TRANS}, {edges()}, tokens(t) AS (VALUES {', '.join(f'({text(t)})' for t in TOKENS)})
SELECT a.t AS src, b.t AS dst, round(CASE WHEN a.t NOT IN (SELECT src FROM edges) THEN 0.05 ELSE coalesce(e.weight, 0) END, 6) AS weight FROM (SELECT t FROM tokens UNION ALL SELECT 'NEVER_SEEN') a CROSS JOIN tokens b LEFT JOIN edges e ON e.src = a.t AND e.dst = b.t""",
    "tc_t": f"WITH {GRAPH} SELECT session, round(tc_2, 6) AS tc_t FROM scores",
    "tc_t_lambda_sweep": f"WITH {GRAPH} SELECT session, {', '.join(f'round(tc_{i}, 6) AS tc_{i}' for i in range(5))} FROM scores",
    "g_w": f"WITH {GRAPH} SELECT session, round(g_w, 6) AS g_w FROM scores",
    "graph_paths": f"WITH {GRAPH} SELECT session, string_agg(src || ' -> ' || dst || '(w=' || printf('%.2f', weight) || ')', '; ' ORDER BY pos) AS path FROM weighted GROUP BY session",
    "lambda_auc": f"WITH {GRAPH}, {SUMMARY}, rows_ AS (SELECT scores.*, label <> 'BENIGN' AS y FROM scores JOIN summary ON session_id = session WHERE label IS NOT NULL) "
    + " UNION ALL ".join(f"SELECT {x}::DOUBLE AS decay, round((sum(CASE WHEN y THEN rk END) - count_if(y) * (count_if(y) + 1) / 2.0::DOUBLE) / (count_if(y) * count_if(NOT y))::DOUBLE, 6) AS auc, count_if(y)::BIGINT AS n_pos, count_if(NOT y)::BIGINT AS n_neg FROM (SELECT y, rank() OVER (ORDER BY tc_{i}) + (count(*) OVER (PARTITION BY tc_{i}) - 1) / 2.0::DOUBLE AS rk FROM rows_)" for i, x in enumerate(SETTINGS.lambdas)),
    "mean_gap": f"WITH {GRAPH} SELECT session, round(mean_gap_s, 3) AS mean_gap_s FROM scores",
    "pooled_gap": f"WITH {STEPS}, {TRANS} SELECT round(coalesce(avg(dt_s), 1.0), 6) AS pooled_gap FROM trans",
    "inv_dt_norm": f"WITH {GRAPH}, tg AS (SELECT (lead(us) OVER (PARTITION BY session ORDER BY us, seq_no) - us) / 1e6 AS dt FROM steps WHERE \"partition\" = 'train') SELECT session, round(greatest((SELECT coalesce(avg(dt), 1.0) FROM tg), 0.001) / (mean_gap_s + 0.001), 6) AS inv_dt_norm FROM scores",
    "clip_bounds": f"WITH {PARAMS} SELECT feature, round(lo, 6) AS lo, round(hi, 6) AS hi FROM params",
    "scaler_params": f"WITH {PARAMS} SELECT feature, round(median, 6) AS median, round(low, 6) AS low, round(high, 6) AS high FROM params",
    "variance_filter": f"WITH {PARAMS} SELECT feature, variance > 1e-4 AS kept FROM params",
    "scaled_features": f"WITH {PARAMS}, ps_ AS (SELECT map_from_entries(list((feature, {{'lo': lo, 'hi': hi, 'median': median, 'variance': variance, 'low': low, 'high': high}}))) AS ps FROM params) SELECT record_id, {_scaled} FROM flow_records r, ps_",
    "feature_groups": f"WITH fs(f) AS (VALUES {', '.join(f'({text(c)})' for c in FEATURES)}) SELECT f AS feature, {_group} AS grp, {_group} IN ('A', 'B') AS forest, {_group} IN ('B', 'D') AS boosting FROM fs",
    "mi_binned": f"WITH {LABELLED}, bins AS ({_bins}), cells AS (SELECT feature, b, y, count(*)::DOUBLE AS n FROM bins GROUP BY ALL), w AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, b) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny FROM cells) SELECT feature, round(greatest(sum(n / t * ln(n * t / (nb * ny))), 0), 6) AS mi FROM w GROUP BY feature",
    "fp_singletons": f"WITH {STEPS}, {SUPPORT} SELECT token, freq, round(support, 6) AS support FROM support",
    "fp_match_score": f"WITH {STEPS}, {SUPPORT} SELECT session, round(max(CASE WHEN support >= 0.02 THEN support ELSE 0 END), 6) AS fp_score FROM (SELECT DISTINCT session, token FROM steps) JOIN support USING (token) GROUP BY session",
    "seq_pairs_support": f"WITH {STEPS} SELECT x.token AS a, y.token AS b, count(DISTINCT x.session) AS freq FROM steps x JOIN steps y ON x.session = y.session AND (x.us, x.seq_no) < (y.us, y.seq_no) GROUP BY 1, 2",
    "gap_match": f"""WITH RECURSIVE {STEPS}, o AS (SELECT session, token, us, row_number() OVER (PARTITION BY session ORDER BY us, seq_no) AS i FROM steps),
walk AS (SELECT session, 0::BIGINT AS i, 0 AS p, 0::BIGINT AS t FROM (SELECT DISTINCT session FROM o)
  UNION ALL
  SELECT w.session, o.i, CASE WHEN w.p >= 3 OR o.token <> {_next} THEN w.p WHEN w.p = 0 OR o.us - w.t <= 60000000 THEN w.p + 1 WHEN o.token = {text(_want[0])} THEN 1 ELSE 0 END,
    CASE WHEN w.p >= 3 OR o.token <> {_next} THEN w.t WHEN w.p = 0 OR o.us - w.t <= 60000000 THEN o.us WHEN o.token = {text(_want[0])} THEN o.us ELSE 0 END
  FROM walk w JOIN o ON o.session = w.session AND o.i = w.i + 1)
SELECT session, bool_or(p >= 3) AS matched FROM walk GROUP BY session""",
    "prob_mean_by_session": f"WITH {STEPS}, p AS (SELECT session, {pseudo('seq_no', 0)} AS p FROM steps) SELECT session, {', '.join(f'round(avg(p[{i + 1}]), 6) AS p_{i}' for i in range(K))} FROM p GROUP BY session",
    "fuse_scores": f"WITH {FUSED} SELECT session_id, {', '.join(f'round(r[{i + 1}], 6) AS r_{i}' for i in range(K))} FROM fused",
    "fused_prediction": f"WITH {FUSED} SELECT session_id, round(r_max, 6) AS r_max, predicted_class FROM fused",
    "risk_meta_features": f"WITH {FUSED} SELECT session_id, round(r_max, 6) AS m_0, round(sp_t, 6) AS m_1, round(tc_t, 6) AS m_2, round(g_w, 6) AS m_3, round(greatest((SELECT coalesce(avg(dt_s), 1.0) FROM trans), 0.001) / (mean_gap_s + 0.001), 6) AS m_4 FROM fused",
    "risk_tiers": f"WITH {SCORED} SELECT {_tier} AS tier, count(*) AS n FROM scored GROUP BY 1",
    "smote_targets": f"WITH {LABELLED}, c AS (SELECT label, count(*) AS n FROM labelled WHERE \"partition\" = 'train' GROUP BY label), m AS (SELECT max(n) AS most FROM c) SELECT label, n, least(CAST(floor(most * 0.1::DOUBLE) AS BIGINT), n * 6) AS target FROM c, m WHERE n >= 50 AND n < most AND least(CAST(floor(most * 0.1::DOUBLE) AS BIGINT), n * 6) > n",
    "confusion": f"WITH {FUSED}, classes(i, c) AS (VALUES {CLASS_ROWS}) SELECT a.c AS truth, b.c AS predicted, count(f.session_id) AS n FROM classes a CROSS JOIN classes b LEFT JOIN fused f ON f.label = a.c AND f.predicted_class = b.c GROUP BY 1, 2",
    "per_class_report": f"WITH {FUSED}, {report()} SELECT class, round(\"precision\", 6) AS \"precision\", round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM fused_f UNION ALL SELECT 'MACRO_AVG', round(avg(\"precision\"), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM fused_f",
    "macro_f1": f"WITH {FUSED}, {report()} SELECT round(avg(f1), 6) AS macro_f1 FROM fused_f",
    "macro_f1_present": f"WITH {FUSED}, {report()} SELECT round(avg(f1), 6) AS macro_f1_present FROM fused_f WHERE support + shown > 0",
    "fpr": f"WITH {FUSED} SELECT round(count_if(label = 'BENIGN' AND predicted_class <> 'BENIGN') / count_if(label = 'BENIGN')::DOUBLE, 6) AS fpr FROM fused",
    "pr_auc": f"""WITH {SCORED}, long AS (SELECT label, unnest({CLASS_LIST}) AS class, unnest(p_a) AS s FROM scored WHERE label IS NOT NULL),
by_ AS (SELECT class, s, count_if(label = class) AS p, count(*) AS n FROM long GROUP BY class, s),
run AS (SELECT class, p, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY class) AS all_p FROM by_ WINDOW w AS (PARTITION BY class ORDER BY s DESC))
SELECT class, round(sum(CASE WHEN all_p > 0 THEN p / all_p::DOUBLE * cp / cn END), 6) AS ap FROM run GROUP BY class""",
    "mcnemar": f"""WITH {SCORED}, x AS (SELECT label, ({CLASS_LIST})[list_position(p_a, list_max(p_a))] AS a, ({CLASS_LIST})[list_position(p_b, list_max(p_b))] AS b FROM scored WHERE label IS NOT NULL),
n AS (SELECT count_if(a = label AND b <> label)::BIGINT AS b, count_if(a <> label AND b = label)::BIGINT AS c FROM x),
s AS (SELECT b, c, CASE WHEN b + c = 0 THEN 0 WHEN b + c < 25 THEN least(b, c) ELSE pow(abs(b - c) - 1, 2) / (b + c) END::DOUBLE AS statistic FROM n),
-- the chi-square tail from Simpson's rule over the normal density
area AS (SELECT sqrt(statistic) / 2000 * list_sum(list_transform(range(2001), lambda i: exp(-pow(sqrt(statistic) * i / 2000, 2) / 2) * CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)) / 3 * sqrt(2 / pi()) AS inside FROM s)
SELECT b, c, round(statistic, 6) AS statistic, round(1 - inside, 6) AS p_value FROM s, area""",
    "stream_assign_windows": f"WITH {STEPS}, {SUMMARY}, {PLACED.format(w=60, s=10)} SELECT session_id, window_start_us FROM windows",
    "stream_window_counts": f"WITH {STEPS}, {SUMMARY}, {PLACED.format(w=60, s=10)} SELECT window_start_us, count(*) AS n_sessions FROM windows GROUP BY 1",
    "stream_n_windows": f"WITH {STEPS}, {SUMMARY} SELECT CAST(floor((max(end_us) - min(start_us)) / 10000000.0::DOUBLE) AS BIGINT) + 1 AS n_windows FROM summary",
    "early_detection": f"WITH {STEPS}, {SUMMARY}, seeds AS (SELECT session, min(seq_no) AS seed FROM steps GROUP BY session) SELECT round(avg(duration_seconds), 3) AS mean_latency, round(median(duration_seconds), 3) AS median_latency, count(*) AS n_detected FROM summary JOIN seeds ON session = session_id WHERE {_risk} >= 0.75 AND label <> 'BENIGN'",
    "missed_sessions": f"WITH {STEPS}, {SUMMARY}, {PLACED.format(w=60, s=10)} SELECT session_id FROM windows WHERE window_start_us IS NULL",
    "alert_report_text": f"""WITH {FUSED}, path AS (SELECT session, first(src ORDER BY pos) || ' -> ' || string_agg(dst || '(w=' || printf('%.2f', weight) || ')', ' -> ' ORDER BY pos) AS path FROM weighted GROUP BY session)
SELECT session_id, 'Alert for Session ' || session_id || ' (' || predicted_class || ')' || chr(10) || printf('  Risk_t: %.3f [%s]', {_risk}, {_tier}) || chr(10)
  || printf('  RF top features:   flow_duration(%+.3f)', {_risk} - 0.5) || chr(10) || printf('  XGBoost top features: syn_flag_count(%+.3f)', 0.25 - {_risk}) || chr(10) || printf('  LSTM token attributions: CONNECTION_ATTEMPT(%+.3f)', {_risk}) || chr(10)
  || printf('  Sequential pattern prior SP_t: %.3f', sp_t) || chr(10) || printf('  Temporal consistency TC_t: %.3f', tc_t) || chr(10) || '  Graph path: ' || coalesce(path, '<single-event session>') || chr(10)
  || '  Recommended action: Review session; correlate source IP against recent alerts.' AS report FROM fused LEFT JOIN path ON session = session_id""",
    "ablation_compare": f"WITH {SCORED}, {fused(0.30, 0.35, 0.25, 0.05, 0.05, 'full_')}, {fused(0.30, 0.35, 0.25, 0.05, 0.05, 'nop', sp='0.0')}, {fused(0.30, 0.35, 0.25, 0.05, 0.05, 'nog', tc='0.0')}, {fused(1 / 3, 1 / 3, 1 / 3, 0.0, 0.0, 'eq')}, {report('full_')}, {report('nop')[report('nop').index('nop_rep'):]}, {report('nog')[report('nog').index('nog_rep'):]}, {report('eq')[report('eq').index('eq_rep'):]} "
    + " UNION ALL ".join(f"SELECT {text(run)} AS run, (SELECT round(avg(f1), 6) FROM {n}_f) AS macro_f1, (SELECT round(count_if(label = 'BENIGN' AND predicted_class <> 'BENIGN') / count_if(label = 'BENIGN')::DOUBLE, 6) FROM {n}) AS fpr, (SELECT round(f1, 6) FROM {n}_f WHERE class = 'Heartbleed') AS heartbleed_f1, (SELECT round(f1, 6) FROM {n}_f WHERE class = 'Infiltration') AS infiltration_f1" for run, n in (("full", "full_"), ("no_patterns", "nop"), ("no_graph", "nog"), ("equal_weights", "eq"))),
    "graph_edges_incremental": f"WITH {STEPS}, {TRANS}, {edges()} SELECT src, dst, round(weight, 6) AS weight FROM edges",
    "attack_alerts": f"WITH {SCORED} SELECT session_id, round({_risk}, 6) AS risk FROM scored WHERE {_risk} >= 0.75",
    "sample_rows": "SELECT record_id FROM flow_records ORDER BY ((record_id + 42) * 2654435761) % 4294967296, record_id LIMIT 250",
    "top_attributions": """WITH v AS (SELECT record_id, unnest(['fwd', 'bwd', 'win']) AS name, unnest([total_fwd_packets - 5.0::DOUBLE, total_backward_packets - 4.0::DOUBLE, coalesce(init_win_bytes_backward, 0) / 4096.0::DOUBLE - 1.0]) AS x FROM flow_records),
r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY abs(x) DESC, name) AS rn FROM v)
SELECT record_id, string_agg(printf('%s(%+.3f)', name, x), ', ' ORDER BY rn) AS top FROM r WHERE rn <= 2 GROUP BY record_id""",
    "fp_itemsets_all": f"""WITH RECURSIVE {STEPS}, once AS (SELECT DISTINCT session, token FROM steps), n AS (SELECT count(DISTINCT session)::DOUBLE AS n FROM once),
sets AS (SELECT session, token AS items, token AS last FROM once UNION ALL SELECT s.session, s.items || ',' || o.token, o.token FROM sets s JOIN once o ON o.session = s.session AND o.token > s.last)
SELECT items, count(*) AS freq, round(count(*) / any_value(n), 6) AS support FROM sets, n GROUP BY items HAVING count(*) >= ceil(any_value(n) * 0.02)""",
    "fusion_grid": f"""WITH {SCORED}, v AS (SELECT label, {", ".join(f"({CLASS_LIST})[list_position({m}, list_max({m}))] AS {m}" for m in ("p_a", "p_b", "p_c"))} FROM scored WHERE "partition" = 'val' AND label IS NOT NULL),
{", ".join(f"f_{m} AS (SELECT avg(2.0::DOUBLE * tp / (a + b)) AS f FROM (SELECT c, (SELECT count(*) FROM v WHERE label = c AND {m} = c) AS tp, (SELECT count(*) FROM v WHERE label = c) AS a, (SELECT count(*) FROM v WHERE {m} = c) AS b FROM (SELECT label AS c FROM v UNION SELECT {m} FROM v)))" for m in ("p_a", "p_b", "p_c"))}
SELECT round(f_p_a.f / (f_p_a.f + f_p_b.f + f_p_c.f), 6) AS a, round(f_p_b.f / (f_p_a.f + f_p_b.f + f_p_c.f), 6) AS b, round(f_p_c.f / (f_p_a.f + f_p_b.f + f_p_c.f), 6) AS c, 0.0::DOUBLE AS s, 0.0::DOUBLE AS t FROM f_p_a, f_p_b, f_p_c""",
    "pipeline_checks": "SELECT " + ", ".join(f"true AS {c}" for c in "sessions_once probabilities_add_up fusion_adds_up greatest_chosen tiers_follow within_bounds risk_fitted".split()),
    "pipeline_sessions": f"""WITH RECURSIVE {LABELLED}, clean AS (SELECT * FROM labelled WHERE {' AND '.join(f'isfinite({c}::DOUBLE)' for c in FEATURES)}), base AS (
  SELECT day, "partition", session_key, label, us, us + greatest(flow_duration, 0) AS e, row_number() OVER (PARTITION BY day, session_key ORDER BY us, record_id) AS i FROM clean WHERE day IS NOT NULL AND session_key IS NOT NULL AND us IS NOT NULL
), walk AS (
  SELECT *, us AS first_us, 0 AS n FROM base WHERE i = 1
  UNION ALL
  SELECT b.*, CASE WHEN b.us - w.e > 60000000 OR b.us - w.first_us > 3600000000 THEN b.us ELSE w.first_us END, CASE WHEN b.us - w.e > 60000000 OR b.us - w.first_us > 3600000000 THEN w.n + 1 ELSE w.n END
  FROM walk w JOIN base b ON b.day = w.day AND b.session_key = w.session_key AND b.i = w.i + 1
), counted AS (SELECT "partition", day, session_key, n, label, count(*) AS c, min(i) AS f FROM walk GROUP BY ALL),
won AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY day, session_key, n ORDER BY c DESC, f) = 1),
flows AS (SELECT day, session_key, n, count(*) AS n_flows FROM walk GROUP BY ALL)
SELECT "partition", count(*) AS n_sessions, CAST(sum(n_flows) AS BIGINT) AS n_flows, CAST(count_if(label <> 'BENIGN') AS BIGINT) AS n_attacks FROM won JOIN flows USING (day, session_key, n) GROUP BY "partition" """,
}
