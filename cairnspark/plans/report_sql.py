"""DuckDB SQL for the queries over whole reports and claims, from how their inputs are made, not from the plans."""

from __future__ import annotations

from cairnspark.functions import fixed
from cairnspark.plans.sql import _EMAIL, _GRAPH, _HOST, _NORMAL, _flag, _hits

_AS_NUMBER = "list_sum(list_transform(string_split({}, '.'), lambda o, i: o::BIGINT * (256 ** (4 - i))::BIGINT))"
_BENIGN = f"EXISTS (SELECT 1 FROM (SELECT unnest({list(fixed.ALLOWLIST)}) AS a) WHERE host = a OR ends_with(host, '.' || a))"

_PAGES = f"""
p AS (SELECT page_id AS k, 'p' || page_id AS report_id, n.url, {_HOST.replace("url", "n.url")} AS host, sha256(page_id::VARCHAR) AS digest, '45.' || page_id % 250 || '.' || (page_id // 250) % 250 || '.7' AS ip FROM pages JOIN {_NORMAL} n USING (page_id)),
ioc AS (
  SELECT report_id, 'url' AS type, url AS value, 2 AS occurrences, 2 AS n_forms, true AS defanged, '1' AS pages, false AS in_ioc_section, '' AS flags FROM p
  UNION ALL SELECT report_id, 'domain', host, 2 + (k % 2 = 0)::INT + (k % 3 = 0)::INT, 2, true, CASE WHEN k % 3 = 0 THEN '1,2' ELSE '1' END, k % 3 = 0, CASE WHEN {_BENIGN} THEN 'benign_domain' ELSE '' END FROM p WHERE k % 2 = 0 OR k % 3 = 0
  UNION ALL SELECT report_id, 'ipv4', ip, 1, 1, true, '2', true, {_flag("x")} FROM (SELECT *, {_AS_NUMBER.format("ip")} AS x FROM p)
  UNION ALL SELECT report_id, 'ipv4', '1.2.3.' || k % 200, 1, 1, false, '3', false, 'possible_version_number' FROM p
  UNION ALL SELECT report_id, 'sha256', digest, 1, 1, false, '2', true, CASE WHEN k % 2 = 0 OR k % 3 = 0 THEN '' ELSE 'hash_without_context' END FROM p
  UNION ALL SELECT report_id, 'email', 'admin' || k || '@' || host, 1, 1, true, '2', true, '' FROM p WHERE k % 3 = 0
  UNION ALL SELECT report_id, 'cve', 'CVE-2024-' || (k + 10000), 1, 1, false, '3', false, '' FROM p
  UNION ALL SELECT report_id, 'ipv6', '2001:db8::' || lower(to_hex(k % 65535 + 1)), 1, 1, false, '', false, '' FROM p)"""

_CLAIMS = r"""
w AS (SELECT doc_id AS d, string_split(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
q AS (SELECT d, d % 7 <> 0 AS fine, d % 2 = 0 AS known, w[1] AS a, w[2] AS b, '198.51.100.' || d % 250 AS ip FROM w WHERE len(w) >= 8 AND lower(w[1]) <> lower(w[2])
  AND regexp_matches(array_to_string(w[1:8], ' '), '^[A-Za-z]{4,20} [A-Za-z]{3,20} [A-Za-z]{3,20}( [A-Za-z]{1,30}){5}$')),
c AS (SELECT unnest([0, 1]) AS chunk, * FROM q)"""

SQL: dict[str, str] = {
    "indicators_pages": f"WITH {_PAGES} SELECT * FROM ioc",
    "indicator_totals_pages": f"""WITH {_PAGES}, t AS (SELECT report_id, type, count(*) AS n, count(*) FILTER (flags <> '') AS f FROM ioc GROUP BY ALL)
SELECT report_id, sum(n)::BIGINT AS total, sum(f)::BIGINT AS flagged, string_agg(type || ':' || n, ',' ORDER BY type) AS counts FROM t GROUP BY report_id""",
    "indicators_documents": f"""
WITH h AS (SELECT doc_id, type, value FROM {_hits("ipv4", "email", "sha1", "sha256", "sha512", "cve")} UNION ALL SELECT doc_id, 'domain', regexp_extract(lower(unnest(regexp_extract_all(text, '{_EMAIL}', 0))), '@(.*)$', 1) FROM documents),
c AS (SELECT doc_id, type, value, count(*) AS occurrences FROM h GROUP BY ALL)
SELECT doc_id::VARCHAR AS report_id, type, value, occurrences, type = 'ipv4' AND contains({_flag(f"CASE WHEN type = 'ipv4' THEN {_AS_NUMBER.format('value')} END").replace("value, '.'", "CASE WHEN type = 'ipv4' THEN value END, '.'")}, 'reserved_ip') AS reserved FROM c""",
    "indicator_names_pages": f"WITH {_PAGES} SELECT DISTINCT report_id, lower(value) AS folded, value AS canonical FROM ioc",
    "section_pages_pages": "SELECT 'p' || page_id AS report_id, '2' AS pages, true AS found FROM pages",
    "claims_outcomes": f"""WITH {_CLAIMS},
e AS (
  SELECT 'entity' AS kind, 0 AS ordinal, 'kept' AS outcome FROM c WHERE fine UNION ALL SELECT 'entity', 1, 'not_grounded' FROM c WHERE fine
  UNION ALL SELECT 'entity', 2, CASE WHEN known THEN 'name_not_in_text' ELSE 'unknown_indicator' END FROM c WHERE fine UNION ALL SELECT 'entity', 3, 'repeated' FROM c WHERE fine
  UNION ALL SELECT 'relationship', 0, CASE WHEN known THEN 'kept' ELSE 'dangling' END FROM c WHERE fine UNION ALL SELECT 'relationship', 1, 'dangling' FROM c WHERE fine
  UNION ALL SELECT 'relationship', 2, 'not_grounded' FROM c WHERE fine UNION ALL SELECT 'proposal', 0, 'schema' FROM c WHERE NOT fine)
SELECT kind, ordinal, outcome, count(*) AS n FROM e GROUP BY ALL""",
    "claims_merged_entities": f"WITH {_CLAIMS} SELECT d::VARCHAR AS report_id, 'malware' AS type, a AS name, b AS aliases, 'loader' AS descriptions, 1 AS quotes, 1 AS ordinal FROM q WHERE fine",
    "claims_merged_relationships": f"WITH {_CLAIMS} SELECT d::VARCHAR AS report_id, a AS source, 'uses' AS relation, ip AS target, 1 AS quotes FROM q WHERE fine AND known",
    "claims_report": f"WITH {_CLAIMS} SELECT d::VARCHAR AS report_id, 8 AS proposed, 2 AS kept, 4 AS dropped, 0.5::DOUBLE AS drop_rate, false AS suspicious FROM q WHERE fine",
    "claims_techniques": f"""WITH {_CLAIMS}, t AS (SELECT d, chunk, 'T' || (d * 3 + 1000) AS id, p_name AS name FROM c LEFT JOIN part ON p_partkey = d * 3)
SELECT d::VARCHAR AS report_id, chunk AS chunk_index, id AS technique_id, name, CASE WHEN name IS NULL THEN 'unknown_technique' WHEN d % 5 = 0 THEN 'not_grounded' WHEN chunk = 1 THEN 'repeated' ELSE 'kept' END AS outcome FROM t""",
    "reports_recent": "SELECT 'report--' || doc_id AS report_id, 'doc ' || doc_id AS name, doc_id AS ingest_seq FROM documents ORDER BY doc_id DESC LIMIT 20",
    "reports_of_indicators": f"WITH {_GRAPH} SELECT DISTINCT node_id, 'report--' || doc_id AS report_id, 'doc ' || doc_id AS report_name FROM contrib WHERE type = 'indicator'",
    "graph_export_roundtrip": f"WITH {_GRAPH} SELECT 'node' AS kind, node_id AS a, name AS b, n_reports AS n FROM node UNION ALL SELECT 'edge', src, dst, n_reports FROM edges",
    "usage_totals_events": """SELECT user_id AS report_id, count(*) AS calls, count(*) FILTER (event_type = 'click') AS cached_calls, sum(event_id % 900)::BIGINT AS input_tokens, sum(event_id % 70)::BIGINT AS output_tokens,
round(sum(CASE WHEN event_type = 'click' THEN 0 ELSE event_id % 11 / 1000.0 END)::DOUBLE, 6) AS cost_usd, sum(event_id % 13)::BIGINT AS duration_ms FROM events GROUP BY user_id""",
    "runs_listed_events": "SELECT user_id AS document, max(event_id) AS run_seq, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id ORDER BY run_seq DESC, user_id LIMIT 50",
}
