"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from cairnspark.llm import licenses, secrets


def _op1() -> str:
    kinds = []
    for i, (name, pattern, least, group) in enumerate(secrets.KINDS):
        p = pattern.replace("'", "''")
        good = f"len(regexp_extract(m, '{p}', 2)) >= {least}" if group else f"len(m) >= {least}"
        kinds.append(
            f"SELECT doc_id, {i} AS kind, '{name}' AS name, pos, gap, m, {good} AS good FROM (SELECT doc_id, unnest(range(len(ms))) AS pos, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS gap FROM (SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS ms, regexp_split_to_array(t, '{p}') AS gs FROM d))"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(kinds)}),
p AS (SELECT *, (sum(len(gap) + len(m)) OVER (PARTITION BY doc_id, kind ORDER BY pos))::BIGINT AS e FROM m),
g AS (SELECT doc_id, kind, name, e - len(m) AS s, e FROM p WHERE good),
u AS (SELECT g.*, kind < 3 OR NOT EXISTS (SELECT 1 FROM g b WHERE b.doc_id = g.doc_id AND b.kind < 3 AND ((b.s <= g.s AND b.e > g.s) OR (b.s >= g.s AND b.s < g.e))) AS free FROM g),
k AS (SELECT a.* FROM u a WHERE a.kind < 3 OR (a.free AND EXISTS (SELECT 1 FROM u b WHERE b.doc_id = a.doc_id AND b.free AND abs(b.s - a.s) <= {secrets.SCOPE}
  AND CASE WHEN a.kind = 4 THEN b.kind IN (1, 3, 5) ELSE b.kind IN (0, 2, 4) END))),
f AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (doc_id)
"""


_OP2 = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', 0) AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', 0) AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
patterns AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM patterns),
windows AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS p FROM words, sizes, unnest(range(1, len(w) - size + 2)) AS r(i)),
found AS (SELECT doc_id, i, size, item FROM windows JOIN patterns USING (size, p)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, size FROM found), unnest(range(i, i + size)) AS r(j) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""

def _op9() -> str:
    templates = ", ".join(f"('{name}', {licenses.group_of(licenses.words(t))}, {[s for s in licenses.shingles(licenses.words(t))]})" for name, t in licenses.TEMPLATES.items())
    return f"""
WITH k(license, grp, template) AS (VALUES {templates}),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+', 0) AS w FROM documents WHERE regexp_matches(lower(text), 'license|licensed|software|conditions|distributed|public|without')),
g AS (SELECT DISTINCT grp FROM k),
v AS (SELECT doc_id, grp, a, w[a + 1:a + 2 * grp] AS ws FROM d, g, unnest(range(0, len(w), grp)) AS r(a)),
x AS (SELECT doc_id, grp, a, list_distinct(list_transform(range(1, greatest(1, len(ws) - {licenses.SHINGLE} + 1) + 1), lambda i: array_to_string(ws[i:i + {licenses.SHINGLE} - 1], ' '))) AS own FROM v),
m AS (SELECT doc_id, license, a, len(list_intersect(own, template)) AS c, len(template) AS n FROM x JOIN k USING (grp))
SELECT doc_id, license, count(*) AS windows, max(c::DOUBLE / n) AS containment, min(a)::BIGINT AS word FROM m WHERE 100 * c >= {licenses.PERCENT} * n GROUP BY doc_id, license
"""


ORACLE_SQL: dict[str, str] = {"op1_secret_scans": _op1(), "op2_decontamination": _OP2, "op9_license_scans": _op9()}
