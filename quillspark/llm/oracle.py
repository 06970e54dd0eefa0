"""SQL that gives the same rows in another engine (DuckDB), where SQL can express an operator over whole tables."""

from __future__ import annotations

from quillspark.llm.boilerplate import MONTHS
from quillspark.llm.canonical import ACCENTS, FORMS, MAX_SPAN, PLAIN
from quillspark.llm.split import SPACE

P1_FOUND = rf"SELECT chunk_id FROM chunk_out WHERE len(regexp_extract_all(content, '[^{SPACE}]+')) > 400"


def _forms_sql() -> str:
    rows = ", ".join(f"('{name}', '{form.replace('_', '')}')" for name, forms in FORMS.items() for form in forms.split())
    return f"(VALUES {rows}) AS t(entry, form)"


def _squeeze(x: str) -> str:
    return f"regexp_replace(translate(translate(lower({x}), '{ACCENTS}', '{PLAIN}'), 'ß''’`', 's'), '[^a-z0-9]+', '', 'g')"


P6 = rf"""
WITH forms AS (
  SELECT form, min(entry_id) AS entry_id, length(form) AS n FROM (
    SELECT region_id AS entry_id, {_squeeze("name")} AS form FROM region_ref
    UNION ALL SELECT region_id, {_squeeze("code")} FROM region_ref
    UNION ALL SELECT region_id, {_squeeze("form")} FROM {_forms_sql()} JOIN region_ref ON name = entry
    UNION ALL SELECT 0, {_squeeze("form")} FROM {_forms_sql()} WHERE entry = '')
  WHERE form <> '' GROUP BY form),
vals AS (
  SELECT v, raw, len(raw) AS m, len(list_filter(raw, lambda t: NOT regexp_full_match(t, '[0-9]+'))) AS words FROM (
    SELECT DISTINCT region AS v, regexp_extract_all(translate(region, '''’`', ''), '[\p{{L}}\p{{N}}]+') AS raw FROM intake WHERE trim(region) <> '')
  WHERE len(raw) > 0),
runs AS (
  SELECT v, words, m, k.len AS len, raw[s.i:s.i + k.len - 1] AS part FROM vals, range(1, 200) AS s(i), range(1, {MAX_SPAN + 1}) AS k(len)
  WHERE s.i + k.len - 1 <= m),
spans AS (
  SELECT v, len = m AS whole, {_squeeze("array_to_string(part, '')")} AS span,
    len = m OR (len = 1 AND regexp_full_match(part[1], '[A-Z]{{2,3}}') AND (v <> upper(v) OR words <= 2))
    OR (len > 1 AND len(list_filter(part, lambda t: length(t) <> 1)) = 0) AS code_ok
  FROM runs),
pairs AS (
  SELECT v, whole, code_ok, entry_id, n, levenshtein(span, form) AS d, list_sort(string_split(span, '')) = list_sort(string_split(form, '')) AS same, span, form
  FROM spans JOIN forms ON span <> '' AND length(span) BETWEEN n - 4 AND n + 4),
scored AS (
  SELECT *, CASE WHEN d >= 2 AND same THEN (d + 1) // 2 ELSE d END AS e FROM pairs
  WHERE (n < 4 AND span = form AND code_ok) OR (n >= 4 AND length(span) >= 3 AND d <= CASE WHEN n >= 9 THEN 4 ELSE 2 END)),
best AS (
  SELECT v, first(entry_id ORDER BY n - 2.5 * e DESC, whole DESC, entry_id) AS entry_id, first(d ORDER BY n - 2.5 * e DESC, whole DESC, entry_id, d) AS distance
  FROM scored WHERE e <= CASE WHEN n >= 9 THEN 3 WHEN n >= 7 THEN 2 ELSE 1 END AND (e = 0 OR whole OR n >= 5) GROUP BY v)
"""

P6_FOUND = P6 + "SELECT intake_id, CAST(coalesce(entry_id, 0) AS INTEGER) AS region_id FROM intake LEFT JOIN best ON region = v WHERE trim(region) <> '' AND region NOT IN (SELECT name FROM region_ref)"
P6_MAPPING = P6 + "SELECT intake_id, region, CAST(CASE WHEN trim(region) <> '' THEN coalesce(entry_id, 0) END AS INTEGER) AS region_id, name AS canonical, CAST(distance AS INTEGER) AS distance FROM intake LEFT JOIN best ON region = v LEFT JOIN region_ref ON region_id = entry_id"
P6_UNMATCHED = P6 + "SELECT region, count(*) AS rows FROM intake WHERE trim(region) <> '' AND region NOT IN (SELECT v FROM best WHERE entry_id > 0) GROUP BY region"


def _same(a: str, b: str) -> str:
    end = f"CASE WHEN length({b}) >= 12 THEN 4 ELSE 2 END"
    n = f"least(length({a}), length({b}))"
    return f"""(abs(length({a}) - length({b})) <= 3 AND (left({a}, {end}) = left({b}, {end}) OR right({a}, {end}) = right({b}, {end}))
      AND levenshtein({a}, {b}) <= CASE WHEN {n} >= 20 THEN 3 WHEN {n} >= 10 THEN 2 WHEN {n} >= 6 THEN 1 ELSE 0 END)"""


P4 = rf"""
WITH lines AS MATERIALIZED (
  SELECT chunk_id, source, unnest(k) AS key, generate_subscripts(k, 1) AS line_no, content FROM (
    SELECT chunk_id, source, content, string_split(regexp_replace(lower(content), '\b(?:{"|".join(MONTHS.split())})\b|[^\p{{L}}\n]+', '', 'g'), chr(10)) AS k FROM chunk_out WHERE content IS NOT NULL AND source IS NOT NULL)),
sizes AS (SELECT source, count(*) AS n FROM chunk_out GROUP BY source),
frequent AS MATERIALIZED (
  SELECT source, key, count(DISTINCT chunk_id) AS c, n FROM lines JOIN sizes USING (source) WHERE key <> ''
  GROUP BY source, key, n HAVING count(DISTINCT chunk_id) >= greatest(4, n * 0.05)),
nodes AS MATERIALIZED (
  SELECT * FROM frequent AS x WHERE NOT EXISTS (
    SELECT 1 FROM frequent AS y WHERE y.source = x.source AND (y.c > x.c OR (y.c = x.c AND y.key < x.key)) AND {_same("x.key", "y.key")})),
hits AS MATERIALIZED (
  SELECT chunk_id, line_no, l.source, n, first(nodes.key ORDER BY l.key = nodes.key DESC, c DESC, nodes.key) AS node
  FROM lines AS l JOIN nodes ON l.source = nodes.source AND (l.key = nodes.key OR {_same("l.key", "nodes.key")}) WHERE l.key <> '' GROUP BY ALL),
kept AS (SELECT source, node, count(DISTINCT chunk_id) AS support FROM hits GROUP BY source, node, n HAVING count(DISTINCT chunk_id) >= greatest(8, n * 0.1)),
gone AS (SELECT chunk_id, line_no FROM hits JOIN kept USING (source, node))
"""
P4_FOUND = P4 + "SELECT chunk_id, CAST(line_no AS INTEGER) AS line_no FROM gone"
P4_CLEAN = P4 + r"""
SELECT c.chunk_id, c.source, CASE WHEN d.lines IS NULL THEN content ELSE array_to_string(list_filter(string_split(content, chr(10)), lambda x, i: NOT list_contains(d.lines, i)), chr(10)) END AS content,
  CAST(coalesce(len(d.lines), 0) AS INTEGER) AS n_removed
FROM chunk_out AS c LEFT JOIN (SELECT chunk_id, list(line_no) AS lines FROM gone GROUP BY chunk_id) AS d USING (chunk_id)"""
# steps between kept wordings on consecutive lines, walked both ways; a block has the name of its first wording
P4_BLOCKS = P4.replace("WITH lines", "WITH RECURSIVE lines", 1) + """,
steps AS (SELECT a.source, a.node AS x, b.node AS y FROM hits AS a JOIN hits AS b ON b.chunk_id = a.chunk_id AND b.line_no = a.line_no + 1 GROUP BY a.source, a.n, a.node, b.node HAVING count(DISTINCT a.chunk_id) >= greatest(8, a.n * 0.1)),
both_ways AS MATERIALIZED (SELECT s.* FROM (SELECT source, x, y FROM steps UNION SELECT source, y, x FROM steps) AS s JOIN kept AS k ON k.source = s.source AND k.node = s.x JOIN kept AS m ON m.source = s.source AND m.node = s.y),
reach AS (SELECT source, node AS x, node AS y FROM kept UNION SELECT r.source, r.x, b.y FROM reach AS r JOIN both_ways AS b ON b.source = r.source AND b.x = r.y)
SELECT source, k.node, support, block FROM kept AS k JOIN (SELECT source, x AS node, min(y) AS block FROM reach GROUP BY source, x) USING (source, node)"""

ORACLE = {"p4_blocks": P4_BLOCKS, "p4_found": P4_FOUND, "p4_clean": P4_CLEAN, "p1_found": P1_FOUND, "p6_found": P6_FOUND, "p6_mapping": P6_MAPPING, "p6_unmatched": P6_UNMATCHED}
