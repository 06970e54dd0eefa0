"""SQL that gives the rows of the named queries in another engine (DuckDB)."""

from __future__ import annotations

from quillspark.functions.answer import NOTHING_FOUND
from quillspark.functions.text import CLAUSE_ID, HEADER, INCOMPLETE_ENDINGS, LIST_ITEM, SPACE


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{SPACE}]+')"


# RE2 reads \x1c inside a class as Java does; line ends are those of str.splitlines()
def lines(x: str) -> str:
    parts = rf"string_split_regex({x}, '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
    return f"list_filter({parts}, lambda s, i: i < len({parts}) OR s <> '')"


def level(x: str) -> str:
    return f"(length({x}) - length(translate({x}, '.(', '')))"


_SPURIOUS = f"({strip('line')} = '' OR regexp_matches(line, '(?i)docusign envelope id:') OR regexp_matches(line, '^[{SPACE}]*[0-9]+[{SPACE}]*$'))"
_LINES = f"SELECT row_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (SELECT row_id, {lines('content')} AS l FROM page_in WHERE content IS NOT NULL)"
_TWO = f"len({words('title')}) > 1"
_DOUBTFUL = rf"(regexp_full_match(clause_id, '[0-9]+') AND ((regexp_matches(title, '^\p{{Ll}}') AND {_TWO}) OR starts_with(title, '(') OR (starts_with(lower(title), 'part ') AND {_TWO})))"
_HEADERS = f"""SELECT *, {level("clause_id")} AS level, regexp_full_match(clause_id, '{CLAUSE_ID}') AND title <> '' AND NOT {_DOUBTFUL} AS valid FROM (
  SELECT row_id, CAST(line_no AS INTEGER) AS line_no, regexp_extract({strip("line")}, '{HEADER}', 1) AS clause_id, regexp_extract({strip("line")}, '{HEADER}', 2) AS title
  FROM ({_LINES}) WHERE regexp_matches({strip("line")}, '{HEADER}'))"""


def tokens(table: str, key: str, text: str) -> str:
    return f"SELECT {key}, token, ln(1 + count(*)) AS weight FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS token FROM {table}) GROUP BY {key}, token"


def sparse(questions: str = "question") -> str:
    return f"""SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rnk FROM (
    SELECT query_id, chunk_id, round(sum(q.weight * c.weight), 6) AS score FROM ({tokens(questions, "query_id", "text")}) AS q JOIN ({tokens("chunk_out", "chunk_id", "content")}) AS c USING (token) GROUP BY query_id, chunk_id)
  WHERE score > 0) WHERE rnk <= 100"""


_SPARSE = sparse()
_ASKED = "(SELECT query_id, trim(text, ' \t\r\n') AS text FROM question WHERE trim(text, ' \t\r\n') <> '')"


def vectors(table: str, key: str, text: str, size: int = 64) -> str:
    """Token weights hashed to `size` signed places, at unit length."""
    places = f"SELECT {key}, code % {size} AS place, round(sum(CASE WHEN code // {size} % 2 = 0 THEN weight ELSE -weight END), 9) AS x FROM (SELECT *, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) AS code FROM ({tokens(table, key, text)})) GROUP BY 1, 2"
    return f"""SELECT {key}, list_transform(range({size}), lambda i: round(coalesce(m[i][1], 0.0) / norm, 6)) AS embedding FROM (
      SELECT {key}, map_from_entries(list({{'k': place, 'v': [x]}})) AS m, sqrt(sum(x * x)) AS norm FROM ({places}) GROUP BY 1) WHERE norm > 0"""


_WHOLE = "array_to_string(list_transform(embedding, lambda x: CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR)), ',')"
_DENSE = f"""SELECT query_id, chunk_id, rnk FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_distance(q.embedding, c.embedding), 6), chunk_id) AS rnk
  FROM ({vectors(_ASKED, "query_id", "text")}) AS q, ({vectors("chunk_out", "chunk_id", "content")}) AS c) WHERE rnk <= 100"""
_SAME = "md5(coalesce(source, 'UnknownSource') || chr(1) || coalesce(CAST(page_number AS VARCHAR), 'UnknownPage') || chr(1) || coalesce(content, ''))"


def keyed(hits: str) -> str:
    return f"SELECT h.*, coalesce(doc_key, CAST(h.chunk_id AS VARCHAR)) AS doc_key FROM {hits} AS h LEFT JOIN (SELECT chunk_id, {_SAME} AS doc_key FROM chunk_out) AS c ON h.chunk_id = c.chunk_id"


def fused(hits: str) -> str:
    return f"""SELECT query_id, doc_key, m.c AS chunk_id, rrf, m.p AS first_seen, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, m.p, m.c) AS rnk FROM (
      SELECT query_id, doc_key, round(sum(1.0 / (rnk - 1 + 60)), 12) AS rrf, min({{'p': CAST(CASE WHEN retriever = 'dense' THEN 0 ELSE 1000000 END + rnk AS BIGINT), 'c': chunk_id}}) AS m FROM ({keyed(hits)}) GROUP BY query_id, doc_key)"""


def blended(hits: str) -> str:
    asked, has = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))", "list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+'))"
    norm = lambda c: f"coalesce(({c} - min({c}) OVER w) / nullif(max({c}) OVER w - min({c}) OVER w, 0), 0)"
    return f"""SELECT query_id, chunk_id, doc_key, rrf, rerank, combined, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, rnk) AS rnk FROM (
      SELECT *, round(CASE WHEN count(*) OVER w = 1 THEN rerank ELSE 0.4 * {norm("rrf")} + 0.6 * {norm("rerank")} END, 9) AS combined FROM (
        SELECT f.query_id, f.chunk_id, f.doc_key, rrf, f.rnk, round(coalesce(len(list_intersect({asked}, {has})) / nullif(len({asked}), 0), 0), 6) AS rerank
        FROM ({fused(hits)}) AS f JOIN question USING (query_id) JOIN chunk_out USING (chunk_id) WHERE f.rnk <= 200)
      WINDOW w AS (PARTITION BY query_id))"""


_K = "least(greatest(count(*) FILTER (combined >= 0.4), 1), 12)"


def selected(hits: str) -> str:
    return f"""SELECT b.*, b.rnk AS pos FROM ({blended(hits)}) AS b JOIN (SELECT query_id, {_K} AS k FROM ({blended(hits)}) GROUP BY query_id) AS ks USING (query_id) WHERE b.rnk <= k"""


_CITATION = """concat(coalesce(source, 'Unknown Source'), ' (Customer: ', coalesce(customer, 'Unknown Customer'), ') - Page ', coalesce(CAST(page_number AS VARCHAR), 'N/A'))
  || CASE WHEN clause <> '' AND clause <> 'N/A' THEN ' (Clause: ' || clause || ')' WHEN len(hierarchy) > 0 THEN ' (Section: ' || hierarchy[-1] || ')' ELSE '' END"""
_HEAD = "'Source: ' || coalesce(source, 'Unknown') || ' | Page: ' || coalesce(CAST(page_number AS VARCHAR), 'N/A') || ' | Customer: ' || coalesce(customer, 'Unknown') || ' | Clause: ' || coalesce(clause, 'N/A')"
_BODY = strip("regexp_replace(regexp_replace(coalesce(content, ''), '(?m)^```[a-zA-Z]*\\n', '', 'g'), '(?m)\\n```$', '', 'g')")
_EXTRACT = f"""SELECT query_id, pos, head || ' --- ' || CASE WHEN e <> '' THEN e ELSE '{NOTHING_FOUND}' END AS extract FROM (
  SELECT query_id, pos, {_HEAD} AS head, array_to_string(list_transform(list_filter(regexp_extract_all({_BODY}, '[^.\\n]+'), lambda s: list_has_any(regexp_extract_all(lower(s), '[a-z0-9]+'), regexp_extract_all(lower(text), '[a-z0-9]+'))), lambda s: trim(s, ' ')), ' ') AS e
  FROM ({selected("hit")}) JOIN question USING (query_id) JOIN chunk_out USING (chunk_id))"""
_ANSWER = f"CASE WHEN count(*) FILTER (NOT ends_with(extract, '{NOTHING_FOUND}')) > 0 THEN string_agg(extract, chr(10) || chr(10) ORDER BY pos) FILTER (NOT ends_with(extract, '{NOTHING_FOUND}')) ELSE '{NOTHING_FOUND}' END"
_CLEAN = r"""trim(CASE WHEN lower(c) LIKE '%sp. z o.o' OR lower(c) LIKE '%sp z o o' THEN trim(regexp_replace(regexp_replace(c, '(?i)sp\. z o\.o$', ''), '(?i)sp z o o$', ''), ' ,.') ELSE c END, ' ,.')"""
_NAMES = rf"""SELECT intake_id, {_CLEAN} AS cleaned FROM (SELECT intake_id, trim(regexp_replace(trim(regexp_replace(trim(trim(customer, ' ,.()"'''), '*_'), '\s+', ' ', 'g'), ' '), '\s+\([^)]+\)$', ''), ' ') AS c FROM intake)"""
_REFERENCE = r"(?i)\b(?:Clause\s[0-9.]+(?:\([a-zA-Z]+\))?|Schedule\s[0-9]+\sPart\s[0-9]+)\b"


def reference(x: str) -> str:
    bare = f"{strip(f'regexp_replace({strip(x)}, {chr(39)}[.]+${chr(39)}, {chr(39)}{chr(39)})')}"
    parts = f"list_filter(list_transform(string_split(lower(substr({bare}, 9)), 'part'), lambda p: {strip('p')}), lambda p: p <> '')"
    return f"CASE WHEN starts_with(lower({bare}), 'clause') THEN {strip(f'substr({bare}, 7)')} WHEN starts_with(lower({bare}), 'schedule') THEN 'Schedule-' || array_to_string({parts}, '-') ELSE {bare} END"


_EDGES = f"""SELECT DISTINCT source, src, dst FROM (SELECT source, {reference("clause")} AS src, {reference("ref")} AS dst FROM (
  SELECT source, clause, unnest(regexp_extract_all(content, '{_REFERENCE}')) AS ref FROM chunk_out)) WHERE src <> '' AND dst <> '' AND src <> dst"""
_RUNS = """SELECT 'q' || query_id AS run_id, NULL AS parent_run_id, asked_by AS email, 'root' AS tag FROM question
  UNION ALL SELECT DISTINCT 'q' || query_id || '/' || retriever, 'q' || query_id, NULL, retriever FROM hit
  UNION ALL SELECT DISTINCT 'q' || query_id || '/' || retriever || '/' || rnk || '/' || chunk_id, 'q' || query_id || '/' || retriever, NULL, retriever FROM hit"""
_EMAIL = f"""WITH RECURSIVE runs AS ({_RUNS}), up AS (SELECT run_id, nullif(email, '') AS email, parent_run_id, tag FROM runs UNION ALL
  SELECT up.run_id, nullif(r.email, ''), r.parent_run_id, up.tag FROM up JOIN runs AS r ON r.run_id = up.parent_run_id WHERE up.email IS NULL)
SELECT run_id, max(email) AS email, first(tag) AS tag FROM up GROUP BY run_id"""
_DISTANCES = "SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS distance FROM embeddings AS q, embeddings AS v WHERE q.vec_id % 20 = 0"
_BOTH = f"(SELECT query_id, chunk_id, 'dense' AS retriever, rnk FROM ({_DENSE}) UNION ALL SELECT query_id, chunk_id, 'sparse', rnk FROM ({sparse(_ASKED)}))"
_OWNED = f"SELECT b.query_id, b.chunk_id, b.rnk, customer FROM ({blended('hit')}) AS b JOIN chunk_out USING (chunk_id) WHERE customer <> 'Unknown Customer'"
_ENDINGS = ", ".join(f"'{w}'" for w in INCOMPLETE_ENDINGS)
_SECOND = f"({lines('content')})[2]"

_RULE = "'+-----------+-----------+'"
_TABLE = f"{_RULE} || chr(10) || '| charge    | ' || rpad(format('{{:,}}', chunk_id * 1000), 9, ' ') || ' |' || chr(10) || {_RULE}"
_FINANCIAL = f"""SELECT chunk_id, concat_ws(chr(10), concat_ws(' ', clause, clause_title), {_TABLE}, 'The charge is balanced each year by', '\\text{{Balancing Payment}} = \\left(\\frac{{A}}{{B}} \\times ' || CASE WHEN chunk_id % 2 = 0 THEN '$' ELSE '' END || '2,600,000\\right) - $ 2,600,000', CASE WHEN chunk_id % 3 = 0 THEN {_TABLE} END) AS content FROM chunk_out WHERE clause_title IS NOT NULL""".replace("\\\\", "\\")
_DICTIONARY = r"""(WITH n AS (SELECT name, CASE WHEN w <> '' THEN lower(w) END AS k FROM (SELECT name, regexp_extract(CASE WHEN regexp_matches(name, '(?i)^(.*?)(?: pty ltd| pty limited| ltd| limited| inc)$') THEN regexp_extract(name, '(?i)^(.*?)(?: pty ltd| pty limited| ltd| limited| inc)$', 1) ELSE name END, '(\S+)', 1) AS w FROM (SELECT DISTINCT name FROM entity)))
  SELECT keyword, max(name) AS name FROM (SELECT k AS keyword, name FROM n WHERE k IS NOT NULL UNION ALL SELECT replace(lower(name), ' ', ''), name FROM n WHERE k IS NOT NULL) GROUP BY keyword)"""
# keyword after keyword, the longest first; a hit hides what it covers
_DETECT = rf"""WITH RECURSIVE kw AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY length(keyword) DESC, keyword) AS r FROM {_DICTIONARY}),
  steps AS (SELECT query_id, CAST(0 AS BIGINT) AS i, lower(text) AS q, CAST([] AS VARCHAR[]) AS names FROM question UNION ALL
    SELECT query_id, i + 1, CASE WHEN hit THEN regexp_replace(q, pattern, repeat('_', length(keyword))) ELSE q END, CASE WHEN hit THEN list_append(names, name) ELSE names END FROM (
      SELECT query_id, i, q, names, keyword, name, '\b' || regexp_escape(keyword) || '\b' AS pattern, coalesce(regexp_matches(q, '\b' || regexp_escape(keyword) || '\b') AND NOT list_contains(names, name), false) AS hit FROM steps JOIN kw ON kw.r = steps.i + 1))
  SELECT query_id, list_sort(names) AS names, CASE WHEN len(names) = 1 THEN names[1] END AS filter_name FROM steps WHERE i = (SELECT count(*) FROM kw)"""


def owned(hits: str) -> str:
    return f"SELECT b.*, customer FROM ({blended(hits)}) AS b LEFT JOIN ({_DETECT}) AS d USING (query_id) LEFT JOIN chunk_out USING (chunk_id) WHERE d.filter_name IS NULL OR customer = d.filter_name"


_BY_CUSTOMER = f"""WITH pool AS MATERIALIZED ({owned(_BOTH)}), det AS MATERIALIZED ({_DETECT}), ks AS (SELECT query_id, {_K} AS k FROM pool GROUP BY query_id),
  best AS (SELECT query_id, chunk_id, combined, row_number() OVER (PARTITION BY query_id ORDER BY rnk) AS pos FROM pool WHERE query_id NOT IN (SELECT query_id FROM det WHERE len(names) > 1)),
  turns AS (SELECT p.*, row_number() OVER (PARTITION BY p.query_id, p.customer ORDER BY p.rnk) AS rn FROM pool AS p JOIN (SELECT query_id, unnest(names) AS customer FROM det WHERE len(names) > 1) AS t USING (query_id, customer)),
  balanced AS (SELECT query_id, chunk_id, combined, row_number() OVER (PARTITION BY query_id ORDER BY rn > 2, CASE WHEN rn <= 2 THEN rnk END, rn, customer) AS pos FROM turns)
  SELECT query_id, CAST(pos AS INTEGER) AS pos, chunk_id, source, page_number, round(combined, 6) AS score, {_CITATION} AS citation FROM (SELECT * FROM best UNION ALL SELECT * FROM balanced) JOIN ks USING (query_id) JOIN chunk_out USING (chunk_id) WHERE pos <= k"""
_OPENINGS = """SELECT CAST(intake_id AS VARCHAR) AS source, coalesce(customer, 'the undersigned') AS typed, coalesce(region, 'no fixed place') AS place, intake_id % 3 = 0 AS second, CASE WHEN intake_id % 2 = 0 THEN 'Polar Quay Storage Pty Ltd' ELSE 'Northmoor Cold Stores Limited' END AS provider FROM intake"""
_FOUND = rf"""SELECT source, typed, place, trim(regexp_extract(typed, '^\s*([^,(;\n]*)', 1), ' ') AS raw FROM ({_OPENINGS})"""
_PARTY = rf"""SELECT source, CASE WHEN NOT regexp_matches(raw, '[A-Z]') OR cleaned = '' OR lower(cleaned) = 'unknown customer' THEN 'Unknown Customer' ELSE trim(regexp_replace(cleaned, '(?i)\s?(?:pty limited|pty ltd|limited|ltd|inc|llc|plc)$', ''), ' ,.') END AS customer, typed, place FROM (
  SELECT source, typed, place, raw, {_CLEAN} AS cleaned FROM (SELECT *, trim(regexp_replace(trim(regexp_replace(trim(trim(raw, ' ,.()"'''), '*_'), '\s+', ' ', 'g'), ' '), '\s+\([^)]+\)$', ''), ' ') AS c FROM ({_FOUND})))"""
_SOON = r"regexp_extract('The depot lies in Poland. ' || typed || ' has its seat in ' || place || '.', '(?i)\Q' || customer || '\E[^;\n]{0,200}?\b(New Zealand|United Kingdom|Australia|Ireland|Germany|Poland|Mexico|USA)\b', 1)"


# ---- chunking: a page line by line, then the pages of a file one after the other -----------------------------------
_STACK = "STRUCT(id VARCHAR, title VARCHAR, level BIGINT)[]"
_TITLE = f"trim(array_to_string(list_concat([rest], bare[i + 1 : stop - 1]), ' '), ' ')"
_LAST = f"lower(regexp_replace(({words('t0')})[-1], '[.,:;]+$', ''))"
_PEEL = lambda t: rf"CASE WHEN length({t}) >= 2 AND (regexp_full_match({t}, '(?s)\*.*\*') OR regexp_full_match({t}, '(?s)_.*_')) THEN substr({t}, 2, length({t}) - 2) ELSE {t} END"
_CHUNKS = rf"""WITH RECURSIVE gated AS MATERIALIZED (SELECT *, coalesce(len({words("content")}), 0) > 350 AS cut FROM page_in),
  line AS (SELECT row_id, line, line_no, {_SPURIOUS} AS noise FROM ({_LINES}) WHERE row_id IN (SELECT row_id FROM gated WHERE cut)),
  kept AS (SELECT row_id, line, {strip("line")} AS b, row_number() OVER w AS i, coalesce(lead(line_no) OVER w > line_no + 1, false) AS gap FROM line WHERE NOT noise WINDOW w AS (PARTITION BY row_id ORDER BY line_no)),
  read AS (SELECT *, regexp_matches(b, '{HEADER}') AS head, regexp_extract(b, '{HEADER}', 1) AS id, regexp_extract(b, '{HEADER}', 2) AS rest, regexp_matches(b, '{LIST_ITEM}') AS item, len({words("line")}) AS w FROM kept),
  page AS MATERIALIZED (SELECT row_id, count(*) AS n, list(line ORDER BY i) AS lines, list(b ORDER BY i) AS bare, list(gap ORDER BY i) AS gaps, list(item ORDER BY i) AS items, list(head AND len({words("rest")}) + 1 <= 8 ORDER BY i) AS small, list(total ORDER BY i) AS total FROM (SELECT *, sum(w) OVER (PARTITION BY row_id ORDER BY i) AS total FROM read) GROUP BY row_id),
  ends AS (SELECT *, min(CASE WHEN breaks THEN i END) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM (SELECT *, head OR item OR coalesce(lag(gap) OVER (PARTITION BY row_id ORDER BY i), false) AS breaks FROM read)),
  named AS (SELECT e.row_id, e.i, e.head, e.id, p.n, coalesce(e.next, p.n + 1) AS stop, e.rest, p.bare, p.gaps, p.items FROM ends AS e JOIN page AS p USING (row_id)),
  first AS (SELECT *, {_TITLE} AS t0, CASE WHEN stop > n OR gaps[stop - 1] OR items[stop] THEN NULL ELSE bare[stop] END AS more FROM named),
  second AS (SELECT *, rtrim(CASE WHEN more IS NOT NULL AND {_LAST} IN ({", ".join(f"'{w}'" for w in INCOMPLETE_ENDINGS)}) THEN t0 || ' ' || array_to_string(({words("more")})[1:10], ' ') ELSE t0 END, ' ,;:') AS t1 FROM first),
  third AS (SELECT *, {strip(f"CASE WHEN len({words('t1')}) > 40 THEN array_to_string(({words('t1')})[1:40], ' ') || '...' ELSE t1 END")} AS t2 FROM second),
  fourth AS (SELECT *, {_PEEL("t2")} AS t3 FROM third),
  titled AS MATERIALIZED (SELECT row_id, i, head, stop, id, {strip(_PEEL("t3"))} AS title, {level("id")} AS level FROM fourth),
  ruled AS MATERIALIZED (SELECT *, head AND title <> '' AND NOT (regexp_full_match(id, '[0-9]+') AND (starts_with(title, '(') OR (len({words("title")}) > 1 AND (regexp_matches(title, '^\p{{Ll}}') OR starts_with(lower(title), 'part '))))) AS valid FROM titled),
  walk AS (
    SELECT row_id, CAST(1 AS BIGINT) AS cur, CAST(1 AS BIGINT) AS since, false AS split, CAST([] AS {_STACK}) AS stack, CAST(1000000 AS BIGINT) AS low, CAST([] AS STRUCT(a BIGINT, z BIGINT, stack {_STACK}, low BIGINT)[]) AS out FROM page
    UNION ALL
    SELECT row_id, e, CASE WHEN over THEN e - carried ELSE begun END, over AND carried > 0, stack2, low2, CASE WHEN over THEN list_append(out1, {{'a': begun, 'z': e - carried, 'stack': stack2, 'low': low2}}) ELSE out1 END FROM (
      SELECT *, total[e - 1] - (CASE WHEN begun > 1 THEN total[begun - 1] ELSE 0 END) > 400 AS over, least(greatest(1, CAST(floor((e - begun) * 0.3::DOUBLE) AS BIGINT)), e - begun - 1) AS carried FROM (
        SELECT row_id, total, CASE WHEN open_head THEN stop ELSE cur + 1 END AS e, CASE WHEN new THEN cur ELSE since END AS begun,
          CASE WHEN new THEN list_append(list_filter(stack, lambda x: x.level < level), {{'id': id, 'title': title, 'level': level}}) ELSE stack END AS stack2, CASE WHEN new THEN least(low, level) ELSE low END AS low2,
          CASE WHEN new AND since < cur THEN list_append(out, {{'a': since, 'z': cur, 'stack': stack, 'low': low}}) ELSE out END AS out1
        FROM (SELECT s.*, r.stop, r.id, r.title, r.level, p.total, NOT s.split AND r.head AS open_head, NOT s.split AND r.valid AS new FROM walk AS s JOIN ruled AS r ON r.row_id = s.row_id AND r.i = s.cur JOIN page AS p ON p.row_id = s.row_id)))),
  done AS MATERIALIZED (SELECT s.row_id, stack, low, CASE WHEN since <= p.n THEN list_append(out, {{'a': since, 'z': p.n + 1, 'stack': stack, 'low': low}}) ELSE out END AS out, p.lines, p.small FROM walk AS s JOIN page AS p USING (row_id) WHERE s.cur = p.n + 1),
  pieces AS (SELECT row_id, lines, small, unnest(out) AS c, generate_subscripts(out, 1) AS k FROM done),
  cut AS (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY k) AS chunk_seq, {strip("array_to_string(lines[c.a : c.z - 1], chr(10))")} AS content, c.stack AS stack, c.low AS low FROM pieces WHERE c.z > c.a AND NOT (c.z - c.a = 1 AND small[c.a])),
  placed AS MATERIALIZED (SELECT row_id, source, row_number() OVER (PARTITION BY source ORDER BY page_number NULLS FIRST, row_id) AS r FROM page_in),
  fold AS (
    SELECT p.source, p.r, p.row_id, CAST([] AS {_STACK}) AS opening FROM placed AS p WHERE p.r = 1
    UNION ALL
    SELECT q.source, q.r, q.row_id, CASE WHEN d.row_id IS NULL THEN f.opening ELSE list_concat(list_filter(f.opening, lambda x: x.level < d.low), d.stack) END FROM fold AS f JOIN placed AS q ON q.source IS NOT DISTINCT FROM f.source AND q.r = f.r + 1 LEFT JOIN done AS d ON d.row_id = f.row_id),
  every AS (
    SELECT c.row_id, c.chunk_seq, c.content, list_concat(list_filter(f.opening, lambda x: x.level < c.low), c.stack) AS stack, false AS whole_page FROM cut AS c JOIN fold AS f USING (row_id)
    UNION ALL SELECT g.row_id, 1, g.content, f.opening, true FROM gated AS g JOIN fold AS f USING (row_id) WHERE NOT cut AND {strip("g.content")} <> '')
  SELECT row_id, source, page_number, CAST(chunk_seq AS INTEGER) AS chunk_seq, e.content, customer, region, CASE WHEN len(stack) > 0 THEN stack[-1].id WHEN whole_page THEN 'N/A' END AS clause, CASE WHEN NOT whole_page AND len(stack) > 0 THEN stack[-1].title END AS clause_title, array_to_string(list_transform(stack, lambda x: x.id), '>') AS hierarchy, whole_page
  FROM every AS e JOIN page_in USING (row_id)"""


ORACLE: dict[str, str] = {
    "hierarchical_chunks": _CHUNKS,
    "scan_page_profile": f"SELECT source, count(*) AS pages, CAST(coalesce(sum(len({words('content')})), 0) AS BIGINT) AS n_words, CAST(coalesce(sum(length(content)), 0) AS BIGINT) AS n_chars, count(*) FILTER (content IS NULL) AS n_null FROM page_in GROUP BY source",
    "document_plain_text": r"""SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '(?is)<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^<>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t]+', ' ', 'g'), ' ') AS plain FROM documents""",
    "ocr_fallback_choice": f"""SELECT row_id, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS n_chars FROM (SELECT row_id, CASE WHEN length({strip("a")}) < 50 AND length({strip("b")}) > length({strip("a")}) THEN b ELSE a END AS t FROM (
      SELECT row_id, CASE WHEN NOT ocr AND content IS NOT NULL THEN content ELSE '' END AS a, CASE WHEN ocr AND content IS NOT NULL THEN content ELSE '' END AS b FROM page_in))""",
    "latest_page_deliveries": "SELECT row_id, source, page_number FROM (SELECT *, row_number() OVER (PARTITION BY source, page_number ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS n FROM page_in) WHERE n = 1",
    "first_n_pages_concat": r"SELECT source, CAST(n AS INTEGER) AS n_pages, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5 FROM (SELECT source, count(*) AS n, string_agg(coalesce(content, ''), chr(10) || chr(10) || '--- Page Break ---' || chr(10) || chr(10) ORDER BY page_number, row_id) AS t FROM page_in WHERE page_number BETWEEN 1 AND 5 GROUP BY source)",
    "known_entities": "SELECT DISTINCT trim(customer, ' ') AS name FROM intake WHERE trim(customer, ' ') <> '' AND trim(customer, ' ') <> 'Unknown Customer'",
    "page_gate": f"SELECT row_id, CAST(n AS INTEGER) AS n_words, n <= 350 AS whole_page FROM (SELECT row_id, coalesce(len({words('content')}), 0) AS n FROM page_in)",
    "line_explode_spurious": f"SELECT row_id, CAST(line_no AS INTEGER) AS line_no, {_SPURIOUS} AS spurious FROM ({_LINES})",
    "list_item_flag": f"SELECT row_id, CAST(line_no AS INTEGER) AS line_no FROM ({_LINES}) WHERE regexp_matches({strip('line')}, '{LIST_ITEM}')",
    "header_parse": f"SELECT row_id, line_no, clause_id, title, CAST(level AS INTEGER) AS level, valid FROM ({_HEADERS})",
    "title_cleanup": f"""SELECT chunk_id, CASE WHEN length(s) >= 2 AND (regexp_full_match(s, '(?s)\\*.*\\*') OR regexp_full_match(s, '(?s)_.*_')) THEN substr(s, 2, length(s) - 2) ELSE s END AS short_title, c AS clean_title FROM (
      SELECT chunk_id, c, {strip(f"CASE WHEN len({words('c')}) > 4 THEN array_to_string(({words('c')})[1:4], ' ') || '...' ELSE c END")} AS s FROM (SELECT chunk_id, rtrim(clause_title, ' ,;:') AS c FROM chunk_out WHERE clause_title IS NOT NULL))""",
    "title_extend": f"""SELECT chunk_id, CASE WHEN lower(regexp_replace(({words("clause_title")})[-1], '[.,:;]+$', '')) IN ({_ENDINGS}) AND len({words("n")}) > 0 AND NOT regexp_matches({strip("n")}, '{LIST_ITEM}')
      THEN clause_title || ' ' || array_to_string(({words("n")})[1:10], ' ') ELSE clause_title END AS extended FROM (SELECT chunk_id, clause_title, {_SECOND} AS n FROM chunk_out WHERE clause_title IS NOT NULL AND content IS NOT NULL AND len({lines("content")}) > 1)""",
    "hierarchy_stack": f"""WITH h AS MATERIALIZED (SELECT * FROM ({_HEADERS}) WHERE valid)
      SELECT i.row_id, i.line_no, string_agg(j.clause_id, '>' ORDER BY j.line_no) AS stack FROM h AS i JOIN h AS j ON i.row_id = j.row_id AND j.line_no <= i.line_no
      WHERE NOT EXISTS (SELECT 1 FROM h AS k WHERE k.row_id = i.row_id AND k.line_no > j.line_no AND k.line_no <= i.line_no AND k.level <= j.level) GROUP BY i.row_id, i.line_no""",
    "name_normalize": rf"SELECT intake_id, cleaned, CASE WHEN cleaned IS NULL OR cleaned = '' OR lower(cleaned) IN ('unknown customer', 'litribigox beverages group', 'lestuvolas foods and sons ltd', 'polar quay storage') THEN 'Unknown Customer' ELSE trim(regexp_replace(cleaned, '(?i)\s?(?:pty limited|pty ltd|limited|ltd|inc|llc|plc)$', ''), ' ,.') END AS normalized FROM ({_NAMES})",
    "country_standardize": r"""SELECT intake_id, CASE WHEN c IS NULL OR c = '' OR lower(c) = 'unknown region' THEN 'Unknown Region' WHEN lower(c) IN ('usa', 'us', 'united states of america') THEN 'United States' WHEN lower(c) IN ('uk', 'united kingdom', 'great britain', 'g.b.') THEN 'United Kingdom' ELSE c END AS country
      FROM (SELECT intake_id, trim(regexp_replace(trim(region, ' ,.()"''*_'), '\s+', ' ', 'g'), ' ') AS c FROM intake)""",
    "keyword_dictionary": r"""SELECT keyword, max(name) AS name FROM (SELECT k AS keyword, name FROM n WHERE k IS NOT NULL UNION ALL SELECT replace(lower(name), ' ', ''), name FROM n WHERE k IS NOT NULL) GROUP BY keyword""",
    "sparse_encode": f"SELECT chunk_id, token, round(weight, 6) AS weight FROM ({tokens('chunk_out', 'chunk_id', 'content')})",
    "sparse_topn": f"SELECT query_id, chunk_id, score, CAST(rnk AS INTEGER) AS rnk FROM ({_SPARSE})",
    "dense_topk": f"SELECT query_id, chunk_id, round(distance, 6) AS distance, CAST(rnk AS INTEGER) AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 6), chunk_id) AS rnk FROM ({_DISTANCES})) WHERE rnk <= 100",
    "dense_threshold": f"SELECT query_id, chunk_id, round(similarity, 4) AS similarity, CAST(rnk AS INTEGER) AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rnk FROM (SELECT query_id, chunk_id, round(1 - round(distance, 6) * round(distance, 6) / 2, 6) AS similarity FROM ({_DISTANCES})) WHERE similarity >= 0.7) WHERE rnk <= 100",
    "rrf_fusion": f"SELECT query_id, chunk_id, rrf, first_seen, CAST(rnk AS INTEGER) AS rnk FROM ({fused('hit')})",
    "rerank_blend": f"SELECT query_id, chunk_id, rrf, rerank, round(combined, 6) AS combined, CAST(rnk AS INTEGER) AS rnk FROM ({blended('hit')})",
    "dynamic_k_combined": f"SELECT query_id, CAST({_K} AS INTEGER) AS k FROM ({blended('hit')}) GROUP BY query_id",
    "dynamic_k_rrf": f"SELECT query_id, CAST(least(greatest(count(*) FILTER (rrf >= 0.0000003), 1), 12) AS INTEGER) AS k FROM ({fused('hit')}) GROUP BY query_id",
    "smart_select": f"""WITH owned AS MATERIALIZED ({_OWNED}), ks AS (SELECT query_id, {_K} AS k FROM ({blended("hit")}) GROUP BY query_id),
      targets AS (SELECT query_id, customer FROM (SELECT query_id, customer, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, customer) AS r FROM owned GROUP BY query_id, customer) WHERE r <= 2),
      turns AS (SELECT o.*, row_number() OVER (PARTITION BY o.query_id, o.customer ORDER BY o.rnk) AS rn FROM owned AS o JOIN targets USING (query_id, customer))
      SELECT query_id, chunk_id, customer, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rn > 2, CASE WHEN rn <= 2 THEN rnk END, rn, customer) AS pos FROM turns) JOIN ks USING (query_id) WHERE pos <= k""",
    "citations": f"SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS cite_no, {_CITATION} AS label FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, page_number ORDER BY pos) AS n FROM ({selected('hit')}) JOIN chunk_out USING (chunk_id)) WHERE n = 1",
    "map_extract": f"SELECT query_id, CAST(pos AS INTEGER) AS pos, extract FROM ({_EXTRACT})",
    "reduce_concat": f"SELECT query_id, string_agg(extract, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS answer FROM ({_EXTRACT}) GROUP BY query_id",
    "answer_questions": f"""WITH texts AS (SELECT query_id, {_ANSWER} AS answer FROM ({_EXTRACT}) GROUP BY query_id),
      cited AS (SELECT query_id, string_agg(label, '; ' ORDER BY pos) AS sources FROM (SELECT *, {_CITATION} AS label, row_number() OVER (PARTITION BY query_id, source, page_number ORDER BY pos) AS n FROM ({selected("hit")}) JOIN chunk_out USING (chunk_id)) WHERE n = 1 GROUP BY query_id),
      answered AS (SELECT query_id, CASE WHEN text IS NULL OR trim(text, ' \t\r\n') = '' THEN 'Please enter a valid query.' ELSE coalesce(answer, 'Could not find relevant documents for your query after selection (Limit: 1 chunks).') END AS answer, coalesce(sources, '') AS sources FROM question LEFT JOIN texts USING (query_id) LEFT JOIN cited USING (query_id))
      SELECT *, contains(answer, 'Error:') OR contains(answer, 'Could not find') OR contains(answer, 'System not ready') OR contains(answer, 'Found relevant documents, but none matched') AS is_error FROM answered""",
    "explain_retrieval": f"""SELECT b.query_id, b.chunk_id, dense_rnk, sparse_rnk, rrf, rerank, round(combined, 6) AS combined, CAST(b.rnk AS INTEGER) AS rnk, CAST(pos AS INTEGER) AS pos FROM ({blended("hit")}) AS b
      JOIN (SELECT query_id, doc_key, min(rnk) FILTER (retriever = 'dense') AS dense_rnk, min(rnk) FILTER (retriever = 'sparse') AS sparse_rnk FROM ({keyed("hit")}) GROUP BY query_id, doc_key) AS l ON l.query_id = b.query_id AND l.doc_key = b.doc_key
      LEFT JOIN (SELECT query_id, chunk_id, pos FROM ({selected("hit")})) AS s ON s.query_id = b.query_id AND s.chunk_id = b.chunk_id""",
    "answer_error_class": "SELECT query_id, contains(a, 'Error:') OR contains(a, 'Could not find') OR contains(a, 'System not ready') OR contains(a, 'Found relevant documents, but none matched') AS is_error FROM (SELECT query_id, CASE WHEN contains(text, '?') THEN 'Error: ' || text ELSE text END AS a FROM question)",
    "prompt_header_clean": f"""SELECT chunk_id, md5(t) AS document_md5, CAST(length(t) AS INTEGER) AS n_chars FROM (SELECT chunk_id, 'Source: ' || coalesce(source, 'Unknown') || ' | Page: ' || coalesce(CAST(page_number AS VARCHAR), 'N/A') || ' | Customer: ' || coalesce(customer, 'Unknown') || ' | Clause: ' || coalesce(clause, 'N/A') || chr(10) || '---' || chr(10)
      || {strip("regexp_replace(regexp_replace(coalesce(content, ''), '(?m)^```[a-zA-Z]*\\n', '', 'g'), '(?m)\\n```$', '', 'g')")} AS t FROM chunk_out)""",
    "debug_preview": "SELECT query_id, retriever, rnk, chunk_id, CASE WHEN content <> '' THEN substr(content, 1, 250) || '...' ELSE content END AS preview FROM hit JOIN chunk_out USING (chunk_id)",
    "reference_edges": _EDGES,
    "reference_closure": f"WITH RECURSIVE edges AS MATERIALIZED ({_EDGES}), paths AS (SELECT source, src, dst FROM edges UNION SELECT p.source, p.src, e.dst FROM paths AS p JOIN edges AS e ON p.source = e.source AND p.dst = e.src) SELECT source, src, dst FROM paths",
    "grid_tables": rf"""WITH given AS (SELECT chunk_id, content FROM chunk_out UNION ALL {_FINANCIAL}) SELECT chunk_id, CAST(n AS INTEGER) AS table_no, grid, CASE WHEN regexp_matches(b, '{HEADER}') THEN 'Clause ' || regexp_extract(b, '{HEADER}', 1) || ': ' || {strip(f"regexp_extract(b, '{HEADER}', 2)")} ELSE 'N/A' END AS context FROM (
      SELECT chunk_id, n, grid, substr(content, 1, instr(content, grid) - 1) AS b FROM (SELECT chunk_id, content, unnest(g) AS grid, generate_subscripts(g, 1) AS n FROM (SELECT chunk_id, content, regexp_extract_all(content, '(?s)\+[-+]+?\+[\n\r].*?\+[-+]+?\+') AS g FROM given)))""",
    "formula_extract": r"""SELECT chunk_id, unnest(regexp_extract_all(content, '(?is)\\text\{Balancing Payment\}\s*=\s*\\left\(\\frac\{A\}\{B\}\s*\\times\s*\$?\s*2,600,000\\right\)\s*-\s*\$?\s*2,600,000')) AS formula, 'A,B' AS variables, '((A / B) * 2600000) - 2600000' AS calculation FROM (SELECT chunk_id, content FROM chunk_out UNION ALL """
    + _FINANCIAL
    + ")",
    "trace_email_inherit": f"SELECT run_id, email FROM ({_EMAIL})",
    "trace_tags": f"SELECT run_id, tag || CASE WHEN email IS NULL THEN '' ELSE ',user:' || email END AS tags FROM ({_EMAIL})",
    "index_roundtrip": f"""SELECT 'chunks' AS artefact, chunk_id, 1 AS rows, md5(concat_ws('|', source, page_number, content, customer, clause, array_to_string(hierarchy, '>'))) AS digest FROM chunk_out
      UNION ALL SELECT 'postings', chunk_id, CAST(count(*) AS INTEGER), md5(array_to_string(list_sort(list(token || '=' || CAST(round(weight * 1000000) AS BIGINT))), ',')) FROM ({tokens('chunk_out', 'chunk_id', 'content')}) GROUP BY chunk_id
      UNION ALL SELECT 'vectors', chunk_id, 1, md5({_WHOLE}) FROM ({vectors('chunk_out', 'chunk_id', 'content')})""",
    "dense_encode": f"SELECT query_id, {_WHOLE} AS vector FROM ({vectors('question', 'query_id', 'text')})",
    "dense_ask": f"SELECT query_id, chunk_id, CAST(rnk AS INTEGER) AS rnk FROM ({_DENSE})",
    "sparse_ask": f"SELECT query_id, chunk_id, CAST(rnk AS INTEGER) AS rnk FROM ({sparse(_ASKED)})",
    "hybrid_ask": f"SELECT query_id, CAST(pos AS INTEGER) AS pos, chunk_id, source, page_number, round(combined, 6) AS score, {_CITATION} AS citation FROM ({selected(_BOTH)}) JOIN chunk_out USING (chunk_id)",
    "hybrid_ask_by_customer": _BY_CUSTOMER,
    "dense_only_ask": f"""WITH f AS ({fused(f"(SELECT query_id, chunk_id, 'dense' AS retriever, rnk FROM ({_DENSE}))")}) SELECT query_id, CAST(rnk AS INTEGER) AS pos, chunk_id, source, page_number, round(rrf, 9) AS score FROM f
      JOIN (SELECT query_id, least(greatest(count(*) FILTER (rrf >= 0.0000003), 1), 12) AS k FROM f WHERE rnk <= 12 GROUP BY query_id) USING (query_id) JOIN chunk_out USING (chunk_id) WHERE rnk <= k""",
    "fused_without_rerank": f"""WITH f AS ({fused('hit')}) SELECT query_id, chunk_id, CAST(rnk AS INTEGER) AS pos, rrf AS score FROM f
      JOIN (SELECT query_id, least(greatest(count(*) FILTER (rrf >= 0.0000003), 1), 12) AS k FROM f WHERE rnk <= 12 GROUP BY query_id) USING (query_id) WHERE rnk <= k""",
    "fixed_k": f"SELECT query_id, chunk_id, CAST(rnk AS INTEGER) AS pos FROM ({blended('hit')}) WHERE rnk <= 12",
    "entity_detect": f"SELECT query_id, array_to_string(names, '|') AS names, filter_name FROM ({_DETECT})",
    "single_entity_filter": f"SELECT query_id, chunk_id, customer, CAST(rnk AS INTEGER) AS rnk FROM ({owned('hit')})",
    "party_detect": f"""SELECT source, customer, CASE WHEN customer = 'Unknown Customer' OR r = '' THEN 'Unknown Region' WHEN lower(r) = 'usa' THEN 'United States' WHEN lower(r) = 'united kingdom' THEN 'United Kingdom' ELSE r END AS region FROM (SELECT source, customer, {_SOON} AS r FROM ({_PARTY}))""",
    "entity_dictionary": "SELECT DISTINCT trim(customer, ' ') AS name FROM intake WHERE trim(customer, ' ') <> '' AND trim(customer, ' ') <> 'Unknown Customer'",
    "property_filter": "SELECT row_id, concat_ws(',', CASE WHEN customer IS NOT NULL THEN 'customer' END, CASE WHEN ocr IS NOT NULL THEN 'ocr' END, CASE WHEN region IS NOT NULL THEN 'region' END) AS names, (customer IS NOT NULL)::INT + (region IS NOT NULL)::INT + (ocr IS NOT NULL)::INT AS n FROM page_in",
}
ORACLE["keyword_dictionary"] = f"SELECT keyword, name FROM {_DICTIONARY}"
