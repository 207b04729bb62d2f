"""Plans over fixed questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import urls as U
from lodestone.plans import questions as P
from lodestone.registry import register
from lodestone.sources.tables import table

from . import duck as D

YEAR = 2026
#: How questions are put; each user's turn in `conversations` is asked as it stands and once behind one of these.
ASKED = [
    "When did Python 3.11.4 come out?",
    "Is RFC 7231 stricter than PEP 20?",
    "analyze MCP Python SDK docs: which transport for a server?",
    "What does HTTP status 429 mean and what is CVE-2024-12345?",
    "How does SQLite WAL differ from rollback journals?",
    "Why does curl fail with socks5h and error code 97?",
    "latest price of widgets for 3.50 dollars",
    "What is the capital of a country",
    "the github repo owner/name and https://github.com/Other/Thing.git/tree",
    "Which IPv4 private address range is it? What are those for?",
    "According to IETF, is HTTP/2 better versus HTTP/1.1; what is TLS Protocol",
    "cost 12.50 version 2.1 v3.4.5 Name 1.2 USD 4.5",
    "",
]


def asked(spark, sf_dir):
    """(id, question): the user turns, ids from 0, and below 0 the same turns behind the forms of ASKED.

    Letters beyond ASCII stand as `e`: DuckDB's word boundaries, which the SQL needs, know ASCII letters only, the engine's know all.
    """
    t = table(spark, sf_dir, "conversations").filter("role = 'user' and text is not null")
    t = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.regexp_replace("text", r"[^\x00-\x7F]", "e").alias("question"))
    form = F.get(F.lit(ASKED), (F.col("id") % len(ASKED)).cast("int"))
    return t.unionByName(t.select((-F.col("id") - 1).alias("id"), F.concat(form, F.lit(" "), "question").alias("question")))


def _list(texts) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in texts) + "]"


_USER = r"SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS id, regexp_replace(text, '[^\x00-\x7F]', 'e', 'g') AS question FROM conversations WHERE role = 'user' AND text IS NOT NULL"
_ASKED = f"""(SELECT id, question FROM ({_USER}) UNION ALL
  SELECT -id - 1, {_list(ASKED)}[id % {len(ASKED)} + 1] || ' ' || question FROM ({_USER})) AS v(id, question)"""


def batches(spark, sf_dir):
    """(id, question): each user turn's sentences as one compound question, in the ways in which such are written."""
    t = asked(spark, sf_dir).filter("id >= 0").withColumn("s", F.filter(F.transform(F.split("question", r"[.\n]"), lambda x: F.trim(x)), lambda x: x != ""))
    numbered = lambda before, after, between: F.array_join(F.transform("s", lambda x, k: F.concat(F.lit(before), (k + 1).cast("string"), F.lit(after), x)), between)
    ways = [
        F.to_json("s"), F.concat(F.lit('{"queries": '), F.to_json("s"), F.lit("}")), F.concat(F.lit("- "), F.array_join("s", "\n- ")), numbered("", ". ", "\n"), numbered("Query ", ": ", " "),
        F.concat(F.array_join("s", "? "), F.lit("?")), F.array_join("s", "; "), F.array_join("s", " | "), F.array_join("s", " OR "), F.array_join("s", ". "),
    ]
    return t.select("id", F.coalesce(*(F.when(F.floor(F.col("id") / 1000) % len(ways) == k, w) for k, w in enumerate(ways))).alias("question"))


_WAYS = [
    "CAST(to_json(s) AS VARCHAR)", """'{"queries": ' || CAST(to_json(s) AS VARCHAR) || '}'""", "'- ' || array_to_string(s, chr(10) || '- ')", "array_to_string(list_transform(s, lambda x, k: k || '. ' || x), chr(10))",
    "array_to_string(list_transform(s, lambda x, k: 'Query ' || k || ': ' || x), ' ')", "array_to_string(s, '? ') || '?'", "array_to_string(s, '; ')", "array_to_string(s, ' | ')", "array_to_string(s, ' OR ')", "array_to_string(s, '. ')",
]
_BATCHES = f"""(SELECT id, CASE {' '.join(f"WHEN id // 1000 % {len(_WAYS)} = {k} THEN {w}" for k, w in enumerate(_WAYS))} END FROM
  (SELECT id, list_filter(list_transform(string_split_regex(question, '[.\\n]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM ({_USER}))) AS v(id, question)"""


# ---- the rules on identifiers and authorities in SQL: CTEs over v(id, question) ----

_NUMBER = r"(\d+\.\d+(?:\.\d+){0,2})"
_REPO_URL = rf"(?i)(?:https?://)?(?:www\.)?github\.com/({P.REPOSITORY})(?:/[^\s]*)?"
_hit = lambda pattern, x="n": f"regexp_matches({x}, '{pattern}')"
_all = lambda pattern, x="question": f"regexp_extract_all({x}, '{pattern}', 1)"
_TYPED = (r"(?i)\b(?:rfc|pep)\s*[-#:]?\s*(\d{1,5})\b", r"(?i)\bhttp\s+status(?:\s+code)?\s+(\d{3})\b", r"(?i)\b(?:status|error)\s+code\s*[:#-]?\s*(\d{3,5})\b", r"(?i)\b(?:port|issue)\s*[:#-]?\s*(\d{1,5})\b")
_FIRST_WORD = r"regexp_extract(m, '^(\S+)', 1)"
_PLAIN = rf"""list_transform(list_filter({_all(rf'\b([A-Za-z][A-Za-z0-9+#.-]*\s+{_NUMBER})\b')}, lambda m: {D.casefold(_FIRST_WORD)} NOT IN ({', '.join(f"'{w}'" for w in P.PRICE_WORDS)})
  AND (regexp_matches(regexp_extract(m, '\s{_NUMBER}$', 1), '\..*\.') OR NOT regexp_matches(lower(regexp_extract(m, '^(\S+)', 1)), '(usd|eur|gbp)$'))), lambda m: regexp_extract(m, '\s{_NUMBER}$', 1))"""
_FIRST = "list_filter({0}, lambda p, i: list_position(list_transform({0}, lambda x: lower(x)), lower(p)) = i)"
_NAMED = rf"""list_filter(list_concat({_all(_REPO_URL)}, {_all(f'[^A-Za-z0-9_.-]({P.REPOSITORY})', f"(' ' || regexp_replace(question, '{_REPO_URL}', ' ', 'g'))")}), lambda r: NOT regexp_matches(lower(r), '^(http/|https/|github.com/)'))"""


def subject_sql(rel: str) -> str:
    """CTEs up to subjects(id, question, n, repos, sdk, path, anchors, h, sources) over rel(id, question)."""
    return rf"""
q0 AS (SELECT id, question, {D.compact(D.casefold('question'))} AS n, CASE WHEN regexp_matches(question, '(?i)\b(?:github|repo|repository|source\s+code)\b') THEN {_NAMED} ELSE [] END AS named FROM {rel}),
q1 AS (SELECT *, {_FIRST.format('named')} AS repos, regexp_matches(n, '\b(?:mcp|model context protocol)\b') AND contains(n, 'python') AND contains(n, 'sdk') AND (regexp_matches(question, '{P.REFERENCE}') OR regexp_matches(question, '{P.GUIDE}'))
  AND NOT regexp_matches(question, '{P.ADVISORY}') AND NOT (regexp_matches(question, '{P.TROUBLE}') AND NOT regexp_matches(question, '{P.REFERENCE}')) AS sdk FROM q0),
q2 AS (SELECT *, CASE WHEN sdk THEN CASE WHEN regexp_matches(n, '\b(?:server|deploy|deployment|transport|streamable|stdio|sse)\b') THEN '/server/' WHEN regexp_matches(n, '\b(?:client|connect|connection|oauth|authorization)\b') THEN '/client/'
  WHEN regexp_matches(n, '\b(?:install|installation|pip|uv)\b') THEN '/installation/' ELSE '/' END END AS path, regexp_extract(n, '\bpython\s+(\d+)\.(\d+)\.(\d+)\b', ['a', 'b', 'c']) AS py, regexp_extract(n, '\bhttp\s+status(?:\s+code)?\s+(\d{{3}})\b', 1) AS status,
  list_sort(list_distinct(list_transform(list_concat({_all(r'(?i)\b(CVE-\d{4}-\d{4,7})\b')}, {_all(r'\b(\d{1,3}(?:\.\d{1,3}){3})\b')}, {_all(rf'(?i)\b(?:version|ver\.?|v)\s*{_NUMBER}\b')}, {_PLAIN},
    {', '.join(_all(p) for p in _TYPED)}, list_filter({_all(r'\b([A-Z][A-Z0-9]{1,9})\b')}, lambda w: w NOT IN ('THE', 'AND', 'FOR')), repos), lambda w: {D.casefold('w')}))) AS anchors FROM q1),
hints AS (SELECT id, question, n, repos, sdk, path, anchors, list_filter(list_concat([
  CASE WHEN sdk THEN {{'url': 'https://py.sdk.modelcontextprotocol.io' || path, 'title': 'Official MCP Python SDK documentation'}} END,
  CASE WHEN path = '/server/' THEN {{'url': 'https://raw.githubusercontent.com/modelcontextprotocol/python-sdk/v1.x/docs/server.md', 'title': 'Official MCP Python SDK server transport documentation source'}} END,
  CASE WHEN py.a <> '' AND regexp_matches(question, '{P.RELEASE}') AND NOT regexp_matches(question, '{P.ADVISORY}') THEN {{'url': 'https://www.python.org/downloads/release/python-' || py.a || py.b || py.c || '/', 'title': 'Python ' || py.a || '.' || py.b || '.' || py.c || ' official release'}} END,
  CASE WHEN status <> '' THEN {{'url': 'https://www.iana.org/assignments/http-status-codes/http-status-codes.xhtml', 'title': 'IANA official HTTP status code registry: ' || status}} END,
  CASE WHEN contains(n, 'ipv4') AND contains(n, 'private') AND regexp_matches(n, '\b(?:address|block|range)\w*\b') THEN {{'url': 'https://www.iana.org/assignments/iana-ipv4-special-registry/iana-ipv4-special-registry.xhtml', 'title': 'IANA official IPv4 special-purpose address registry'}} END],
  list_transform({_all(r'\brfc\s*[-#:]?\s*(\d{3,5})\b', 'n')}[1:2], lambda x: {{'url': 'https://www.rfc-editor.org/rfc/rfc' || x || '.html', 'title': 'RFC ' || x || ' official publication'}}),
  list_transform({_all(r'\bpep\s*[-#:]?\s*(\d{1,4})\b', 'n')}[1:2], lambda x: {{'url': 'https://peps.python.org/pep-' || lpad(x::INT::VARCHAR, 4, '0') || '/', 'title': 'PEP ' || x::INT || ' official publication'}}), [
  CASE WHEN contains(n, 'sqlite') AND regexp_matches(n, '\b(?:wal|write[- ]ahead log)\b') THEN {{'url': 'https://www.sqlite.org/wal.html', 'title': 'SQLite official write-ahead logging documentation'}} END,
  CASE WHEN contains(n, 'curl') AND regexp_matches(n, '\bsocks5h?\b') THEN {{'url': 'https://curl.se/docs/manpage.html#--socks5-hostname', 'title': 'curl official SOCKS proxy and hostname-resolution documentation'}} END],
  list_transform(repos[1:2], lambda r: {{'url': 'https://github.com/' || r, 'title': 'Official source repository ' || r}})), lambda h: h IS NOT NULL) AS h FROM q2),
subjects AS (SELECT *, list_filter(h, lambda x, i: list_position(list_transform(h, lambda y: y.url), x.url) = i) AS sources FROM hints)"""


_VARIANT = rf"""CASE WHEN sdk THEN 'site:py.sdk.modelcontextprotocol.io "MCP Python SDK" ' || CASE path WHEN '/server/' THEN 'server transport' WHEN '/client/' THEN 'client' WHEN '/installation/' THEN 'installation' ELSE 'documentation' END
  WHEN version <> '' AND regexp_matches(question, '{P.RELEASE}') AND NOT regexp_matches(question, '{P.ADVISORY}') THEN 'site:python.org "Python ' || version || '" release' WHEN {_hit(r'\b(?:rfc|http\s+status|internet standard|ietf)\b', 'c')} THEN 'site:rfc-editor.org ' || question
  WHEN contains(c, 'sqlite') THEN 'site:sqlite.org ' || question WHEN contains(c, 'curl') THEN 'site:curl.se ' || question END"""


def plan_sql(rel: str) -> str:
    """CTEs up to plans(id, q, queries, topics, late) over rel(id, question)."""
    stop = ", ".join(f"'{w}'" for w in P.PLAN_STOP)
    said = lambda p: f"regexp_matches(question, '(?i){p}')"
    late = rf"({said(r'\b(latest|current|today|recent|price|as of|right now)\b')} OR regexp_matches(question, '\b{YEAR}\b'))"
    short = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.ABBREVIATIONS.items())
    intents = ", ".join(f"CASE WHEN {said(rf'\b{t}\w*\b')} THEN '{t}' END" for t in ("production", "transport", "release", "standard", "security"))
    return rf"""{subject_sql(f"(SELECT id, {D.compact('question')} AS question FROM {rel})")},
v0 AS (SELECT *, {D.casefold('question')} AS c, regexp_extract(question, '(?i)\bpython\s+(\d+\.\d+(?:\.\d+)?)\b', 1) AS version, list_filter(regexp_extract_all(question, '{P.WORD}', 1), lambda w: lower(w) NOT IN ({stop}) AND length(w) > 2) AS ents,
  list_transform(string_split_regex(question, '(?i)[;?]|\b(?:and|versus|vs\.)\b'), lambda x: {D.compact('x')}) AS parts, regexp_extract(question, '\b([A-Z][A-Za-z0-9+#.-]*)\s+{_NUMBER}\b', ['name', 'number']) AS v,
  list_filter(regexp_extract_all(question, '\b((?:[A-Z]{{2,10}}|[A-Z][a-z]+)(?:\s+(?:[A-Z]{{2,10}}|[A-Z][a-z]+)){{1,3}})\b', 1), lambda p: regexp_matches(p, '(^|\s)[A-Z]{{2,}}(\s|$)') AND lower(regexp_extract(p, '^(\S+)', 1)) NOT IN ('according', 'how', 'in', 'on', 'what', 'when', 'which')) AS fine FROM subjects),
v1 AS (SELECT *, {_VARIANT} AS variant, {late} AS late, CASE WHEN len(list_filter(parts, lambda x: contains(x, ' '))) > 0 THEN list_filter(parts, lambda x: contains(x, ' ')) WHEN len(ents) > 0 THEN [array_to_string(ents[1:6], ' ')] ELSE [] END[1:8] AS topics, array_to_string(ents[1:12], ' ') AS focused,
  coalesce(nullif(array_to_string(ents[1:12], ' '), ''), question) AS focus, CASE WHEN v.number <> '' THEN '"' || v.name || ' ' || v.number || '" ' || CASE WHEN {said(r'\b(?:date|release|released)\b')} THEN 'release date' ELSE 'official documentation' END
  WHEN len(fine) > 0 THEN '"' || fine[1] || '" ' || coalesce(nullif(array_to_string(list_filter([{intents}], lambda x: x IS NOT NULL)[1:3], ' '), ''), 'official documentation') END AS phrase FROM v0),
v2 AS (SELECT *, list_filter(list_concat([question, phrase, variant, CASE WHEN focused <> '' AND {D.casefold('focused')} <> c THEN focused END, focus || ' official documentation'], list_transform(topics[1:1], lambda t: t || ' official documentation'),
  [CASE WHEN {said(r'\b(error|exception|failed|traceback|code\s+\d+)\b')} THEN '"' || question || '" issue tracker' END], CASE WHEN {said(r'\b(compare|versus|vs\.?|difference|better)\b')} THEN list_transform(topics[1:2], lambda t: t || ' specification benchmark') ELSE [] END,
  [CASE WHEN late THEN focus || ' current release notes {YEAR}' WHEN {said(r'\b(?:release|released)\b')} AND regexp_matches(question, '\b\d+\.\d+(?:\.\d+)?\b') THEN focus || ' official release page' END],
  list_transform(list_filter(ents, lambda e: lower(e) IN ({', '.join(f"'{k}'" for k in P.ABBREVIATIONS)})), lambda e: question || ' ' || CASE lower(e) {short} END),
  [CASE WHEN {said(r'\b(?:paper|peer-reviewed|research|study|evidence)\b')} THEN focus || ' research paper benchmark' END], [CASE WHEN {said(r'\b(?:bug|error|exception|failed|failure|issue|traceback|troubleshoot)\b')} THEN focus || ' issue tracker discussion' END]), lambda x: x IS NOT NULL) AS every FROM v1),
plans AS (SELECT id, question AS q, c, anchors, topics, late, list_transform(list_filter(every, lambda x, i: list_position(list_transform(every, lambda y: {D.casefold('y')}), {D.casefold('x')}) = i), lambda x: left(x, 500))[1:8] AS queries FROM v2)"""


_MARK = r"^\s*(?:[-*•]|\d{1,2}[.)])\s"
_LABEL = r"(?:query|search)\s+\d{1,2}\s*[:.)-]"
_SEVERAL = lambda x: f"CASE WHEN len({x}) >= 2 AND len(list_filter({x}, lambda p: len(regexp_extract_all(p, '{P.WORD}')) < 3)) = 0 THEN {x} END"
_FILLED = lambda x: f"list_filter(list_transform({x}, lambda p: trim(p)), lambda p: p <> '')"


def split_sql(rel: str, limit: int = 4) -> str:
    """CTEs up to splits(id, facets) over rel(id, question)."""
    lines = r"list_filter(string_split_regex(question, '\r?\n'), lambda p: trim(p) <> '')"
    return rf"""
b0 AS (SELECT id, question, {D.compact('question')} AS whole, {lines} AS lines, coalesce(from_json(CASE WHEN starts_with(trim(question), '[') THEN trim(question) END, '["VARCHAR"]'), from_json(CASE WHEN starts_with(trim(question), '{{') THEN trim(question) END, '{{"queries": ["VARCHAR"]}}').queries) AS listed FROM {rel}),
b1 AS (SELECT *, CASE WHEN len(list_filter(lines, lambda p: NOT regexp_matches(p, '{_MARK}'))) = 0 THEN list_transform(lines, lambda p: trim(regexp_replace(p, '{_MARK}*', ''))) END AS marked,
  list_transform(string_split(regexp_replace(whole, '(?i)\s+({_LABEL})', chr(1) || '\1', 'g'), chr(1)), lambda p: regexp_replace(p, '(?i)^{_LABEL}\s*', '')) AS labelled, list_transform({_FILLED("string_split(whole, '?')")}, lambda p: p || '?') AS asked,
  {_FILLED(r"string_split_regex(whole, '\s*;\s*')")} AS halves, {_FILLED(r"string_split_regex(whole, '\s+\|\s+')")} AS bars, {_FILLED(r"string_split_regex(whole, '\s+(?:OR|\|\|)\s+')")} AS ors FROM b0),
b2 AS (SELECT id, whole, coalesce(CASE WHEN len(listed) > 0 THEN listed END, {', '.join(_SEVERAL(c) for c in ('marked', 'labelled', 'asked', 'halves', 'bars', 'ors'))}, [whole]) AS parts FROM b1),
b3 AS (SELECT id, whole, list_filter(list_transform(parts, lambda p: left(regexp_replace({D.compact('p')}, '^[;|,\s]+', ''), 500)), lambda p: p <> '') AS tidy FROM b2),
b4 AS (SELECT id, whole, list_filter(tidy, lambda p, i: list_position(list_transform(tidy, lambda x: {D.casefold('x')}), {D.casefold('p')}) = i)[1:{limit}] AS f FROM b3),
splits AS (SELECT id, CASE WHEN len(f) >= 2 THEN f ELSE [whole] END AS facets FROM b4)"""


def mode_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", P.mode(F.coalesce("text", F.lit(""))).alias("mode"))
    lit = asked(spark, sf_dir).select(F.col("id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), P.mode(F.col("question")).alias("mode"))
    return rows.unionByName(lit).join(F.broadcast(P.budgets(spark)), "mode").select("conv_id", "turn", "mode", "queries", "pages", "passages", "rounds")


register("mode_budget", ("Q1", "Q2", "J10"), mode_budget, f"""
WITH a AS (SELECT conv_id, turn, coalesce(text, '') AS q FROM conversations WHERE role = 'user' UNION ALL SELECT id, -1, question FROM {_ASKED}),
m AS (SELECT conv_id, turn, CASE WHEN regexp_matches({D.compact(D.casefold('q'))}, '{"|".join(P.DEEP)}') THEN 'deep' ELSE 'standard' END AS mode FROM a)
SELECT conv_id, turn, mode, queries, pages, passages, rounds FROM m JOIN {D.values([(b[0], b[1], b[3], b[4], b[5]) for b in P.BUDGETS], 'b(mode, queries, pages, passages, rounds)')} USING (mode)""")


def fallback_query(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), P.fallback(F.coalesce("text", F.lit(""))).alias("fallback"))
    return d.unionByName(asked(spark, sf_dir).select((-F.col("id") - 1).cast("long").alias("id"), P.fallback(F.col("question")).alias("fallback")))


register("fallback_query", ("Q11",), fallback_query, f"""
WITH a AS (SELECT item_id AS id, coalesce(text, '') AS q FROM benchmark UNION ALL SELECT CAST(-id - 1 AS BIGINT), question FROM {_ASKED}),
w AS (SELECT id, q, list_filter(regexp_extract_all(q, '{P.WORD}'), lambda w: {D.casefold('w')} NOT IN ({', '.join(f"'{s}'" for s in P.FALLBACK_STOP)}))[1:16] AS w FROM a)
SELECT id, coalesce(nullif(array_to_string(w, ' '), ''), q) AS fallback FROM w""")


def compound_split(spark, sf_dir):
    rows = batches(spark, sf_dir)
    return rows.select("id", F.array_join(P.split_compound(F.col("question")), " || ").alias("facets"))


register("compound_split", ("Q3", "Z10"), compound_split, f"WITH {split_sql(_BATCHES)} SELECT id, array_to_string(facets, ' || ') AS facets FROM splits")


def heuristic_plan(spark, sf_dir):
    p = asked(spark, sf_dir).withColumn("p", P.plan(F.col("question"), YEAR, 8))
    return p.select("id", F.array_join("p.queries", " || ").alias("queries"), F.array_join("p.topics", " || ").alias("topics"), F.col("p.time_sensitive").alias("time_sensitive"))


register("heuristic_plan", ("Q4", "Q5", "Q6"), heuristic_plan, f"WITH {plan_sql(_ASKED)} SELECT id, array_to_string(queries, ' || ') AS queries, array_to_string(topics, ' || ') AS topics, late AS time_sensitive FROM plans")


def compound_plan(spark, sf_dir):
    rows = batches(spark, sf_dir).withColumn("facets", P.split_compound(F.col("question")))
    out = P.plan_compound(rows, "id", "facets", YEAR, 6)
    return out.select("id", F.array_join("queries", " || ").alias("queries"), F.array_join("topics", " || ").alias("topics"), "time_sensitive")


register("compound_plan", ("Q8", "X4"), compound_plan, rf"""
WITH {split_sql(_BATCHES)}, fs AS (SELECT id * 100 + pos AS id, facet AS question FROM (SELECT id, unnest(facets) AS facet, unnest(range(len(facets))) AS pos FROM splits)), {plan_sql('fs')},
m AS (SELECT *, CASE WHEN late THEN 'current release notes' WHEN regexp_matches(c, '\b(?:error|exception|failed|traceback)\b') THEN 'issue tracker' WHEN regexp_matches(c, '\b(?:compare|versus|vs\.?|difference|better)\b') THEN 'specification benchmark' ELSE 'official documentation' END AS marker,
  list_filter(queries, lambda x: {D.casefold('x')} <> c) AS choices FROM plans),
e AS (SELECT m.id // 100 AS id, m.id % 100 AS pos, fs.question AS facet, late, coalesce(list_filter(choices, lambda x: contains({D.casefold('x')}, marker))[1], choices[1]) AS expansion FROM m JOIN fs USING (id)),
g AS (SELECT id, list(facet ORDER BY pos) AS topics, bool_or(late) AS late, list_transform(list_filter(list_concat(list(facet ORDER BY pos), list(expansion ORDER BY pos)), lambda x: x IS NOT NULL), lambda x: {D.compact('x')}) AS every FROM e GROUP BY id),
u AS (SELECT *, list_filter(every, lambda x: x <> '') AS kept FROM g)
SELECT id, array_to_string(list_filter(kept, lambda x, i: list_position(list_transform(kept, lambda y: {D.casefold('y')}), {D.casefold('x')}) = i)[1:6], ' || ') AS queries, array_to_string(topics, ' || ') AS topics, late AS time_sensitive FROM u""")


def ranking_facets(spark, sf_dir):
    return asked(spark, sf_dir).select("id", F.array_join(P.ranking_facets(F.col("question"), P.topics(F.col("question"))), " || ").alias("facets"))


register("ranking_facets", ("Q9",), ranking_facets, rf"""
WITH {plan_sql(_ASKED)}, f AS (SELECT p.id, v.question, anchors, list_filter(topics, lambda t: len({D.meaningful('t')}) >= 2) AS tops, list_filter(list_transform(regexp_extract_all(v.question, '[A-Za-z0-9./_-]+'), lambda w: {D.casefold('w')}), lambda w: list_contains(anchors, w)) AS said FROM plans p JOIN {_ASKED} ON v.id = p.id),
o AS (SELECT *, list_transform(list_transform(tops, lambda t: CASE WHEN len(list_intersect(anchors, {D.meaningful('t')})) > 0 OR NOT (regexp_matches(t, '(?i)\b(?:it|its|itself|they|their|them|those|these|former|latter|same|such)\b') OR (regexp_matches(trim(t), '(?i)^(?:(?:what|which)\s+(?:is|are|was|were|does|do)|how\s+many)\b')
  AND len(list_filter(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9.+#-]*')[2:], lambda w: lower(w) NOT IN ('how', 'what', 'which') AND regexp_matches(w, '^[A-Z]'))) = 0)) THEN t ELSE array_to_string(list_concat(said, [t]), ' ') END), lambda t: {D.compact('t')}) AS shown FROM f)
SELECT id, array_to_string(CASE WHEN len(tops) <= 1 THEN [question] ELSE list_filter(shown, lambda x, i: x <> '' AND list_position(list_transform(shown, lambda y: {D.casefold('y')}), {D.casefold('x')}) = i)[1:4] END, ' || ') AS facets FROM o""")


def gap_queries(spark, sf_dir):
    plans = table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("original"), F.slice(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\."), lambda t: F.trim(t)), lambda t: t != ""), 1, 8).alias("topics"))
    rounds = spark.range(1, 6).select(F.col("id").alias("r"))
    return P.gap_queries(plans.crossJoin(F.broadcast(rounds)), "item_id", F.col("r")).select("item_id", "round", "pos", "query")


register("gap_queries", ("Q10",), gap_queries, f"""
WITH p AS (SELECT item_id, coalesce(text, '') AS original, list_filter(list_transform(string_split(coalesce(text, ''), '.'), lambda t: trim(t, ' ')), lambda t: t <> '')[1:8] AS topics FROM benchmark),
b AS (SELECT item_id, CASE WHEN len(topics) > 0 THEN topics[1:5] ELSE [original] END AS base, r FROM p, range(1, 6) AS t(r)),
u AS (SELECT item_id, r, unnest(base) AS topic, unnest(range(len(base))) AS pos FROM b)
SELECT item_id, r AS round, CAST(pos AS INTEGER) AS pos, topic || ' ' || [{', '.join(f"'{s}'" for s in P.ROUND_SUFFIXES)}][least(r, 4)] AS query FROM u""")


def unique_queries(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract(F.coalesce("text", F.lit("")), r"^(\S+\s+\S+)", 1).alias("query"))
    return P.first_queries(rows, [], "query", "conv_id").groupBy(P.casefold("query").alias("key")).agg(F.count(F.lit(1)).alias("n"))


register("unique_queries", ("Q12",), unique_queries, rf"""
WITH q AS (SELECT {D.compact(r"regexp_extract(coalesce(text, ''), '^(\S+\s+\S+)', 1)")} AS query FROM conversations) SELECT {D.casefold('query')} AS key, CAST(1 AS BIGINT) AS n FROM q WHERE query <> '' GROUP BY key""")


def anchors(spark, sf_dir):
    rows = asked(spark, sf_dir).withColumn("a", P.anchors(F.col("question")))
    return rows.select("id", F.array_join("a", ",").alias("anchors"), F.round(P.anchor_coverage(F.col("a"), F.lit("See RFC 9110, PEP 8, HTTP 429 and 3.12.0; not 19110.")), 4).alias("coverage"))


register("anchors", ("Q7", "T17"), anchors, f"""
WITH {subject_sql(_ASKED)} SELECT id, array_to_string(anchors, ',') AS anchors, round(CASE WHEN len(anchors) = 0 THEN 1.0 ELSE len(list_filter(anchors, lambda a: regexp_matches(' see rfc 9110, pep 8, http 429 and 3.12.0; not 19110. ', '[^a-z0-9]' || regexp_escape(a) || '[^a-z0-9]'))) / len(anchors)::DOUBLE END, 4)::DOUBLE AS coverage FROM subjects""")


def official_sources(spark, sf_dir):
    rows = asked(spark, sf_dir).select("id", F.posexplode(F.slice(P.official_sources(F.col("question")), 1, 3)).alias("pos", "h"))
    return rows.select("id", "pos", F.col("h.url").alias("url"), F.col("h.title").alias("title"))


register("official_sources", ("S10",), official_sources, f"""
WITH {subject_sql(_ASKED)}, u AS (SELECT id, unnest(sources[1:3]) AS s, unnest(range(len(sources[1:3]))) AS pos FROM subjects) SELECT id, CAST(pos AS INTEGER) AS pos, s.url AS url, s.title AS title FROM u""")


PREFERRED = ["https://docs.python.org/3/", "https://www.rfc-editor.org/rfc/rfc9110.html", "https://github.com/owner/name/tree/main", "https://github.com/owner/namesake", "https://www.sqlite.org/wal.html", "https://example.com/"]


def authorities(spark, sf_dir):
    rows = asked(spark, sf_dir).select("id", "question", F.array_join(P.authority_domains(F.col("question")), ",").alias("domains"), P.authority_variant(F.col("question")).alias("variant"))
    urls = spark.createDataFrame([(u,) for u in PREFERRED], "url string")
    hits = rows.crossJoin(F.broadcast(urls)).filter(P.matches_authority(F.col("question"), F.col("url"))).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(U.host("url"))), ",").alias("hosts"))
    return rows.join(hits, "id", "left").select("id", "domains", "variant", "hosts")


register("authorities", ("U10", "U11", "Q6"), authorities, rf"""
WITH {subject_sql(_ASKED)}, c AS (SELECT *, {D.casefold('question')} AS c FROM subjects),
d AS (SELECT *, list_sort(list_distinct(list_concat(list_transform(sources, lambda s: {D.host('s.url')}), CASE WHEN {_hit(r'\b(?:rfc|http\s+status|internet standard|ietf)\b', 'c')} THEN ['iana.org', 'rfc-editor.org', 'ietf.org'] ELSE [] END,
  CASE WHEN {_hit(r'\bpython\b', 'c')} THEN ['python.org', 'docs.python.org', 'peps.python.org'] ELSE [] END, CASE WHEN {_hit(r'\bsqlite\b', 'c')} THEN ['sqlite.org'] ELSE [] END, CASE WHEN {_hit(r'\bcurl\b', 'c')} THEN ['curl.se', 'everything.curl.dev'] ELSE [] END,
  CASE WHEN {_hit(r'\b(?:mcp|model context protocol)\b', 'c')} AND {_hit(r'\b(?:docs?|documentation|official|protocol|reference|specification|transport)\b', 'c')} THEN ['modelcontextprotocol.io'] ELSE [] END))) AS domains,
  regexp_extract(question, '(?i)\bpython\s+(\d+\.\d+(?:\.\d+)?)\b', 1) AS version FROM c),
u AS (SELECT url, {D.host('url')} AS host, '/' || trim(lower({D.part('url', 3)}), '/') AS p FROM {D.values([(x,) for x in PREFERRED], 'v(url)')}),
m AS (SELECT id, array_to_string(list_sort(list(host)), ',') AS hosts FROM d, u WHERE CASE WHEN host IN ('github.com', 'www.github.com') THEN len(list_filter(list_concat(repos, CASE WHEN sdk THEN ['modelcontextprotocol/python-sdk'] ELSE [] END), lambda r: p = '/' || lower(r) OR starts_with(p, '/' || lower(r) || '/'))) > 0
  ELSE len(list_filter(domains, lambda x: host = x OR ends_with(host, '.' || x))) > 0 END GROUP BY id)
SELECT id, array_to_string(domains, ',') AS domains, {_VARIANT} AS variant, hosts FROM d LEFT JOIN m USING (id)""")
