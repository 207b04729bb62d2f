"""From questions to plans: depth and budget, facets, search variants, anchors, authorities. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import urls as U
from lodestone.functions.text import bind, casefold, compact, meaningful

# Signals of depth, budgets by mode, suffixes of later rounds, words that a plan leaves out, abbreviations.
DEEP = (
    r"\b(?:deep|comprehensive|exhaustive|investigate|systematic)\b",
    r"\b(?:conflict|contradiction|disagree|multiple independent sources)\b",
    r"\b(?:design|architecture|threat model|trade-?offs?)\b",
    r"\b(?:analy[sz]e|evaluate|assess|synthesi[sz]e|optimi[sz]e|improve)\b",
    r"\b(?:latest|current|today|recent|as of|right now)\b",
    r"\b(?:evidence|sources|research|citations?)\b",
)
BUDGETS = (("quick", 3, 15, 5, 10, 1, 0), ("standard", 6, 40, 10, 20, 2, 1), ("deep", 15, 100, 25, 40, 4, 3))
BUDGET_FIELDS = ("mode", "queries", "raw_results", "pages", "passages", "rounds", "browser_pages")
ROUND_SUFFIXES = ("primary source specification", "research paper benchmark", "issue tracker discussion", "release notes current")
PLAN_STOP = "a an and according are does differ for from how in is of on or the to what was when where which who why with".split()
FALLBACK_STOP = "a an according and are does for from how in is of on the to what when which with".split()
ABBREVIATIONS = {
    "ssrf": "server side request forgery",
    "mcp": "model context protocol",
    "llm": "large language model",
    "dns": "domain name system",
    "api": "application programming interface",
}
PRICE_WORDS = "amount cost costs count counts dollar dollars eur gbp pay price prices quantity total usd".split()
# Patterns of words, repositories and of what a question is about. The cues of one kind of question, on
# documentation, stand in two patterns, REFERENCE and GUIDE, because rules also ask for the first alone.
WORD = r"([A-Za-z0-9_.+#-]+)"
RELEASE = r"(?i)\b(?:release(?:d|s)?|release\s+date|download|announcement|became\s+available|availability)\b"
ADVISORY = r"(?i)\b(?:CVE-\d{4}-\d{4,7}|vulnerab\w*|exploit\w*|security\s+advisory|affected\s+versions?|patched\s+versions?)\b"
REFERENCE = r"(?i)\b(?:according\s+to|docs?|documentation|official|reference|manual)\b"
GUIDE = r"(?i)\b(?:how\s+to|which\s+transport|recommended\s+transport)\b"
TROUBLE = r"(?i)\b(?:bug|broken|crash\w*|error|exception|fail\w*|not\s+working|timeout|traceback|troubleshoot\w*)\b"
REPOSITORY = r"[A-Za-z0-9](?:[A-Za-z0-9_.-]{0,99})/[A-Za-z0-9](?:[A-Za-z0-9_.-]{0,99})"


def folded(q: Column) -> Column:
    return compact(casefold(q))


def first_wins(parts: Column, fold=casefold) -> Column:
    """parts without those that an earlier one equals but for case."""
    return bind(parts, lambda ps: bind(F.transform(ps, fold), lambda fs: F.filter(ps, lambda p, i: F.array_position(fs, fold(p)) == i + 1)))


def extract_all(q: Column, pattern: str) -> Column:
    return F.regexp_extract_all(q, F.lit(pattern), F.lit(1))


def mode(q: Column) -> Column:
    return F.when(folded(q).rlike("|".join(DEEP)), "deep").otherwise("standard")


def budgets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BUDGETS), ", ".join(f"{f} {'string' if f == 'mode' else 'int'}" for f in BUDGET_FIELDS))


def unique_queries(parts: Column) -> Column:
    return first_wins(F.filter(F.transform(parts, compact), lambda p: p != ""))


def fallback(q: Column) -> Column:
    """The first sixteen words that carry meaning, or the question itself."""
    words = F.slice(F.filter(extract_all(q, WORD), lambda w: ~casefold(w).isin(*FALLBACK_STOP)), 1, 16)
    return F.coalesce(F.nullif(F.array_join(words, " "), F.lit("")), q)


def split_compound(q: Column, limit: int = 4) -> Column:
    """Facets of an explicit batch (JSON, marked lines, labels, question marks, separators), else the question alone."""
    whole = compact(q)
    enough = lambda p: F.size(extract_all(p, WORD)) >= 3
    several = lambda ps: bind(ps, lambda x: F.when((F.size(x) >= 2) & F.forall(x, enough), x))
    filled = lambda ps: F.filter(F.transform(ps, lambda p: F.trim(p)), lambda p: p != "")
    trimmed = F.trim(q)
    listed = F.when(trimmed.startswith("["), F.from_json(trimmed, "array<string>")).when(trimmed.startswith("{"), F.from_json(trimmed, "queries array<string>")["queries"])
    listed = bind(F.array_compact(listed), lambda x: F.when(F.size(x) > 0, x))
    mark = r"^\s*(?:[-*•]|\d{1,2}[.)])\s"
    lines = F.filter(F.split(q, r"\r?\n"), lambda p: F.trim(p) != "")
    marked = bind(lines, lambda x: F.when(F.forall(x, lambda p: p.rlike(mark)), several(F.transform(x, lambda p: F.trim(F.regexp_replace(p, mark + r"*", ""))))))
    label = r"(?i)^(?:query|search)\s+\d{1,2}\s*[:.)-]\s*"
    labelled = several(F.transform(F.split(whole, r"(?i)\s+(?=(?:query|search)\s+\d{1,2}\s*[:.)-])"), lambda p: F.regexp_replace(p, label, "")))
    asked = several(F.transform(filled(F.split(whole, r"\?")), lambda p: F.concat(p, F.lit("?"))))
    parted = [several(filled(F.split(whole, s))) for s in (r"\s*;\s*", r"\s+\|\s+", r"\s+(?:OR|\|\|)\s+")]
    parts = F.coalesce(listed, marked, labelled, asked, *parted, F.array(whole))
    tidy = F.filter(F.transform(parts, lambda p: F.left(F.regexp_replace(compact(p), r"^[;|,\s]+", ""), F.lit(500))), lambda p: p != "")
    return bind(F.slice(first_wins(tidy), 1, max(1, limit)), lambda x: F.when(F.size(x) >= 2, x).otherwise(F.array(whole)))


# ---- identifiers ----


def repositories(q: Column) -> Column:
    """owner/name pairs that a question on repositories names, first spelling of each."""
    url = rf"(?i)(?:https?://)?(?:www\.)?github\.com/({REPOSITORY})(?:/[^\s]*)?"
    named = F.concat(extract_all(q, url), extract_all(F.regexp_replace(q, url, " "), rf"(?<![\w.-])({REPOSITORY})(?![\w.-])"))
    kept = F.filter(named, lambda r: ~casefold(r).rlike("^(http/|https/|github.com/)"))
    return F.when(q.rlike(r"(?i)\b(?:github|repo|repository|source\s+code)\b"), first_wins(kept)).otherwise(F.array().cast("array<string>"))


def anchors(q: Column) -> Column:
    """Identifiers whose absence speaks against a result: CVEs, addresses, versions, typed numbers, capitals, repositories; sorted."""
    # The patterns of identifiers.
    number = r"(\d+\.\d+(?:\.\d+){0,2})"
    named = F.regexp_extract_all(q, F.lit(rf"\b([A-Za-z][A-Za-z0-9+#.-]*\s+{number})\b"), F.lit(1))
    context = lambda m: casefold(F.regexp_extract(m, r"^(\S+)", 1))
    value = lambda m: F.regexp_extract(m, rf"\s{number}$", 1)
    plain = F.filter(named, lambda m: ~context(m).isin(*PRICE_WORDS) & (value(m).rlike(r"\..*\.") | ~context(m).rlike("(usd|eur|gbp)$")))
    typed = (r"(?i)\b(?:rfc|pep)\s*[-#:]?\s*(\d{1,5})\b", r"(?i)\bhttp\s+status(?:\s+code)?\s+(\d{3})\b", r"(?i)\b(?:status|error)\s+code\s*[:#-]?\s*(\d{3,5})\b", r"(?i)\b(?:port|issue)\s*[:#-]?\s*(\d{1,5})\b")
    capitals = F.filter(extract_all(q, r"\b([A-Z][A-Z0-9]{1,9})\b"), lambda w: ~w.isin("THE", "AND", "FOR"))
    found = F.concat(
        extract_all(q, r"(?i)\b(CVE-\d{4}-\d{4,7})\b"), extract_all(q, r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"), extract_all(q, rf"(?i)\b(?:version|ver\.?|v)\s*{number}\b"),
        F.transform(plain, value), *(extract_all(q, p) for p in typed), capitals, repositories(q),
    )
    return F.array_sort(F.array_distinct(F.transform(found, casefold)))


def anchor_coverage(found: Column, text: Column) -> Column:
    """Share of the anchors that stand in the text by themselves; 1 without anchors."""
    t = casefold(text)
    hit = lambda a: F.regexp_like(t, F.concat(F.lit(r"(?<![a-z0-9])\Q"), a, F.lit(r"\E(?![a-z0-9])")))
    return F.when(F.size(found) == 0, F.lit(1.0)).otherwise(F.size(F.filter(found, hit)) / F.size(found))


def sdk_path(q: Column) -> Column:
    """Where the protocol's Python SDK documents what is asked; null for other questions."""
    n = folded(q)
    about = n.rlike(r"\b(?:mcp|model context protocol)\b") & n.contains("python") & n.contains("sdk") & (q.rlike(REFERENCE) | q.rlike(GUIDE)) & ~q.rlike(ADVISORY)
    part = (
        F.when(n.rlike(r"\b(?:server|deploy|deployment|transport|streamable|stdio|sse)\b"), "/server/")
        .when(n.rlike(r"\b(?:client|connect|connection|oauth|authorization)\b"), "/client/")
        .when(n.rlike(r"\b(?:install|installation|pip|uv)\b"), "/installation/")
        .otherwise("/")
    )
    return F.when(about & ~(q.rlike(TROUBLE) & ~q.rlike(REFERENCE)), part)


def official_sources(q: Column) -> Column:
    """array<struct<url, title>>: pages that follow from a question's identifiers, at most one per URL, in the rules' order."""
    # The pages' addresses and titles, and the words that call for them.
    n, path = folded(q), sdk_path(q)
    hint = lambda url, title: F.struct(url.alias("url"), title.alias("title"))
    lit, fmt = F.lit, F.format_string
    py = [F.regexp_extract(n, r"\bpython\s+(\d+)\.(\d+)\.(\d+)\b", i) for i in (1, 2, 3)]
    status = F.regexp_extract(n, r"\bhttp\s+status(?:\s+code)?\s+(\d{3})\b", 1)
    one = [
        F.when(path.isNotNull(), hint(F.concat(lit("https://py.sdk.modelcontextprotocol.io"), path), lit("Official MCP Python SDK documentation"))),
        F.when(path == "/server/", hint(lit("https://raw.githubusercontent.com/modelcontextprotocol/python-sdk/v1.x/docs/server.md"), lit("Official MCP Python SDK server transport documentation source"))),
        F.when((py[0] != "") & q.rlike(RELEASE) & ~q.rlike(ADVISORY), hint(F.concat(lit("https://www.python.org/downloads/release/python-"), *py, lit("/")), F.concat(lit("Python "), F.concat_ws(".", *py), lit(" official release")))),
        F.when(status != "", hint(lit("https://www.iana.org/assignments/http-status-codes/http-status-codes.xhtml"), F.concat(lit("IANA official HTTP status code registry: "), status))),
        F.when(n.contains("ipv4") & n.contains("private") & n.rlike(r"\b(?:address|block|range)\w*\b"), hint(lit("https://www.iana.org/assignments/iana-ipv4-special-registry/iana-ipv4-special-registry.xhtml"), lit("IANA official IPv4 special-purpose address registry"))),
    ]
    rfc = F.transform(F.slice(extract_all(n, r"\brfc\s*[-#:]?\s*(\d{3,5})\b"), 1, 2), lambda x: hint(F.concat(lit("https://www.rfc-editor.org/rfc/rfc"), x, lit(".html")), F.concat(lit("RFC "), x, lit(" official publication"))))
    pep = F.transform(F.slice(extract_all(n, r"\bpep\s*[-#:]?\s*(\d{1,4})\b"), 1, 2), lambda x: hint(fmt("https://peps.python.org/pep-%04d/", x.cast("int")), fmt("PEP %d official publication", x.cast("int"))))
    two = [
        F.when(n.contains("sqlite") & n.rlike(r"\b(?:wal|write[- ]ahead log)\b"), hint(lit("https://www.sqlite.org/wal.html"), lit("SQLite official write-ahead logging documentation"))),
        F.when(n.contains("curl") & n.rlike(r"\bsocks5h?\b"), hint(lit("https://curl.se/docs/manpage.html#--socks5-hostname"), lit("curl official SOCKS proxy and hostname-resolution documentation"))),
    ]
    repos = F.transform(F.slice(repositories(q), 1, 2), lambda r: hint(F.concat(lit("https://github.com/"), r), F.concat(lit("Official source repository "), r)))
    every = F.concat(F.array_compact(F.array(*one)), rfc, pep, F.array_compact(F.array(*two)), repos)
    return bind(every, lambda hs: F.filter(hs, lambda h, i: F.array_position(F.transform(hs, lambda x: x["url"]), h["url"]) == i + 1))


def authority_domains(q: Column) -> Column:
    """Domains that a question prefers, sorted."""
    n = casefold(q)
    rules = (
        (n.rlike(r"\b(?:rfc|http\s+status|internet standard|ietf)\b"), ["iana.org", "rfc-editor.org", "ietf.org"]),
        (n.rlike(r"\bpython\b"), ["python.org", "docs.python.org", "peps.python.org"]),
        (n.rlike(r"\bsqlite\b"), ["sqlite.org"]),
        (n.rlike(r"\bcurl\b"), ["curl.se", "everything.curl.dev"]),
        (n.rlike(r"\b(?:mcp|model context protocol)\b") & n.rlike(r"\b(?:docs?|documentation|official|protocol|reference|specification|transport)\b"), ["modelcontextprotocol.io"]),
    )
    none = F.array().cast("array<string>")
    hosts = F.transform(official_sources(q), lambda h: U.host(h["url"]))
    return F.array_sort(F.array_distinct(F.concat(hosts, *(F.when(c, F.lit(d)).otherwise(none) for c, d in rules))))


def subject(q: Column) -> Column:
    """What scores need of a question, as struct<terms, anchors, domains, repositories, sdk>: made once per question, however many results are scored by it."""
    sdk = sdk_path(q).isNotNull()
    repos = F.concat(repositories(q), F.when(sdk, F.array(F.lit("modelcontextprotocol/python-sdk"))).otherwise(F.array().cast("array<string>")))
    return F.struct(F.array_distinct(meaningful(q)).alias("terms"), anchors(q).alias("anchors"), authority_domains(q).alias("domains"), F.transform(repos, casefold).alias("repositories"), sdk.alias("sdk"))


def within_authority(s: Column, url: Column) -> Column:
    """The URL belongs to a preferred domain of the subject s, or to a repository that it names."""
    h, path = U.host(url), F.concat(F.lit("/"), F.btrim(casefold(U.path(url)), F.lit("/")))
    within = F.exists(s["repositories"], lambda r: (path == F.concat(F.lit("/"), r)) | path.startswith(F.concat(F.lit("/"), r, F.lit("/"))))
    return (
        F.when(h == "raw.githubusercontent.com", s["sdk"] & casefold(U.path(url)).startswith("/modelcontextprotocol/python-sdk/"))
        .when(h.isin("github.com", "www.github.com"), within)
        .otherwise(F.exists(s["domains"], lambda d: U.under(h, d)))
    )


def matches_authority(q: Column, url: Column) -> Column:
    """The URL belongs to a preferred domain, or to a repository that the question names."""
    return bind(subject(q), lambda s: within_authority(s, url))


def authority_variant(q: Column) -> Column:
    """One search restricted to a primary source; null without a rule."""
    n, path = casefold(q), sdk_path(q)
    topic = F.when(path == "/server/", "server transport").when(path == "/client/", "client").when(path == "/installation/", "installation").otherwise("documentation")
    version = F.regexp_extract(q, r"(?i)\bpython\s+(\d+\.\d+(?:\.\d+)?)\b", 1)
    return (
        F.when(path.isNotNull(), F.concat(F.lit('site:py.sdk.modelcontextprotocol.io "MCP Python SDK" '), topic))
        .when((version != "") & q.rlike(RELEASE) & ~q.rlike(ADVISORY), F.concat(F.lit('site:python.org "Python '), version, F.lit('" release')))
        .when(n.rlike(r"\b(?:rfc|http\s+status|internet standard|ietf)\b"), F.concat(F.lit("site:rfc-editor.org "), q))
        .when(n.contains("sqlite"), F.concat(F.lit("site:sqlite.org "), q))
        .when(n.contains("curl"), F.concat(F.lit("site:curl.se "), q))
    )


# ---- plans ----


def entities(q: Column) -> Column:
    return F.filter(extract_all(q, WORD), lambda w: ~F.lower(w).isin(*PLAN_STOP) & (F.length(w) > 2))


def topics(q: Column) -> Column:
    """Parts of two words or more between ; ? and, versus, vs.; else the first entities; at most eight."""
    parts = F.transform(F.split(q, r"(?i)[;?]|\b(?:and|versus|vs\.)\b"), compact)
    named = F.filter(parts, lambda p: p.contains(" "))
    alone = bind(F.slice(entities(q), 1, 6), lambda e: F.when(F.size(e) > 0, F.array(F.array_join(e, " "))).otherwise(F.array().cast("array<string>")))
    return F.slice(bind(named, lambda n: F.when(F.size(n) > 0, n).otherwise(alone)), 1, 8)


def distinctive(q: Column) -> Column:
    """A quoted phrase worth a search of its own: a name with a version, or capitalised words with an acronym; null without one."""
    versioned = r"\b([A-Z][A-Za-z0-9+#.-]*)\s+(\d+\.\d+(?:\.\d+){0,2})\b"
    name, number = F.regexp_extract(q, versioned, 1), F.regexp_extract(q, versioned, 2)
    dated = F.when(q.rlike(r"(?i)\b(?:date|release|released)\b"), "release date").otherwise("official documentation")
    phrases = extract_all(q, r"\b((?:[A-Z]{2,10}|[A-Z][a-z]+)(?:\s+(?:[A-Z]{2,10}|[A-Z][a-z]+)){1,3})\b")
    lead = ("according", "how", "in", "on", "what", "when", "which")
    fine = F.filter(phrases, lambda p: p.rlike(r"(^|\s)[A-Z]{2,}(\s|$)") & ~casefold(F.regexp_extract(p, r"^(\S+)", 1)).isin(*lead))
    intents = F.slice(F.array_compact(F.array(*(F.when(q.rlike(rf"(?i)\b{t}\w*\b"), F.lit(t)) for t in ("production", "transport", "release", "standard", "security")))), 1, 3)
    tail = F.coalesce(F.nullif(F.array_join(intents, " "), F.lit("")), F.lit("official documentation"))
    return F.when(number != "", F.concat(F.lit('"'), name, F.lit(" "), number, F.lit('" '), dated)).when(F.size(fine) > 0, F.concat(F.lit('"'), F.get(fine, F.lit(0)), F.lit('" '), tail))


def time_sensitive(q: Column, year: int) -> Column:
    return q.rlike(r"(?i)\b(latest|current|today|recent|price|as of|right now)\b") | q.rlike(rf"\b{year}\b")


def plan(question: Column, year: int, limit: int = 6) -> Column:
    """struct<original, queries, topics, time_sensitive>; the year is a parameter, so that a plan can be made again."""
    q = compact(question)
    none = F.array().cast("array<string>")

    def build(r: Column) -> Column:
        q, ents, tops = r["q"], r["e"], r["t"]
        focused = F.array_join(F.slice(ents, 1, 12), " ")
        focus = F.coalesce(F.nullif(focused, F.lit("")), q)
        put = lambda c, *x: F.when(c, F.concat(*x))
        late = time_sensitive(q, year)
        said = lambda p: q.rlike("(?i)" + p)
        queries = F.concat(
            F.array(q, distinctive(q), authority_variant(q), put((focused != "") & (casefold(focused) != casefold(q)), focused), F.concat(focus, F.lit(" official documentation"))),
            F.transform(F.slice(tops, 1, 1), lambda t: F.concat(t, F.lit(" official documentation"))),
            F.array(put(said(r"\b(error|exception|failed|traceback|code\s+\d+)\b"), F.lit('"'), q, F.lit('" issue tracker'))),
            F.when(said(r"\b(compare|versus|vs\.?|difference|better)\b"), F.transform(F.slice(tops, 1, 2), lambda t: F.concat(t, F.lit(" specification benchmark")))).otherwise(none),
            F.array(
                F.when(late, F.concat(focus, F.lit(f" current release notes {year}"))).when(said(r"\b(?:release|released)\b") & q.rlike(r"\b\d+\.\d+(?:\.\d+)?\b"), F.concat(focus, F.lit(" official release page")))
            ),
            F.transform(F.filter(ents, lambda e: F.lower(e).isin(*ABBREVIATIONS)), lambda e: F.concat(q, F.lit(" "), F.element_at(F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv)), F.lower(e)))),
            F.array(put(said(r"\b(?:paper|peer-reviewed|research|study|evidence)\b"), focus, F.lit(" research paper benchmark"))),
            F.array(put(said(r"\b(?:bug|error|exception|failed|failure|issue|traceback|troubleshoot)\b"), focus, F.lit(" issue tracker discussion"))),
        )
        kept = F.slice(F.transform(first_wins(F.array_compact(queries)), lambda x: F.left(x, F.lit(500))), 1, limit)
        return F.struct(q.alias("original"), kept.alias("queries"), tops.alias("topics"), late.alias("time_sensitive"))

    return bind(F.struct(q.alias("q"), entities(q).alias("e"), topics(q).alias("t")), build)


def plan_compound(questions: DataFrame, key: str, facets: str, year: int, limit: int) -> DataFrame:
    """(key, queries, topics, time_sensitive): the facets, then for each facet one expansion that suits its intent."""
    rows = questions.select(key, F.posexplode(facets).alias("pos", "facet")).withColumn("p", plan(F.col("facet"), year, 8))
    low = casefold(F.col("p.original"))
    marker = (
        F.when(F.col("p.time_sensitive"), "current release notes").when(low.rlike(r"\b(?:error|exception|failed|traceback)\b"), "issue tracker")
        .when(low.rlike(r"\b(?:compare|versus|vs\.?|difference|better)\b"), "specification benchmark").otherwise("official documentation")
    )
    choices = F.filter("p.queries", lambda x: casefold(x) != low)
    fit = F.filter(choices, lambda x: casefold(x).contains(F.col("marker")))
    rows = rows.withColumn("marker", marker).withColumn("expansion", F.coalesce(F.get(fit, F.lit(0)), F.get(choices, F.lit(0))))
    got = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "facet", "expansion"))).alias("r"), F.bool_or("p.time_sensitive").alias("time_sensitive"))
    each = lambda f: F.transform("r", lambda x: x[f])
    return got.select(key, F.slice(unique_queries(F.concat(each("facet"), F.array_compact(each("expansion")))), 1, limit).alias("queries"), each("facet").alias("topics"), "time_sensitive")


def needs_context(topic: Column) -> Column:
    """A facet leans on the rest of its question: it has a pronoun, or asks what or which without naming a subject."""
    pronoun = topic.rlike(r"(?i)\b(?:it|its|itself|they|their|them|those|these|former|latter|same|such)\b")
    bare = F.trim(topic).rlike(r"(?i)^(?:(?:what|which)\s+(?:is|are|was|were|does|do)|how\s+many)\b")
    words = F.slice(extract_all(topic, r"([A-Za-z][A-Za-z0-9.+#-]*)"), 2, 1000)
    return pronoun | (bare & ~F.exists(words, lambda w: ~casefold(w).isin("how", "what", "which") & w.rlike("^[A-Z]")))


def ranking_facets(question: Column, tops: Column) -> Column:
    """At most four facets to rank by; those that need it are led by the question's anchors."""
    full = F.filter(tops, lambda t: F.size(meaningful(t)) >= 2)
    found = anchors(question)
    ordered = F.filter(F.transform(extract_all(question, "([A-Za-z0-9./_-]+)"), casefold), lambda w: F.array_contains(found, w))
    one = lambda t: F.when((F.size(F.array_intersect(found, meaningful(t))) > 0) | ~needs_context(t), t).otherwise(F.array_join(F.concat(ordered, F.array(t)), " "))
    return bind(full, lambda f: F.when(F.size(f) <= 1, F.array(question)).otherwise(F.slice(unique_queries(F.transform(f, one)), 1, 4)))


def gap_queries(plans: DataFrame, key: str, round_number: Column) -> DataFrame:
    """(key, round, pos, query): each of the first five topics, else the question, with the suffix of the round."""
    suffix = F.element_at(F.lit(list(ROUND_SUFFIXES)), F.greatest(F.lit(1), F.least(round_number, F.lit(len(ROUND_SUFFIXES)))).cast("int"))
    base = F.when(F.size("topics") > 0, F.slice("topics", 1, 5)).otherwise(F.array("original"))
    return plans.select(key, round_number.alias("round"), F.posexplode(F.transform(base, lambda t: F.concat(t, F.lit(" "), suffix))).alias("pos", "query"))


def first_queries(rows: DataFrame, by: list[str], query: str, order: str) -> DataFrame:
    """The first of the queries that differ only in white space and case, over rows rather than arrays."""
    rows = rows.withColumn(query, compact(query)).filter(F.col(query) != "")
    k = F.row_number().over(Window.partitionBy(*by, casefold(query)).orderBy(order))
    return rows.withColumn("_k", k).filter("_k = 1").drop("_k")
