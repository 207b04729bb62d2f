"""DuckDB spellings of the text and URL functions, for the SQL side of the queries."""

from __future__ import annotations

from lodestone.functions.text import INJECTION, STOP
from lodestone.functions.urls import BLOCKED, BLOCKED_SUFFIX, DOCUMENTATION, SECRET_KEY, SPECIAL_V4, TRACKING, TRACKING_PREFIX, _v4

WORDS = r"[\p{L}\p{N}_+#.-]{2,}"
PARTS = r"[\p{L}\p{N}_+#-]{2,}"


def casefold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def compact(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def tokens(x: str) -> str:
    parts = rf"regexp_extract_all(regexp_replace(replace(t, '.', ' '), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '{PARTS}')"
    raw = f"list_filter(list_transform(regexp_extract_all({x}, '{WORDS}'), lambda t: trim(t, '.-')), lambda t: length(t) >= 2)"
    return rf"list_transform(flatten(list_transform({raw}, lambda t: CASE WHEN len({parts}) > 1 AND regexp_matches(t, '\p{{L}}') THEN {parts} ELSE [t] END)), lambda t: {casefold('t')})"


def inflection(t: str) -> str:
    single = lambda b: f"CASE WHEN length({b}) > 3 AND right({b}, 1) = substr({b}, length({b}) - 1, 1) THEN left({b}, length({b}) - 1) ELSE {b} END"
    cut = lambda k: f"left({t}, length({t}) - {k})"
    return f"""CASE WHEN length({t}) > 5 AND ends_with({t}, 'ies') THEN {cut(3)} || 'y'
    WHEN length({t}) > 6 AND ends_with({t}, 'ing') THEN {single(cut(3))}
    WHEN length({t}) > 5 AND ends_with({t}, 'ied') THEN {cut(3)} || 'y'
    WHEN length({t}) > 5 AND ends_with({t}, 'ed') THEN {single(cut(2))}
    WHEN length({t}) > 5 AND regexp_matches({t}, '(sses|shes|ches|xes|zes)$') THEN {cut(2)}
    WHEN length({t}) > 4 AND ends_with({t}, 's') AND NOT regexp_matches({t}, '(ss|us|is)$') THEN {cut(1)} ELSE {t} END"""


def meaningful(x: str) -> str:
    stop = ", ".join(f"'{s}'" for s in STOP)
    return f"list_transform(list_filter({tokens(x)}, lambda t: t NOT IN ({stop})), lambda t: {inflection('t')})"


def bigrams(w: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({w}), 1)), lambda i: {w}[i] || ' ' || {w}[i + 1]))"


def coverage(terms: str, words: str) -> str:
    return f"(len(list_intersect(list_distinct({terms}), {words})) / greatest(len(list_distinct({terms})), 1)::DOUBLE)"


def reasons(x: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({x}, '(?i){p}') THEN '{k}' END" for k, p in INJECTION.items()) + "], lambda r: r IS NOT NULL)"


def risk(r: str) -> str:
    return f"CASE WHEN len({r}) >= 2 OR list_contains({r}, 'instruction_override') THEN 'high' WHEN len({r}) = 1 THEN 'medium' ELSE 'low' END"


def values(rows: list[tuple], names: str) -> str:
    """(VALUES ...) AS names, with text quoted."""
    one = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS {names}"


# ---- URLs ----

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(u: str, k: int) -> str:
    return f"regexp_extract({u}, '{_URL}', {k})"


def scheme(u: str) -> str:
    return f"lower({part(u, 1)})"


def host(u: str) -> str:
    return rf"lower(regexp_replace(regexp_replace(regexp_replace({part(u, 2)}, '^.*@', ''), ':[0-9]*$', ''), '\.+$', ''))"


def port(u: str) -> str:
    return f"regexp_extract({part(u, 2)}, ':([0-9]+)$', 1)"


def pairs(q: str) -> str:
    return f"list_transform(list_filter(string_split({q}, '&'), lambda p: p <> ''), lambda p: {{'key': split_part(p, '=', 1), 'value': CASE WHEN contains(p, '=') THEN regexp_replace(p, '^[^=]*=', '') ELSE '' END}})"


def joined(ps: str) -> str:
    return f"array_to_string(list_transform({ps}, lambda p: p.key || '=' || p.value), '&')"


def normalize(u: str) -> str:
    keys = ", ".join(f"'{k}'" for k in TRACKING)
    kept = f"list_sort(list_filter({pairs(part(u, 4))}, lambda p: lower(p.key) NOT IN ({keys}) AND NOT regexp_matches(lower(p.key), '{TRACKING_PREFIX}')))"
    path = f"regexp_replace(CASE WHEN {part(u, 3)} = '' THEN '/' ELSE {part(u, 3)} END, '/{{2,}}', '/', 'g')"
    at = f"CASE WHEN ({scheme(u)} = 'http' AND {port(u)} = '80') OR ({scheme(u)} = 'https' AND {port(u)} = '443') OR {port(u)} IN ('', '0') THEN {host(u)} ELSE {host(u)} || ':' || {port(u)} END"
    return f"({scheme(u)} || '://' || {at} || CASE WHEN {path} = '/' THEN '/' ELSE regexp_replace({path}, '/+$', '') END || CASE WHEN len({kept}) > 0 THEN '?' || {joined(kept)} ELSE '' END)"


def under(name: str, domain: str) -> str:
    return f"({name} = '{domain}' OR ends_with({name}, '.{domain}'))"


def source_type(u: str) -> str:
    h, p = host(u), f"lower({part(u, 3)})"
    docs = " OR ".join(under(h, d) for d in DOCUMENTATION)
    git = f"({under(h, 'github.com')} OR {h} = 'raw.githubusercontent.com')"
    return rf"""CASE WHEN regexp_matches({h}, '\.(gov|edu)$') THEN 'primary_institution'
    WHEN {docs} OR contains({h}, 'docs.') OR contains({p}, '/docs/') OR contains({p}, '/documentation/') THEN 'official_documentation'
    WHEN {git} AND contains({p}, '/issues/') THEN 'issue_tracker' WHEN {git} THEN 'source_repository'
    WHEN regexp_matches({p}, 'paper|article|research') THEN 'publication' ELSE 'web_page' END"""


def sensitive_key(k: str) -> str:
    return rf"regexp_matches(replace(regexp_replace({k}, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '-', '_'), '{SECRET_KEY}')"


def sensitive(u: str) -> str:
    return f"(len(list_filter(list_concat({pairs(part(u, 4))}, {pairs(part(u, 5))}), lambda p: {sensitive_key('p.key')})) > 0)"


def redact(u: str) -> str:
    shown = f"list_transform({pairs(part(u, 4))}, lambda p: {{'key': p.key, 'value': CASE WHEN {sensitive_key('p.key')} THEN '%5BREDACTED%5D' ELSE p.value END}})"
    return f"(CASE WHEN {scheme(u)} IN ('http', 'https') THEN {scheme(u)} || '://' || {part(u, 2)} || {part(u, 3)} || CASE WHEN len({shown}) > 0 THEN '?' || {joined(shown)} ELSE '' END ELSE {u} END)"


def _v4_special(n: str) -> str:
    return "(" + " OR ".join(f"{n} BETWEEN {_v4(a)} AND {_v4(b)}" for a, b in SPECIAL_V4) + ")"


def unsafe_reasons(rel: str) -> str:
    """The rows of rel (url, n) with the judgement of each URL, for hosts other than bracketed ones with special blocks inside 2000::/3."""
    url = "url"
    blocked = ", ".join(f"'{h}'" for h in BLOCKED)
    auth = f"regexp_extract(ltrim({url}), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    place = f"regexp_replace({auth}, '^.*@', '')"
    raw = rf"lower(regexp_extract({place}, '^(\[[^\]]*\]|[^:]*)', 1))"
    host = rf"regexp_replace(CASE WHEN contains({raw}, '%') THEN lower(url_decode({raw})) ELSE {raw} END, '\.+$', '')"
    port = rf"regexp_extract({place}, '^(?:\[[^\]]*\]|[^:\[]*):(.*)$', 1)"
    digits = lambda x, base, most: f"list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(lower({x}), ''), lambda d: (strpos('0123456789abcdef', d) - 1)::HUGEINT)), lambda a, d: least(a * {base} + d, {most}))"
    parts = rf"list_transform(string_split(h, '.'), lambda x: CASE WHEN regexp_matches(x, '^0[xX]') THEN {digits("substr(x, 3)", 16, 4096)} WHEN starts_with(x, '0') THEN {digits("x", 8, 4096)} ELSE {digits("x", 10, 4096)} END)"
    dotted = r"\.".join(["(0[xX][0-9a-fA-F]+|0[0-7]*|[1-9][0-9]*)"] * 4)
    v4 = f"""CASE WHEN regexp_matches(h, '^[0-9]+$') THEN {digits("h", 10, 1 << 36)} WHEN regexp_matches(h, '^0[xX][0-9a-fA-F]+$') THEN {digits("substr(h, 3)", 16, 1 << 36)}
      WHEN regexp_matches(h, '^{dotted}$') THEN CASE WHEN list_max({parts}) > 255 THEN 0 ELSE list_reduce({parts}, lambda a, d: a * 256 + d) END END"""
    v6 = r"raw LIKE '[%' AND NOT regexp_matches(raw, '^\[[23][0-9a-f]{3}:')"
    judged = rf"""CASE WHEN length(url) > 4096 OR regexp_matches(url, '[\x00-\x1F]') THEN 'encoding' WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN usr NOT IN ('', ':') THEN 'credentials'
      WHEN h = '' OR contains(h, '%') THEN 'host' WHEN h IN ({blocked}) OR regexp_matches(h, '{BLOCKED_SUFFIX}') THEN 'internal'
      WHEN coalesce({_v4_special("v4")}, FALSE) OR {v6} THEN 'address' WHEN port <> '' AND coalesce(NOT (regexp_matches(port, '^[0-9]+$') AND try_cast(port AS HUGEINT) BETWEEN 1 AND 65535), TRUE) THEN 'port' END"""
    return f"""SELECT url, n, {judged} AS reason FROM (SELECT *, {v4} AS v4 FROM (SELECT url, n, {scheme("ltrim(url)")} AS scheme, {host} AS h, {raw} AS raw, {port} AS port, CASE WHEN contains({auth}, '@') THEN regexp_extract({auth}, '^(.*)@', 1) ELSE '' END AS usr FROM {rel}))"""
