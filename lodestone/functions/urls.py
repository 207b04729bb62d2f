"""URLs as Column expressions: parts, normal form, identity, safety, redaction and kind of source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, col

# Query keys and key prefixes that only track, hosts that are never fetched, documentation domains.
TRACKING = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "ref_src", "igshid")
TRACKING_PREFIX = "^(utm_|pk_|vero_|ga_)"
BLOCKED = (
    "localhost", "host.docker.internal", "gateway.docker.internal", "metadata.google.internal", "metadata.azure.internal",
    "instance-data", "searxng", "tor-search", "tor-fetch", "browser-service",
)
BLOCKED_SUFFIX = r"\.(localhost|local|internal|home\.arpa)$"
DOCUMENTATION = (
    "curl.se", "docs.python.org", "everything.curl.dev", "ietf.org", "iana.org", "modelcontextprotocol.io",
    "peps.python.org", "py.sdk.modelcontextprotocol.io", "python.org", "rfc-editor.org", "sqlite.org",
)
SECRET_KEY = r"(?i)(?:^|[_\-.])(?:api[_-]?key|token|secret|password|key|auth|authorization|signature|sig|credential|access[_-]?id|session(?:[_-]?id)?|jwt|bearer|code)(?:$|[_\-.])"
#: Special-purpose IPv4 ranges (first and last address) of the public registry.
SPECIAL_V4 = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.8"), ("192.0.0.11", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"), ("224.0.0.0", "255.255.255.255"),
)

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def scheme(c: str | Column) -> Column:
    return F.lower(F.regexp_extract(col(c), _URL, 1))


def authority(c: str | Column) -> Column:
    return F.regexp_extract(col(c), _URL, 2)


def host(c: str | Column) -> Column:
    """Lower-case host without user, port and trailing dots; square brackets of IPv6 stay."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority(c), r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", ""))


def port(c: str | Column) -> Column:
    return F.regexp_extract(authority(c), r":([0-9]+)$", 1)


def path(c: str | Column) -> Column:
    return F.regexp_extract(col(c), _URL, 3)


def query(c: str | Column) -> Column:
    return F.regexp_extract(col(c), _URL, 4)


def fragment(c: str | Column) -> Column:
    return F.regexp_extract(col(c), _URL, 5)


def pairs(q: Column) -> Column:
    """array<struct<key, value>> of a query; a part without = has an empty value, empty parts go."""
    parts = F.filter(F.split(q, "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit("")).alias("value")))


def joined(ps: Column) -> Column:
    return F.array_join(F.transform(ps, lambda p: F.concat(p["key"], F.lit("="), p["value"])), "&")


def normalize(c: str | Column) -> Column:
    """Lower-case scheme and host, no default port, single slashes, no trailing one, tracking keys gone, keys sorted, no fragment.

    Values with % or + keep their spelling; the port and every other part are as given.
    """
    c = F.trim(col(c))
    plain = ((scheme(c) == "http") & (port(c) == "80")) | ((scheme(c) == "https") & (port(c) == "443")) | (port(c) == "") | (port(c) == "0")
    at = F.when(plain, host(c)).otherwise(F.concat(host(c), F.lit(":"), port(c)))
    slashes = F.regexp_replace(F.when(path(c) == "", F.lit("/")).otherwise(path(c)), "/{2,}", "/")
    tidy = F.when(slashes == "/", slashes).otherwise(F.regexp_replace(slashes, "/+$", ""))
    kept = F.array_sort(F.filter(pairs(query(c)), lambda p: ~F.lower(p["key"]).isin(*TRACKING) & ~F.lower(p["key"]).rlike(TRACKING_PREFIX)))
    return F.concat(scheme(c), F.lit("://"), at, tidy, F.when(F.size(kept) > 0, F.concat(F.lit("?"), joined(kept))).otherwise(F.lit("")))


def identity(c: str | Column) -> Column:
    """What two spellings of one page share, as a key to join by."""
    return F.struct(scheme(c).alias("scheme"), host(c).alias("host"), port(c).alias("port"), F.regexp_replace(path(c), "/+$", "").alias("path"), query(c).alias("query"))


def under(name: Column, domain: str | Column) -> Column:
    """name is the domain or one of its subdomains."""
    d = F.lit(domain) if isinstance(domain, str) else domain
    return (name == d) | F.endswith(name, F.concat(F.lit("."), d))


def source_type(c: str | Column) -> Column:
    def kind(u: Column) -> Column:
        h, p = u["host"], u["path"]
        github = under(h, "github.com") | (h == "raw.githubusercontent.com")
        documented = h.contains("docs.") | p.contains("/docs/") | p.contains("/documentation/") | F.exists(F.lit(list(DOCUMENTATION)), lambda d: under(h, d))
        return (
            F.when(h.rlike(r"\.(gov|edu)$"), "primary_institution")
            .when(documented, "official_documentation")
            .when(github & p.contains("/issues/"), "issue_tracker")
            .when(github, "source_repository")
            .when(p.rlike("paper|article|research"), "publication")
            .otherwise("web_page")
        )

    return bind(F.struct(host(c).alias("host"), F.lower(path(c)).alias("path")), kind)


def sensitive_key(k: Column) -> Column:
    return F.translate(F.regexp_replace(k, "(?<=[a-z0-9])(?=[A-Z])", "_"), "-", "_").rlike(SECRET_KEY)


def sensitive(c: str | Column) -> Column:
    """A key of the query or the fragment names a secret."""
    return F.exists(F.concat(pairs(query(c)), pairs(fragment(c))), lambda p: sensitive_key(p["key"]))


def redact(c: str | Column) -> Column:
    """Values of secret keys replaced, fragment gone; anything but http and https is left alone."""
    shown = F.transform(pairs(query(c)), lambda p: F.struct(p["key"].alias("key"), F.when(sensitive_key(p["key"]), F.lit("%5BREDACTED%5D")).otherwise(p["value"]).alias("value")))
    out = F.concat(scheme(c), F.lit("://"), authority(c), path(c), F.when(F.size(shown) > 0, F.concat(F.lit("?"), joined(shown))).otherwise(F.lit("")))
    return F.when(scheme(c).isin("http", "https"), out).otherwise(col(c))


def _v4(text: str) -> int:
    a, b, c, d = map(int, text.split("."))
    return (a << 24) + (b << 16) + (c << 8) + d


def address(h: Column) -> Column:
    """A host as an IPv4 number: one decimal or hexadecimal number of any length, or four dotted ones, each decimal, octal or hexadecimal; null for names.

    Four dotted numbers with one beyond 255 are no address that could be allowed: they count as 0.0.0.0.
    """
    number = lambda digits, base, most: F.when(F.length(digits) <= most, F.conv(F.when(digits == "", "0").otherwise(digits), base, 10).cast("long"))
    bare = lambda x, at: F.ltrim(F.substring(x, at, 4096), F.lit("0"))
    hexadecimal = lambda x: x.rlike("^0[xX]")
    part = lambda x: F.when(hexadecimal(x), number(bare(x, 3), 16, 4)).when(x.startswith("0"), number(bare(x, 1), 8, 4)).otherwise(number(x, 10, 4))
    fits = lambda n: F.when(n < 1 << 32, n)
    joined_up = lambda p: sum((F.get(p, F.lit(i)) * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0))
    dotted = "^" + r"\.".join(["(0[xX][0-9a-fA-F]+|0[0-7]*|[1-9][0-9]*)"] * 4) + "$"
    return (
        F.when(h.rlike("^[0-9]+$"), fits(number(bare(h, 1), 10, 10)))
        .when(h.rlike("^0[xX][0-9a-fA-F]+$"), fits(number(bare(h, 3), 16, 8)))
        .when(h.rlike(dotted), bind(F.transform(F.split(h, r"\."), part), lambda p: F.when(F.forall(p, lambda x: F.coalesce(x <= 255, F.lit(False))), joined_up(p)).otherwise(F.lit(0))))
    )


def special(number: Column) -> Column:
    out = F.lit(False)
    for first, last in SPECIAL_V4:
        out = out | number.between(_v4(first), _v4(last))
    return F.coalesce(out, F.lit(False))


def v6_groups(h: Column) -> Column:
    """array<long> of the eight groups of a bracketed IPv6 host; null if it is none."""
    inner = F.lower(F.regexp_extract(h, r"^\[([0-9A-Fa-f:.]+)\]$", 1))
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    tail = r"^(.*:)" + r"\.".join([octet] * 4) + "$"
    pair = lambda i: F.lower(F.hex(F.regexp_extract(inner, tail, i).cast("long") * 256 + F.regexp_extract(inner, tail, i + 1).cast("long")))
    spelt = F.when(inner.rlike(tail), F.concat(F.regexp_extract(inner, tail, 1), pair(2), F.lit(":"), pair(4))).otherwise(inner)
    listed = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))
    zeros = lambda n: F.array_repeat(F.lit("0"), n)

    def read(x: Column) -> Column:
        halves = F.split(x, "::")
        left, right = listed(F.get(halves, F.lit(0))), listed(F.get(halves, F.lit(1)))
        whole = (
            F.when((F.size(halves) == 2) & (F.size(left) + F.size(right) <= 7), F.concat(left, zeros(8 - F.size(left) - F.size(right)), right))
            .when((F.size(halves) == 1) & (F.size(left) == 8), left)
        )
        return F.when(F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.transform(whole, lambda g: F.conv(g, 16, 10).cast("long")))

    return F.when(inner != "", bind(spelt, read))


def special_v6(h: Column) -> Column:
    """Bracketed IPv6 hosts that are not global unicast (2000::/3), are documentation, transition or protocol blocks, or map a special IPv4 address."""

    def judge(g: Column) -> Column:
        at = lambda i: F.get(g, F.lit(i))
        none = lambda *places: F.forall(F.array(*(at(i) for i in places)), lambda x: x == 0)
        mapped = none(0, 1, 2, 3, 4) & (at(5) == 0xFFFF)
        protocol = (at(0) == 0x2001) & (at(1) < 0x200)
        open_ones = ((at(1) == 1) & none(2, 3, 4, 5, 6) & at(7).isin(1, 2)) | (at(1) == 3) | ((at(1) == 4) & (at(2) == 0x112)) | at(1).between(0x20, 0x3F)
        blocks = (protocol & ~open_ones) | ((at(0) == 0x2001) & (at(1) == 0xDB8)) | (at(0) == 0x2002) | ((at(0) == 0x3FFF) & (at(1) < 0x1000))
        return F.when(mapped, special(at(6) * 65536 + at(7))).otherwise(~at(0).between(0x2000, 0x3FFF) | blocks)

    return F.coalesce(bind(v6_groups(h), judge), F.lit(False))


def unsafe_reason(c: str | Column) -> Column:
    """Why a URL must not be fetched; null if it may. Percent escapes in the host are read first; blanks before the URL don't count."""
    c = col(c)
    c_trimmed = F.ltrim(c)

    def judge(u: Column) -> Column:
        raw, h = u["raw"], u["host"]
        return (
            F.when((F.length(c) > 4096) | c.rlike(r"[\x00-\x1F]"), "encoding")
            .when(~u["scheme"].isin("http", "https"), "scheme")
            .when(~u["user"].isin("", ":"), "credentials")
            .when((h == "") | h.contains("%") | (raw.rlike(r"[\[\]]") & v6_groups(raw).isNull()), "host")
            .when(h.isin(*BLOCKED) | h.rlike(BLOCKED_SUFFIX), "internal")
            .when(bind(address(h), special) | special_v6(raw), "address")
            .when((u["port"] != "") & ~u["port"].rlike("^0*([1-9][0-9]{0,3}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])$"), "port")
        )

    def parted(a: Column) -> Column:
        place = F.regexp_replace(a, "^.*@", "")
        raw = F.lower(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1))
        read = F.when(raw.contains("%"), F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)).otherwise(raw)
        return F.struct(F.when(a.contains("@"), F.regexp_extract(a, "^(.*)@", 1)).otherwise(F.lit("")).alias("user"), raw.alias("raw"), F.lower(F.regexp_replace(read, r"\.+$", "")).alias("host"), F.regexp_extract(place, r"^(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1).alias("port"))

    return bind(F.struct(scheme(c_trimmed).alias("scheme"), bind(authority(c_trimmed), parted).alias("p")), lambda u: judge({"scheme": u["scheme"], "user": u["p"]["user"], "raw": u["p"]["raw"], "host": u["p"]["host"], "port": u["p"]["port"]}))


def local_endpoint(c: str | Column) -> Column:
    """The host stays within the machine or its private network: a local or dotless name, or a loopback or private address in its usual spelling."""

    def judge(h: Column) -> Column:
        name = h.isin("localhost", "host.docker.internal", "gateway.docker.internal") | h.rlike("^-*[a-z0-9][a-z0-9-]*$")
        usual = h.rlike(r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.|$)){4}") & ~h.rlike(r"^2(2[4-9]|3[0-9])\.")
        return (h != "") & (name | (usual & special(address(h))) | (special_v6(h) & ~h.startswith("[ff")))

    return bind(host(c), judge)


def separated(search_proxy: Column, fetch_proxy: Column, direct_egress: Column, mode: Column) -> Column:
    """Searching and fetching go through two proxies and nothing leaves directly; development always passes."""
    return (mode == "development") | ((search_proxy != "") & (fetch_proxy != "") & (search_proxy != fetch_proxy) & ~direct_egress)
