"""URL filters: rules on hosts and paths, and empirical-Bayes host reputation for what no rule decides.

Labelled page outcomes count successes at hosts. Beta-binomial priors shrink a host's rate to its registered
domain's, that to its suffix's, and that to the overall rate; each prior's strength is fitted by moments to how much
rates differ at its level. A host is blocked when the upper bound of its posterior (a quantile of the beta distribution) stays under a share of
the overall rate: where hosts differ no more than chance has them, priors are strong and none is blocked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, lookup_join, table

#: (verdict, rule): host and path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: The posterior's quantile that is the bound, and the share of the overall rate of good pages that the bound must reach.
SURE, LEAST = 0.95, 0.8
#: Suffixes of two labels under which sites are registered (fixed values: common ones of the public suffix list).
SUFFIXES = (
    "ac.jp", "ac.uk", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw", "com.ua", "edu.au",
    "edu.cn", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk",
)
#: Cells of the grid on which a posterior is summed up, over so many standard deviations to either side of its mean.
CELLS, REACH = 256, 10.0
#: Bounds of a prior's strength, in pages, and the strength where rates don't differ or nothing is labelled.
WEAKEST, STRONGEST = 1.0, 1000.0


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<verdict, rule> of the longest rule that fits, the earlier among equally long ones; null if none fits."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        here = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits & (out["rule"].isNull() | (F.length(out["rule"]) < len(rule))), here).otherwise(out)
    return out


def name_of(host: Column) -> Column:
    """The host without user, port and trailing dots."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.*(:[0-9]*)?$", "")


def is_address(name: Column) -> Column:
    return name.rlike(r"^([0-9]+\.){3}[0-9]+$|^\[")


def suffix_of(host: Column, suffixes=SUFFIXES) -> Column:
    """The last two labels if these are one of suffixes, else the last; addresses have the suffix `[]`."""
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(is_address(name), "[]").when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, suffixes=SUFFIXES) -> Column:
    """The registered domain: one label more than the suffix; addresses and shorter names are their own."""
    name = name_of(host)
    return F.when(is_address(name), name).when(F.substring_index(name, ".", -2).isin(*suffixes), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def upper_bound(a: Column, b: Column, sure: float = SURE) -> Column:
    """The `sure` quantile of a beta distribution, about: its density is summed up over even steps of the arc sine of the root, where its spread is even."""
    middle, spread = F.asin(F.sqrt(a / (a + b))), F.lit(0.5 * REACH) / F.sqrt(a + b)
    low, high = F.greatest(F.lit(0.0), middle - spread), F.least(F.lit(math.pi / 2), middle + spread)
    step = (high - low) / F.lit(float(CELLS))
    grid = F.struct(a.alias("a"), b.alias("b"), middle.alias("m"), low.alias("low"), step.alias("step"))

    def height(g, k):
        u = g["low"] + (k + F.lit(0.5)) * g["step"]
        return F.exp((2 * g["a"] - 1) * F.log(F.sin(u) / F.sin(g["m"])) + (2 * g["b"] - 1) * F.log(F.cos(u) / F.cos(g["m"])))

    def walk(g, heights):
        target = F.aggregate(heights, F.lit(0.0), lambda s, x: s + x) * F.lit(sure)
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("at"), F.lit(False).alias("done"))

        def on(s, x):
            here = ~s["done"] & (s["sum"] + x >= target)
            return F.struct((s["sum"] + F.when(s["done"] | here, 0.0).otherwise(x)).alias("sum"), (s["at"] + F.when(s["done"], 0.0).when(here, (target - s["sum"]) / x).otherwise(1.0)).alias("at"), (s["done"] | here).alias("done"))

        u = g["low"] + F.aggregate(heights, start, on)["at"] * g["step"]
        return F.sin(u) * F.sin(u)

    # One-element arrays bind what is used more than once.
    bound = F.transform(F.array(grid), lambda g: F.struct(g.alias("g"), F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda k: height(g, k)).alias("h")))
    return F.get(F.transform(bound, lambda x: walk(x["g"], x["h"])), F.lit(0))


def _strength(children: DataFrame, mean: Column) -> float:
    """Prior strength of a level by moments, from its labelled children (n, g) around their parents' rates."""
    p = F.col("g") / F.col("n")
    r = children.filter("n > 0").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * (p - mean) * (p - mean)).alias("v"), F.sum(F.col("n") * mean * (1 - mean)).alias("m")).first()
    if not r.n:
        return STRONGEST
    v, m = r.v / r.n, r.m / r.n
    over = v - m * r.k / r.n
    return STRONGEST if over <= 1e-9 else min(STRONGEST, max(WEAKEST, (m - v) / over))


def reputation(pages: DataFrame, outcomes: DataFrame, host: str = "host", page_id: str = "page_id", sure: float = SURE) -> DataFrame:
    """(host, pages, n, g, mean, bound, root): every host of pages with its labelled pages, good ones, posterior mean and upper bound, and the overall rate.

    outcomes: (page_id, good boolean), one row per labelled page; null ids or outcomes don't count. Without any
    labelled page the rate is one half at every level and nothing is blocked but by rules.
    """
    labelled = outcomes.filter(F.col("good").isNotNull() & F.col(page_id).isNotNull()).select(F.col(page_id).alias("_page"), F.col("good").cast("int").alias("_good"))
    hosts = pages.select(F.col(host).alias("host"), F.col(page_id).alias("_page")).join(labelled, "_page", "left").groupBy("host")
    hosts = cut(hosts.agg(F.count(F.lit(1)).alias("pages"), F.count("_good").alias("n"), F.coalesce(F.sum("_good"), F.lit(0)).alias("g")).withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))
    domains = cut(hosts.groupBy("domain", "suffix").agg(F.count(F.lit(1)).alias("under"), F.sum("n").alias("n"), F.sum("g").alias("g")))
    suffixes = domains.groupBy("suffix").agg(F.count(F.lit(1)).alias("under"), F.sum("n").alias("n"), F.sum("g").alias("g"))
    suffixes = cut(suffixes)
    all_n, all_g, n_domains = suffixes.agg(F.sum("n"), F.sum("g"), F.sum("under")).first()
    n_hosts = hosts.count()
    root = ((all_g or 0) + 1) / ((all_n or 0) + 2)
    rate = lambda parent: F.when(F.col("n") > 0, F.col("g") / F.col("n")).otherwise(parent)
    post = lambda strength, prior: (F.lit(strength) * prior + F.col("g")) / (F.lit(strength) + F.col("n"))
    s = _strength(suffixes, F.lit(root))
    suffixes = suffixes.select("suffix", "under", rate(F.lit(root)).alias("raw"), post(s, F.lit(root)).alias("up"))
    domains = lookup_join(domains.withColumnRenamed("under", "hosts"), suffixes, "suffix", "under", ["domain"], n_domains or 0)
    s = _strength(domains, F.col("raw"))
    domains = domains.select("domain", "hosts", rate(F.col("raw")).alias("raw"), post(s, F.col("up")).alias("up"))
    hosts = lookup_join(hosts, domains, "domain", "hosts", ["host"], n_hosts)
    s = F.lit(_strength(hosts, F.col("raw")))
    a, b = s * F.col("up") + F.col("g"), s * (1 - F.col("up")) + F.col("n") - F.col("g")
    return hosts.select("host", "pages", "n", "g", (a / (a + b)).alias("mean"), upper_bound(a, b, sure).alias("bound"), F.lit(root).alias("root"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, least: float = LEAST, sure: float = SURE, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) for every row of pages.

    A null url, or one without ://, has an empty host and path; such pages share the reputation of the empty host.
    Repeated rows are judged alike, each labelled row counts once per row of pages, and other columns are ignored.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    known = reputation(rows, outcomes.withColumnRenamed(page_id, "page_id") if page_id != "page_id" else outcomes, sure=sure)
    total = known.agg(F.sum("pages")).first()[0] or 0
    rows = lookup_join(rows, known.select("host", "pages", "bound", "root"), "host", "pages", ["page_id", "path"], total)
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("bound") < F.lit(least) * F.col("root"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "bound")


def document_of(url: Column) -> Column:
    """The number of the document that a url's path names: its first segment that is a number (with or without an ending)."""
    return F.regexp_extract(path_of(url), r"^(?:/[^/]*)*?/([0-9]{1,18})(?:\.[a-z]+)?(?:/|$)", 1).try_cast("long")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, good): outcomes of the pages whose urls name a labelled document: good if of quality and not toxic. The worst of repeated labels holds."""
    good = (F.min("quality") > 0) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(good.alias("good"))
    named = pages.select("page_id", document_of(F.col("url")).alias("doc_id")).filter("page_id is not null and doc_id is not null").distinct()
    return named.join(known, "doc_id").groupBy("page_id").agg(F.min("good").alias("good"))


def op4_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    out = judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict")


def _strength_sql(children: str, mean: str) -> str:
    return f"""(SELECT CASE WHEN coalesce(sum(n), 0) = 0 THEN 1000.0
    WHEN sum(n * (g / n::DOUBLE - {mean}) * (g / n::DOUBLE - {mean})) / sum(n) - sum(n * {mean} * (1 - {mean})) / sum(n) * count(*) / sum(n) <= 1e-9 THEN 1000.0
    ELSE least(1000.0, greatest(1.0, (sum(n * {mean} * (1 - {mean})) / sum(n) - sum(n * (g / n::DOUBLE - {mean}) * (g / n::DOUBLE - {mean})) / sum(n))
      / (sum(n * (g / n::DOUBLE - {mean}) * (g / n::DOUBLE - {mean})) / sum(n) - sum(n * {mean} * (1 - {mean})) / sum(n) * count(*) / sum(n)))) END::DOUBLE AS s
    FROM {children} WHERE n > 0)"""


SQL = {
    "op4_url_filter": rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT doc_id, CAST(min(quality) > 0 AND coalesce(max(toxic), 0) = 0 AS INTEGER) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
o AS (SELECT page_id, min(good) AS good FROM (SELECT page_id, try_cast(regexp_extract(path, '^(?:/[^/]*)*?/([0-9]{{1,18}})(?:\.[a-z]+)?(?:/|$)', 1) AS BIGINT) AS doc_id FROM p WHERE page_id IS NOT NULL) JOIN l USING (doc_id) GROUP BY page_id),
b AS (SELECT page_id, host, regexp_replace(regexp_replace(host, '^.*@', ''), '\.*(:[0-9]*)?$', '') AS name FROM p),
c AS (SELECT *, regexp_matches(name, '^([0-9]+\.){{3}}[0-9]+$|^\[') AS address, array_to_string(string_split(name, '.')[-2:], '.') AS two, array_to_string(string_split(name, '.')[-3:], '.') AS three FROM b),
h AS (SELECT host, CASE WHEN address THEN name WHEN two IN {SUFFIXES!r} THEN three ELSE two END AS domain,
    CASE WHEN address THEN '[]' WHEN two IN {SUFFIXES!r} THEN two ELSE string_split(name, '.')[-1] END AS suffix,
    count(o.good) AS n, coalesce(sum(o.good), 0) AS g FROM c LEFT JOIN o USING (page_id) GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(g) AS g FROM h GROUP BY ALL),
x AS (SELECT suffix, sum(n) AS n, sum(g) AS g FROM d GROUP BY suffix),
r AS (SELECT (sum(g) + 1) / (sum(n) + 2)::DOUBLE AS root FROM x),
x0 AS (SELECT x.*, root FROM x, r),
xs AS (SELECT x0.*, CASE WHEN n > 0 THEN g / n::DOUBLE ELSE root END AS raw, (s * root + g) / (s + n) AS up FROM x0, {_strength_sql("x0", "root")} AS t),
d0 AS (SELECT d.*, xs.raw AS par, xs.up AS pup FROM d JOIN xs USING (suffix)),
ds AS (SELECT d0.domain, CASE WHEN n > 0 THEN g / n::DOUBLE ELSE par END AS raw, (s * pup + g) / (s + n) AS up FROM d0, {_strength_sql("d0", "par")} AS t),
h0 AS (SELECT h.*, ds.raw AS par, ds.up AS pup FROM h JOIN ds USING (domain)),
ab AS (SELECT host, s * pup + g AS a, s * (1 - pup) + n - g AS b FROM h0, {_strength_sql("h0", "par")} AS t),
lim AS (SELECT host, a, b, asin(sqrt(a / (a + b))) AS m, 5.0::DOUBLE / sqrt(a + b) AS spread FROM ab),
lh AS (SELECT *, greatest(0.0::DOUBLE, m - spread) AS low, least(pi() / 2, m + spread) AS high FROM lim),
cells AS (SELECT host, k, low, (high - low) / 256 AS step, low + (k + 0.5::DOUBLE) * (high - low) / 256 AS u, a, b, m FROM lh, range(256) AS t(k)),
dens AS (SELECT host, k, low, step, exp((2 * a - 1) * ln(sin(u) / sin(m)) + (2 * b - 1) * ln(cos(u) / cos(m))) AS w FROM cells),
cum AS (SELECT *, sum(w) OVER (PARTITION BY host ORDER BY k) AS upto, sum(w) OVER (PARTITION BY host) * 0.95::DOUBLE AS target FROM dens),
hs AS (SELECT host, power(sin(low + (k + (target - (upto - w)) / w) * step), 2) AS bound FROM cum WHERE upto >= target QUALIFY row_number() OVER (PARTITION BY host ORDER BY k) = 1),
rules(verdict, rule, name, rest) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
m AS (SELECT page_id, arg_max(verdict, length(rule)) AS verdict, arg_max(rule, length(rule)) AS rule FROM p JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, rest) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, CASE WHEN hs.bound < 0.8::DOUBLE * r.root THEN 'block' ELSE 'allow' END) AS verdict
FROM p CROSS JOIN r LEFT JOIN m USING (page_id) LEFT JOIN hs USING (host)
""",
}
