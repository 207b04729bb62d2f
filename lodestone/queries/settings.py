"""Settings, policies and evaluation runs over made-up rows that follow the events' numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import urls as U
from lodestone.operators import metrics as M
from lodestone.plans import settings as P
from lodestone.registry import register
from lodestone.sources.tables import table
from lodestone.streaming import state as Z

from . import duck as D

#: The numbers of event n's settings: a field counts up through its bounds and beyond by n.
TESTED = list(P.BOUNDS)
MODES = ["strict", "development", "open"]
PROXIES = ["", "socks5://a:1", "socks5://b:2"]
HOSTS = ["127.0.0.1", "localhost", "0.0.0.0", "10.0.0.1"]
PLANNERS = ["", "http://ollama:11434/v1", "https://example.com/v1", "http://host.docker.internal:1234/v1/", "http://192.168.1.9:80/", "http://8.8.8.8/", "http://127.0.0.1:1/"]


def _picked(values: list[str], divisor: int):
    return F.get(F.lit(values), (F.floor(F.col("n") / divisor) % len(values)).cast("int"))


def _picked_sql(values: list[str], divisor: int) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][(n // {divisor}) % {len(values)} + 1]"


def settings_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("n"))
    which, n = F.col("n") % len(TESTED), F.col("n")
    given = {k: F.when(which == i, F.lit(low) + F.floor(n / 35) % 7 * F.lit((high - low) / 4.0) - F.lit((high - low) / 4.0)) for i, (k, (_, low, high)) in enumerate(P.BOUNDS.items())}
    given |= {"privacy_mode": _picked(MODES, 1), "search_proxy": _picked(PROXIES, 3), "fetch_proxy": _picked(PROXIES, 5), "direct_egress": n % 7 == 0, "admin_host": _picked(HOSTS, 11), "containerized": n % 2 == 0}
    given |= {"enable_reranker": n % 13 == 0, "internal_planner": n % 3 == 0, "planner_url": _picked(PLANNERS, 2), "planner_model": F.when(n % 5 == 0, "").otherwise("m")}
    return rows.select(F.col("n").alias("event_id"), F.array_join(P.errors(given), ",").alias("errors"))


_BOUNDS_SQL = ", ".join(f"CASE WHEN n % {len(TESTED)} = {i} AND NOT ({low} + (n // 35) % 7 * {(high - low) / 4.0} - {(high - low) / 4.0})::DOUBLE BETWEEN {low} AND {high} THEN '{k}' END" for i, (k, (_, low, high)) in enumerate(P.BOUNDS.items()))
_LOCAL = "'" + "', '".join(u for u in PLANNERS if u and "example.com" not in u and "8.8.8.8" not in u) + "'"
register("settings_errors", ("Z1", "Z2"), settings_errors, f"""
WITH e AS (SELECT event_id AS n FROM events),
s AS (SELECT n, {_picked_sql(MODES, 1)} AS mode, {_picked_sql(PROXIES, 3)} AS sp, {_picked_sql(PROXIES, 5)} AS fp, {_picked_sql(HOSTS, 11)} AS host, {_picked_sql(PLANNERS, 2)} AS pu, CASE WHEN n % 5 = 0 THEN '' ELSE 'm' END AS pm FROM e)
SELECT n AS event_id, array_to_string(list_filter([{_BOUNDS_SQL}, CASE WHEN n % 13 = 0 THEN 'ranking capability' END, CASE WHEN mode NOT IN ('strict', 'development') THEN 'privacy mode' END, CASE WHEN mode = 'strict' AND n % 7 = 0 THEN 'direct egress' END,
  CASE WHEN mode = 'strict' AND (sp = '' OR fp = '') THEN 'proxies missing' END, CASE WHEN mode = 'strict' AND sp = fp THEN 'proxies equal' END, CASE WHEN NOT (host IN ('127.0.0.1', 'localhost') OR (host = '0.0.0.0' AND n % 2 = 0)) THEN 'host interface' END,
  CASE WHEN n % 3 = 0 AND (pu = '' OR pm = '') THEN 'planner incomplete' END, CASE WHEN n % 3 = 0 AND pu <> '' AND pu NOT IN ({_LOCAL}) THEN 'planner remote' END, CASE WHEN n % 3 = 0 AND rtrim(pu, '/') = 'http://host.docker.internal:1234/v1' THEN 'planner shared' END], lambda x: x IS NOT NULL), ',') AS errors FROM s""")


def network_policy(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("n"))
    p = P.network_policy(_picked(PROXIES, 1), _picked(PROXIES, 3), F.col("n") % 4 == 0, _picked(MODES, 9))
    return rows.select(F.col("n").alias("event_id"), p.alias("p")).groupBy("p.strict", "p.separate", F.col("p.pass").alias("passes")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


register("network_policy", ("Z3",), network_policy, f"""
WITH e AS (SELECT event_id AS n FROM events), s AS (SELECT n, {_picked_sql(PROXIES, 1)} AS sp, {_picked_sql(PROXIES, 3)} AS fp, n % 4 = 0 AS direct, {_picked_sql(MODES, 9)} AS mode FROM e),
p AS (SELECT n, mode = 'strict' AS strict, sp <> '' AND fp <> '' AND sp <> fp AS separate, CASE WHEN mode = 'strict' THEN sp <> '' AND fp <> '' AND sp <> fp AND NOT direct ELSE TRUE END AS passes FROM s)
SELECT strict, separate, passes, count(*) AS n, min(n) AS first FROM p GROUP BY ALL""")

STATEMENTS = ["INSERT INTO cache_entries VALUES (1)", "  insert or replace\n into main.requests VALUES (1)", "REPLACE INTO evidence_fts VALUES (1)", "INSERT INTO evidence_records_old VALUES (1)", "DELETE FROM requests", "SELECT 'insert into requests'", "insert into schema_version VALUES (1)"]


def persistence_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), F.get(F.lit(STATEMENTS), (F.col("event_id") % len(STATEMENTS)).cast("int")).alias("statement"))
    return rows.select(F.col("n").alias("event_id"), P.write_permitted(F.col("statement"), F.col("n") % 3 == 0).alias("permitted"))


register("persistence_gate", ("Z17",), persistence_gate, f"""
WITH s AS (SELECT event_id, [{', '.join("'" + x.replace("'", "''") + "'" for x in STATEMENTS)}][event_id % {len(STATEMENTS)} + 1] AS statement FROM events)
SELECT event_id, event_id % 3 = 0 OR NOT regexp_matches(statement, '{P.GATED}') AS permitted FROM s""")


def evaluation_runs(spark, sf_dir):
    """Every question in every mode, one row a run; what events say of a user's type stands for what the run gave."""
    e = table(spark, sf_dir, "events")
    kind = F.get(F.lit(list(M.EVALUATED)), (F.col("event_id") % 4).cast("int"))
    runs = e.groupBy((F.col("user_id") % 97).alias("question_id"), kind.alias("mode")).agg(F.round(F.sum(F.abs("value")), 3).alias("elapsed"), F.count(F.lit(1)).alias("sources"), F.count_if(F.col("event_type") == "click").alias("evidence"), F.round(F.avg(F.abs("value")) / 100, 3).alias("coverage"))
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"))
    return M.evaluation(questions, runs, "question_id", 300.0).select("question_id", "mode", "elapsed", "sources", "evidence", "coverage", "error")


register("evaluation_runs", ("Z23", "A11"), evaluation_runs, """
WITH r AS (SELECT user_id % 97 AS question_id, ['raw', 'quick', 'standard', 'deep'][event_id % 4 + 1] AS mode, round(sum(abs(value)), 3) AS elapsed, count(*) AS sources, count(*) FILTER (event_type = 'click') AS evidence, round(avg(abs(value)) / 100, 3) AS coverage FROM events GROUP BY ALL),
q AS (SELECT item_id AS question_id, mode FROM benchmark, (VALUES ('raw'), ('quick'), ('standard'), ('deep')) AS m(mode))
SELECT q.question_id, q.mode, CASE WHEN elapsed <= 300.0 THEN elapsed WHEN elapsed IS NOT NULL THEN 300.0::DOUBLE END AS elapsed, CASE WHEN elapsed <= 300.0 THEN sources ELSE 0 END AS sources, CASE WHEN elapsed <= 300.0 THEN evidence ELSE 0 END AS evidence,
  CASE WHEN elapsed <= 300.0 THEN coverage END AS coverage, CASE WHEN elapsed IS NULL THEN 'NotRun' WHEN elapsed > 300.0 THEN 'TimeoutError' ELSE '' END AS error FROM q LEFT JOIN r USING (question_id, mode)""")


def paced_calls(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("caller"), "event_id", "ts", F.round(F.abs("value") * 1000).cast("long").alias("took"))
    return Z.paced(calls, ["caller"], "ts", "took", 1250, "event_id").select("caller", "event_id", "waited")


register("paced_calls", ("X5",), paced_calls, """
WITH c AS (SELECT user_id % 5 AS caller, event_id, epoch_us(ts) AS t, (CAST(round(abs(value) * 1000) AS BIGINT) + 1250) * 1000 AS busy FROM events),
p AS (SELECT *, coalesce(sum(busy) OVER (PARTITION BY caller ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT caller, event_id, CAST(before + max(t - before) OVER (PARTITION BY caller ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) - t AS BIGINT) AS waited FROM p""")


def local_endpoints(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") * 16_777_259 % 4_294_967_296).alias("n"))
    host = F.format_string("http://%d.%d.%d.%d:80/", *(F.floor(F.col("n") / (1 << k)).cast("long") % 256 for k in (24, 16, 8, 0)))
    return rows.select("page_id", U.local_endpoint(host).alias("local"))


register("local_endpoints", ("Z2",), local_endpoints, f"""
SELECT page_id, {D._v4_special('n')} AND NOT n BETWEEN {D._v4('224.0.0.0')} AND {D._v4('239.255.255.255')} AS local FROM (SELECT page_id, page_id * 16777259 % 4294967296 AS n FROM pages)""")
