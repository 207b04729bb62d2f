"""Settings as rows: bounds of each field, rules across fields, the network policy and the gate on stored query data."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import urls as U

# Each number's default and bounds, other defaults, tables that hold what queries leave.
BOUNDS = {
    "cache_retention_days": (7, 0, 365), "max_response_bytes": (5_242_880, 65_536, 52_428_800), "request_timeout_seconds": (30, 1, 120), "robots_timeout_seconds": (15, 1, 60), "max_redirects": (4, 0, 10),
    "per_domain_concurrency": (2, 1, 10), "search_min_interval_seconds": (1.25, 0, 10), "recovery_delay_seconds": (10.5, 0, 30),
    "quick_queries": (3, 1, 10), "quick_raw_results": (15, 3, 100), "quick_pages": (5, 1, 25), "quick_passages": (10, 1, 50), "quick_rounds": (1, 1, 4), "quick_browser_pages": (0, 0, 5),
    "standard_queries": (6, 1, 15), "standard_raw_results": (40, 3, 150), "standard_pages": (10, 1, 30), "standard_passages": (20, 1, 75), "standard_rounds": (2, 1, 4), "standard_browser_pages": (1, 0, 10),
    "deep_queries": (15, 1, 30), "deep_raw_results": (100, 3, 300), "deep_pages": (25, 1, 50), "deep_passages": (40, 1, 150), "deep_rounds": (4, 1, 6), "deep_browser_pages": (3, 0, 15),
    "quick_context_chars": (8_000, 4_000, 50_000), "standard_context_chars": (9_000, 4_000, 50_000), "deep_context_chars": (10_000, 4_000, 50_000), "read_context_chars": (8_000, 4_000, 50_000),
    "tool_deadline_seconds": (105, 30, 300), "repeat_search_cooldown_seconds": (5, 0, 60), "quick_deadline_seconds": (90, 30, 1_800), "standard_deadline_seconds": (240, 30, 1_800), "deep_deadline_seconds": (720, 30, 1_800),
}
DEFAULTS = {
    "privacy_mode": "strict", "search_proxy": "socks5://tor-search:9050", "fetch_proxy": "socks5://tor-fetch:9050", "direct_egress": False, "admin_host": "127.0.0.1", "tool_host": "127.0.0.1", "containerized": False,
    "enable_embeddings": False, "enable_reranker": False, "internal_planner": False, "planner_url": "", "planner_model": "", "model_url": "http://host.docker.internal:1234/v1",
}
QUERY_TABLES = ("cache_entries", "requests", "evidence_records", "evidence_fts")
GATED = r"(?i)^\s*(?:insert(?:\s+or\s+\w+)?|replace)\s+into\s+(?:main\.)?(?:" + "|".join(QUERY_TABLES) + r")\b"


def setting(given: Mapping[str, Column], name: str) -> Column:
    """A row's value of a setting, or its default."""
    default = F.lit(BOUNDS[name][0]).cast("double") if name in BOUNDS else F.lit(DEFAULTS[name])
    return F.coalesce(given[name].cast("double") if name in BOUNDS else given[name], default) if name in given else default


def errors(given: Mapping[str, Column]) -> Column:
    """array<string>: names of the fields out of bounds, in their order, then of the rules that the row breaks. given: columns by setting; null stands for the default."""
    of = lambda name: setting(given, name)
    bounds = [F.when(~of(k).between(low, high), F.lit(k)) for k, (_, low, high) in BOUNDS.items() if k in given]
    strict = of("privacy_mode") == "strict"
    outside = lambda h: ~(h.isin("127.0.0.1", "localhost") | (of("containerized") & (h == "0.0.0.0")))
    plain = lambda u: F.regexp_replace(u, "/+$", "")
    planner = of("internal_planner")
    rules = [
        F.when(of("enable_embeddings") | of("enable_reranker"), "ranking capability"),
        F.when(~of("privacy_mode").isin("strict", "development"), "privacy mode"),
        F.when(strict & of("direct_egress"), "direct egress"),
        F.when(strict & ((of("search_proxy") == "") | (of("fetch_proxy") == "")), "proxies missing"),
        F.when(strict & (of("search_proxy") == of("fetch_proxy")), "proxies equal"),
        F.when(outside(of("admin_host")) | outside(of("tool_host")), "host interface"),
        F.when(planner & ((of("planner_url") == "") | (of("planner_model") == "")), "planner incomplete"),
        F.when(planner & (of("planner_url") != "") & ~U.local_endpoint(of("planner_url")), "planner remote"),
        F.when(planner & (plain(of("planner_url")) == plain(of("model_url"))), "planner shared"),
    ]
    return F.array_compact(F.array(*bounds, *rules))


def network_policy(search_proxy: Column, fetch_proxy: Column, direct_egress: Column, mode: Column) -> Column:
    """struct<strict, separate, pass>: whether searching and fetching go through two proxies; outside strict mode everything passes."""
    separate = (search_proxy != "") & (fetch_proxy != "") & (search_proxy != fetch_proxy)
    return F.struct((mode == "strict").alias("strict"), separate.alias("separate"), F.when(mode == "strict", separate & ~direct_egress).otherwise(F.lit(True)).alias("pass"))


def write_permitted(statement: Column, persistence: Column) -> Column:
    """Whether a statement may run: without persistence nothing is inserted into the tables that hold what queries leave."""
    return persistence | ~statement.rlike(GATED)
