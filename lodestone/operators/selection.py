"""Which candidates of a question are fetched."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import PRIMARY

LEAST, LEAST_TOP, SHARE = 0.12, 0.15, 0.55


def choose(rows: list[dict], limit: int) -> list[dict]:
    """Candidates in the order in which they are taken.

    rows, best first: key, domain, kind, preliminary, preferred (position or None), and for each facet scores and fits (enough of its terms). First
    the preferred, then each facet's best ones, the best of all, one primary source, new domains, and whatever is left.
    """
    if limit <= 0:
        return []
    taken: dict[str, dict] = {}

    def take(some) -> bool:
        for r in some:
            if r["key"] not in taken:
                taken[r["key"]] = r
                return True
        return False

    facets = range(len(rows[0]["scores"]) if rows else 0)
    ranked = {f: sorted((r for r in rows if r["fits"][f]), key=lambda r: -r["scores"][f]) for f in facets}
    for r in sorted((r for r in rows if r["preferred"] is not None and r["preferred"] == r["preferred"]), key=lambda r: r["preferred"]):
        take([r])
        if len(taken) >= limit:
            return list(taken.values())
    for _ in range(2 if facets and limit >= 2 * len(facets) else 1):
        for f in facets:
            floor = max(LEAST, SHARE * ranked[f][0]["scores"][f]) if ranked[f] else LEAST
            take(r for r in ranked[f] if r["scores"][f] >= floor)
            if len(taken) >= limit:
                return list(taken.values())
    take(rows[:1])
    if len(taken) < limit and rows:
        fine = [r for r in rows[: max(10, 3 * limit)] if r["preliminary"] >= max(LEAST_TOP, SHARE * rows[0]["preliminary"])]
        take(r for r in fine if r["kind"] in PRIMARY)
        for r in fine:
            if len(taken) < limit and r["domain"] not in {t["domain"] for t in taken.values()}:
                take([r])
    for r in rows:
        if len(taken) < limit:
            take([r])
    return list(taken.values())


def preferred(rows: DataFrame, by: Sequence[str], facets: int, least: float = LEAST) -> DataFrame:
    """(by, key, preferred): which facet each of the first results belongs to, one facet and one result to each other.

    rows: by, key, pos (place among the exact results, interleaved over the facets' searches), arrays of `facets` scores and fits. Only the first `facets`
    results of a group take part. Facets choose in their order: of the results that are left and fit, the best by the facet's score,
    the earlier of equals, if that is at least `least`; what is chosen is gone. A group's choice is made in its one row of at most `facets` results.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy("pos"))
    first = rows.withColumn("_k", place).filter(F.col("_k") <= facets)
    held = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_k", "key", "scores", "fits"))).alias("held"))

    def choose(done: Column, facet: Column) -> Column:
        """done and one entry more: the key that the facet takes, or null."""
        left = F.filter("held", lambda r: ~F.exists(done, lambda d: d.eqNullSafe(r["key"])) & F.get(r["fits"], facet) & (F.get(r["scores"], facet) >= least))
        best = F.array_min(F.transform(left, lambda r: F.struct((-F.get(r["scores"], facet)).alias("less"), r["_k"].alias("k"), r["key"].alias("key"))))
        return F.concat(done, F.array(best["key"]))

    kind = dict(rows.dtypes)["key"]
    taken = F.aggregate(F.sequence(F.lit(0), F.lit(facets - 1)), F.array().cast(f"array<{kind}>"), choose) if facets else F.array().cast(f"array<{kind}>")
    return held.select(*by, F.posexplode(taken).alias("preferred", "key")).filter("key is not null").select(*by, "key", F.col("preferred").cast("double").alias("preferred"))


def fetch_order(rows: DataFrame, by: Sequence[str], limit: int, facets: int) -> DataFrame:
    """(by, key, position): see choose(). rows: by, key, pos, domain, kind, preliminary, preferred, and arrays of `facets` scores and fits.

    A group can have any size: at most `limit` candidates are taken, so of each order in which choose() takes them only the first that many beyond those taken
    can be reached. Only these rows meet in one task.
    """
    best = [F.desc("preliminary"), F.col("pos")]

    def first(some: DataFrame, most: int, *order: Column) -> DataFrame:
        """The first rows of each group in an order; each task passes on no more than that."""
        k = F.row_number().over(Window.partitionBy(*by).orderBy(*order, *best))
        return some.withColumn("_n", k).filter(F.col("_n") <= most).drop("_n")

    some = first(rows, max(10, 3 * limit) + limit)
    for f in range(facets):
        some = some.unionByName(first(rows, 2 * limit + 2, F.desc(F.get("fits", F.lit(f))), F.desc(F.get("scores", F.lit(f)))))
    some = some.unionByName(first(rows.filter("preferred is not null"), limit, F.col("preferred").asc()))
    reached = some.dropDuplicates([*by, "pos", "key"]).withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*best)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = choose(pdf.sort_values("_k").to_dict("records"), limit)
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] * len(got) for b in by}, "key": [g["key"] for g in got], "position": range(1, len(got) + 1)})

    kinds = dict(rows.dtypes)
    return reached.groupBy(*by).applyInPandas(run, ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", key string, position int")
