"""One result to each facet, one facet to each result, against a loop."""

from __future__ import annotations

import random

from lodestone.operators import selection as W


def loop(rows, facets):
    left, out = sorted(rows, key=lambda r: r["pos"])[:facets], {}
    for f in range(facets):
        fine = [r for r in left if r["fits"][f]]
        if not fine:
            continue
        best = max(fine, key=lambda r: r["scores"][f])
        if best["scores"][f] >= 0.12:
            out[best["key"]] = f
            left.remove(best)
    return out


def test_preferred_against_the_loop(spark):
    r = random.Random(4)
    for facets in (1, 2, 4):
        rows = [{"q": q, "pos": p, "key": f"k{p}", "scores": [round(r.choice((0.05, 0.12, 0.3, r.random())), 2) for _ in range(facets)], "fits": [r.random() < 0.7 for _ in range(facets)]} for q in range(40) for p in r.sample(range(50), r.randrange(1, 8))]
        df = spark.createDataFrame(rows, "q int, pos int, key string, scores array<double>, fits array<boolean>")
        got = {(x.q, x.key): int(x.preferred) for x in W.preferred(df, ["q"], facets).collect()}
        assert got == {(q, k): f for q in range(40) for k, f in loop([x for x in rows if x["q"] == q], facets).items()}
    assert len(got) > 40
    assert W.preferred(df.limit(0), ["q"], 3).count() == 0


def test_preferred_results_are_fetched_first(spark):
    rows = [{"q": 0, "pos": p, "key": f"k{p}", "domain": f"d{p}", "kind": "web_page", "preliminary": 1 - p / 10, "scores": [0.5 - p / 100, 0.3 + p / 100], "fits": [True, True]} for p in range(8)]
    df = spark.createDataFrame(rows, "q int, pos int, key string, domain string, kind string, preliminary double, scores array<double>, fits array<boolean>")
    chosen = W.preferred(df, ["q"], 2)
    got = W.fetch_order(df.join(chosen, ["q", "key"], "left"), ["q"], 4, 2).orderBy("position").collect()
    assert [x.key for x in got][:2] == ["k0", "k1"]
