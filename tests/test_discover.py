"""The search phase: its stop rules, queries and budgets."""

from __future__ import annotations

import random
from itertools import product

from lodestone import api
from lodestone.plans.questions import BUDGETS


def rounds_by_the_rules(mode, most, facts, max_sources):
    """How many rounds run, told step by step: facts are (relevant, primary, useful) after each."""
    weak = done = 0
    for k in range(most):
        relevant, primary, useful = facts[k]
        done += 1
        weak_discovery = relevant < max(2, min(4, max_sources // 2)) or not primary
        weak = 0 if useful else weak + 1
        more = k + 1 < most
        if weak >= 2:
            break
        if mode == "deep" and more:
            strong = relevant >= max(6, max_sources) and primary
            if k == 0 or not strong:
                continue
        if mode == "standard" and weak_discovery and more:
            continue
        if not more or not weak_discovery:
            break
    return done


def test_stop_rules():
    r = random.Random(1)
    for mode, most, sources in product(("quick", "standard", "deep"), (1, 2, 4, 6), (1, 4, 8, 12)):
        if mode == "quick" and most > 1:
            continue  # its budget has one round
        for _ in range(60):
            facts = [(r.choice((0, 1, 2, 4, 6, 9, 20)), r.random() < 0.5, r.random() < 0.6) for _ in range(most)]
            weak = done = 0
            for k, (relevant, primary, useful) in enumerate(facts):
                done, weak = done + 1, 0 if useful else weak + 1
                if not api.goes_on(mode, k, k + 1 < most, weak, relevant, primary, sources):
                    break
            assert done == rounds_by_the_rules(mode, most, facts, sources)


def test_rounds_and_budgets(spark):
    asked = []

    def search(query, limit):
        asked.append((query, limit))
        n = len(asked)
        rows = [(p, f"https://x{p}.example/{n if p % 2 else 0}", f"erinant thonor ering {p}", "erinant thonor ering", ["a"], 1 - p / 40) for p in range(30)]
        return spark.createDataFrame(rows, "pos int, url string, title string, snippet string, engines array<string>, search_score double")

    got = api.discover(spark, "erinant thonor ering", search, api.Options(mode="deep"))
    log = [(r["round"], r.query, r.relevant, r.useful) for r in got["rounds"].collect()]
    assert [q for _, q, _, _ in log] == [q for q, _ in asked] and asked[0] == ("erinant thonor ering", 10)
    budget = next(b for b in BUDGETS if b[0] == "deep")
    assert len(asked) <= budget[1] and {k for k, *_ in log} == {1, 2, 3}  # no primary source: as long as there are queries
    assert all(3 <= n <= 15 for _, n in asked[1:]) and sum(n for _, n in asked) <= budget[2]
    rows = got["results"].orderBy("pos").collect()
    assert len({r.url for r in rows}) == len(rows) and len(rows) < sum(n for _, n in asked)
    assert log[-1][2] >= 2 and log[-1][3]
    asked.clear()
    api.discover(spark, "erinant thonor ering", search, api.Options(mode="quick"))
    assert len(asked) <= 3
