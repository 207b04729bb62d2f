from __future__ import annotations

import itertools
import random

from lodestone.llm import licences as L

KNOWN = {k: L.bigrams_of(L.words_of(t)) for k, t in L.TEMPLATES.items()}


def brute(text):
    """All units (lines, the whole, every window of a template's number of words) against all templates, without size bounds or telling words."""
    best = {}
    lines = [x for x in (text or "").split("\n") if L.words_of(x)]
    for unit in lines + ([" ".join(lines)] if len(lines) > 1 else []):
        bag = L.bigrams_of(L.words_of(unit))
        for k, t in KNOWN.items():
            n = sum(bag.values()) + sum(t.values())
            best[k] = max(best.get(k, 0), round(2 * sum((bag & t).values()) / n, 6) if n else 0)
    words = L.words_of(text or "")
    for k, t in KNOWN.items():
        size = sum(t.values())
        for at in range(len(words) - 1):
            bag = L.bigrams_of(words[at : at + size + 1])
            best[k] = max(best.get(k, 0), round(2 * sum((bag & t).values()) / (size + sum(bag.values())), 6))
    hits = {k: v for k, v in best.items() if v >= L.LEAST}
    top = max(hits.values(), default=None)
    return next((k for k, v in hits.items() if v == top), None), top, list(hits)


def test_against_loops(spark, documents):
    rng = random.Random(11)
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "Licensed\nunder the Apache\nLicense, Version 2.0!")]
    templates = list(L.TEMPLATES.values())
    for i in range(150):
        lines = []
        for _ in range(rng.randint(0, 4)):
            w = rng.choice(templates).split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(["the", "License", "x", "License, the License,", "—"])
            lines.append("  ".join(w[rng.randint(0, 1) :]))
        rows.append((10 + i, "\n".join(lines)))
    for r in L.scan(documents(rows)).collect():
        lic, score, hits = brute(dict(rows)[r.doc_id])
        assert (r.license, r.score, [f.license for f in r.found]) == (lic, score, hits), dict(rows)[r.doc_id]


def test_notices_inside_texts(spark, documents):
    """Notices and whole licences wrapped over lines, inside prose, with words changed, left out and put in; two in one text; the end of a text."""
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choices("on the and river software copyright with house of license to use in garden this".split(), k=n))
    rows, want = [], {}
    for k, t in L.TEMPLATES.items():
        for _ in range(4):
            w = t.split()
            for _ in range(len(w) // 25):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [w[at], "very"], ["other"]])
            broken = "".join(x + rng.choice([" ", " ", " ", "\n", "\n * "]) for x in w)
            i = len(rows)
            rows.append((i, f"{prose(rng.randint(0, 80))} {broken}{prose(rng.randint(0, 80))}"))
            want[i] = k
    rows.append((len(rows), prose(300) + "\n" + L.TEMPLATES["MIT-text"].replace(" ", "\n") + prose(100) + L.TEMPLATES["ISC"]))
    got = {r.doc_id: r for r in L.scan(documents(rows)).collect()}
    for i, t in rows:
        assert (got[i].license, got[i].score, [f.license for f in got[i].found]) == brute(t), t
    assert sum(want[i] in [f.license for f in got[i].found] for i in want) > 0.85 * len(want)
    assert {f.license for f in got[len(rows) - 1].found} >= {"MIT-text", "ISC"}


def test_telling_words_lose_nothing():
    for k, t in L.TEMPLATES.items():
        words = L.words_of(t)
        chosen, n = L.telling(words), len(words) - 1
        left = sum(not ({a, b} & set(chosen)) for a, b in zip(words, words[1:], strict=False))
        assert 2 * left / (left + n) < L.LEAST, k  # all that a unit without these words could share


def test_needed_words_lose_nothing():
    """No set of fewer words of a template lets a unit share enough bigrams: over all sets of short templates, and the best found of long ones."""
    for k, t in L.TEMPLATES.items():
        words = L.words_of(t)
        n, count = len(words) - 1, L.needed(words)
        shared = lambda some, words=words: sum({a, b} <= some for a, b in zip(words, words[1:], strict=False))
        vocabulary, low = sorted(set(words)), L.size_bounds(n)[0]
        if len(vocabulary) <= 14:
            assert all(shared(set(c)) < low for c in itertools.combinations(vocabulary, count - 1)), k
        else:
            some = set(vocabulary)
            while len(some) >= count:
                some.discard(max(sorted(some), key=lambda w: shared(some - {w})))
            assert shared(some) < low, k


def test_size_bounds_are_tight():
    for n in (1, 2, 5, 12):
        low, high = L.size_bounds(n)
        best = lambda a, n=n: 2 * min(a, n) / (a + n)
        assert best(low) >= L.LEAST - 1e-9 and best(high) >= L.LEAST - 1e-9
        assert best(low - 1) < L.LEAST and best(high + 1) < L.LEAST


def test_awkward_rows(spark, documents, awkward):
    docs = documents(awkward).selectExpr("*", "1 AS found", "2 AS bags", "3 AS license")
    rows = L.scan(docs).collect()
    assert len(rows) == len(awkward) and all(r.license is None and r.found == [] for r in rows)
    assert L.scan(docs.limit(0)).count() == 0


def test_plan_has_no_python(spark, sf_dir):
    plan = L.op8_license_scan(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Exchange" not in plan
