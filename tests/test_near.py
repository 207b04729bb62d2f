"""The similarity join and the merge in order, against loops."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np

from lodestone.operators import evidence as V
from lodestone.operators import graph
from lodestone.operators import near as N


def edited(r, text, most):
    for _ in range(r.randrange(most + 1)):
        i = r.randrange(len(text) + 1)
        text = r.choice([text[:i] + r.choice("abcxyz ") + text[i:], text[:i] + text[i + 1 :]])
    return text


def strings(seed, n, size):
    r = random.Random(seed)
    stems = ["".join(r.choices("abcdefgh ", k=r.randrange(1, size))) for _ in range(n // 4)]
    return list({edited(r, r.choice(stems), max(1, size // 12)) for _ in range(n)})


def test_alike_strings_against_all_pairs(spark):
    for kind, size in ((0, 14), (0, 70), (1, 320)):
        texts = strings(size, 110, size)
        df = spark.createDataFrame([(7, i, kind, t) for i, t in enumerate(texts)], "cell long, id long, kind int, text string")
        got = sorted((p.later, p.earlier) for p in N.alike_strings(df).collect())
        want = sorted((i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and SequenceMatcher(None, a, b).ratio() >= N.LIMITS[kind])
        assert got == want
    assert len(got) > 20


def test_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(140)] + [(999, 999)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.label for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


SCHEMA = "q int, pos long, canonical_url string, domain string, title string, snippet string, engines array<string>, search_score double"


def results(seed, n, domains, q=1):
    """Results of one question: families of near titles and snippets, shared URLs, mirrors under other domains, empty and mixed-case fields."""
    r = random.Random(seed)
    titles = ["".join(r.choices("abcdefgh ", k=r.randrange(0, 50))) for _ in range(n // 3 + 1)]
    bodies = ["".join(r.choices("abcdefgh ", k=r.randrange(0, 150))) for _ in range(n // 3 + 1)]
    out = []
    for p in range(n):
        d = f"d{r.randrange(domains)}.x"
        title, snippet = edited(r, r.choice(titles), 3), edited(r, r.choice(bodies), 6)
        out.append((q, p, f"http://{d}/{r.randrange(n)}", d if r.random() > 0.1 else f"mirror{r.randrange(1 + domains // 5)}.x", title.upper() if p % 5 == 0 else title, snippet, [f"e{p % 3}"], round(r.random(), 3)))
    r.shuffle(out)
    return out


def merged(rows):
    kept = []
    for r in sorted(rows, key=lambda r: r[1]):
        _, pos, url, domain, title, snippet, engines, score = r
        for k in kept:
            if url == k["url"] or (domain == k["domain"] and (N.alike(title.casefold(), k["title"].casefold(), 0.93) or (snippet and k["snippet"] and N.alike(snippet.casefold(), k["snippet"].casefold(), 0.94)))):
                k["engines"] |= set(engines)
                k["score"] = max(k["score"], score)
                k["snippet"] = snippet if len(snippet) > len(k["snippet"]) else k["snippet"]
                break
        else:
            kept.append({"pos": pos, "url": url, "domain": domain, "title": title, "snippet": snippet, "engines": set(engines), "score": score})
    return sorted((k["pos"], k["url"], k["domain"], k["title"], k["snippet"], sorted(k["engines"]), k["score"]) for k in kept)


def got(df):
    return sorted((r.pos, r.canonical_url, r.domain, r.title, r.snippet, r.engines, r.search_score) for r in df.collect())


def test_one_domain_of_many_near_copies(spark):
    rows = results(2, 240, 2)
    out = N.near_results(spark.createDataFrame(rows, SCHEMA), ["q"])
    want = merged(rows)
    assert got(out) == want and out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert len(want) < 220


def test_a_group_of_ten_thousand(spark):
    rows = results(3, 10_000, 600)
    want = merged(rows)
    assert got(N.near_results(spark.createDataFrame(rows, SCHEMA), ["q"])) == want
    assert len(want) < 9_990


def test_alike_strings_in_blocks(spark, monkeypatch):
    """Blocks of a few strings and neighbouring bands of sizes lose no pair and give none twice."""
    monkeypatch.setattr(N, "BLOCK", 5)
    r, texts = random.Random(8), strings(5, 90, 60)
    texts = sorted({*texts, *(t + r.choice("abcdefgh") * k for t in texts for k in (1, 2, 5)), "", "a", "ä" * 40, "ä" * 39 + "\U0001f600", "x" * 700, "x" * 660})
    df = spark.createDataFrame([(c, i, 0, t) for c in (1, 2) for i, t in enumerate(texts)], "cell long, id long, kind int, text string")
    got = sorted((p.cell, p.later, p.earlier) for p in N.alike_strings(df).collect())
    want = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and SequenceMatcher(None, a, b).ratio() >= N.LIMITS[0]]
    assert got == sorted((c, *p) for c in (1, 2) for p in want) and len(want) > 100


def test_few_unlike_strings_are_compared():
    """Of titles of the same few words, letters leave hardly any pair but those that are alike, and all of these."""
    r = random.Random(4)
    words = ["".join(r.choices("aeinorstdhlu", k=r.randrange(2, 9))) for _ in range(60)]
    texts = list(dict.fromkeys(" ".join(r.choices(words, k=12))[:60] for _ in range(500)))
    texts += [edited(r, t, 3) for t in texts[:40]]
    rows = list(enumerate(texts))
    size, letters = np.array([len(t) for t in texts]), np.stack([np.bincount([ord(c) % N.LETTERS for c in t], minlength=N.LETTERS).astype(np.uint8) for t in texts])
    left = {(int(i), int(j)) for x, y in N.candidates(size, letters, np.zeros(len(texts), int), np.ones(len(texts), bool), False, 0.93) for i, j in zip(x, y, strict=True)}
    alike = {(i, j) for i, a in rows for j, b in rows[i + 1 :] if N.alike(a, b, 0.93)}
    assert alike <= left and len(alike) >= 40 and len(left) < len(texts) ** 2 / 2 / 500
    assert all(N.may_be_alike(texts[i], texts[j], 0.93) for i, j in alike)


def test_groups_stay_apart_and_small_groups_fold_alike(spark):
    rows = [r for q in range(8) for r in results(q, 60, 3, q)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(x for q in range(8) for x in merged([r for r in rows if r[0] == q]))
    assert got(N.near_results(df, ["q"])) == want
    assert got(V.merge_few(df, ["q"])) == want


def test_no_results(spark):
    assert N.near_results(spark.createDataFrame([], SCHEMA), ["q"]).count() == 0
