"""Substring dedup against loops over all windows; hot passages, repeated rows, long texts, clashing columns."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from lodestone.llm import substrings


def loops(rows, window=20):
    """Kept words and removed positions of each row, by a table of all windows' first places."""
    body = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    place = lambda r: (r[0] is None, r[0] or 0, signed(body(r[1])))
    cut = lambda t: (t or "").encode().split()
    first = {}
    for r in sorted(rows, key=place):
        w = cut(r[1])
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (place(r), i))
    out = []
    for r in rows:
        w = cut(r[1])
        gone = {i + k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] != (place(r), i) for k in range(window)}
        out.append((r[0], len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def rows_of(df):
    return [(r.doc_id, r.n_words, r.n_removed, " ".join((r.text or "").encode().decode().split()) if r.n_removed == 0 else r.text) for r in df.collect()]


def plain(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def corpus(seed, n=150, vocabulary=12):
    r = random.Random(seed)
    word = lambda: r.choice([f"w{k}" for k in range(vocabulary)])
    passages = [[word() for _ in range(r.randrange(15, 60))] for _ in range(8)]
    return [(i, " ".join(w for _ in range(r.randrange(0, 4)) for w in [*(word() for _ in range(r.randrange(0, 30))), *r.choice(passages)])) for i in range(n)]


@pytest.mark.parametrize("hot", [10_000, 2])
def test_against_loops(documents, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    rows = corpus(4)
    got = rows_of(substrings.dedup_substrings(documents(rows)))
    assert plain(got) == plain(loops(rows))
    assert sum(r[2] for r in got) > 500


def test_awkward(documents, awkward):
    rows = [r[:2] for r in awkward] + [(9, "a b c d e " * 9), (9, "a b c d e " * 9), (None, "a b c d e " * 9)]
    got = rows_of(substrings.dedup_substrings(documents(rows)))
    assert plain(got) == plain((i, n, m, " ".join(t.split()) if m == 0 else t) for i, n, m, t in loops(rows))
    assert max(r[2] for r in got) == 140_000 - 7 - 19 + 19  # the period's own windows stay


@pytest.mark.parametrize("hot", [10_000, 2])
def test_a_third_of_all_documents_share_a_passage(documents, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    own = lambda i, k: " ".join(f"{i}-{j}" for j in range(k))
    passage = " ".join(f"p{j}" for j in range(60))
    rows = [(i, f"{own(i, i % 30)} {passage} {own(-i, i % 9)}" if i % 3 == 0 else own(i, 40)) for i in range(600)] + [(1_000 + i, f"{passage} copy") for i in range(300)]
    got = rows_of(substrings.dedup_substrings(documents(rows)))
    assert plain(got) == plain(loops(rows))


def test_spans_are_maximal_and_clashes_are_kept(spark):
    text = " ".join(f"x{k}" for k in range(30))
    df = spark.createDataFrame([(1, text, 7, "a", 1), (2, f"one {text} two {text}", 8, "b", 2), (3, None, None, None, None)], "doc_id int, text string, n_words int, `odd.name` string, _name int")
    got = {r.doc_id: r for r in substrings.dedup_substrings(df).collect()}
    assert [(x.start, x.end) for x in got[2].removed] == [(1, 31), (32, 62)]
    assert (got[2].text, got[2].n_words, got[2]["odd.name"], got[2]._name) == ("one two", 62, "b", 2)
    assert (got[1].text, got[1].removed, got[3].text, got[3].n_words) == (text, [], None, 0)


def test_empty(documents):
    assert substrings.dedup_substrings(documents([])).count() == 0


@given(st.lists(st.sampled_from("ab"), min_size=4, max_size=60).map(lambda w: [x.encode() for x in w]))
def test_equal_windows_share_hash_and_anchor(words):
    own = substrings.Windows(4)
    own.run = 2
    for _, values, least, places in own.parts(words):
        seen = {}
        for i, h in enumerate(own.hashes(values, 4, 0).tolist()):
            assert seen.setdefault(tuple(words[i : i + 4]), (h, least[i])) == (h, least[i])
        assert len({h for h, _ in seen.values()}) == len(seen)
        repeated = [a for w, (_, a) in seen.items() if sum(tuple(words[i : i + 4]) == w for i in range(len(words) - 3)) > 1]
        counts = dict(zip(*np.unique(places, return_counts=True), strict=True))
        assert all(counts[a] > 1 for a in repeated)
