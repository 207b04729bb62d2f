"""Importance resampling: features, gains and draws against loops; copies, ties, nulls and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestone.llm import resample

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def bag(text):
    return sorted(zlib.crc32(f.encode()) % 10_000 for f in features(text)[1])


def loops(rows, target, share=5, least=20):
    s, t = [0] * 10_000, [0] * 10_000
    for texts, n in (([x for _, x in rows], s), (target, t)):
        for x in texts:
            for b in bag(x):
                n[b] += 1
    gain = [math.floor(1000 * math.log((y + 1.0) * (sum(s) + 10_000.0) / ((x + 1.0) * (sum(t) + 10_000.0)))) for x, y in zip(s, t, strict=True)]
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bag(x))
        out.append([i, len(bag(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), features(x)[0] >= least])
    may = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(may) * share // 100
    ranks = {}
    for k, r in enumerate(may[:drawn], 1):
        ranks.setdefault(id(r), k)
    return [(*r[:4], ranks.get(id(r))) for r in out]


def rows_of(df):
    return [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@given(st.text(alphabet="aB9 -é中\n\x7f", max_size=60), st.integers(1, 5))
def test_grams(text, part):
    n, found = resample.Grams().of(text, part)
    assert n == features(text)[0]
    assert sorted(found.tolist()) == bag(text)


def test_long_words_and_texts():
    r = random.Random(1)
    text = " ".join(r.choice("abcdef") * r.choice((1, 63, 64, 65, 5_000)) for _ in range(400)) + " é" * 70_000
    assert sorted(resample.Grams().of(text)[1].tolist()) == bag(text)


@given(st.lists(st.integers(0, 9_999), max_size=50))
def test_packed_bags(buckets):
    assert resample.unpacked(resample.packed(np.array(buckets, np.int64))).tolist() == sorted(buckets)


def corpus(n=400, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    return [(i, " ".join(r.choices(vocabulary, k=r.randrange(0, 45)))) for i in range(n)]


def test_against_loops(spark, documents, awkward):
    rows = corpus() + [(1_000 + i, corpus(1, 9)[0][1] + " one more word" * 9) for i in range(120)] + [r[:2] for r in awkward]
    target = ["w1 w2 w3 w1 w2", "w1 w2", "w1 w2", None, "", "Other W5 words"]
    got = resample.resample(documents(rows), spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string"))
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want = loops(rows, target)
    # Rows alike in id and score may change ranks among themselves.
    assert ordered(rows_of(got)) == ordered(want)
    assert sum(r[4] is not None for r in want) > 10


def test_ranks_over_many_ranges(spark):
    rows = [(i if i % 7 else 1, i % 5, i % 3 > 0) for i in range(2_000)]
    df = spark.createDataFrame(rows, "doc_id long, score long, may boolean")
    got = [(r.doc_id, r.score, r["rank"]) for r in resample.drawn(df, 700, 13).collect()]
    placed = sorted((r for r in got if r[2]), key=lambda r: r[2])
    assert [r[2] for r in placed] == list(range(1, 701))
    assert [r[:2] for r in placed] == sorted(((d, s) for d, s, may in rows if may), key=lambda r: (-r[1], r[0]))[:700]


def test_a_third_of_all_rows_is_one_text(spark, documents):
    rows = corpus(200) + [(5_000 + i, "the very same text " * 8) for i in range(100)]
    target = ["very same"]
    got = resample.resample(documents(rows), spark.createDataFrame([("very same",)], "text string"), share=50)
    assert ordered(rows_of(got)) == ordered(loops(rows, target, 50))


@pytest.mark.parametrize("kept", [[], [(1, None, None, None)]])
def test_empty(spark, documents, kept):
    got = resample.resample(documents(kept), spark.createDataFrame([], "text string")).collect()
    assert [(r.n_features, r.weight, r["rank"]) for r in got] == [(0, 0, None)] * len(kept)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c " * 10, 5, "x", 2, 3)], "doc_id int, text string, weight int, key string, copies long, `odd.name` int")
    got = resample.resample(df, df.select("text"), share=100).collect()
    assert [(r.doc_id, r.n_words, r["rank"]) for r in got] == [(1, 30, 1)]
