"""Searches by postings against ranking every passage."""

from __future__ import annotations

import random

import pytest

from lodestone.functions.text import meaningful_py
from lodestone.operators import index as I
from lodestone.operators import rank as R


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(3)
    words = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta", "running", "classes") for b in ("", "s", "x", "ing")] + ["the", "of", "WAL."]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = [(i, None if i % 60 == 0 else " ".join(r.choices(words, weights, k=r.randrange(0, 40)))) for i in range(240)]
    rows += [(1_000, "prealphas of betaxy"), (1_001, "alpha beta " * 30), (1_002, "İstanbul ß straße alpha")]
    df = spark.createDataFrame(rows, "id long, text string")
    folder = str(tmp_path_factory.mktemp("index") / "i")
    I.build(df, "id", folder, blocks=6)
    return df, I.Index(spark, folder)


@pytest.mark.parametrize(("question", "k"), [("alpha beta", 5), ("deltaing classesx runningx", 7), ("alphas of betax", 3), ("gammaing", 250), ("zzz nothing", 4), ("the of", 3)])
def test_same_as_ranking_all(corpus, question, k):
    df, index = corpus
    want = [(r["rank"], r.id, r.score) for r in R.top(R.rank(df, {"q": question}, "id"), k, "id").orderBy("rank").collect()]
    got = [(r["rank"], r.key, r.score) for r in index.top(question, k, first=2).orderBy("rank").collect()]
    assert got == want


def test_blocks_that_cannot_win_are_not_read(corpus, monkeypatch):
    _, index = corpus
    asked, scored = [], I.Index._scored
    monkeypatch.setattr(I.Index, "_scored", lambda self, q, t, d, blocks: asked.append(sorted(blocks)) or scored(self, q, t, d, blocks))
    said = iter([100.0] + [0.001] * 5)
    monkeypatch.setattr(I.Index, "_most", staticmethod(lambda own, rare, terms: next(said)))
    index.top("alpha beta", 1, first=1).collect()
    assert [len(x) for x in asked] == [1]


def test_postings_are_read_by_term_and_block(corpus):
    _, index = corpus
    plan = index.postings.filter("block in (1, 2) and term in ('alpha', 'beta')")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "In(term, [alpha,beta])" in plan


def test_blocks_grow_with_the_corpus_and_words_are_not_shuffled(spark, tmp_path, monkeypatch):
    """What is shuffled to build an index is whole texts; a block's text is bounded, whatever the size of the corpus."""
    monkeypatch.setattr(I, "BLOCK_BYTES", 4_000)
    rows = [(i, f"alpha beta{i % 7} alpha {'gamma ' * (i % 5)}") for i in range(2_000)] + [(2_000, None), (2_001, "  ")]
    df, folder = spark.createDataFrame(rows, "id long, text string"), str(tmp_path / "i")
    size = sum(len(t or "") for _, t in rows)
    I.build(df, "id", folder)
    postings, passages = (spark.read.parquet(f"{folder}/{k}") for k in ("postings", "passages"))
    assert passages.select("block").distinct().count() == -(-size // 4_000) > I.LEAST_BLOCKS
    assert len(postings.inputFiles()) == len(passages.inputFiles()) == -(-size // 4_000)  # one task for a block
    got = {(r.key, r.term): (r.n, r.places) for r in postings.collect()}
    want = {}
    for i, t in rows:
        words = meaningful_py(t or "")
        for p, w in enumerate(words):
            want.setdefault((i, w), (len(words), []))[1].append(p)
    assert got == want
    totals = spark.read.parquet(f"{folder}/totals").first()
    assert (totals.docs, totals.avg_n) == (len(rows), sum(len(meaningful_py(t or "")) for _, t in rows) / len(rows))
