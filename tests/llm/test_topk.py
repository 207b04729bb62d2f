from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lodestone.llm import topk as K


def brute(rows, k, every):
    fine = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, v in fine:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in fine if i != q and len(w) == len(v))
            out[q] = [(-s, i) for s, i in scored[:k]]
    return {q: r for q, r in out.items() if r}


def run(spark, rows, k=5, every=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = {}
    for r in K.top_k(df, lambda c: c % every == 0, k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("blocks", [(4096, 16, 8192), (8, 2, 5)])
def test_against_loops(spark, monkeypatch, blocks):
    for name, n in zip(("BUCKET", "SHARD", "QUERIES"), blocks, strict=True):
        monkeypatch.setattr(K, name, n)
    rng = random.Random(12)
    unit = lambda: [float(np.float32(x)) for x in (lambda v: [c / math.sqrt(sum(d * d for d in v)) for c in v])([rng.gauss(0, 1) for _ in range(6)])]
    rows = [(i, unit()) for i in range(120)] + [(200 + i, [c * rng.choice([0.01, 1.0, 9.0]) for c in unit()]) for i in range(60)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows] + [(500 + i, [0.5, -0.5, 0.25, 0.0, 0.0, 0.1]) for i in range(40)]  # many equal vectors
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    rows += [(600, None), (605, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (610, [float("nan")] * 6), (615, [float("inf")] * 6), (None, [0.1] * 6), (620, [1.0, 2.0]), (625, [3.0, 1.0]), (630, [0.0] * 6), (635, [])]
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    assert run(spark, rows) == brute(rows, 5, 5)


def test_few_rows(spark):
    assert run(spark, [(5, [1.0]), (6, [2.0])]) == {5: [(256 * 512, 6)]}
    assert run(spark, [(5, [1.0])]) == {}
    assert run(spark, []) == {}


def test_large_components():
    a = np.array([[2**40, -(2**39)], [3, 2**52]])
    assert K.products(a, a).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in a.tolist()] for r in a.tolist()]


def test_pruning_keeps_what_verification_would():
    rng = np.random.default_rng(13)
    base = rng.normal(size=(900, 16)) * rng.choice([1, 40, 300], size=(900, 1))
    v = np.floor(base).astype(np.int64)
    q = np.vstack([v[:20], np.floor(rng.normal(size=(10, 16)) * 50).astype(np.int64)])
    qid = np.concatenate([np.arange(20), np.arange(5000, 5010)])
    buckets = [(np.arange(s, s + 100), v[s : s + 100]) for s in range(0, 900, 100)]
    for least in (-1.7e308, 0.0):
        got = K.search(qid, q, np.full(len(q), least), buckets, 5)
        for j, row in enumerate(got):
            scores = q[j] @ v.T
            want = sorted(((-int(s), i) for i, s in enumerate(scores) if i != qid[j] and s >= least))[:5]
            assert [(-s, i) for s, i in row] == want


def test_passes_with_different_numbers_of_blocks(spark, monkeypatch):
    """The second pass's table has more partitions than the first's, as adaptive plans may deal it; its last blocks must meet all shards."""
    for name, n in (("BUCKET", 8), ("SHARD", 2), ("QUERIES", 5)):
        monkeypatch.setattr(K, name, n)
    packed, seen = K.packed, []

    def dealt(rows, size, extra=None):
        if extra:
            seen.append(1)
            rows = rows.repartition(1 if len(seen) == 1 else 6)
        return packed(rows, size, extra)

    monkeypatch.setattr(K, "packed", dealt)
    rng = random.Random(14)
    rows = [(i, [float(np.float32(rng.gauss(0, 1) * (1 + i % 7))) for _ in range(6)]) for i in range(150)]
    assert run(spark, rows) == brute(rows, 5, 5) and len(seen) == 2


def test_blocks_keep_their_bounds(spark, monkeypatch):
    for name, n in (("BUCKET", 64), ("SHARD", 4), ("QUERIES", 50), ("BYTES", 8 * 6 * 40)):
        monkeypatch.setattr(K, name, n)
    packed, made = K.packed, []

    def kept(rows, size, extra=None):
        out = packed(rows, size, extra)
        made.append((size, out.selectExpr("length(ids) div 8 n", "length(vectors) b").collect()))
        return out

    monkeypatch.setattr(K, "packed", kept)
    rng = random.Random(15)
    rows = [(i, [float(np.float32(rng.gauss(0, 1) * (1 + i % 50))) for _ in range(6)]) for i in range(2000)]
    assert run(spark, rows, every=2) == brute(rows, 5, 2)
    assert len(made) == 3 and all(r.n <= size and r.b <= K.BYTES for size, got in made for r in got)


def test_only_shards_that_can_reach_the_threshold_are_met(spark, monkeypatch):
    for name, n in (("BUCKET", 16), ("SHARD", 1), ("QUERIES", 4)):
        monkeypatch.setattr(K, name, n)
    pairs, met = [], K.met
    monkeypatch.setattr(K, "met", lambda *a: pairs.append((out := met(*a)).count()) or out)
    rng = random.Random(16)
    rows = [(i, [float(np.float32((0.5 + rng.random()) * 1.15 ** -(i // 16))) for _ in range(4)]) for i in range(480)]
    assert run(spark, rows) == brute(rows, 5, 5)
    assert len(pairs) == 2 and pairs[1] < 24 * 29 // 4


def test_other_columns_and_64_bits(spark):
    rows = [(0, [1e30, 1.0]), (5, [1e30, -1e30]), (6, [-1e30, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS v", "3 AS NORM", "4 AS dim", "5 AS shard", "6 AS query_id")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in K.top_k(df, lambda c: c % 5 == 0).orderBy("query_id", "rank").collect()]
    top = (1 << 63) - 1
    big = lambda x: max(-(1 << 63), min(top, math.floor(256 * x)))
    want = []
    for q in (0, 5):
        own = dict(rows)[q]
        scored = sorted((-max(-(1 << 63), min(top, sum(big(a) * big(b) for a, b in zip(own, v, strict=True)))), i) for i, v in rows if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == want
