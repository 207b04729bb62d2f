from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from lodestone.llm import simhash as S


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_groups(prints, distance=2):
    """prints: (id, fingerprint); the smallest id that links reach, by loops."""
    top = {i: i for i, _ in prints}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if bin(a ^ b).count("1") <= distance:
                a1, b1 = root(i), root(j)
                top[max(a1, b1)] = min(a1, b1)
    return {i: root(i) for i, _ in prints}


def test_fingerprints(spark, sf_dir, awkward):
    for t in ["", "One", "one TWO", "a b c", "a  b\tc\nd", "É é x y", *(r[1] for r in awkward if r[1] is None or len(r[1]) < 1000)]:
        assert S.simhash(t) == brute_print(t)
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect():
        assert S.simhash(r.text) == brute_print(r.text)


def prints(spark, rows):
    return S.cut(spark.createDataFrame([(S.signed(f), i) for i, f in rows], "fp long, node long"))


@pytest.mark.parametrize("bucket", [4096, 4])
def test_links_against_loops(spark, bucket):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    seen = dict.fromkeys(base)
    for b in base[:12]:
        x = b
        for _ in range(25):  # chains and balls around a fingerprint
            x = (x if rng.random() < 0.5 else b) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            seen[x] = None
    rows = list(enumerate(seen))
    fps = prints(spark, rows)
    n, both = S.bit_moments(fps)
    assert n == len(rows) and both[0, 0] == sum(f & 1 for _, f in rows)
    got = {r.node: r.component for r in S.components(S.links(fps, S.plan(n, both), bucket=bucket)).collect()}
    want = brute_groups(rows)
    assert {i: got.get(i, i) for i, _ in rows} == want


@pytest.mark.parametrize("parts", [[(list(range(32)), 1), (list(range(32, 64)), 0)], [(list(range(64)), 2)], [(list(range(0, 64, 2)), 0), (list(range(1, 64, 2)), 1)]])
def test_unequal_thresholds_lose_nothing(spark, parts):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(8)]
    rows = list(enumerate(dict.fromkeys([*base, *(b ^ (1 << i) ^ (1 << j) for b in base for i, j in [(rng.randrange(64), rng.randrange(64)) for _ in range(6)])])))
    got = {r.node: r.component for r in S.components(S.links(prints(spark, rows), parts)).collect()}
    assert {i: got.get(i, i) for i, _ in rows} == brute_groups(rows)


def test_allocation():
    cost, ts = S.allocate([[0, 5, 9, 30], [0, 1, 2, 3], [0, 5, 9, 30]], 0)
    assert sum(ts) == 0 and (cost, ts) == (3.0, [-1, 2, -1])
    rng = np.random.default_rng(1)
    for _ in range(20):
        c = np.sort(rng.random((3, 4)), axis=1)
        c[:, 0] = 0
        best = min(c[0, a + 1] + c[1, b + 1] + c[2, d + 1] for a in range(-1, 3) for b in range(-1, 3) for d in range(-1, 3) if a + b + d == 0)
        assert abs(S.allocate(c.tolist(), 0)[0] - best) < 1e-12


def test_groups_put_what_goes_together():
    both = np.full((64, 64), 250.0)
    for a, b in ((0, 40), (1, 50)):
        both[a, b] = both[b, a] = 500
    np.fill_diagonal(both, 500)
    for g in S.group_bits(1000, both, 3):
        assert (0 in g) == (40 in g) and (1 in g) == (50 in g)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 105), (105, 103), (200, 201)]
    got = {r.node: r.component for r in S.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 0), 103: 100, 105: 100, 201: 200}
    assert S.components(spark.createDataFrame(chain, "a long, b long").limit(0)).count() == 0


def test_awkward_rows(spark, documents, awkward):
    docs = documents(awkward).selectExpr("*", "1 AS fp", "2 AS node", "3 AS component_id", "4 AS _id", "5 AS _K")
    rows = S.near_duplicates(docs).collect()
    assert len(rows) == len(awkward)
    group = {r.doc_id: r.component_id for r in rows}
    assert group[1] == group[2] == group[3] == 1  # texts without words have fingerprint 0
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}  # all rows of an id are one document
    assert {r.component_id for r in rows if r.doc_id is None} == {1, None}
    kept = S.keep_first(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 4, 6, 7, 8] and sum(r.doc_id is None for r in kept) == 1
    assert S.near_duplicates(docs.limit(0)).count() == 0 and S.keep_first(docs.limit(0)).count() == 0


def test_ids_of_any_size(spark, documents):
    ids = [(1 << 61) - 1, 1 << 61, (1 << 62) - 1, (1 << 62) + 5, (1 << 62) + 9, (1 << 63) - 1, -(1 << 63), -7, 3]
    rows = [(i, f"text {k} of words {k * k} that stand alone {k}") for k, i in enumerate(ids)] + [((1 << 62) + 7, "text 4 of words 16 that stand alone 4"), (None, "words without an id"), (None, "text 8 of words 64 that stand alone 8")]
    got = S.near_duplicates(documents(rows)).collect()
    prints = dict(zip([r[0] if r[0] is not None else ("none", k) for k, r in enumerate(rows)], [brute_print(t) for _, t in rows], strict=True))
    for r in got:
        linked = [i for i, f in prints.items() if bin(f ^ (r.fp & (1 << 64) - 1)).count("1") <= 2 and not isinstance(i, tuple)]
        assert r.component_id == min(linked, default=None)
    assert len(got) == len(rows) and len(S.keep_first(documents(rows)).collect()) == len(ids) + 1


def test_hot_buckets_and_stars_are_salted(spark, monkeypatch):
    from lodestone.llm.common import lookup_join

    monkeypatch.setattr(S, "lookup_join", lambda *a, **k: lookup_join(*a, **(k | {"least": 3})))
    star = [(i, 0) for i in range(1, 60)] + [(70 + i, 69) for i in range(20)]
    got = {r.node: r.component for r in S.components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 60), 0), **dict.fromkeys(range(70, 90), 69)}
    rng = random.Random(2)
    base = rng.getrandbits(64)
    rows = list(enumerate(dict.fromkeys([base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(80)] + [rng.getrandbits(64) for _ in range(40)])))
    fps = prints(spark, rows)
    n, both = S.bit_moments(fps)
    got = {r.node: r.component for r in S.components(S.links(fps, S.plan(n, both), bucket=8)).collect()}
    assert {i: got.get(i, i) for i, _ in rows} == brute_groups(rows)


def test_whole_table(spark, sf_dir):
    rows = S.op7_simhash_near_dedup(spark, sf_dir).collect()
    want = brute_groups([(r.doc_id, int(r.fingerprint, 16)) for r in rows])
    assert all(r.component_id == want[r.doc_id] for r in rows)
