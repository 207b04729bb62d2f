from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from lodestone.llm import mixing as M


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by the contract's words: give by weight, stop at the cap, share the excess again."""
    w = {s: weights[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    free, left, out = set(sizes), share * sum(sizes.values()), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def rows_of(documents, spec):
    out, i = [], 0
    for source, docs in spec.items():
        for n in docs:
            out.append((i, " ".join(["word"] * n), "en", source))
            i += 1
    return documents(out)


SPEC = {"a": [10] * 30, "b": [7, 500, 60] * 20, None: [40] * 15, "c": [3] * 5, "empty": [0, 0], "é": [100] * 12}


def test_targets_and_budgets(spark, documents, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 7)  # many buckets a source
    rows = M.mix(rows_of(documents, SPEC)).collect()
    sizes = {s: sum(d) for s, d in SPEC.items()}
    want = brute_targets(sizes)
    got = defaultdict(list)
    for r in rows:
        got[r.source].append(r)
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-5 and 0 <= r.taken <= 2 * r.size
    assert len(rows) == sum(map(len, SPEC.values()))
    for s, rs in got.items():
        assert abs(sum(r.taken for r in rs) - want[s]) <= 1
        epochs = min((r.taken // r.size for r in rs if r.size), default=0)
        assert epochs == (math.floor(want[s] / sizes[s]) if sizes[s] else 0) or all(r.taken == 2 * r.size for r in rs)


def test_order_of_keys_decides(spark, documents, monkeypatch):
    docs = rows_of(documents, {"a": [10] * 200, "b": [10] * 50})
    whole = {r.doc_id: r.taken for r in M.mix(docs).collect()}
    monkeypatch.setattr(M, "BUCKET", 3)
    assert {r.doc_id: r.taken for r in M.mix(docs).collect()} == whole  # the buckets only spread the work
    keys = docs.select("doc_id", "source", M.exponential(F.col("doc_id"), F.col("source"), M.quality(F.col("text"), F.lit(10))).alias("k")).collect()
    for s in "ab":
        own = sorted((r.k, whole[r.doc_id]) for r in keys if r.source == s)
        assert [t for _, t in own] == sorted((t for _, t in own), reverse=True)


def test_buckets_are_even_in_every_source(spark, documents):
    """A rare source of light documents beside a large one of heavy ones, and documents without ids."""
    light = [(i, "w " * (1 + i % 3), "en", "rare") for i in range(1500)]
    heavy = [(10_000 + i, "w " * 80, "en", "large") for i in range(6000)]
    unnamed = [(None, f"w{i} " * (20 + i % 60), "en", "unnamed") for i in range(1500)]
    sizes = [r["count"] for r in M.bucketed(documents(light + heavy + unnamed), bucket=50).groupBy("group", "bucket").count().collect()]
    assert sum(sizes) == 9000 and max(sizes) < 4 * 50 and len(sizes) > 0.7 * 9000 / 50


def test_weights_tilt_the_draw(spark, documents):
    docs = documents([(i, " ".join(["word"] * (10 if i % 2 else 50)), "en", "a") for i in range(600)] + [(1000 + i, "x " * 200, "en", "b") for i in range(400)])
    taken = M.mix(docs).filter("source = 'a'").collect()
    rate = lambda rs: sum(r.taken > r.size * (rs[0].target // rs[0].source_size) for r in rs) / len(rs)
    assert rate([r for r in taken if r.size == 50]) >= rate([r for r in taken if r.size == 10])


def test_the_mix_itself(spark, documents):
    docs = rows_of(documents, SPEC)
    taken = M.cut(M.mix(docs))
    out = M.take(docs, taken)
    assert out.columns == docs.columns
    words = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != ""))).alias("n")).collect()}
    assert words == {r.doc_id: r.taken for r in taken.collect() if r.taken}


def test_awkward_rows(spark, documents, awkward):
    docs = documents(awkward).selectExpr("*", "1 AS size", "2 AS key", "3 AS bucket", "4 AS target", "5 AS _one", "6 AS _ident", "7 AS _words", "8 AS `_group`")
    taken = M.cut(M.mix(docs))
    rows = taken.collect()
    assert len(rows) == len(awkward) and all(r.taken <= 2 * r.size for r in rows)
    out = M.take(docs, taken)
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in out.collect()) == sum(r.taken for r in rows) and out.columns == docs.columns
    assert M.mix(docs.limit(0)).count() == 0


def test_repeated_rows_spread_over_buckets_and_share_one_text(spark, documents):
    """A third of all rows is one row; the mix takes from it what its source's words allow, and gives its text that often."""
    rows = [(i, f"own words of text {i}", "en", "s1") for i in range(6_000)] + [(7, "the same row again and again", "en", "s1")] * 3_000
    docs = documents(rows)
    sizes = [r["count"] for r in M.bucketed(docs, bucket=100).groupBy("bucket").count().collect()]
    assert sum(sizes) == 9_000 and max(sizes) < 300
    taken = M.mix(docs, bucket=100)
    assert taken.count() == 9_000
    words = taken.groupBy().sum("taken").first()[0]
    given = M.take(docs, taken).select(F.sum(F.regexp_count("text", F.lit(r"[^ ]+")))).first()[0]
    target = taken.first().target
    assert words == given and abs(words - target) <= 2 * 6
