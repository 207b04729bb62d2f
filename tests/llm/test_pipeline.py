"""The pipeline against its stages done by loops, and its promises stage by stage."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline as C
from lodestone.llm import mixing, packing
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_similar import brute as brute_copies


def test_stages(spark, documents, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing", "packing"]
    for k, (_, stage) in enumerate(C.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        columns = docs.columns
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        rows, docs = None, spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
            rows = docs.collect()
            after = {r.doc_id: r.text for r in rows}
            assert all(r.n_chars == len(r.text) for r in rows)
        if k == 0:
            assert set(before) - set(after) == {i for i, t in before.items() if not any(c.isalpha() for c in t)}
        elif k == 1:
            assert after == brute_lines(list(before.items()))
        elif k == 2:
            assert set(after) == brute_copies(list(before.items()))
        elif k == 3:
            counts = defaultdict(int)
            for r in rows:
                counts[r.doc_id] += len(r.text.split())
            taken = {r.doc_id: r.taken for r in mixing.mix(spark.read.parquet(str(tmp_path / "2"))).collect() if r.taken}
            assert counts == taken
        else:
            ids = defaultdict(int)
            for r in docs.collect():
                ids[r.doc_id] += r.length
            assert set(ids) == set(after)
            assert set(docs.columns) == {f.split()[0] for f in packing.SCHEMA.split(", ")}


def test_run(spark, sf_dir):
    rows = C.run(spark, sf_dir).collect()
    whole = defaultdict(int)
    for r in rows:
        whole[r.sequence_id] += r.length
    assert rows and all(n == 4096 or n & (n - 1) == 0 for n in whole.values())


def test_awkward_rows(spark, documents, awkward, sf_dir):
    docs = documents(awkward).selectExpr("*", "1 AS score", "2 AS n_lines", "3 AS _id", "4 AS size")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for _, stage in C.STAGES:
            now = spark.createDataFrame((out := stage(spark, now, sf_dir)).collect(), out.schema)
        assert (now.count() == 0) == empty
