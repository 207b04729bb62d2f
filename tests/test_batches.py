"""What Python holds at once is bounded, however many or long the rows of Spark's batches."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import api, registry
from lodestone.operators import near as N
from lodestone.operators import response as Q
from lodestone.plans import batches as B
from lodestone.sources import pages as G

TEXT = "One sentence stands here. Another follows it, about things.\n" * 10


def test_pieces():
    rows = pa.RecordBatch.from_pydict({"i": range(5_003), "t": ["x" * (3 * B.BYTES if i == 17 else 2_000 if i > 4_000 else 1) for i in range(5_003)]})
    got = list(B.pieces(rows))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([rows]))
    assert all(p.num_rows <= B.ROWS and (p.nbytes <= 2 * B.BYTES or p.num_rows == 1) for p in got)


def _given(spark, name, sf_dir):
    texts = spark.createDataFrame([(1, TEXT)], "id long, text string")
    if name == "chunk":
        return G.chunk(texts, "id"), {"id": pa.int64(), "text": pa.string()}
    if name == "read":
        return api.G.read(texts, "id", "text"), {"id": pa.int64(), "html": pa.string()}
    if name == "extract_text":
        return G.extract_text(texts, "id", "text"), {"id": pa.int64(), "html": pa.string(), "kind": pa.string()}
    if name == "grams":
        return N._grams(texts.selectExpr("id AS cell", "id", "0 AS kind", "text")), {"cell": pa.int64(), "id": pa.int64(), "kind": pa.int32(), "text": pa.string()}
    return registry.queries()["read_responses"](spark, sf_dir), {"doc_id": pa.int64(), "text": pa.string()}


@pytest.mark.parametrize("name", ["chunk", "read", "extract_text", "grams", "read_responses"])
def test_a_large_batch_is_worked_off_in_pieces(spark, sf_dir, monkeypatch, name):
    caught, kind = [], type(spark.range(0))
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **k: caught.append(f) or self)
    _, fields = _given(spark, name, sf_dir)
    value = {pa.int64(): 7, pa.int32(): 0, pa.string(): TEXT}
    batch = pa.RecordBatch.from_arrays([pa.array(["text/html" if c == "kind" and t == pa.string() else i if t == pa.int64() else value[t] for i in range(3_000)], t) for c, t in fields.items()], list(fields))
    out = caught[0](iter([batch]))
    first = next(out)
    assert 0 < len(set(first.column(1 if name == "grams" else 0).to_pylist())) <= B.BYTES // len(TEXT)
    seen = pa.Table.from_batches([first, *out])
    assert set(seen.column(1 if name == "grams" else 0).to_pylist()) == set(range(3_000))


def test_what_travels_to_scalar_functions_is_bounded_unless_the_session_says_so(spark):
    for k, (own, v) in B.BATCH.items():
        spark.conf.set(k, own)
        Q.extracts(spark.createDataFrame([(TEXT,)], "text string"), "text", F.lit("q"), 100)
        assert spark.conf.get(k) == v
        spark.conf.set(k, "77")
        N.near_results(spark.createDataFrame([], "q int, pos long, url string, canonical_url string, domain string, title string, snippet string, engines array<string>, search_score double"), ["q"])
        assert spark.conf.get(k) == "77"
        spark.conf.unset(k)


def test_pages_are_read_as_extracted_and_chunked(spark):
    html = "<body><p>" + "</p><p>".join(f"Part {i} of a page. " * 30 for i in range(9)) + "</p></body>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>short</p>"), (4, html.replace("<p>", "<h2>Head</h2><p>"))], "id long, html string")
    old = G.chunk(G.extract_text(pages, "id").filter("not failed").select("id", "text"), "id")
    assert sorted(G.read(pages, "id").collect()) == sorted(old.collect()) and old.count() > 4
