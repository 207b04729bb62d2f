"""Versioned stores: whole versions or none, batches once, deletes, the gate, streams that crash."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.sources.store import Conflict, Store

SCHEMA = "namespace string, id long, value string, at long"


def made(spark, path, **more):
    return Store(spark, str(path), spark.createDataFrame([], SCHEMA).schema, ["namespace", "id"], ["at"], 4, **more)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_upserts_keep_the_latest_row(spark, tmp_path):
    s = made(spark, tmp_path / "t")
    assert s.read().count() == 0 and s.versions() == []
    assert s.upsert(frame(spark, ("a", 1, "x", 5), ("a", 2, "y", 5), (None, 3, "n", 1))) == 1
    assert s.upsert(frame(spark, ("a", 1, "late", 4), ("a", 2, "same", 5), ("b", 1, "new", 9))) == 2
    assert rows_of(s.read().na.fill("-")) == [("-", 3, "n", 1), ("a", 1, "x", 5), ("a", 2, "same", 5), ("b", 1, "new", 9)]
    assert s.read(1).count() == 3  # an earlier version is still whole
    assert s.delete(F.col("namespace") == "a") == (3, 2)
    assert s.delete(F.col("namespace") == "zzz") == (None, 0)
    assert rows_of(s.read().na.fill("-")) == [("-", 3, "n", 1), ("b", 1, "new", 9)]
    assert s.vacuum() >= 1 and s.versions() == [3] and s.read().count() == 2


def test_a_crash_before_the_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    s = made(spark, tmp_path / "t")
    s.upsert(frame(spark, ("a", 1, "old", 1)))

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", dies)
        with pytest.raises(OSError, match="lost"):
            s.upsert(frame(spark, ("a", 1, "new", 2)), "s", 0)
    assert s.manifest().version == 1 and rows_of(s.read()) == [("a", 1, "old", 1)]
    assert s.upsert(frame(spark, ("a", 1, "new", 2)), "s", 0) == 2 and s.vacuum() == 2
    assert rows_of(s.read()) == [("a", 1, "new", 2)]


def test_two_writers_of_one_version(spark, tmp_path):
    s = made(spark, tmp_path / "t")
    old = s.manifest()
    s.upsert(frame(spark, ("a", 1, "first", 1)))
    with pytest.raises(Conflict):
        s._commit(old, frame(spark, ("a", 2, "second", 1)), [0, 1, 2, 3], None, 0)
    assert rows_of(s.read()) == [("a", 1, "first", 1)]


def test_batches_count_once_and_the_gate_holds(spark, tmp_path):
    s = made(spark, tmp_path / "t")
    assert s.upsert(frame(spark, ("a", 1, "x", 1)), "s", 0) == 1
    assert s.upsert(frame(spark, ("a", 1, "again", 2)), "s", 0) is None
    assert s.upsert(frame(spark, ("a", 1, "other", 2)), "t", 0) == 2
    shut = made(spark, tmp_path / "u", keep=False)
    assert shut.upsert(frame(spark, ("a", 1, "x", 1))) is None and shut.read().count() == 0 and not (tmp_path / "u").exists()


def test_a_stream_that_fails_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    for k in range(4):
        frame(spark, *((("a", "b")[i % 2], i, f"v{k}", k) for i in range(k, k + 6))).coalesce(1).write.mode("append").parquet(str(source))
    s = made(spark, tmp_path / "t")
    write, calls = Store.upsert, []

    def fails_once(self, rows, stream=None, batch=0):
        done = write(self, rows, stream, batch)  # committed, but the stream doesn't hear of it
        calls.append((batch, done))
        if len(calls) == 2:
            raise OSError("lost")
        return done

    monkeypatch.setattr(Store, "upsert", fails_once)

    def go():
        live = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        q = live.writeStream.foreachBatch(s.sink("q")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    with pytest.raises(Exception, match="lost"):
        go()
    go()
    assert [d for _, d in calls] == [1, 2, None, 3, 4] and [b for b, _ in calls] == [0, 1, 1, 2, 3]
    want = {}
    for r in spark.read.parquet(str(source)).orderBy("at").collect():
        want[r.namespace, r.id] = tuple(r)
    assert rows_of(s.read()) == sorted(want.values())
