"""Suppressed searches and cache lookups, as tables and as streams, against loops."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from lodestone.streaming import state as Z

START = dt.datetime(2024, 1, 1)
CALLS = "caller string, id long, at timestamp, ended timestamp, completed boolean"


def calls(seed, n=400):
    r = random.Random(seed)
    out = []
    for i in range(n):
        at = START + dt.timedelta(seconds=r.randrange(0, 3_000) / 2)
        out.append(("hot" if i % 3 else f"c{r.randrange(5)}", i, at, None if i % 50 == 0 else at + dt.timedelta(seconds=r.choice((0, 1, 4, 20))), None if i % 31 == 0 else r.random() < 0.6))
    return out


def claims(rows, seconds):
    """One caller's flags over time: a search that runs, and when the last one was completed."""
    active, will, done, out = None, False, None, {}
    for _, i, at, ended, completed in sorted(rows, key=lambda r: (r[2], r[1])):
        if active is not None and at >= active:
            if will:
                done = active
            active = None
        if active is not None:
            out[i] = "active"
        elif done is not None and (at - done).total_seconds() < seconds:
            out[i] = "completed"
        else:
            out[i], active, will = None, ended or at, bool(completed)
    return out


def wanted(rows, seconds):
    return {k: v for c in {r[0] for r in rows} for k, v in claims([r for r in rows if r[0] == c], seconds).items()}


def test_suppressed_against_the_loop(spark):
    for seed, seconds in ((1, 5), (2, 0), (3, 60)):
        rows = calls(seed)
        got = Z.suppressed(spark.createDataFrame(rows, CALLS), ["caller"], "at", "ended", "completed", seconds, "id").collect()
        assert {r.id: r.reason for r in got} == wanted(rows, seconds)
        assert all(r.accepted == (r.reason is None) for r in got)


def test_suppressed_stream_is_the_table(spark, tmp_path):
    rows = sorted(calls(5, 150), key=lambda r: r[2])
    for k in range(3):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], CALLS).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            f.rename(tmp_path / "in" / f"{k}.parquet")
    live = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = Z.suppressed_stream(live, "caller", 5).writeStream.format("memory").queryName("searches").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert {r.id: r.reason for r in spark.sql("SELECT * FROM searches").collect()} == wanted(rows, 5)


def test_lookups_against_a_loop(spark):
    r = random.Random(7)
    moment = lambda: START + dt.timedelta(seconds=r.randrange(0, 40_000))
    key = lambda: r.choice((None, "hot", "hot", "hot", "a", "b", "rare"))
    entries = [(key(), i, t := moment(), t + dt.timedelta(seconds=r.choice((0, 60, 5_000)))) for i in range(300)]
    entries += [(k, 1_000 + i, t, e) for k, i, t, e in entries[:60]]  # of one moment the largest id counts
    requests = [(key(), i, entries[i][2] if i % 7 == 0 else moment(), "x") for i in range(300)]
    e = spark.createDataFrame(entries, "key string, entry_id long, created timestamp, expires timestamp")
    q = spark.createDataFrame(requests, "key string, id long, at timestamp, entry_id string")
    for seconds in (100, 5_000, 10_000_000):
        got = {x.id: (x.entry and x.entry.entry_id, x.found) for x in Z.lookups(q, e, ["key"], "at", "created", "expires", "entry_id", seconds).withColumnRenamed("entry_id", "other").collect()}
        for k, i, at, _ in requests:
            held = max(((c, n, x) for kk, n, c, x in entries if k is not None and kk == k and c <= at), default=None)
            assert got[i] == ((None, "miss") if held is None else (held[1], "hit" if held[2] > at else "expired"))
    assert Z.lookups(q, e.limit(0), ["key"], "at", "created", "expires", "entry_id").filter(F.col("found") != "miss").count() == 0
