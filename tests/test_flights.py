"""Shared work in flight and swept stores, as tables and as streams; conflicts of any size: all against loops."""

from __future__ import annotations

import datetime as dt
import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from lodestone.operators import evidence as V
from lodestone.sources.store import Store
from lodestone.streaming import state as Z

START = dt.datetime(2024, 1, 1)
REQUESTS = "key string, id long, at timestamp, ended timestamp"


def requests(seed, n=300):
    r = random.Random(seed)
    moments = [START + dt.timedelta(seconds=r.randrange(0, 1_000) / 2) for _ in range(n)]  # many of them equal
    return [("hot" if i % 3 else r.choice(("a", "b", None)), i, t, r.choice((None, t, t + dt.timedelta(seconds=3), t + dt.timedelta(seconds=40), t - dt.timedelta(seconds=9)))) for i, t in enumerate(moments)]


def leaders(rows):
    """Each key's work: who began the last one and when it ends."""
    busy, out = {}, {}
    for key, i, at, ended in sorted(rows, key=lambda r: (r[2], r[1])):
        leader, until = busy.get(key, (None, None))
        if leader is None or at >= until:
            busy[key] = leader, until = i, max(at, ended or at)
        out[i] = leader
    return out


def test_flights_against_the_loop(spark):
    for seed in (1, 2):
        rows = requests(seed)
        df = spark.createDataFrame(rows, REQUESTS).withColumn("extra", F.lit("x"))
        got = Z.in_flight(df, ["key"], "id", "at", "ended")
        assert got.columns == [*df.columns, "leader"]
        assert {r.id: r.leader for r in got.collect()} == leaders(rows)
    assert Z.in_flight(df.limit(0), ["key"], "id", "at", "ended").count() == 0


def test_flights_of_a_stream_are_the_table(spark, tmp_path):
    rows = sorted((r for r in requests(3, 150) if r[0]), key=lambda r: (r[2], r[1]))
    (tmp_path / "in").mkdir()
    for k in range(3):
        spark.createDataFrame(rows[len(rows) * k // 3 : len(rows) * (k + 1) // 3], REQUESTS).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{k}.parquet")
        time.sleep(0.05)  # files are read in the order of their times
    live = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = Z.in_flight_stream(live, "key").writeStream.format("memory").queryName("flights").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert {r.id: r.leader for r in spark.sql("SELECT * FROM flights").collect()} == leaders(rows)


ENTRIES = "key long, value string, created_at timestamp_ntz, expires_at timestamp_ntz"


def entry(key, value, created, lives):
    return key, value, START + dt.timedelta(hours=created), START + dt.timedelta(hours=created + lives)


def _swept(spark, tmp_path, rows, moments, days, until):
    """What the store holds once `until` is true of it; the clock shows the next of `moments` at each trigger, at last the last one."""
    store, shown = Store(spark, str(tmp_path / "t"), spark.createDataFrame([], ENTRIES).schema, ["key"], ["created_at"], 4), list(moments)
    spark.createDataFrame(rows, ENTRIES).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = Z.retained_stream(spark.readStream.schema(ENTRIES).parquet(str(tmp_path / "in")), store, str(tmp_path / "c"), lambda: shown.pop(0) if len(shown) > 1 else shown[0], days, "1 second")
    held = None
    try:
        for _ in range(120):
            time.sleep(0.5)
            assert q.exception() is None
            if store.versions() and until(held := {r["key"]: r["value"] for r in store.read().collect()}) and len(shown) == 1:
                break
    finally:
        q.stop()
    return held


def test_retention_sweeps_without_new_entries(spark, tmp_path):
    rows = [entry(1, "short", 0, 1), entry(2, "long", 0, 900), entry(3, "old", 0, 2), entry(3, "renewed", 2, 900), entry(4, "none", 0, 0)]
    hours = lambda h: START + dt.timedelta(hours=h)
    assert _swept(spark, tmp_path / "a", rows, [hours(0), hours(0), hours(5)], 7, lambda h: 1 not in h and 3 in h) == {2: "long", 3: "renewed"}
    # A week on, what was made at the cutoff is gone whenever it expires.
    assert _swept(spark, tmp_path / "b", rows, [hours(0), hours(7 * 24)], 7, lambda h: 2 not in h) == {3: "renewed"}


def stated(text):
    import re

    topic = " ".join(re.findall(r"[a-z][a-z0-9_-]{2,}", text.lower())[:4])
    return [(topic, (u or "").lower(), n) for n, u in re.findall(V.VALUE, text)]


def test_conflicts_of_any_size(spark):
    r = random.Random(4)
    texts = [f"Product speed result stands at {r.randrange(3)} ms" if i % 2 else f"Topic word number n{i % 40} is {r.randrange(2)}.5 % or {i % 3} ms" for i in range(600)]
    texts += ["Alone here stands one 5 ms and 6 ms", "Same value given twice 7 ms", "Same value given twice 7 ms", "", None, "no number"]
    df = spark.createDataFrame([("q" if i % 3 else None, i, t) for i, t in enumerate(texts)], "q string, pos int, text string").withColumn("evidence_id", F.col("pos"))
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        for topic, unit, number in stated(t or ""):
            groups["q" if i % 3 else None, topic, unit].append((number, i))
    groups = {g: v for g, v in groups.items() if len({n for n, _ in v}) > 1 and len({i for _, i in v}) > 1}
    want = {(*g, n): (len({i for m, i in v if m == n}), min(i for m, i in v if m == n)) for g, v in groups.items() for n, _ in v}
    got = V.conflicting_values(df, ["q"]).collect()
    assert {(x.q, x.topic, x.unit, x.number): (x["records"], x["first"]) for x in got} == want and len(got) == len(want) > 20
    # With a limit the first ones come, and they are what the whole list says of them.
    every = {(x.q, x.topic, x.unit): (x.evidence_ids, x.description) for x in V.contradictions(df, ["q"], limit=None).collect()}
    some = {(x.q, x.topic, x.unit): (x.evidence_ids, x.description) for x in V.contradictions(df, ["q"], limit=5).collect()}
    assert set(every) == set(groups)
    firsts = lambda q: sorted((g for g in groups if g[0] == q), key=lambda g: min(i for _, i in groups[g]))[:5]
    assert len(some) == 10 and all(every[g] == v for g, v in some.items())
    assert {min(i for _, i in groups[g]) for g in some if g[0] == "q"} == {min(i for _, i in groups[g]) for g in firsts("q")}
