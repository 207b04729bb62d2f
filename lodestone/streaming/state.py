"""State that ages: caches, retention, circuit breakers, suppression; in batch form and as streams."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Minutes that entries live, by namespace; other namespaces live for the retention's days.
LIFETIMES = {"search": 30, "failures": 5, "robots": 360}
TRANSIENT = (408, 425, 429, 500, 502, 503, 504)
FAILURES, OPEN_SECONDS, COOLDOWN = 3, 60, 5
#: Why a search is suppressed.
ACTIVE, COMPLETED = "active", "completed"


def lifetime(namespace: Column, retention_days: int = 7) -> Column:
    """Seconds that an entry of the namespace lives."""
    out = F.lit(retention_days * 86400)
    for name, minutes in LIFETIMES.items():
        out = F.when(namespace == name, F.lit(minutes * 60)).otherwise(out)
    return out


def live(entries: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Entries that a lookup at `now` finds; one that expires at that moment is gone."""
    return entries.filter(F.col(expires) > now)


def cacheable(entries: DataFrame, empty: Column, sensitive: Column) -> DataFrame:
    """What may be written: no empty searches and nothing of sensitive URLs."""
    return entries.filter(~F.coalesce(empty, F.lit(False)) & ~F.coalesce(sensitive, F.lit(False)))


def sweep(cache: DataFrame, requests: DataFrame, evidence: DataFrame, passages: DataFrame, now: Column, retention_days: int) -> dict[str, DataFrame]:
    """The four tables after a retention sweep; with no retention nothing is left, and nothing is to be written.

    Entries go when expired or older than the cutoff, requests at the cutoff, evidence when expired, passages with their evidence.
    """
    if retention_days <= 0:
        return {"cache": cache.limit(0), "requests": requests.limit(0), "evidence": evidence.limit(0), "passages": passages.limit(0)}
    cutoff = now - F.make_dt_interval(days=F.lit(retention_days))
    kept = evidence.filter(F.col("expires_at") > now)
    return {
        "cache": cache.filter((F.col("expires_at") > now) & (F.col("created_at") > cutoff)), "requests": requests.filter(F.col("created_at") > cutoff),
        "evidence": kept, "passages": passages.join(kept.select("record_id"), "record_id", "left_semi"),
    }


def folded(rows: DataFrame, by: Sequence[str], order: Sequence[str], start: Callable[[], Any], step: Callable[[Any, tuple], Any], read: Sequence[str], name: str, kind: str = "boolean") -> DataFrame:
    """rows with `name` of type `kind` (boolean, string or bigint): what `step` says of each row's `read` columns, given the state that the rows before it in its group left.

    One shuffle by group and an external sort; the fold itself holds one state and one batch, however long a group is.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for b in batches:
            out = []
            keys, seen = zip(*(b.column(names.index(c)).to_pylist() for c in by), strict=True), zip(*(b.column(names.index(c)).to_pylist() for c in read), strict=True)
            for key, x in zip(keys, seen, strict=True):
                if key != last:
                    last, state = key, start()
                out.append(step(state, x))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, {"boolean": pa.bool_(), "string": pa.string(), "bigint": pa.int64()}[kind])], [*names, name])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, f"{schema}, `{name}` {kind}")


class Searches:
    """A caller's searches: when the one that runs ends, and when one was last completed (microseconds)."""

    def __init__(self, until: int | None = None, running: bool = False, completed: int | None = None):
        self.until, self.running, self.completed = until, running, completed

    def claim(self, at: int, until: int, completes: bool, cooldown: int) -> str | None:
        """Why a search at that time is suppressed; null if it runs. A search that ends at that moment, or was completed a whole cooldown ago, is no hindrance."""
        if self.until is not None and at >= self.until:
            if self.running:  # whether it is completed is known by now
                self.completed = self.until
            self.until, self.running = None, False
        if self.until is not None:
            return ACTIVE
        if self.completed is not None and at - self.completed < cooldown:
            return COMPLETED
        self.until, self.running = max(at, until), completes
        return None


def suppressed(calls: DataFrame, by: Sequence[str], at: str, ended: str, completed: str, seconds: int = COOLDOWN, order: str | None = None) -> DataFrame:
    """calls with `accepted` and `reason`: a caller's search is suppressed while one of theirs runs ("active") and for `seconds` after one was completed ("completed").

    ended: when the search would end if it ran; completed: whether it would then have a result. Only searches that ran count, and of those only completed ones start the
    pause. Null ends or outcomes count as at once and not completed. A chain over accepted calls, folded in order of time, then `order`; a caller's state is one record.
    """
    rows = calls.withColumns({"_e": F.unix_micros(F.col(at).cast("timestamp")), "_u": F.unix_micros(F.coalesce(ended, at).cast("timestamp")), "_c": F.coalesce(F.col(completed), F.lit(False))})
    out = folded(rows, by, ["_e", order or at], Searches, lambda s, x: s.claim(x[0], x[1], x[2], seconds * 1_000_000), ["_e", "_u", "_c"], "reason", "string").drop("_e", "_u", "_c")
    return out.withColumn("accepted", F.col("reason").isNull())


def suppressed_stream(calls: DataFrame, by: str, seconds: int = COOLDOWN, lateness: str = "1 minute") -> DataFrame:
    """The same over a stream of calls (by, id, at, ended timestamps, completed): a caller's state goes once event time has passed its search's end and pause."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind, pause = dict(calls.dtypes)[by], seconds * 1_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = Searches(*(None if x == -1 else x for x in state.get)) if state.exists else Searches()
        s.running = bool(s.running)
        rows = pd.concat(list(batches)).sort_values(["at", "id"], kind="stable")
        moments = zip((rows["at"].astype("datetime64[us]").astype("int64")), (rows["ended"].fillna(rows["at"]).astype("datetime64[us]").astype("int64")), rows["completed"].fillna(False).astype(bool), strict=True)
        out = rows.assign(reason=[s.claim(a, u, c, pause) for a, u, c in moments])
        state.update((-1 if s.until is None else s.until, int(s.running), -1 if s.completed is None else s.completed))
        # State that a later call could still ask for stays; event time must pass it and the watermark's lateness.
        free = max(s.until or 0, s.completed or 0) + pause
        state.setTimeoutTimestamp(max(free // 1000, state.getCurrentWatermarkMs() + 1))
        yield out[[by, "id", "at", "reason"]]

    rows = calls.withWatermark("at", lateness).select(by, "id", "at", "ended", "completed")
    return rows.groupBy(by).applyInPandasWithState(run, f"`{by}` {kind}, id long, at timestamp, reason string", "until long, running int, completed long", "append", GroupStateTimeout.EventTimeTimeout)


class Flight:
    """One key's work in flight: which request began it and when it ends (microseconds)."""

    def __init__(self, leader: int | None = None, until: int | None = None):
        self.leader, self.until = leader, until

    def join(self, request: int, at: int, until: int) -> int:
        """The request whose result this one gets: the one in flight, else itself. Work that ends at that moment is over."""
        if self.until is None or at >= self.until:
            self.leader, self.until = request, max(at, until)
        return self.leader


def in_flight(requests: DataFrame, by: Sequence[str], request: str, at: str, ended: str) -> DataFrame:
    """requests with `leader`: the request (bigint) whose work a request shares, itself if it does its own.

    ended: when the work would end if this request began it; null ends at once. Of requests of one moment the smallest leads. A chain over
    leaders, folded in order of time: one shuffle by key, a record of state.
    """
    rows = requests.withColumns({"_e": F.unix_micros(F.col(at).cast("timestamp")), "_u": F.unix_micros(F.coalesce(ended, at).cast("timestamp")), "_r": F.col(request).cast("long")})
    return folded(rows, by, ["_e", "_r"], Flight, lambda s, x: s.join(*x), ["_r", "_e", "_u"], "leader", "bigint").drop("_e", "_u", "_r")


def in_flight_stream(requests: DataFrame, by: str, lateness: str = "1 minute") -> DataFrame:
    """The same over a stream of requests (by, id, at, ended timestamps): a key's state goes once event time has passed the end of its work."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = dict(requests.dtypes)[by]
    micros = lambda s: s.astype("datetime64[us]").astype("int64")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        f = Flight(*state.get) if state.exists else Flight()
        rows = pd.concat(list(batches)).sort_values(["at", "id"], kind="stable")
        out = rows.assign(leader=[f.join(i, a, u) for i, a, u in zip(rows["id"], micros(rows["at"]), micros(rows["ended"].fillna(rows["at"])), strict=True)])
        state.update((int(f.leader), int(f.until)))
        state.setTimeoutTimestamp(max(f.until // 1000, state.getCurrentWatermarkMs() + 1))
        yield out[[by, "id", "at", "leader"]]

    rows = requests.withWatermark("at", lateness).select(by, "id", "at", "ended")
    return rows.groupBy(by).applyInPandasWithState(run, f"`{by}` {kind}, id long, at timestamp, leader long", "leader long, until long", "append", GroupStateTimeout.EventTimeTimeout)


def retained_stream(entries: DataFrame, store: Any, folder: str, now: Callable[[], Any], retention_days: int = 7, every: str = "300 seconds") -> Any:
    """A running stream that writes entries to a store and, at every trigger, deletes what has expired or is as old as the retention.

    entries: the store's rows, with created_at and expires_at. A clock's ticks travel with them, so that triggers without an entry sweep as well, and one writer
    makes all versions. Entries are upserted first: one that was renewed stays. A batch that is sent again writes nothing twice. now: the moment
    of a trigger; no retention keeps nothing.
    """
    ticks = entries.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    ticks = ticks.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in entries.schema.fields), F.lit(True).alias("_tick"))

    def write(batch: DataFrame, n: int) -> None:
        rows = batch.filter("not _tick").drop("_tick")
        if retention_days > 0 and not rows.isEmpty():  # ticks alone make no version
            store.upsert(rows, folder, n)
        moment = F.lit(now()).cast("timestamp_ntz")
        old = F.col("created_at") <= moment - F.make_dt_interval(days=F.lit(retention_days))
        store.delete((F.col("expires_at") <= moment) | old if retention_days > 0 else F.lit(True))

    return entries.withColumn("_tick", F.lit(False)).unionByName(ticks).writeStream.foreachBatch(write).option("checkpointLocation", folder).trigger(processingTime=every).start()


def lookups(requests: DataFrame, entries: DataFrame, by: Sequence[str], at: str, created: str, expires: str, tie: str, seconds: int = 86_400) -> DataFrame:
    """requests with `entry` (the struct of entries' columns that a lookup finds, or null) and `found`: hit, expired or miss.

    The entry is the latest of the key at the request's moment, of equal moments that with the largest `tie`; one that expires at that moment has
    expired. Keys may be hot: rows meet by key and time slice of `seconds`, and what a slice starts with comes from the last
    entries of the slices before, a row per key and slice. Null keys find nothing.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    part = lambda t: F.floor(t / (seconds * 1_000_000))
    keys, held = list(by), F.struct(*(F.col(c) for c in entries.columns))
    e = entries.select(*keys, micros(created).alias("_t"), F.lit(0).alias("_kind"), F.col(tie).alias("_tie"), held.alias("_entry"), F.lit(None).cast(requests.schema).alias("_request"))
    r = requests.select(*keys, micros(at).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(dict(entries.dtypes)[tie]).alias("_tie"), F.lit(None).cast(entries.schema).alias("_entry"), F.struct(*(F.col(c) for c in requests.columns)).alias("_request"))
    both = e.unionByName(r).withColumn("_part", part(F.col("_t")))
    # What each slice ends with, then what each begins with: a row per key and slice.
    ends = both.groupBy(*keys, "_part").agg(F.max_by(F.when(F.col("_kind") == 0, F.col("_entry")), F.when(F.col("_kind") == 0, F.struct("_t", "_tie"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*keys, "_part", F.last("_last", ignorenulls=True).over(before).alias("_first"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_t", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_seen", F.last("_entry", ignorenulls=True).over(inside)).filter("_kind = 1")
    same = F.lit(True)
    for k in keys:
        same = same & seen[k].eqNullSafe(starts[k])
    met = seen.join(starts, same & (seen["_part"] == starts["_part"]), "left").select(seen["_request"], F.coalesce(seen["_seen"], starts["_first"]).alias("entry"), seen["_t"])
    named = F.lit(True)
    for k in keys:
        named = named & F.col(f"_request.{k}").isNotNull()
    met = met.withColumn("entry", F.when(named, F.col("entry")))
    stale = F.unix_micros(F.col(f"entry.{expires}").cast("timestamp")) <= F.col("_t")
    return met.select("_request.*", "entry", F.when(F.col("entry").isNull(), "miss").when(stale, "expired").otherwise("hit").alias("found"))


def paced(calls: DataFrame, by: Sequence[str], at: str, took: str, interval_ms: int, order: str) -> DataFrame:
    """calls with `waited` (microseconds): calls of a caller run one after another, each `interval_ms` after the one before has ended. took: milliseconds.

    A call starts at the latest of all moments at which the calls up to it, run without a pause, would let it: a running maximum, no fold.
    """
    w = Window.partitionBy(*by).orderBy("_e", order)
    rows = calls.withColumn("_e", F.unix_micros(F.col(at).cast("timestamp")))
    rows = rows.withColumn("_b", F.coalesce(F.sum((F.col(took) + interval_ms) * 1000).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.col("_b") + F.max(F.col("_e") - F.col("_b")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("waited", start - F.col("_e")).drop("_e", "_b")


def soon_after(calls: DataFrame, by: Sequence[str], at: str, seconds: int = COOLDOWN) -> DataFrame:
    """calls with `repeated`: within `seconds` of the call before, accepted or not; never fewer than are suppressed."""
    w = Window.partitionBy(*by).orderBy(at)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.lag(F.unix_micros(F.col(at).cast("timestamp"))).over(w)
    return calls.withColumn("repeated", F.coalesce(gap < seconds * 1_000_000, F.lit(False)))


class Breaker:
    """Consecutive transient failures of one domain; three open it for a minute, a success closes it."""

    def __init__(self, failed: int = 0, until: float = 0.0):
        self.failed, self.until = failed, until

    def admit(self, at: float, transient: bool) -> bool:
        """Whether the request at that time is let through; if so, its outcome counts."""
        if at < self.until:
            return False
        self.failed = self.failed + 1 if transient else 0
        if self.failed >= FAILURES:
            self.failed, self.until = 0, at + OPEN_SECONDS
        return True


def _run_breaker(b: Breaker, pdf: pd.DataFrame) -> list[bool]:
    return [b.admit(t, bool(x)) for t, x in zip(pdf["at"], pdf["transient"], strict=True)]


def breaker(requests: DataFrame, domain: str) -> DataFrame:
    """requests (domain, at seconds, id, transient) with `admitted`, folded in order of time within each domain."""
    return folded(requests, [domain], ["at", "id"], Breaker, lambda b, x: b.admit(x[0], bool(x[1])), ["at", "transient"], "admitted")


def breaker_stream(requests: DataFrame, domain: str) -> DataFrame:
    """The same over a stream: the state of a domain is its failures and until when it is open; it ends a day after its last request."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = dict(requests.dtypes)[domain]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        b = Breaker(*state.get) if state.exists else Breaker()
        rows = pd.concat(list(batches)).sort_values(["at", "id"], kind="stable")
        out = rows.assign(admitted=_run_breaker(b, rows))
        state.update((b.failed, b.until))
        state.setTimeoutDuration(86_400_000)
        yield out

    rows = requests.select(F.col(domain), "at", "id", "transient")
    return rows.groupBy(domain).applyInPandasWithState(run, f"`{domain}` {kind}, at double, id long, transient boolean, admitted boolean", "failed int, until double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def late_results(results: DataFrame, by: Sequence[str], started: str, finished: str, deadline_seconds: float) -> tuple[DataFrame, DataFrame]:
    """Results that came before their request's deadline, and for each request how many did not, as a failure row."""
    late = (F.unix_micros(F.col(finished).cast("timestamp")) - F.unix_micros(F.col(started).cast("timestamp"))) > deadline_seconds * 1_000_000
    failed = results.filter(late).groupBy(*by).agg(F.count(F.lit(1)).alias("count")).withColumn("error", F.lit("ResearchDeadlineExceeded"))
    return results.filter(~late), failed


def windowed(events: DataFrame, at: str, by: Sequence[str], length: str, slide: str | None = None, lateness: str | None = None) -> DataFrame:
    """Counts and sums by event-time window, for tables and (with a lateness) for streams."""
    if lateness:
        events = events.withWatermark(at, lateness)
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return events.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def latest(stream: DataFrame, keys: Sequence[str], at: str, ttl: str) -> DataFrame:
    """A stream without repeats of a key within the TTL: the first of them passes."""
    return stream.withWatermark(at, ttl).dropDuplicatesWithinWatermark(list(keys))


def fingerprint(text: Column, key: bytes) -> Column:
    """Sixteen hexadecimal digits that only who holds the key can make again; the key is a parameter, new for each process by design."""

    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hmac.new(key, x.encode(), hashlib.sha256).hexdigest()[:16])

    return digest(text)


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts as a compact JSON object with sorted names."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)
