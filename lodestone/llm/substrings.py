"""Substring dedup over windows of a fixed number of words.

Every window of `window` consecutive words gets a Rabin-Karp hash. Windows are counted over all documents; each
occurrence after the first is covered, covers merge into maximal intervals, and their words are removed.

Few windows occur twice, and those that do are found without moving the others. A window's anchor is the least hash among its runs
of RUN words: equal windows have equal anchors, and neighbours mostly share theirs. So anchors are counted first, and only
windows whose anchor occurs at two places are dealt out and compared, a row for all neighbours of one anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lookup_join, map_batches, sifted, table, text_or_empty, unused

WINDOW, RUN = 20, 8
#: Odd bases of the three hashes, modulo 2 ** 64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Words that are hashed at once, and most windows in one row.
PART, BLOCK = 1 << 16, 32
#: Distinct words that a task remembers before it starts anew.
MEMORY = 300_000
#: Bits of the table that says which anchors are repeated; beyond some millions of such anchors more pass for nothing, and that is all.
SIEVE_BITS = 1 << 26
#: Anchors at more places than this, or than 1 in 50,000 of all, are dealt out by their windows' own hashes: there are 50,000 such anchors at most.
HOT, MOST_HOT = 10_000, 50_000


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (minimum or maximum) over each n consecutive values."""
    size = 1
    while 2 * size <= n:
        x, size = f(x[:-size], x[size:]), 2 * size
    return f(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


class Windows:
    """Hashes of windows and their anchors. A polynomial's sum over a window is a difference of running sums, taken back to power 0."""

    def __init__(self, window: int = WINDOW):
        self.window, self.run = window, min(RUN, window)
        self.known: dict[bytes, int] = {}
        self.up, self.down = ([_powers(b, PART + window) for b in bases] for bases in (BASES, [pow(b, -1, 1 << 64) for b in BASES]))

    def _word(self, w: bytes) -> int:
        found = self.known.get(w)
        if found is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            found = self.known[w] = xxhash.xxh3_64_intdigest(w)
        return found

    def hashes(self, values: np.ndarray, n: int, k: int) -> np.ndarray:
        """Rabin-Karp hashes of all runs of n words, by the base of number k."""
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.up[k][: len(values)])])
        return _mixed((sums[n:] - sums[:-n]) * self.down[k][: len(values) - n + 1])

    def parts(self, words: list[bytes]):
        """(first window's place, word hashes, windows' anchors, anchors' occurrences) for each stretch of a text's windows."""
        for at in range(0, len(words) - self.window + 1, PART):
            values = np.array([self._word(w) for w in words[at : at + PART + self.window - 1]], np.uint64)
            runs = self.hashes(values, self.run, 1)
            span = self.window - self.run + 1
            least = _slide(runs, span, np.minimum)
            most = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
            yield at, values, least, runs[_slide(most, span, np.maximum) == runs]


def _places(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(text_or_empty(F.col(f"`{text}`").cast("string"))).alias("body"), F.col(f"`{text}`").cast("string").alias("text"))


def repeated_anchors(places: DataFrame, window: int = WINDOW) -> DataFrame:
    """(anchor, n): anchors at two or more places."""

    def run(batches):
        own = Windows(window)
        for b in batches:
            found = [x for t in b.column(0).to_pylist() for *_, x in own.parts((t or "").encode("utf-8", "surrogatepass").split())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], ["anchor"])

    return map_batches(places.select("text"), run, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _sieve(anchors: DataFrame) -> np.ndarray:
    """A table of SIEVE_BITS bits with those of the anchors set; its size is the same for any input."""
    word, bit = F.shiftrightunsigned("anchor", 64 - SIEVE_BITS.bit_length() + 1), F.lit(63)
    rows = anchors.groupBy(F.shiftrightunsigned(word, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), word.bitwiseAND(bit).cast("int"))).alias("bits")).toPandas()
    out = np.zeros(SIEVE_BITS // 64, np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def _passes(anchors: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    at = anchors >> np.uint64(64 - SIEVE_BITS.bit_length() + 1)
    return (sieve[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _blocks(least: np.ndarray) -> np.ndarray:
    """Where windows with another anchor than the one before start, and every BLOCK windows of one anchor."""
    starts = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(least[1:] != least[:-1]) + 1])
    sizes = np.diff(starts, append=len(least))
    more = [np.arange(s + BLOCK, s + n, BLOCK) for s, n in zip(starts[sizes > BLOCK], sizes[sizes > BLOCK], strict=True)]
    return np.sort(np.concatenate([starts, *more])) if more else starts


def candidates(places: DataFrame, sieve, hot, window: int = WINDOW) -> DataFrame:
    """(key, doc_id, body, start, later, hashes): blocks of neighbouring windows that may be repeated, equal ones under one key.

    key is the anchor or, where that is hot, a second hash of the block's only window. What a batch holds twice
    is settled there: its later places come with their bits in `later` and no hashes, so a passage that
    every document has gives one row per batch.
    """

    def run(batches):
        own = Windows(window)
        bits, many = sieve.value, hot.value
        for b in batches:
            rows = {}
            for name, body, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows[name is None, name or 0, body] = t
            seen: set[tuple[int, bytes]] = set()
            out: list[tuple] = []
            held: list[np.ndarray] = []

            def put(key: int, place: tuple, start: int, h: np.ndarray) -> None:
                none, name, body = place
                block = (key, h.tobytes())
                again = block in seen
                seen.add(block)
                # What is settled needs no company, so its key is its own place's: many copies don't meet.
                out.append(((body ^ (name * 0x9E3779B97F4A7C15 + start) & ~(-1 << 63)) if again else key, None if none else name, body, start, (1 << len(h)) - 1 if again else 0, 0 if again else len(h)))
                if not again:
                    held.append(h)

            for place in sorted(rows):
                for at, values, least, _ in own.parts((rows[place] or "").encode("utf-8", "surrogatepass").split()):
                    starts = _blocks(least)
                    ends = np.append(starts[1:], len(least))
                    good = np.flatnonzero(_passes(least[starts], bits))
                    if not len(good):
                        continue
                    h, anchors = own.hashes(values, window, 0), least[starts[good]]
                    is_hot = np.isin(anchors, many) if len(many) else np.zeros(len(good), bool)
                    second = own.hashes(values, window, 2).view(np.int64) if is_hot.any() else None
                    for key, s, e, by_window in zip(anchors.view(np.int64).tolist(), starts[good].tolist(), ends[good].tolist(), is_hot.tolist(), strict=True):
                        if by_window:
                            for i in range(s, e):
                                put(int(second[i]), place, at + i, h[i : i + 1])
                        else:
                            put(key, place, at + s, h[s:e])
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int32), np.cumsum(cols[5], dtype=np.int32)]), pa.int32()), pa.array(np.concatenate([*held, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=False)), lists], ["key", "doc_id", "body", "start", "later", "hashes"])

    return map_batches(places, run, "key long, doc_id long, body long, start int, later long, hashes array<long>")


def covers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, body, covered array<struct<start, bits>>): for each document with later occurrences, the windows (start + bit) that are later ones."""
    spark, places = docs.sparkSession, _places(docs, doc_id, text)
    anchors = cut(repeated_anchors(places, window))
    total = anchors.agg(F.sum("n")).first()[0] or 0
    often = anchors.filter(F.col("n") > max(HOT, total // MOST_HOT)).select("anchor").toPandas()["anchor"].to_numpy(np.int64).view(np.uint64)
    found = candidates(places, spark.sparkContext.broadcast(_sieve(anchors)), spark.sparkContext.broadcast(often), window)
    # All windows of a key meet in one task and are ranked there by place, in a sort that spills. Places that are equal, of repeated rows, have one rank.
    each = found.repartition("key").select("key", "doc_id", "body", "start", "later", F.posexplode_outer("hashes").alias("k", "hash"))
    by = Window.partitionBy("key", "hash").orderBy(F.col("doc_id").asc_nulls_last(), "body", F.col("start") + F.coalesce("k", F.lit(0)))
    bit = F.when(F.col("hash").isNull(), F.col("later")).when(F.rank().over(by) > 1, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k"))).otherwise(F.lit(0))
    bits = each.withColumn("bit", bit.cast("long")).groupBy("key", "doc_id", "body", "start").agg(F.bit_or("bit").alias("bits")).filter("bits <> 0")
    return bits.groupBy("doc_id", "body").agg(F.collect_list(F.struct("start", "bits")).alias("covered"))


def _spans(covered: list | None, window: int) -> list[tuple[int, int]]:
    """Maximal intervals of words, end exclusive, that the covered windows make together."""
    starts = sorted(x["start"] + k for x in covered or () for k in range(x["bits"].bit_length()) if x["bits"] >> k & 1)
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + window)
        else:
            out.append((s, s + window))
    return out


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without the words of repeated windows, and n_words, n_removed and removed (array<struct<start, end>>, maximal intervals of words).

    The first place of a window is that of the smallest (doc_id, hash of the text, position); null ids come last. Rows that
    share doc_id and text are one document and are treated alike. Of a text that loses words the others are joined by one
    space; other texts stay as they are. Null texts stay null, with no words, and texts of fewer words than a window lose nothing.
    Columns of docs named n_words, n_removed or removed, in any case, are replaced.
    """
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_words", "n_removed", "removed")))
    names = kept.columns
    name, weight, covered, owner, body = unused(kept, "_name", "_rows", "_covered", "_owner", "_body")
    found = cut(covers(docs, doc_id, text, window).withColumn(name, F.xxhash64("doc_id", "body")))
    rows = kept.withColumn(owner, F.col(f"`{doc_id}`").cast("long")).withColumn(body, F.xxhash64(text_or_empty(F.col(f"`{text}`").cast("string"))))
    rows = rows.withColumn(name, F.xxhash64(owner, body))
    # Only rows that lose words move.
    some, none = sifted(rows, F.col(name), found.select(name), found.count())
    lines = found.join(some.groupBy(name).agg(F.count(F.lit(1)).alias(weight)), name).withColumnsRenamed({"covered": covered, "doc_id": f"{owner}2", "body": f"{body}2"})
    met = lookup_join(some, lines, name, weight, [owner], some.count())
    mine = F.col(owner).eqNullSafe(F.col(f"{owner}2")) & (F.col(body) == F.col(f"{body}2"))
    # The other columns travel in one, under plain names.
    others = [c for c in names if c != text]
    own = [F.col(f"`{text}`").cast("string").alias("text"), F.struct(F.lit(0).alias("z"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("others")]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for b in batches:
            texts, sizes, gone, spans = [], [], [], []
            for t, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                cut_out = _spans(c, window)
                left, start = [], 0
                for s, e in [*cut_out, (len(words), len(words))]:
                    left += words[start:s] if cut_out else ()
                    start = e
                texts.append(b" ".join(left).decode("utf-8", "surrogatepass") if cut_out else t)
                sizes.append(len(words))
                gone.append(sum(e - s for s, e in cut_out))
                spans.append([{"start": s, "end": e} for s, e in cut_out])
            cols = [pa.array(texts, pa.string()), b.column(1), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(span))]
            yield pa.RecordBatch.from_arrays(cols, ["text", "others", "n_words", "n_removed", "removed"])

    whole = none.select(*own, F.lit(None).cast("array<struct<start: int, bits: bigint>>").alias("covered")).unionByName(met.select(*own, F.when(mine, F.col(covered)).alias("covered")))
    out = map_batches(whole, run, f"text string, others {whole.schema['others'].dataType.simpleString()}, n_words long, n_removed long, removed array<struct<start: bigint, end: bigint>>")
    at = {c: F.col(f"others.c{i}") for i, c in enumerate(others)} | {text: F.col("text")}
    return out.select(*(at[c].alias(c) for c in names), "n_words", "n_removed", "removed")


def op12_substring_dedup(spark, sf_dir):
    left = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.trim(F.regexp_replace(text_or_empty(), r"[\x20\x09-\x0D]+", " "))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


SQL = {
    "op12_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, pos, array_to_string(w[pos : pos + 19], ' ') AS words
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS pos FROM d)),
later AS (SELECT doc_id, pos FROM windows QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, range(20) AS r(k)),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.pos) AS words FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
}
