"""Target-distribution importance resampling over hashed word n-grams.

Identical texts collapse into one by a grouping of full texts. Each distinct text gives its features once; counts of
features are multiplied by the text's copies. A text's weight, the sum of its features' gains under the
target's distribution against the corpus's own, is joined back to its documents before each draws noise of its own.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lookup_join, map_batches, table, text_or_empty
from .sqlparts import crc32_of, crc_table

BUCKETS, ORDER, SEED, SHARE, LEAST_WORDS = 10_000, 3, 42, 5, 20
#: A word is a run of digits, lower-case letters and bytes beyond ASCII, once A-Z are lower-cased: everything else is a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Distinct words that a task remembers before it starts anew.
MEMORY = 200_000
#: Longest run of bytes that one step of _behind() passes over.
STEP = 64


def _zeros() -> np.ndarray:
    """[n, k, byte]: what byte k of a CRC becomes when n zero bytes follow it."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(0xEDB88320), one >> 1)
    out = np.empty((STEP + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(STEP):
        out[n + 1] = out[n] >> 8 ^ one[out[n] & 255]
    return out


ZEROS = _zeros()


def _behind(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs as n further bytes move them, whatever these bytes are; what they add is their own CRC, by exclusive or."""
    crc, n = crc.copy(), n.copy()
    at = np.arange(len(crc))
    while len(at):
        k, x = np.minimum(n[at], STEP), crc[at]
        crc[at] = ZEROS[k, 0, x & 255] ^ ZEROS[k, 1, x >> 8 & 255] ^ ZEROS[k, 2, x >> 16 & 255] ^ ZEROS[k, 3, x >> 24]
        n[at] -= k
        at = at[n[at] > 0]
    return crc


class Grams:
    """The buckets of a text's runs of 1 to `order` words: CRC-32 of the words joined by one space, modulo `buckets`.

    A word's CRC is computed once; that of a run follows from those of its words.
    """

    def __init__(self, buckets: int = BUCKETS, order: int = ORDER):
        self.buckets, self.order, self.known = buckets, order, {}

    def _word(self, w: bytes) -> tuple[int, int, int]:
        found = self.known.get(w)
        if found is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            found = self.known[w] = (zlib.crc32(w), zlib.crc32(b" " + w), len(w) + 1)
        return found

    def of(self, text: str | None, part: int = 1 << 16) -> tuple[int, np.ndarray]:
        """Number of words, and the buckets of all runs in no order. Long texts are passed over in parts, the last words of one going before the next."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()
        out = [np.zeros(0, np.int64)]
        for at in range(0, len(words), part):
            before = max(0, at - self.order + 1)
            own = np.array([self._word(w) for w in words[before : at + part]], np.int64).reshape(-1, 3)
            crc, after, size = own[:, 0].astype(np.uint32), own[:, 1].astype(np.uint32), own[:, 2]
            run = crc
            for k in range(self.order):
                if k:
                    run = _behind(run[:-1], size[k:]) ^ after[k:]
                out.append((run[max(0, at - before - k) :] % np.uint32(self.buckets)).astype(np.int64))
        return len(words), np.concatenate(out)


def packed(buckets: np.ndarray) -> bytes:
    """A bag of buckets as the gaps between them in order, a byte each; a gap of 255 or more has a byte of 255 for every 255 in it."""
    gaps = np.diff(np.sort(buckets), prepend=0)
    out = np.full(len(gaps) + int((gaps // 255).sum()), 255, np.uint8)
    out[np.cumsum(gaps // 255 + 1) - 1] = gaps % 255
    return out.tobytes()


def unpacked(held: bytes) -> np.ndarray:
    gaps = np.frombuffer(held, np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps < 255]


def bags(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """(key, copies, n_words, n_features, bag): a row per distinct text; key is its SHA-256, null texts count as empty."""

    def run(batches):
        grams = Grams(buckets, order)
        for b in batches:
            words, sizes, held = [], [], []
            for t in b.column(2).to_pylist():
                n, found = grams.of(t)
                words.append(n)
                sizes.append(len(found))
                held.append(packed(found))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(held, pa.binary())], ["key", "copies", "n_words", "n_features", "bag"])

    whole = docs.groupBy(text_or_empty(F.col(f"`{text}`").cast("string")).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    return map_batches(whole.select(F.unhex(F.sha2("text", 256)).alias("key"), "copies", "text"), run, "key binary, copies long, n_words long, n_features long, bag binary")


def counts(bags: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs, copies included. A task gives at most one row per bucket, and so does the driver's share: its size is `buckets`."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for copies, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total += copies * np.bincount(unpacked(held), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in map_batches(bags.select("copies", "bag"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and source, rounded down."""
    a, b, k = float(source.sum() + len(source)), float(target.sum() + len(target)), zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * a / ((s + 1.0) * b))) for s, t in k], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A document's own draw from the Gumbel distribution, in thousandths; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def weights(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for every row of docs; rows of one text share all but the id, however many they are."""
    own = cut(bags(docs, text, buckets, order))
    gain = gains(counts(own, buckets), counts(bags(target, target_text, buckets, order), buckets))

    def run(batches):
        for b in batches:
            sums = [int(gain[unpacked(x)].sum()) for x in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(sums, pa.int64())], ["key", "copies", "n_words", "n_features", "weight"])

    weighed = map_batches(own, run, "key binary, copies long, n_words long, n_features long, weight long")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.unhex(F.sha2(text_or_empty(F.col(f"`{text}`").cast("string")), 256)).alias("key"))
    return lookup_join(rows, weighed, "key", "copies", ["doc_id"], docs.count()).drop("key")


def drawn(scored: DataFrame, wanted: int, parts: int | None = None) -> DataFrame:
    """scored (score, doc_id, may, ...) with rank: 1, 2, ... for the first `wanted` rows that may be drawn by score, then smaller doc_id (null last).

    Rows are dealt by ranges of that order, so that no task sorts them all; a row's rank is its place in its range after the
    rows of the ranges before, of which there are as many as tasks. Equal rows are dealt apart by their number.
    """
    order = [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_n")]
    n = parts or int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(scored.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order))
    placed = dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).drop("_size")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = placed.join(F.broadcast(before), "_part")
    return out.withColumn("rank", F.when(F.col("may") & (rank <= F.lit(wanted)), rank)).drop("_at", "_part", "_before", "_n")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", share: int = SHARE, least: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of docs: `share` in 100 of the documents with `least` words are drawn.

    A null or empty text has no words, no features and weight 0. Repeated rows are drawn one by one; a null id comes
    last among ties and its noise is that of an empty id. An empty target or table leaves every gain as smoothing makes it. Other columns are ignored.
    """
    scored = cut(weights(docs, target, doc_id, text, target_text, buckets, order).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("may", F.col("n_words") >= least))
    wanted = share * scored.filter("may").count() // 100
    return drawn(scored, wanted).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


SQL = {
    "op11_importance_resampling": rf"""
WITH crc AS ({crc_table()}),
texts AS (SELECT text, count(*) AS copies, 0 AS target FROM documents WHERE text IS NOT NULL GROUP BY text
    UNION ALL SELECT text, count(*), 1 FROM benchmark WHERE text IS NOT NULL GROUP BY text),
split AS (SELECT text, copies, target,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM texts),
runs AS (SELECT text, copies, target, len(w) AS n_words, unnest(flatten([w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])])) AS run FROM split),
distinct_runs AS (SELECT DISTINCT run FROM runs),
hashed AS (SELECT run, {crc32_of("run")} % 10000 AS bucket FROM distinct_runs, crc),
bags AS (SELECT text, copies, target, bucket, count(*) AS n FROM runs JOIN hashed USING (run) GROUP BY ALL),
seen AS (SELECT bucket, coalesce(sum(n * copies) FILTER (target = 0), 0) AS s, coalesce(sum(n * copies) FILTER (target = 1), 0) AS t FROM bags GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE + 10000 AS s_all, coalesce(sum(t), 0)::DOUBLE + 10000 AS t_all FROM seen),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t::DOUBLE + 1) * s_all / ((s::DOUBLE + 1) * t_all))) AS BIGINT) AS g FROM seen, sums),
weighed AS (SELECT text, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight FROM bags JOIN gain USING (bucket) WHERE target = 0 GROUP BY text),
sized AS (SELECT text, len(w) AS n_words FROM split WHERE target = 0),
scored AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM documents d LEFT JOIN weighed USING (text) LEFT JOIN sized USING (text)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 5 * n // 100 THEN r END AS rank FROM placed
""",
}
