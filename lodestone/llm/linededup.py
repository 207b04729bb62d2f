"""Line dedup over overlapping three-line windows.

Every three consecutive lines of a document are hashed. A window that occurs more than once in all documents stays at
its first place; its later places are covered, overlapping covers merge, and covered lines are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup_join, map_batches, table, text_or_empty, unused

WINDOW = 3


def windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, body, pos, high, low): a row per window; the 128-bit hash of its lines and body, the hash of the whole text.

    Lines are what stands between line feeds. Blank lines are passed over: a window is three consecutive lines with a
    character other than white space, and pos counts such lines from 0.
    """

    def run(batches):
        for b in batches:
            ids, bodies, at, high, low = [], [], [], [], []
            for name, body, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines = [x for x in (t or "").encode("utf-8", "surrogatepass").split(b"\n") if x.strip()]
                n = len(lines) - window + 1
                if n > 0:
                    own = [xxhash.xxh3_128_digest(x) for x in lines]
                    h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b"".join(own[i : i + window])) for i in range(n)), "<i8").reshape(-1, 2)
                    ids += [name] * n
                    bodies += [body] * n
                    at += range(n)
                    high.append(h[:, 0])
                    low.append(h[:, 1])
            join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.int64()), pa.array(at, pa.int32()), pa.array(join(high)), pa.array(join(low))], ["doc_id", "body", "pos", "high", "low"])

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("body"), F.col(text).cast("string").alias("text")), run, "doc_id long, body long, pos int, high long, low long")


def covers(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, body, starts): for each document with later occurrences, the positions at which they start, in order."""
    marked = cut(found.withColumn("key", F.struct("high", "low")))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "body", "pos")
    # A document that comes in several rows has its places once: all its rows keep or lose the same lines.
    first = marked.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")).filter("first <> last").drop("last")
    met = lookup_join(marked, first, "key", "n", ["doc_id", "pos"], marked.count(), "inner")
    return met.filter(place != F.col("first")).groupBy("doc_id", "body").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the text of covered lines removed, n_lines and n_removed (non-blank lines); columns of docs with these two names are replaced.

    The first place of a window is the one of the smallest (doc_id, hash of the text, position); null ids come last.
    Rows that share doc_id and text are one document and are treated alike. No row is dropped: a text of covered lines
    alone becomes empty, a null text stays null, and texts of fewer than three non-blank lines stay as they are.
    """
    kept = docs.drop("n_lines", "n_removed")
    names, at = kept.columns, kept.columns.index(text)
    name, body, starts = unused(kept, "_id", "_body", "_starts")
    found = covers(windows(docs, doc_id, text, window), window).select(F.col("doc_id").alias(name), F.col("body").alias(body), F.col("starts").alias(starts))
    same = kept[doc_id].cast("long").eqNullSafe(found[name]) & (F.xxhash64(text_or_empty(kept[text])) == found[body])
    joined = kept.join(found, same, "left").drop(name, body)
    schema = ", ".join(f"`{c.replace('`', '``')}` {t}" for c, t in kept.dtypes)

    def run(batches):
        for b in batches:
            texts, lines, gone = [], [], []
            for t, starts in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                own = (t or "").encode("utf-8", "surrogatepass").split(b"\n")
                full = [i for i, x in enumerate(own) if x.strip()]
                drop = {full[p + k] for p in starts or () for k in range(window)}
                texts.append(b"\n".join(x for i, x in enumerate(own) if i not in drop).decode("utf-8", "surrogatepass") if drop else t)
                lines.append(len(full))
                gone.append(len(drop))
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_removed"])

    return map_batches(joined, run, f"{schema}, n_lines long, n_removed long")


def op2_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


SQL = {
    "op2_line_dedup": r"""
WITH cut AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS ord FROM cut),
filled AS (SELECT doc_id, line, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS pos FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
three AS (SELECT doc_id, pos, line, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, pos) AS k FROM three WHERE c IS NOT NULL) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, pos + d AS pos FROM later, (VALUES (0), (1), (2)) AS t(d)),
gone_ord AS (SELECT f.doc_id, f.ord FROM filled f JOIN gone g USING (doc_id, pos)),
left_over AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.ord) AS text FROM lines l LEFT JOIN gone_ord g ON g.doc_id = l.doc_id AND g.ord = l.ord WHERE g.doc_id IS NULL GROUP BY l.doc_id),
sizes AS (SELECT doc_id, count(*) AS n FROM filled GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(x.text, '') END AS text,
  CAST(coalesce(s.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN left_over x USING (doc_id) LEFT JOIN sizes s USING (doc_id) LEFT JOIN removed r USING (doc_id)
""",
}
