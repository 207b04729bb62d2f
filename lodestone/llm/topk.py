"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets of similar length. For a query with threshold t (its k-th best so
far), a bucket whose longest vector has length l matters only if the cosine can reach t / (|q| l). Where that local threshold is
high, candidates are those whose coordinate in the query's main direction can reach it; where it is low, those that are long enough.
What is left is verified by exact integer products. Queries of like t / |q| form a block, and a block is shipped only to the
shards whose longest vector can reach its least t / |q|.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, table

K, EVERY, SCALE = 5, 50, 256.0
#: Vectors to a bucket, buckets to a shard (what a task holds), queries to a block.
BUCKET, SHARD, QUERIES = 4_096, 16, 8_192
#: Most bytes of a bucket or block of queries (one binary cell), whatever the dimension.
BYTES = 8 << 20
#: Most shards whose lengths (a dimension, a number and a length each) are broadcast; beyond that they are joined.
LISTED = 1_000_000
#: Local cosine threshold from which a coordinate prunes better than length.
COORDINATE = 0.7


def quantised(rows: DataFrame, vec_id: str, embedding: str, scale: float = SCALE) -> DataFrame:
    """(vec_id, v array<long>, dim, norm): rows with an id and a vector of finite components; the others take no part."""
    x = F.col(embedding).cast("array<double>")
    fine = F.col(vec_id).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    out = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(fine, F.transform(x, lambda c: F.floor(F.lit(scale) * c))).alias("v")).filter("v is not null")
    return out.withColumn("dim", F.size("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))


def packed(rows: DataFrame, size: int, extra: str | None = None) -> DataFrame:
    """(dim, ids, vectors, extra, far, need): rows of a task, in their order, as blocks of at most `size` rows and BYTES; little-endian 64-bit numbers.

    far is the greatest length of the block's vectors and need the least of extra / length, where that is positive for all of them.
    """

    def run(batches):
        held: dict[int, list] = {}

        def block(dim):
            i, v, e = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            most = per(dim)
            for s in range(0, len(i), most):
                w, least = v[s : s + most], e[s : s + most]
                norm = np.sqrt((w.astype(np.float64) ** 2).sum(axis=1))
                need = float(np.min(least / norm)) * (1 - 1e-9) if (least > 0).all() and (norm > 0).all() else -1.0
                cells = [pa.array([x.tobytes()], pa.binary()) for x in (i[s : s + most], w, least)]
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *cells, pa.array([float(norm.max())]), pa.array([need])], ["dim", "ids", "vectors", "extra", "far", "need"])

        per = lambda dim: max(1, min(size, BYTES // (8 * max(dim, 1))))
        for b in batches:
            ids, dims, extras = (np.asarray(b.column(k).to_numpy(zero_copy_only=False)) for k in (0, 2, 3))
            a = b.column(1)
            flat, at = a.values.to_numpy(zero_copy_only=False), a.offsets.to_numpy()
            for dim in np.unique(dims).tolist():
                which = np.nonzero(dims == dim)[0]
                v = flat[at[which][:, None] + np.arange(dim)] if dim else np.zeros((len(which), 0), np.int64)
                held.setdefault(dim, []).append((ids[which].astype("<i8"), v.astype("<i8"), extras[which].astype("<f8")))
                if sum(len(x[0]) for x in held[dim]) >= per(dim):
                    yield from block(dim)
        for dim in list(held):
            yield from block(dim)

    return map_batches(rows.select("vec_id", "v", "dim", (F.col(extra) if extra else F.lit(0.0)).cast("double").alias("extra")), run, "dim int, ids binary, vectors binary, extra binary, far double, need double")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and b: by floating point where that is exact, else by Python's integers."""
    most = a.shape[1] * float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0))
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    return np.array([[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a], object).reshape(len(a), len(b))


def search(qid: np.ndarray, q: np.ndarray, least: np.ndarray, buckets: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[int, int]]]:
    """For each query the best k (score, vec_id) over the buckets among those that reach `least`, ties to the smaller id."""
    norms = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    best: list[list[tuple[int, int]]] = [[] for _ in qid]
    theta = least.copy()
    q_unit = q / np.maximum(norms, 1e-300)[:, None]
    focus = np.abs(q_unit).argmax(axis=1) if q.shape[1] else np.zeros(len(q), int)
    sized = [(np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)), ids, v) for ids, v in buckets]
    for length, ids, v in sorted(sized, key=lambda x: -x[0].max(initial=0)):
        top = length.max(initial=0)
        local = np.where((norms > 0) & (top > 0), theta / np.maximum(norms * top, 1e-300), -1.0)
        unit = None
        plain = []
        for j in np.nonzero(local <= 1 + 1e-9)[0]:
            if local[j] < COORDINATE:
                plain.append(j)
                continue
            if unit is None:
                unit = v / np.maximum(length, 1e-300)[:, None]
            c = focus[j]
            here, cap = np.arccos(np.clip(q_unit[j, c], -1, 1)), np.arccos(min(local[j], 1.0)) + 1e-6
            low, high = np.cos(min(np.pi, here + cap)) - 1e-9, np.cos(max(0.0, here - cap)) + 1e-9
            some = np.nonzero((unit[:, c] >= low) & (unit[:, c] <= high))[0]
            _keep(best, theta, j, qid[j], ids[some], products(q[j : j + 1], v[some])[0], k)
        for s in range(0, len(plain), 256):
            rows = np.array(plain[s : s + 256])
            need = np.where((theta[rows] > 0) & (norms[rows] > 0), theta[rows] / np.maximum(norms[rows], 1e-300) * (1 - 1e-9), -1.0).min()
            some = np.nonzero(length >= need)[0]
            for j, got in zip(rows, products(q[rows], v[some]), strict=True):
                _keep(best, theta, j, qid[j], ids[some], got, k)
    return best


def _keep(best, theta, j, own, ids, scores, k):
    fine = np.nonzero((scores >= theta[j]) & (ids != own))[0]
    if len(fine) > 4 * k:
        cutoff = np.partition(scores[fine], len(fine) - k)[len(fine) - k]
        fine = fine[scores[fine] >= cutoff]
    merged = sorted([*best[j], *((int(scores[i]), int(ids[i])) for i in fine)], key=lambda x: (-x[0], x[1]))[:k]
    best[j] = merged
    if len(merged) == k:
        theta[j] = max(theta[j], float(merged[-1][0]) * (1 - 1e-15) - 0.5)  # integers: half below, so that equal scores stay


def met(blocks: DataFrame, lengths: DataFrame, n_shards: int) -> DataFrame:
    """(dim, shard, qb): the blocks that each shard can have candidates for. lengths: dim, shard, far."""
    listed = lengths.groupBy("dim").agg(F.collect_list(F.struct("shard", "far")).alias("shards"))
    listed = F.broadcast(listed) if n_shards <= LISTED else listed
    return blocks.select("dim", "qb", "need").join(listed, "dim").select("dim", "qb", F.explode(F.filter("shards", lambda x: x["far"] >= F.col("need"))).alias("s")).select("dim", "s.shard", "qb")


def _pairs(shards: DataFrame, blocks: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of each query block in each shard that it meets."""
    own = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns))  # noqa: E731  the two sides come from the same tables
    left = own(shards.select("dim", "shard", "ids", "vectors").join(pairs, ["dim", "shard"]))
    right = own(blocks.select("dim", "qb", "ids", "vectors", "extra").join(own(pairs), ["dim", "qb"]))

    def run(key, a, b):
        dim = key[0].as_py()
        read = lambda t, c, kind: [np.frombuffer(x, kind) for x in t.column(c).to_pylist()]
        ids, buckets = read(a, "ids", "<i8"), [x.reshape(-1, dim) if dim else x.reshape(0, 0) for x in read(a, "vectors", "<i8")]
        buckets = [(i, v if dim else np.zeros((len(i), 0), np.int64)) for i, v in zip(ids, buckets, strict=True)]
        out = []
        for qid, raw, least in zip(read(b, "ids", "<i8"), read(b, "vectors", "<i8"), read(b, "extra", "<f8"), strict=True):
            q = raw.reshape(-1, dim) if dim else np.zeros((len(qid), 0), np.int64)
            for j, found in enumerate(search(qid, q, least, buckets, k) if buckets else []):
                out += [(int(qid[j]), i, min(max(s, -(1 << 63)), (1 << 63) - 1)) for s, i in found]
        cols = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    by = ["dim", "shard", "qb"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, "query_id long, vec_id long, score long")


def top_k(rows: DataFrame, is_query, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query the k highest integer products with other rows.

    Ties go to the smaller vec_id. Rows without an id, and vectors that are null or hold null or non-finite components, take no part; vectors of
    different dimensions never meet. Rows that share a vec_id are never their own candidates, and of such query rows the smallest
    vector asks. Fewer candidates than k give fewer ranks; repeated candidate rows each count. Components and scores beyond 64
    bits count as the nearest 64-bit number. Other columns are ignored.
    """
    data = cut(quantised(rows, vec_id, embedding, scale))
    asks = F.coalesce(is_query(F.col("vec_id")), F.lit(False))
    weight = 8 * (F.col("dim") + 1).cast("long")
    sizes = data.agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("b"), F.sum(asks.cast("int")).alias("q"), F.sum(F.when(asks, weight)).alias("qb")).first()
    parts = lambda n, b, most: max(1, -(-(n or 0) // most), -(-(b or 0) // (BYTES * SHARD)))
    n_shards, n_blocks = parts(sizes.n, sizes.b, BUCKET * SHARD), parts(sizes.q, sizes.qb, QUERIES)
    asked = data.filter(asks).groupBy("vec_id").agg(F.min(F.struct("v", "dim", "norm")).alias("s")).select("vec_id", "s.v", "s.dim", "s.norm")
    ranged = data.repartitionByRange(n_shards, F.col("dim"), F.col("norm").desc(), F.col("vec_id")).sortWithinPartitions("dim", F.col("norm").desc(), "vec_id")
    # The partition is the shard: a run of lengths, with at most BUCKET vectors to a bucket.
    shards = cut(packed(ranged, BUCKET).withColumn("shard", F.spark_partition_id()))
    lengths = shards.groupBy("dim", "shard").agg(F.max("far").alias("far"))
    firsts = lengths.groupBy("dim").agg(F.min(F.struct("shard", "far")).alias("s")).select("dim", "s.*")

    def blocks(q: DataFrame) -> DataFrame:
        """The query blocks, numbered, those of like needs together."""
        q = q.repartitionByRange(n_blocks, "dim", "need", "vec_id").sortWithinPartitions("dim", "need", "vec_id")
        return cut(packed(q, QUERIES, "least").withColumn("qb", F.monotonically_increasing_id()))

    # The longest vectors of a dimension give each query a first threshold; the other shards have to beat it.
    blind = blocks(asked.withColumn("least", F.lit(-1.7e308)).withColumn("need", F.lit(0.0)))
    found = cut(_pairs(shards, blind, met(blind, firsts, n_shards), k))
    if n_shards > 1:
        bound = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).filter(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), (F.col("low") - 0.5).alias("least"))
        seen = blocks(asked.join(bound, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(-1.7e308))).withColumn("need", F.col("least") / F.greatest("norm", F.lit(1e-300))))
        others = lengths.join(firsts.select("dim", "shard"), ["dim", "shard"], "left_anti")
        found = found.unionByName(_pairs(shards, seen, cut(met(seen, others, n_shards)), k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda c: c % EVERY == 0)


SQL = {
    "op9_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
