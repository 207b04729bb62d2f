"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits; two documents are linked when their fingerprints differ in at most `distance` bits, and
a component is what links connect. Bits that go together are put into one partition; dynamic programming gives the
partitions unequal thresholds that sum to distance - partitions + 1 at the least estimated number of
candidates; a fingerprint is probed in the buckets of each partition and bucket members are verified on all bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lookup_join, map_batches, sifted, table, unused

BITS, SHINGLE, DISTANCE, SEED = 64, 3, 2, 42
#: Most members of a bucket that one task compares with one another; larger buckets are split by further bits.
BUCKET = 4_096
#: Cost of making and shuffling one bucket key, in comparisons of two fingerprints.
KEY_COST = 40.0


def simhash(text: str | None) -> int:
    """The fingerprint of a whole text: majority bits of the XXH64 of its shingles, with repeats; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        n, ones = 1, _bit_counts([digest(b" ".join(words), SEED)])
    else:
        n, ones = len(words) - SHINGLE + 1, np.zeros(BITS, np.int64)
        for at in range(0, n, 65_536):  # bounded memory, however long the text
            part = words[at : min(at + 65_536, n) + SHINGLE - 1]
            ones += _bit_counts([digest(b" ".join(z), SEED) for z in zip(part, part[1:], part[2:], strict=False)])
    return int(sum(1 << b for b in np.nonzero(2 * ones > n)[0].tolist()))


def _bit_counts(hashes: list[int] | np.ndarray) -> np.ndarray:
    a = np.asarray(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(a, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 without any."""
    ones = sum((_bit_counts(hashes[at : at + 65_536]) for at in range(0, len(hashes), 65_536)), np.zeros(BITS, np.int64))
    return int(sum(1 << b for b in np.nonzero(2 * ones > len(hashes))[0].tolist()))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of docs; a null text counts as empty. The column doc_id may have any type."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array([simhash(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, run, f"doc_id {rows.dtypes[0][1]}, fp long").withColumnRenamed("doc_id", doc_id)


# ---- the plan: partitions and thresholds ----


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each two bits, how many have both; sums over all of them, 2,080 rows to the driver."""
    upper = np.triu_indices(BITS)

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            x = np.unpackbits(np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False)).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(x), both + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(upper[0])), -1), pa.int32()), pa.array(np.append(both[upper], n).astype(np.int64))], ["cell", "n"])

    got = {r.cell: r.n for r in map_batches(fps.select("fp"), run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    both = np.zeros((BITS, BITS))
    for k, (i, j) in enumerate(zip(*upper, strict=True)):
        both[i, j] = both[j, i] = got.get(k, 0)
    return int(got.get(-1, 0)), both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits into partitions of nearly equal width, each time adding the bit that goes best with those there."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        own = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.discard(own[0])
        while len(own) < width:
            b = max(sorted(left), key=lambda b: corr[b, own].sum())
            own.append(b)
            left.discard(b)
        out.append(sorted(own))
    return out


def expected_pairs(n: int, both: np.ndarray, bits: list[int], radius: int) -> float:
    """Estimated pairs that differ in at most `radius` of the given bits, from how often each bit is set."""
    p = np.diag(both)[bits] / max(n, 1)
    dist = np.zeros(radius + 2)
    dist[0] = 1.0
    for differ in 2 * p * (1 - p):
        dist[1:] = dist[1:] * (1 - differ) + dist[:-1] * differ
        dist[0] *= 1 - differ
    return n * n / 2 * float(dist[: radius + 1].sum())


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, -1 (not probed) or more, that sum to `total` at the least cost; costs[i][t + 1] is partition i's at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in enumerate(row, start=-1):
                if s + t not in new or c + x < new[s + t][0]:
                    new[s + t] = (c + x, [*ts, t])
        best = new
    return best.get(total, (float("inf"), []))


def plan(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds: the cheapest over the numbers of partitions."""
    chosen: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for parts in range(1, distance + 3):
        groups = group_bits(n, both, parts)
        costs = [[0.0, *(expected_pairs(n, both, g, t) + KEY_COST * n * len(masks(g, t)) for t in range(distance + 1))] for g in groups]
        cost, ts = allocate(costs, distance - parts + 1)
        if ts and cost < chosen[0]:
            chosen = cost, list(zip(groups, ts, strict=True))
    return chosen[1]


def masks(bits: list[int], threshold: int) -> list[int]:
    """Bits to compare: two values differ in at most `threshold` bits if they agree under one of these masks."""
    whole = sum(1 << b for b in bits)
    return [whole & ~sum(1 << b for b in out) for out in combinations(bits, min(threshold, len(bits)))] if threshold >= 0 else []


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# ---- probing and verifying ----


def spanning(fps: np.ndarray, nodes: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links in one bucket, as (node, smaller node); compares in blocks."""
    n = len(fps)
    order = np.argsort(nodes, kind="stable")
    fps, nodes, top = fps[order].view(np.uint64), nodes[order], np.arange(n)

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for at in range(0, n, 512):
        near = np.bitwise_count(fps[at : at + 512, None] ^ fps[None, at:]) <= distance
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            a, b = root(at + i), root(at + j)
            if a != b:
                top[max(a, b)] = min(a, b)
    return [(int(nodes[x]), int(nodes[root(x)])) for x in range(n) if root(x) != x]


def links(fps: DataFrame, probes: list[tuple[list[int], int]], distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(a, b): pairs of nodes that connect what links connect. fps: fp, node; one row per fingerprint, checkpointed.

    Buckets of more than `bucket` members are split again: their members agree on the bucket's bits, so the rest of the
    bits is dealt into distance + 1 parts, one of which must agree as well. Parts get the bits that vary most in that bucket evenly.
    Ends because a bucket whose members agree on all but k bits holds at most 2 ** k fingerprints.
    """
    keys = [signed(m) for bits, t in probes for m in masks(bits, t)]
    # One column of a key is the mask, so that equal values under two masks never meet.
    rows = fps.select("fp", "node", F.explode(F.array(*(F.lit(m) for m in keys))).alias("mask"))
    rows = rows.select("fp", "node", F.struct(F.lit(0).cast("long").alias("path"), "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value")).alias("key"))
    total, found = fps.count() * len(keys), []
    while True:
        counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        met = cut(lookup_join(rows, counted.withColumn("weight", F.col("n")), "key", "weight", ["fp"], total, "inner"))
        small = met.filter(F.col("n") <= bucket).groupBy("key").agg(F.collect_list(F.struct("fp", "node")).alias("members")).select("members")

        def verify(batches):
            for b in batches:
                a = b.column(0)
                ends, flat = a.offsets.to_numpy(), a.values
                fp, node = flat.field("fp").to_numpy(zero_copy_only=False), flat.field("node").to_numpy(zero_copy_only=False)
                edges = [e for s, t in zip(ends, ends[1:], strict=False) for e in spanning(fp[s:t], node[s:t], distance)]
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

        found.append(map_batches(small, verify, "a long, b long"))
        hot = met.filter(F.col("n") > bucket)
        if not (total := hot.count()):
            break
        ones = [F.sum(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(BITS)]
        split = hot.groupBy("key", "n").agg(*ones)
        bit = F.lit([signed(1 << b) for b in range(BITS)])
        share = F.array(*(F.struct((-F.least(F.col(f"b{b}"), F.col("n") - F.col(f"b{b}"))).alias("v"), F.lit(b).alias("b")) for b in range(BITS)))
        free = F.transform(F.filter(F.array_sort(share), lambda x: F.get(bit, x["b"]).bitwiseAND(F.col("key.mask")) == 0), lambda x: x["b"])
        dealt = lambda k: lambda _, i: i % (distance + 1) == k
        parts = [F.aggregate(F.filter("free", dealt(k)), F.col("key.mask"), lambda acc, b: acc.bitwiseOR(F.get(bit, b))) for k in range(distance + 1)]
        split = split.withColumn("free", free).select("key", F.col("n").alias("weight"), F.array(*parts).alias("more"))
        rows = lookup_join(hot.drop("n"), split, "key", "weight", ["fp"], total, "inner").withColumn("mask", F.explode(F.array_distinct("more")))
        # A bucket is named by the hash of its way down; two that collide would only be compared in vain.
        rows = rows.select("fp", "node", F.struct(F.xxhash64("key").alias("path"), "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value")).alias("key"))
        total *= distance + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node that edges connect to a smaller one, the smallest such node.

    Large-star and small-star steps in turn; every step is a minimum by node (combined before the shuffle) and a join
    back, salted where one node has very many neighbours. Each round is checkpointed.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        total = 2 * (now.count() if mark is None else mark[0])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = lookup_join(both, low, "u", "n", ["v"], total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        ends = [F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))]
        small = lookup_join(large, low, "u", "n", ["v"], total).select(F.explode(F.array(*ends)).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        now = cut(small)
        was, mark = mark, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == was:
            break
    return now.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component"))


def tied(marked: DataFrame, name: str, node: str, total: int) -> DataFrame:
    """(a, b): the smallest node of a name with each other one: rows of one name are one document, whatever their nodes. Null names tie nothing."""
    ends = marked.filter(F.col(name).isNotNull()).groupBy(name).agg(F.min(node).alias("a"), F.max(node).alias("z"), F.count(F.lit(1)).alias("n")).filter("a <> z").drop("z")
    return lookup_join(marked.select(name, F.col(node).alias("b")), ends, name, "n", ["b"], total, "inner").filter("a <> b").select("a", "b").distinct()


def identity(doc_id: str, text: str) -> tuple[Column, Column]:
    """A row's name, struct<unnamed, id>, and the hash of its text. Where it has no id it is named by its text; such names come after all ids."""
    body, own = F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.col(doc_id).cast("long")
    return F.struct(own.isNull().alias("unnamed"), F.coalesce(own, body).alias("id")), body


def groups(docs: DataFrame, doc_id: str, text: str, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(name, fp, first) for every row of docs: its name, and the smallest name that links reach. Links are drawn between fingerprints, so ids may be any numbers."""
    ident, _ = identity(doc_id, text)
    marked = cut(fingerprints(docs.select(ident.alias("name"), F.col(text).alias("text")), "name", "text"))
    total = marked.count()
    fps = cut(marked.groupBy("fp").agg(F.min("name").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("node", F.col("fp")))
    n, both = bit_moments(fps)
    edges = links(fps, plan(n, both, distance), distance, bucket) if n > 1 else fps.select(F.col("node").alias("a"), F.col("node").alias("b"))
    found = components(edges.unionByName(tied(marked, "name", "fp", total)))
    named = cut(fps.join(found, "node", "left").select("fp", "n", "first", F.coalesce("component", "node").alias("component")))
    smallest = named.groupBy("component").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("weight"))
    named = lookup_join(named.drop("first"), smallest, "component", "weight", ["fp"], n).select("fp", "n", "first")
    return lookup_join(marked, named, "fp", "n", ["name"], total).select("name", "fp", "first")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest doc_id that links reach, the row's own included. Rows that share a doc_id are one
    document. A null text counts as empty, and all texts without words have fingerprint 0 and are linked. A null doc_id
    is never the smallest; a component without any other id has component_id null. Ids may be any 64-bit numbers. Other columns are ignored.
    """
    given = lambda name: F.when(~F.col(f"{name}.unnamed"), F.col(f"{name}.id"))
    return groups(docs, doc_id, text, distance, bucket).select(given("name").alias("doc_id"), "fp", given("first").alias("component_id"))


def rows_of(docs: DataFrame, names: DataFrame, firsts: DataFrame, ident: Column, body: Column) -> DataFrame:
    """One row of docs for each name of firsts: that with the smallest text hash. names: the name of every row.

    Rows whose name is theirs alone and stays pass where they are; only the others, found by a sieve, are shuffled.
    """
    name, k = unused(docs, "_id", "_k")
    kept = firsts.select(F.col(firsts.columns[0]).alias("name"), F.lit(True).alias("stays"))
    suspects = cut(names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).join(kept, "name", "left").filter("stays is null or n > 1"))
    some, rest = sifted(docs, ident, suspects.select("name"), suspects.count())
    rows = some.withColumn(name, ident).join(kept.select(F.col("name").alias(name)), name, "left_semi")
    rows = rows.withColumn(k, F.row_number().over(Window.partitionBy(name).orderBy(body))).filter(F.col(k) == 1).select(*docs.columns)
    return rest.unionByName(rows)


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: the row with its smallest id.

    Where that id has several rows, the one with the smallest text hash stays; rows equal in that too are one document.
    A row without an id is named by its text, after all ids.
    """
    found = cut(groups(docs, doc_id, text).select("name", "first"))
    return rows_of(docs, found.select("name"), found.filter(F.col("name") == F.col("first")).select("name").distinct(), *identity(doc_id, text))


def op7_simhash_near_dedup(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
