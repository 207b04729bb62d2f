"""What the operators share: words, lineage cuts, Arrow text maps and a skew-safe lookup join."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters; bytes.split() cuts UTF-8 text alike.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one Arrow batch carries to a Python worker, and rows, so that long documents come one by one.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's own settings for what an Arrow batch holds, and those that replace them: without, 10,000 long texts travel at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", str(BATCH_ROWS)), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(BATCH_BYTES))}
#: Rows from which a key can be hot.
LEAST_HOT = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables. Only on one machine (master local), where none is set, it is a temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return folder or tempfile.mkdtemp(prefix="lodestone-")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and go on from there, so that a lost executor costs no rerun."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(f). Batches are bounded by BATCH, unless the caller's session has bounds of its own; Spark reads them when it runs the plan.

    Python workers live on after a task, beside those of later stages: what a task has freed goes back to the machine at its end.
    """
    conf = df.sparkSession.conf
    for k, (own, v) in BATCH.items():
        if conf.get(k) == own:
            conf.set(k, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return df.mapInArrow(run, schema)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, weight: str, spread: Sequence[str], total: int, how: str = "left", most: int = 50_000, least: int = LEAST_HOT) -> DataFrame:
    """Join rows to a lookup that has one line per key, however many rows share a key.

    lookup[weight] says how many rows hold the key. A key is hot above limit = max(least, total / most) rows, so there
    are at most `most` hot keys: that proves the size of the one table broadcast here. The rows of a hot key are
    dealt over ceil(weight / limit) salts by the hash of `spread`, and its lookup line is repeated for each salt.
    Keys are matched as `=` does: null keys meet nothing.
    """
    limit = max(least, total // most)
    if total <= limit:
        return rows.join(lookup.drop(weight), key, how)
    hot = lookup.filter(F.col(weight) > limit).select(key, F.ceil(F.col(weight) / limit).cast("int").alias("_salts"))
    one = F.coalesce("_salts", F.lit(1))
    many = lookup.drop(weight).join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_salts")
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), one).cast("int")).drop("_salts")
    return dealt.join(many, [key, "_salt"], how).drop("_salt")


#: Most rows of the table that sifted() broadcasts: 16 bytes each, 64 names to a row.
SIEVE_ROWS = 1 << 19


def sifted(rows: DataFrame, name: Column, wanted: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """rows in two parts without moving them: those whose name may be among wanted (one column, `count` distinct names), and those whose name surely isn't.

    Tests a broadcast table of bits by hashes of the names. It has at most SIEVE_ROWS rows, however many names there
    are; beyond some millions of names more rows pass for nothing, and that is all.
    """
    size = 1 << min(SIEVE_ROWS.bit_length() - 1, max(count // 4, 1).bit_length())
    word, bit, bits = unused(rows, "_word", "_bit", "_bits")
    split = lambda h: (F.pmod(h, F.lit(size)), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int"))
    at, which = split(F.xxhash64(wanted.columns[0]))
    table = wanted.select(at.alias(word), which.alias("b")).groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias(bits))
    at, which = split(F.xxhash64(name))
    tested = rows.withColumn(word, at).withColumn(bit, which).join(F.broadcast(table), word, "left")
    hit = F.coalesce(F.expr(f"shiftrightunsigned(`{bits}`, `{bit}`) & 1L = 1L"), F.lit(False))
    return tuple(tested.filter(x).select(*(F.col(f"`{c}`") for c in rows.columns)) for x in (hit, ~hit))
