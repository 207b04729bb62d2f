"""Python over Arrow batches of bounded size, whatever the length of the texts in them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes that Python objects are made of at once. Spark's own batches hold up to 10,000 rows or 64 MB.
ROWS, BYTES = 1_000, 1 << 18
#: Spark's own bounds on what travels to Python at once, and those that replace them.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ROWS rows and about BYTES bytes; a longer row is a slice of its own."""
    step = max(1, min(ROWS, batch.num_rows * BYTES // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        if part.num_rows > 1 and part.nbytes > 2 * BYTES:  # long rows lie together
            yield from pieces(part)
        else:
            yield part


def freed() -> None:
    """Workers live on after a task, beside those of later stages: what a task has freed goes back to the machine."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def bounded(df: DataFrame) -> None:
    """From now on the session's batches hold what BATCH says, unless it has bounds of its own; Spark reads them when it runs a plan."""
    conf = df.sparkSession.conf
    for k, (own, v) in BATCH.items():
        if conf.get(k) == own:
            conf.set(k, v)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df over as many partitions as its session's shuffles have, or as there are cores: for rows that cost far more than their few bytes let Spark expect."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def map_pieces(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(f), where f gets its rows, in order, in pieces() and gives a batch for each."""
    bounded(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(part for b in batches for part in pieces(b))
        freed()

    return df.mapInArrow(run, schema)
