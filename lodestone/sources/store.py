"""A stored table that is written as a whole or not at all: upserts and deletes in versions, from batches and from streams.

The table's rows lie in buckets by the hash of their keys, each bucket in a folder of its own. A write makes new folders for the
buckets that it touches, then a new manifest that names all folders; the manifest appears by one rename, so that a reader sees
the old version or the new one, and a job that dies before it leaves the old. The manifest also holds the last batch of each stream, so a batch that is
sent again changes nothing. All files are read and written by Spark and its file systems, never by the driver's own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import delete, upsert


class Conflict(RuntimeError):
    """Another writer has made the version that this one was to make; read again and retry."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    folders: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class Store:
    """Rows of `schema` by `keys`, the latest by `version` (columns, largest first) each. keep=False is the gate: nothing is ever written.

    buckets is fixed when the table is made: choose it so that a bucket stays well under an executor's memory share, as a write reads
    and writes whole buckets. The manifest is as long as the buckets are many, and is all that the driver reads.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], version: Sequence[str], buckets: int = 16, keep: bool = True):
        self.spark, self.path, self.schema, self.keys, self.order, self.buckets, self.keep = spark, path.rstrip("/"), schema, list(keys), list(version), buckets, keep
        self._files = spark._jvm.org.apache.hadoop.fs

    def _at(self, name: str):
        path = self._files.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, folder = self._at("_manifests")
        if not fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()[1:-5]) for f in fs.listStatus(folder) if f.getPath().getName().startswith("v"))

    def manifest(self, version: int | None = None) -> Manifest:
        found = self.versions()
        if version is None and not found:
            return Manifest()
        fs, path = self._at(f"_manifests/v{found[-1] if version is None else version:09d}.json")
        stream = fs.open(path)
        try:
            return Manifest(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the latest version, or of an earlier one that vacuum() has left."""
        return self._rows(self.manifest(version).folders.values())

    def _rows(self, folders) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k) for k in self.keys)), F.lit(self.buckets)).cast("int")

    def _commit(self, old: Manifest, rows: DataFrame, touched: list[int], stream: str | None, batch: int) -> int:
        name = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        fs, folder = self._at(name)
        made = {s.getPath().getName().partition("=")[2]: f"{name}/{s.getPath().getName()}" for s in fs.listStatus(folder) if s.isDirectory()}
        folders = {b: f for b, f in old.folders.items() if int(b) not in touched} | made
        new = Manifest(old.version + 1, folders, old.batches | ({stream: batch} if stream else {}))
        self._publish(new)
        return new.version

    def _publish(self, new: Manifest) -> None:
        """The one step that makes a version: a rename, which fails where the version is there already."""
        fs, draft = self._at(f"_drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(json.dumps(new.__dict__).encode())
        out.close()
        _, path = self._at(f"_manifests/v{new.version:09d}.json")
        fs.mkdirs(path.getParent())
        if fs.exists(path) or not fs.rename(draft, path):
            fs.delete(draft, False)
            raise Conflict(f"version {new.version} of {self.path} is there already")

    def upsert(self, rows: DataFrame, stream: str | None = None, batch: int = 0) -> int | None:
        """The new version; None where nothing is kept, or a stream's batch is there already. Of equal versions of a key the new row holds."""
        old = self.manifest()
        if not self.keep or (stream and old.batches.get(stream, -1) >= batch):
            return None
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema.fields))
        touched = [r.b for r in rows.select(self._bucket().alias("b")).distinct().collect()]  # at most `buckets` numbers
        held = self._rows(f for b, f in old.folders.items() if int(b) in touched)
        return self._commit(old, upsert(held, rows, self.keys, [F.col(c) for c in self.order]), touched, stream, batch)

    def delete(self, condition: Column) -> tuple[int | None, int]:
        """The new version (None if no row goes) and how many rows went; buckets without such a row stay as they are."""
        old = self.manifest()
        gone = self._rows(old.folders.values()).filter(F.coalesce(condition, F.lit(False))).groupBy(self._bucket().alias("b")).count().collect()
        if not gone or not self.keep:
            return None, 0
        touched = [r.b for r in gone]
        kept, _ = delete(self._rows(f for b, f in old.folders.items() if int(b) in touched), condition)
        return self._commit(old, kept, touched, None, 0), sum(r["count"] for r in gone)

    def sink(self, stream: str) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: each micro-batch is one version, once, even if it is sent again after a failure."""

        def write(rows: DataFrame, batch: int) -> None:
            self.upsert(rows, stream, batch)

        return write

    def vacuum(self, keep_versions: int = 1) -> int:
        """Remove all but the last versions and the folders that none of them names, those of failed writes too; how many folders went. No writer may be at work."""
        found = self.versions()
        last = found[-max(1, keep_versions) :]
        named = {f.split("/")[1] for v in last for f in self.manifest(v).folders.values()}
        for v in found[: len(found) - len(last)]:
            fs, path = self._at(f"_manifests/v{v:09d}.json")
            fs.delete(path, False)
        fs, folder = self._at("data")
        stale = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in named] if fs.exists(folder) else []
        for path in stale:
            fs.delete(path, True)
        return len(stale)
