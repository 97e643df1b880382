"""What the operators share: tables in the cluster's shared folder, and the code that executors need."""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
#: Groups that hold at least one row in so many are hot; there can't be more of them than this, so they are broadcast.
HOT = 4096
#: Rows may be blobs of megabytes: row groups are small, so that neither a writer nor a reader holds many of them.
_ROWS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "8"}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    into = Path(tempfile.mkdtemp())
    copy = into / "tree" / package.name
    shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(into / package.name), "zip", into / "tree"))
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset (tests), a new local folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_quire_folder", None)
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = sc._quire_folder = "file://" + tempfile.mkdtemp()
    return found


class Scratch:
    """Tables of one operator call in the shared folder: they cut the lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/quire-{name}-{uuid.uuid4().hex}"
        self.n = 0
        ship(spark)
        at = self._path(self.root)
        at.getFileSystem(self._hadoop()).deleteOnExit(at)  # what is left of it ends with the application

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _hadoop(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def cut(self, df: DataFrame) -> DataFrame:
        """Writes df and reads it again; the shuffle files behind it can go."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        schema = df.schema
        before = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.options(**_ROWS).parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEAN)
            else:
                self.spark.conf.set(_CLEAN, before)
        del df
        gc.collect()
        out = self.spark.read.schema(schema).parquet(path)
        out._quire_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for t in tables:
            p = self._path(t._quire_path)
            p.getFileSystem(self._hadoop()).delete(p, True)


def buckets(spark: SparkSession) -> int:
    """How many buckets a packed shuffle has: as many as the session's shuffle partitions, so it is sized with the data."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def to_group(rows: DataFrame, groups: DataFrame, keys: list[str], copies: str, total: int) -> DataFrame:
    """rows joined to the one row of groups that has their keys; copies names the column with how many rows that is.

    Hot groups are broadcast, so their rows stay where they are; the rest, of which none is large, is shuffled.
    """
    values = [c for c in groups.columns if c not in (*keys, copies)]
    hot = groups.filter(F.col(copies) >= -(-total // HOT)).select(*keys, *(F.col(c).alias(f"_{c}") for c in values), F.lit(True).alias("_hot"))
    near = rows.join(F.broadcast(hot), keys, "left")
    far = near.filter("_hot is null").select(*rows.columns).join(groups.drop(copies), keys)
    return near.filter("_hot").select(*rows.columns, *(F.col(f"_{c}").alias(c) for c in values)).unionByName(far.select(*rows.columns, *values))


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, which gives its worker's memory back when a task ends: workers live on, and one for each core adds up."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return inner


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return
