"""Shared folder, intermediate tables and bounded Arrow batches for the text operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import ClassVar
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch at most; the kernels cut batches further by bytes.
BATCH_ROWS = 1024
#: Seconds after which the executors of a relieved() piece of work collect their garbage again, when a table is to be written.
RELIEF_SECONDS = 15


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only a local session may go without one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="tarnlake-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def small_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to BATCH_ROWS rows, so that a batch of long texts fits a Python worker."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def let_go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In a worker: forgets the words that the encoder has met, and gives what is free back to the system."""
    if (bpe := sys.modules.get(f"{__package__}.bpe")) is not None:
        bpe.WORDS = bpe.WordStore()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)
    yield from batches


def relieve(spark: SparkSession) -> None:
    """Has executors and their workers give back what former work has left: a heap grows with garbage and only a whole collection makes
    it smaller, and workers keep the words they have met. There is a task for each core; who gets none stays as it is."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).mapInArrow(let_go, "id long").select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


class Stash:
    """Tables written once under the shared folder: they cut lineage and survive lost executors. They are needed until the result
    that reads them has been written; temporary() tells which ones a piece of work has made, and close() removes them."""

    made: ClassVar[list[list[Stash]]] = []
    #: When the executors were relieved last; None outside of relieved().
    relieved_at: ClassVar[float | None] = None

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        for each in self.made:
            each.append(self)
        # Plans, broadcasts and tables of former work are let go before new work begins: the driver's memory is small.
        gc.collect()
        spark._jvm.System.gc()
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        small_batches(spark)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}"
        if Stash.relieved_at is not None and time.monotonic() - Stash.relieved_at > RELIEF_SECONDS:
            relieve(self.spark)
            Stash.relieved_at = time.monotonic()
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def _remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *names: str) -> None:
        """Removes tables that no later result reads."""
        for name in names:
            self._remove(f"{self.path}/{name}")

    def close(self) -> None:
        """Removes all tables."""
        self._remove(self.path)


@contextmanager
def relieved(spark: SparkSession) -> Iterator[None]:
    """Relieves the executors before and after a piece of work, and every RELIEF_SECONDS or so within: for works that follow each other
    in the same executors."""
    relieve(spark)
    outer, Stash.relieved_at = Stash.relieved_at, time.monotonic()
    try:
        yield
    finally:
        last, Stash.relieved_at = Stash.relieved_at, outer
    if time.monotonic() - last > RELIEF_SECONDS:
        relieve(spark)


@contextmanager
def temporary() -> Iterator[None]:
    """Removes, at the end, all tables that were made within."""
    mine: list[Stash] = []
    Stash.made.append(mine)
    try:
        yield
    finally:
        Stash.made.remove(mine)
        for stash in mine:
            stash.close()


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder URI, for files that executors write and read themselves."""
    if urlparse(uri).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, name: str, data) -> None:
    """Writes bytes (or an iterable of them) under another name and then renames, so that a retried task leaves one whole file."""
    fs, folder = open_folder(uri)
    fs.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        for x in [data] if isinstance(data, (bytes, bytearray, memoryview)) else data:
            out.write(x)
    fs.move(part, f"{folder}/{name}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
