"""Intermediate tables as Parquet files in the session's shared folder."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Hashable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 21


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one in the
    warehouse, which executors share as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints").rstrip("/")


class Scratch:
    """Tables of one run. They are written, reread, and dropped when done with.

    A reread table has no lineage: a lost executor costs no more than the tasks
    it was running.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.folder}/{self.count}-{name}"

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Delete files of tables that no later step reads."""
        for table in tables:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold ``BATCH_BYTES`` at most (a row is
    never cut), unless it has a limit of its own. By rows alone a batch of long texts
    takes tens of megabytes outside the heap, which an executor does not give back."""
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each key, one key at a time, from batches ordered by the keys."""
    held, key = [], None
    for batch in batches:
        values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        begin = 0
        for i in range(1, len(values) + 1):
            if i < len(values) and values[i] == values[begin]:
                continue
            if held and values[begin] != key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, i - begin))
            key, begin = values[begin], i
    if held:
        yield pa.Table.from_batches(held)


def once_in_worker(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in a Python worker and kept for later tasks.

    Functions travel to tasks with copies of their modules' variables, so it is
    the worker's main module that remembers.
    """
    kept = vars(sys.modules["__main__"]).setdefault("_kept_in_worker", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def forget_in_worker(*keep: Hashable) -> None:
    """Let go of what earlier tasks kept in this worker, but for the keys named, and
    of memory that Arrow and the C library hold ready."""
    kept = vars(sys.modules["__main__"]).get("_kept_in_worker", {})
    for key in set(kept) - set(keep):
        del kept[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
        if trim:
            trim(0)
