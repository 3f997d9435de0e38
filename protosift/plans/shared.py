"""A table that tasks read file by file from the shared folder.

For jobs in which every task goes over the whole table: it is written once, each
task reads the files it needs, and no copy of a row is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import pyarrow.parquet
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protosift.plans.lineage import shared_folder


@dataclass(frozen=True)
class SharedTable:
    """``files`` holds a line per file in the order of the table: its ``uri`` and
    the aggregates asked for."""

    spark: SparkSession
    folder: str
    files: pd.DataFrame

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def share(df: DataFrame, order: list[Column], files: int, aggregates: list[Column]) -> SharedTable:
    """Write ``df`` to about ``files`` files, each a range of ``order``."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    placed = df.repartitionByRange(files, *order) if files > 1 else df.coalesce(1)
    placed.sortWithinPartitions(*order).write.option("maxRecordsPerFile", 0).parquet(folder)
    # One row per file.
    found = (
        spark.read.schema(df.schema).parquet(folder)
        .groupBy(F.input_file_name().alias("uri"))
        .agg(*aggregates)
        .toPandas()
    )
    number = found["uri"].str.extract(r"part-(\d+)-", expand=False).astype("int64")
    return SharedTable(spark, folder, found.iloc[number.argsort(kind="stable")].reset_index(drop=True))


def read_file(uri: str) -> pd.DataFrame:
    store, path = fs.FileSystem.from_uri(uri)
    return pyarrow.parquet.read_table(path, filesystem=store, use_threads=False).to_pandas()


class Reader:
    """Files of a shared table as ``make`` arranges them, kept while they are few."""

    def __init__(self, uris: list[str], rows: list[int], most_rows: int, make: Callable[[pd.DataFrame], object]):
        self.uris, self.make = uris, make
        self.room = most_rows if sum(rows) <= most_rows else 0
        self.kept: dict[int, object] = {}

    def __getitem__(self, i: int):
        if i in self.kept:
            return self.kept[i]
        part = self.make(read_file(self.uris[i]))
        if not self.room:
            self.kept.clear()
        self.kept[i] = part
        return part
