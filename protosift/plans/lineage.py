"""Cutting lineage so that several jobs can share one intermediate table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one in the
    warehouse, which executors share as well."""
    folder = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints").rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the folder the session names.

    The folder is ``spark.checkpoint.dir``, which has to be shared storage so
    that the files outlive executors. Where it is unset they go to the warehouse,
    which is shared as well.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def cut_and_observe(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """As ``cut_lineage``, with aggregates of all rows that are seen on the way.

    They cost no pass of their own. A task that is run again may add to sums and
    counts once more, so these only serve to cut the work; least and greatest
    values are exact.
    """
    seen = Observation()
    kept = cut_lineage(df.observe(seen, *[c.alias(name) for name, c in metrics.items()]))
    return kept, seen.get


def shuffles(df: DataFrame) -> bool:
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def reusable(df: DataFrame) -> DataFrame:
    """``df`` for several passes: a plan that shuffles is computed only once.

    A plain scan is left alone, as reading its few columns again is cheaper
    than writing them.
    """
    return cut_lineage(df) if shuffles(df) else df
