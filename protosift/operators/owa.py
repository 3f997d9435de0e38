"""Ordered weighted average with harmonic weights.

The r-th smallest of n values weighs ``1 / (r * H_n)``: a soft minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protosift.functions.harmonic import run_weight
from protosift.plans.lineage import cut_lineage


def owa(
    df: DataFrame,
    by: list[str],
    value: str,
    *,
    count: str | None = None,
    result: str = "owa",
) -> DataFrame:
    """One row per group of ``by``: its average, number of values, least and greatest.

    Equal values are merged first (``count`` names a column of multiplicities).
    Ranking is spread over the cluster even inside one group: rows are placed
    by ranges of (group, value), ranked within their partition, and shifted by
    the counts of the partitions before, of which a group has as many as there
    are partitions.
    """
    n = F.sum(count) if count else F.count(F.lit(1))
    merged = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(n.alias("_n"))
    )
    # Range bounds are sampled, so the placement is fixed before it is read twice.
    placed = cut_lineage(
        merged.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id())
    )
    part_totals = placed.groupBy(*by, "_part").agg(F.sum("_n").alias("_in_part"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = part_totals.select(
        *by, "_part", F.coalesce(F.sum("_in_part").over(earlier), F.lit(0)).alias("_shift")
    )
    within = Window.partitionBy("_part", *by).orderBy("_v")
    ranked = (
        placed.withColumn(
            "_local", F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
        )
        .join(shifts, [*by, "_part"])
        .withColumn("_before", F.col("_local") + F.col("_shift"))
        .withColumn("_weight", run_weight("_before", "_n"))
    )
    return ranked.groupBy(*by).agg(
        (F.sum(F.col("_v") * F.col("_weight")) / F.sum("_weight")).alias(result),
        F.sum("_n").alias("n_values"),
        F.min("_v").alias("least"),
        F.max("_v").alias("greatest"),
    )
