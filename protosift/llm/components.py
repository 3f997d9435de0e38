"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protosift.llm.scratch import Scratch


def _state(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (id, component_id) for every id that is in a link (a, b).

    ``component_id`` is the smallest id that links reach. Every round hangs the
    larger neighbours of a node on its smallest neighbour, then the smaller
    ones, until nothing changes; rounds grow with the logarithm of the
    longest path. Links are only ever joined and grouped by node, with minima
    combined before they are shuffled, so a node with many links is no burden.
    Null ends and links of an id with itself are ignored.
    """
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = scratch.keep(ends.where("u <> v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(hung, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = (
            large.join(least, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        small = scratch.keep(hung, "small")
        scratch.drop(edges, large)
        edges, after = small, _state(small)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return stars.unionByName(roots)
