"""Profiles: one row for all rows that share the same key columns.

Copies have the same distance to everything, so the pairwise jobs run on
profiles and the results are handed back to the rows afterwards. Both steps
stay even when one profile stands for a large share of the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protosift.plans.lineage import cut_and_observe

RID = "_rid"
COPIES = "_copies"

# At most this many profiles can be called hot, so their list is always small.
MAX_HOT = 1024
HOT_FLOOR = 200_000


@dataclass(frozen=True)
class Profiles:
    df: DataFrame
    keys: tuple[str, ...]
    rows: int
    source_rows: int
    most_copies: int

    @property
    def hot_limit(self) -> int:
        return max(HOT_FLOOR, self.source_rows // MAX_HOT)


def profiles_of(df: DataFrame, keys, id: str, *aggregates: Column) -> Profiles:
    """Group by ``keys``; the lowest id names the profile.

    The aggregate combines on the map side, so a key with very many copies
    sends one row per map task.
    """
    grouped, seen = cut_and_observe(
        df.groupBy(*keys).agg(
            F.min(id).alias(RID), F.count(F.lit(1)).alias(COPIES), *aggregates
        ),
        rows=F.count(F.lit(1)),
        source=F.coalesce(F.sum(COPIES), F.lit(0)),
        most=F.coalesce(F.max(COPIES), F.lit(0)),
    )
    return Profiles(grouped, tuple(keys), seen["rows"], seen["source"], seen["most"])


def hand_back(rows: DataFrame, id: str, results: DataFrame, profiles: Profiles, *keep: str) -> DataFrame:
    """Give every row the result of its profile; rows without one get nulls.

    ``results`` holds one row per profile id at most. ``keep`` names its
    columns to carry over.
    """
    keys = list(profiles.keys)
    named = profiles.df.select(*keys, COPIES, RID).join(results.select(RID, *keep), RID, "left")
    if profiles.most_copies <= profiles.hot_limit:
        return rows.join(named.drop(RID, COPIES), keys, "left")

    # Every hot profile has more than 1/MAX_HOT of all rows: MAX_HOT at most.
    limit = profiles.hot_limit
    salts = F.ceil(F.col(COPIES) / F.lit(limit)).cast("int")
    hot = profiles.df.where(F.col(COPIES) > limit).select(*keys, salts.alias("_salts"))
    spread = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt",
        F.coalesce(F.pmod(F.xxhash64(id), F.col("_salts")), F.lit(0)).cast("int"),
    )
    copied = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return spread.join(copied, [*keys, "_salt"], "left").drop("_salt", "_salts", RID, COPIES)
