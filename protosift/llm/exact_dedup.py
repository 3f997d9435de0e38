"""Exact deduplication by a tree-merge of sorted digest runs.

Each partition of the input gives a run: its texts' digests in order, each with the
identifier that stays and the number of copies. In every round partitions exchange
runs with those whose numbers differ in the round's bits and merge what
they get, keeping the largest identifier of equal texts. Partition ``p`` ends up
with the digests that belong to ``p``, so the runs stay spread over all partitions;
and since a run holds a text once, a task never gets more than ``fan_in`` entries
of a text, however many copies it has. On the way back an entry of a first run
learns what stays from the last run, and its rows from the entry.

Entries are merged only if they are verified to be the same text: besides the digest
their lengths in bytes and a second, independent hash have to agree. Texts that
share a digest by chance stay apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protosift.llm.scratch import Scratch

# What makes two entries the same text, and where its entry belongs.
TEXT = ["_digest", "_length", "_second", "_home"]


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class ExactDedup:
    """Rows with equal texts, and the one of them that stays.

    Texts are compared as they are; null counts as empty. Of equal texts the row
    with the largest id stays; a null id is below all others, and of rows with the
    same text and id the last one read stays. Ids may repeat. Other columns are not
    read, and an empty table gives an empty result. ``fan_in`` runs are merged at a
    time (a power of two); ``most_runs`` bounds their number (input partitions
    beyond it share runs).
    """

    def __init__(
        self,
        *,
        fan_in: int = 8,
        most_runs: int = 1 << 14,
        digest: Callable[[Column], Column] = sha256,
    ):
        if fan_in < 2 or fan_in & (fan_in - 1) or most_runs < 1:
            raise ValueError("fan_in has to be a power of two, and most_runs at least 1")
        self.bits, self.most_runs, self.digest = fan_in.bit_length() - 1, most_runs, digest

    def groups(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
        """``id, keep_id, group_size, kept, digest`` of every row."""
        scratch = Scratch(docs.sparkSession, "exact-dedup")
        rows = scratch.keep(self._digests(docs, id, text), "rows")
        # One number: the last partition of the input.
        last_run = rows.agg(F.max("_run")).first()[0] or 0
        depth = min(last_run.bit_length(), (self.most_runs - 1).bit_length())
        runs = 1 << depth
        homed = rows.withColumn("_home", F.pmod(F.xxhash64("_digest"), F.lit(runs)).cast("int"))
        homed = homed.withColumn("_run", F.pmod("_run", F.lit(runs)).cast("int"))
        best = F.struct(F.col("id"), F.col("_row"))
        first = scratch.keep(
            homed.groupBy("_run", *TEXT).agg(F.max(best).alias("_keep"), F.count(F.lit(1)).alias("_copies")), "run"
        )
        merged = first
        for level in range(0, depth, self.bits):
            merged = self._exchange(merged, min(level + self.bits, depth), runs)
        last = merged.select(*TEXT, F.col("_keep").alias("_stays"), F.col("_copies").alias("group_size"))
        # An entry of the first runs finds its text in the last ones, a row its entry:
        # a text has at most one entry in a run, so no key of either join is hot.
        known = first.select("_run", *TEXT).join(last, TEXT)
        return (
            homed.join(known, ["_run", *TEXT], "left")
            .select(
                "id",
                F.col("_stays.id").alias("keep_id"),
                "group_size",
                (F.col("_row") == F.col("_stays._row")).alias("kept"),
                F.col("_digest").alias("digest"),
            )
        )

    def _digests(self, docs: DataFrame, id: str, text: str) -> DataFrame:
        """One row per document without its text."""
        whole = F.coalesce(F.col(text), F.lit(""))
        return docs.select(
            F.col(id).alias("id"),
            F.monotonically_increasing_id().alias("_row"),
            F.spark_partition_id().alias("_run"),
            self.digest(whole).alias("_digest"),
            F.octet_length(whole).alias("_length"),
            F.xxhash64(whole).alias("_second"),
        )

    def _exchange(self, runs: DataFrame, level: int, count: int) -> DataFrame:
        """One round: the partitions that differ in bits below ``level`` split their
        digests among them, and each merges the sorted runs that it gets."""
        low = (1 << level) - 1
        place = F.col("_run").bitwiseAND(F.lit(~low)).bitwiseOR(F.col("_home").bitwiseAND(F.lit(low)))
        return (
            runs.withColumn("_run", place)
            .repartitionById(count, "_run")
            .sortWithinPartitions("_run", *TEXT)
            .groupBy("_run", *TEXT)
            .agg(F.max("_keep").alias("_keep"), F.sum("_copies").alias("_copies"))
        )
