"""Bounded samples of labelled rows, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def learnable(id_col: str) -> Column:
    """Rows to learn from: the crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def bounded_sample(rows: DataFrame, label: str, key: str, limit: int, salt: int = 1) -> DataFrame:
    """About ``limit`` rows at most of every label, picked by a hash of the key.

    The picking threshold of each label follows from how many rows it has, so no
    ordering or limit passes rows through one task. Rows that agree in label and
    key are picked together but only one of them stays.
    """
    place = F.shiftrightunsigned(F.xxhash64(F.lit(salt), key), 11) / F.lit(float(2**53))
    usable = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    counts = usable.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    keep = F.col("rows") * place < F.lit(float(limit))
    return usable.join(F.broadcast(counts), label).where(keep).drop("rows").dropDuplicates([label, key])
