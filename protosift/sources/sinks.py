"""Text outputs of the jobs, written by all tasks in parallel.

The caller names the folder; any other format is one ``df.write`` away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protosift.sources.text import to_line


def write_quality(quality: DataFrame, path: str) -> None:
    """Lines ``id,quality``."""
    quality.select("id", "quality").write.csv(path)


def write_approximations(approximations: DataFrame, path: str) -> None:
    """Lines ``id,upper,lower``."""
    approximations.select("id", "upper", "lower").write.csv(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Lines ``(id,actual,predicted)``; a missing number is empty."""
    numbers = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "actual", "predicted")]
    pair = F.concat(F.lit("("), F.concat_ws(",", *numbers), F.lit(")"))
    predictions.select(pair.alias("value")).write.text(path)


def write_rows(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """The kept lines, or the listed columns as lines."""
    value = to_line(*columns) if columns else F.col("line")
    rows.select(value.alias("value")).write.text(path)


def write_report(report: DataFrame, path: str) -> None:
    """Lines ``quality,rmse,size`` under a header, best threshold first."""
    lines = report.select(F.col("threshold").alias("quality"), "rmse", "size")
    lines.coalesce(1).orderBy(F.desc("quality")).write.csv(path, header=True)
