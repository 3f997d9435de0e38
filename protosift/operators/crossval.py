"""Error of kNN prediction by cross-validation over id folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protosift.functions.fuzzy import fold_of
from protosift.operators.neighbours import Weighting, knn_predict
from protosift.plans.tiles import TileSettings
from protosift.spec import RowSpec


def rmse_by_fold(
    prototypes: DataFrame,
    full: DataFrame,
    spec: RowSpec,
    k: int,
    *,
    folds: int = 10,
    weighting: str | Weighting = "reference",
    on_empty: str = "own_label",
    scaling: str | None = None,
    jaccard: str = "equal",
    settings: TileSettings = TileSettings(),
) -> DataFrame:
    """``fold, rmse, n_rows``: every row of ``full`` is predicted from the
    prototypes of the other folds."""
    predicted = knn_predict(
        full,
        prototypes,
        spec,
        k,
        weighting=weighting,
        on_empty=on_empty,
        folds=folds,
        scaling=scaling,
        jaccard=jaccard,
        settings=settings,
    ).where("predicted is not null")
    error = F.col("predicted") - F.col("actual")
    return (
        predicted.groupBy(fold_of(F.col("id"), folds).alias("fold"))
        .agg(F.sum(error * error).alias("_sum"), F.count(F.lit(1)).alias("n_rows"))
        .select("fold", F.sqrt(F.col("_sum") / F.col("n_rows")).alias("rmse"), "n_rows")
    )


def rmse_cv(
    prototypes: DataFrame, full: DataFrame, spec: RowSpec, k: int, *, folds: int = 10, **options
) -> DataFrame:
    """One row ``rmse, n_folds``: fold errors added up and divided by ``folds``,
    also when fewer folds have rows."""
    each = rmse_by_fold(prototypes, full, spec, k, folds=folds, **options)
    return each.agg(
        (F.sum("rmse") / F.lit(float(folds))).alias("rmse"), F.count(F.lit(1)).alias("n_folds")
    )


def rmse_cv_scaled(df: DataFrame, spec: RowSpec, k: int, *, folds: int = 10, **options) -> DataFrame:
    """One row ``rmse, n_folds``: range-scaled attributes, mean over the folds present."""
    each = rmse_by_fold(df, df, spec, k, folds=folds, scaling="range", **options)
    return each.agg(F.avg("rmse").alias("rmse"), F.count(F.lit(1)).alias("n_folds"))
