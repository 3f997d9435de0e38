"""Choosing prototypes by a quality threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protosift.functions.fuzzy import fold_of
from protosift.operators.approximation import quality_hml
from protosift.operators.conflicts import quality_powa
from protosift.operators.neighbours import STEP, Weighting, predictions_by_step, predictions_of, search
from protosift.plans.lineage import cut_and_observe, cut_lineage, reusable
from protosift.plans.profiles import hand_back
from protosift.plans.tiles import TileSettings
from protosift.spec import RowSpec

ERROR_DECIMALS = 9


def join_quality(df: DataFrame, quality: DataFrame, spec: RowSpec) -> DataFrame:
    """Rows with their quality; rows without one are dropped."""
    return df.join(quality.withColumnRenamed("id", spec.id), spec.id, "inner")


def select_prototypes(
    df: DataFrame, quality: DataFrame, spec: RowSpec, threshold: float
) -> DataFrame:
    """Rows of ``df``, as they are, whose quality reaches the threshold."""
    kept = quality.where(F.col("quality") >= F.lit(threshold)).select(F.col("id").alias(spec.id))
    return df.join(kept, spec.id, "left_semi")


def threshold_sweep(
    df: DataFrame,
    quality: DataFrame,
    spec: RowSpec,
    k: int,
    *,
    steps: int = 10,
    folds: int = 10,
    weighting: str | Weighting = "reference",
    on_empty: str = "own_label",
    jaccard: str = "equal",
    settings: TileSettings = TileSettings(),
) -> DataFrame:
    """``threshold, rmse, n_folds, size`` for thresholds from the best quality
    down to the lowest in ``steps`` equal steps (one threshold if all are equal).

    The prototype sets are nested, so one search serves all thresholds: each
    prototype is compared once and counts from the first threshold it reaches.
    """
    tests = reusable(spec.conform(df))
    rated, seen = cut_and_observe(
        join_quality(tests, quality.select("id", F.col("quality").alias("_quality")), spec),
        low=F.min("_quality"),
        high=F.max("_quality"),
    )
    low, high = seen["low"], seen["high"]
    if low is None:
        raise ValueError("no row has a quality")
    step = (high - low) / steps
    thresholds = [high - i * step for i in range(steps)] + [low] if high > low else [high]
    cases = "".join(f" WHEN _quality >= ({t!r}D) THEN {i}" for i, t in enumerate(thresholds[:-1]))
    last = len(thresholds) - 1
    prototypes = rated.withColumn(STEP, F.expr(f"CASE{cases} ELSE {last} END" if cases else "0"))
    result = search(
        tests, prototypes, spec, k, folds=folds, steps=len(thresholds), jaccard=jaccard,
        settings=settings,
    )
    steps_of = range(len(thresholds))
    names = [f"_at_{i}" for i in steps_of]
    if len(thresholds) > 1:
        predicted = predictions_by_step(result.found, weighting, names)
    else:
        predicted = predictions_of(result.found, weighting).withColumnRenamed("predicted", names[0])
    rows = hand_back(result.tests, spec.id, predicted, result.profiles, *names)
    fallback = f"coalesce(_at_{{}}, `{spec.label}`)" if on_empty == "own_label" else "_at_{}"
    squares = [f"power({fallback.format(i)} - `{spec.label}`, 2)" for i in steps_of]
    by_fold = rows.groupBy(fold_of(F.col(spec.id), folds).alias("_of")).agg(
        *[F.expr(f"sqrt(avg({square})) AS _at_{i}") for i, square in enumerate(squares)]
    )
    # One row per threshold; the sizes are running counts over the steps.
    sizes = prototypes.selectExpr(
        f"array({', '.join(f'count_if({STEP} <= {i})' for i in steps_of)}) AS _sizes"
    ).scalar()
    lines = ", ".join(
        f"""struct({t!r}D AS threshold, sum(_at_{i}) / {folds}D AS rmse,
                   count(_at_{i}) AS n_folds, {i} AS _line)"""
        for i, t in enumerate(thresholds)
    )
    return (
        by_fold.selectExpr(f"array({lines}) AS _lines")
        .select(F.inline("_lines"))
        .select("threshold", "rmse", "n_folds", F.get(sizes, F.col("_line")).alias("size"))
    )


def best_threshold(report: DataFrame) -> DataFrame:
    """The report line with the least error; of equals the highest threshold.

    Errors are compared to nine decimals: equal sets of prototypes can differ in
    the last bits, as doubles are added in any order.
    """
    error = F.round("rmse", ERROR_DECIMALS).asc_nulls_last()
    return report.orderBy(error, F.col("threshold").desc()).limit(1)


def choose_prototypes(
    df: DataFrame,
    spec: RowSpec,
    k: int,
    quality: str | DataFrame = "hml",
    *,
    numeric_only: bool = False,
    blocks: int = 1,
    jaccard: str = "equal",
    **sweep,
) -> tuple[DataFrame, DataFrame, float]:
    """Quality, sweep and selection in one go: kept rows, report and threshold.

    ``quality`` is ``"hml"``, ``"powa"`` or a table ``id, quality`` from before.
    """
    if isinstance(quality, str):
        if quality == "hml":
            quality = quality_hml(df, spec, numeric_only=numeric_only, jaccard=jaccard)
        elif quality == "powa":
            quality = quality_powa(df, spec, blocks=blocks, jaccard=jaccard)
        else:
            raise ValueError(f"unknown quality {quality!r}")
        quality = cut_lineage(quality)
    report = cut_lineage(threshold_sweep(df, quality, spec, k, jaccard=jaccard, **sweep))
    threshold = best_threshold(report).first()["threshold"]
    return select_prototypes(df, quality, spec, threshold), report, threshold
