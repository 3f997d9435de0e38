"""Column statistics and the two scalings built on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protosift.plans.lineage import cut_and_observe, reusable, shuffles
from protosift.spec import RowSpec


def column_ranges(df: DataFrame, spec: RowSpec) -> DataFrame:
    """One row, ``<column>_range`` = maximum - minimum of each numeric column."""
    return df.selectExpr(*[f"max(`{c}`) - min(`{c}`) AS `{c}_range`" for c in spec.numeric])


def column_minmax(df: DataFrame, spec: RowSpec) -> DataFrame:
    """One row, ``<column>_min`` and ``<column>_max`` of numerics and the label."""
    columns = [*spec.numeric, spec.label]
    return df.selectExpr(
        *[f"{f}(`{c}`) AS `{c}_{f}`" for f in ("min", "max") for c in columns]
    )


@dataclass(frozen=True)
class Bounds:
    """Least and greatest value of each column, read in one pass as one row."""

    low: dict[str, float]
    high: dict[str, float]

    @staticmethod
    def of(df: DataFrame, columns) -> Bounds:
        columns = list(columns)
        if not columns:
            return Bounds({}, {})
        return Bounds._from(columns, df.agg(*[c.alias(n) for n, c in _edges(columns).items()]).first().asDict())

    @staticmethod
    def _from(columns: list[str], edges: dict) -> Bounds:
        low, high = ([edges[f"{e}_{i}"] for i in range(len(columns))] for e in ("low", "high"))
        return Bounds(dict(zip(columns, low)), dict(zip(columns, high)))


def _edges(columns: list[str]) -> dict[str, Column]:
    return {
        f"{name}_{i}": edge(F.col(c).cast("double"))
        for i, c in enumerate(columns)
        for name, edge in (("low", F.min), ("high", F.max))
    }


def reusable_with_bounds(df: DataFrame, columns) -> tuple[DataFrame, Bounds]:
    """``df`` for several passes and the bounds of its columns, seen while it is kept."""
    columns = list(columns)
    if not columns or not shuffles(df):
        return reusable(df), Bounds.of(df, columns)
    kept, seen = cut_and_observe(df, **_edges(columns))
    return kept, Bounds._from(columns, seen)


def scale(
    df: DataFrame, spec: RowSpec, mode: str | None, bounds: Bounds | None = None
) -> DataFrame:
    """Scale numeric attributes; a constant column becomes 0.

    ``"range"`` divides by the range. ``"minmax"`` maps to [0, 1] and does the
    same to the label. ``None`` leaves everything as it is. ``bounds`` are
    those of ``df`` itself unless given.
    """
    if mode is None:
        return df
    if mode not in ("range", "minmax"):
        raise ValueError(f"unknown scaling {mode!r}")
    columns = list(spec.numeric) + ([spec.label] if mode == "minmax" else [])
    bounds = bounds or Bounds.of(df, columns)

    def scaled(c: str) -> str:
        lo, hi = bounds.low[c], bounds.high[c]
        if lo is None or not hi > lo:
            return f"0D AS `{c}`"
        value = f"CAST(`{c}` AS double)"
        value = value if mode == "range" else f"({value} - ({lo!r}D))"
        return f"{value} / ({hi - lo!r}D) AS `{c}`"

    return df.selectExpr(*[scaled(c) if c in columns else f"`{c}`" for c in df.columns])
