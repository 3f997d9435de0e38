"""Fuzzy-rough lower and upper approximations and the quality built on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protosift.functions.fuzzy import DEFAULT_CUTS, Memberships, three_classes
from protosift.operators.stats import reusable_with_bounds, scale
from protosift.plans.approximate import LEAST_APPROXIMATED, LEAST_NUMBERS, Approximation, Ordered
from protosift.plans.blocks import Held
from protosift.plans.profiles import RID, hand_back, profiles_of
from protosift.plans.tiles import Reach, TileSettings, compare
from protosift.spec import RowSpec


def _least_of_greatest(
    rows: DataFrame,
    spec: RowSpec,
    degrees: dict[str, Column],
    jaccard: str,
    settings: TileSettings,
) -> DataFrame:
    """``min over b of max(1 - similarity(a, b), degree(b))`` for every row a.

    A row is its own neighbour at distance 0, so its own degree bounds the
    result from above. Only held rows with a lower degree, in cells nearer than
    the bound, can improve it; a row whose bounds are all 0 is never sent out.
    """
    names = list(degrees)
    # 1 - similarity is never below 0, so neither is the result: memberships
    # outside [0, 1] are floored before a row's own degree bounds anything.
    own = rows.withColumns({n: F.greatest(F.lit(0.0), c) for n, c in degrees.items()})
    found = profiles_of(own, spec.attributes, spec.id, *[F.min(c).alias(c) for c in names])
    table = found.df.select(RID, *spec.attributes, *names)

    def least_seen(
        distances: np.ndarray, probes: dict, batch: dict, seen: np.ndarray | None
    ) -> np.ndarray:
        best = np.stack([batch[c] for c in names], axis=1)
        best = best if seen is None else np.minimum(best, seen[:, :, 0])
        reached = [np.maximum(distances, probes[c][None, :]).min(axis=1, initial=np.inf) for c in names]
        return np.minimum(best, np.stack(reached, axis=1) + 1e-9)[:, :, None]

    def relevant(least: np.ndarray, bound: np.ndarray, cells: dict) -> np.ndarray:
        need = np.zeros(least.shape, bool)
        for q, c in enumerate(names):
            floor = np.maximum(least, cells[f"_least_{c}"][None, :])
            need |= np.maximum(floor, 0.0) < bound[:, q, None]
        return need

    def tighten(found: DataFrame) -> DataFrame:
        reached = [(F.min(c) + F.lit(1e-9)).alias(f"_bound_{i}") for i, c in enumerate(names)]
        return found.groupBy(RID).agg(*reached)

    reach = Reach(
        least_seen, relevant, [f"_bound_{i}" for i in range(len(names))], {f"_least_{c}": c for c in names},
        len(names), tighten=tighten,
    )

    def kernel(rows: pd.DataFrame):
        held = Held(spec, rows)
        degree = rows[names].to_numpy("float64").T.copy()
        many = len(spec.numeric) >= LEAST_NUMBERS and spec.prunable and not spec.distance
        cells = Approximation(held) if many and len(rows) >= LEAST_APPROXIMATED else None
        ordered = [Ordered(cells, d) for d in degree] if cells else []

        def reduce_many(batch):
            out = batch[names].to_numpy("float64").T.copy()
            for some, best in zip(ordered, out):
                # Only rows that a held row can improve, those of about one bound together.
                at = best.argsort(kind="stable")
                at = at[best[at] > some.degree[0]]
                if len(at):
                    best[at] = some.least_of_greatest(held.seen_from(batch.iloc[at]), best[at], jaccard)
            yield pd.DataFrame({RID: batch[RID].to_numpy(), **dict(zip(names, out))})

        def reduce(batch):
            view = held.seen_from(batch)
            out = np.empty((len(names), view.size))
            for part in view.slices():
                far = view.similarities(part, jaccard)
                np.subtract(1.0, far, out=far)
                work = np.empty_like(far)
                for q in range(len(names)):
                    np.maximum(far, degree[q][None, :], out=work)
                    out[q, part] = work.min(axis=1)
            yield pd.DataFrame({RID: batch[RID].to_numpy(), **dict(zip(names, out))})

        return reduce_many if cells else reduce

    open_rows = table.where(F.greatest(F.lit(0.0), *names) > 0)
    schema = f"{RID} long, " + ", ".join(f"`{c}` double" for c in names)
    partial = compare(
        spec, jaccard, open_rows, found.rows, table, found.rows, kernel, schema,
        reach, settings,
    )
    best = (
        partial.unionByName(table.select(RID, *names))
        .groupBy(RID)
        .agg(*[F.min(c).alias(c) for c in names])
    )
    return hand_back(rows, spec.id, best, found, *names)


def class_approximations(
    df: DataFrame,
    spec: RowSpec,
    memberships: Memberships | None = None,
    *,
    which: tuple[str, ...] = ("lower", "upper"),
    numeric_only: bool = False,
    jaccard: str = "equal",
    settings: TileSettings = TileSettings(),
) -> DataFrame:
    """``id`` and ``lower_<class>`` / ``upper_<class>`` of every row.

    Attributes are divided by their range first. ``lower`` is the least
    Kleene-Dienes implication over all rows, at most 1; ``upper`` the greatest
    minimum t-norm, at least 0. The row itself takes part in both.
    """
    memberships = memberships or three_classes()
    whole = spec
    if numeric_only:
        spec = spec.only_numeric()
    rows, bounds = reusable_with_bounds(whole.conform(df), [*spec.numeric, spec.label])
    low, high = (F.lit(b[spec.label]).cast("double") for b in (bounds.low, bounds.high))
    classes = memberships(F.col(spec.label), low, high)
    # max min(s, c) = 1 - min max(1 - s, 1 - c): one search serves both.
    degrees = {}
    if "lower" in which:
        degrees |= {f"_lower_{name}": c for name, c in classes.items()}
    if "upper" in which:
        degrees |= {f"_upper_{name}": F.lit(1.0) - c for name, c in classes.items()}
    scaled = scale(rows, spec, "range", bounds).select(spec.id, *spec.attributes, spec.label)
    best = _least_of_greatest(scaled, spec, degrees, jaccard, settings)
    return best.select(
        F.col(spec.id).alias("id"),
        *[
            F.least(F.lit(1.0), F.col(c)).alias(c[1:])
            if c.startswith("_lower_")
            else F.greatest(F.lit(0.0), F.lit(1.0) - F.col(c)).alias(c[1:])
            for c in degrees
        ],
    )


def approximations(
    df: DataFrame,
    spec: RowSpec,
    memberships: Memberships | None = None,
    *,
    numeric_only: bool = True,
    jaccard: str = "equal",
    settings: TileSettings = TileSettings(),
) -> DataFrame:
    """``id``, ``upper`` and ``lower``: the greatest over the classes, at least 0."""
    by_class = class_approximations(
        df, spec, memberships, numeric_only=numeric_only, jaccard=jaccard, settings=settings
    )

    def over_classes(kind: str) -> Column:
        names = [c for c in by_class.columns if c.startswith(f"{kind}_")]
        return F.greatest(F.lit(0.0), *names).alias(kind)

    return by_class.select("id", over_classes("upper"), over_classes("lower"))


def quality_hml(
    df: DataFrame,
    spec: RowSpec,
    *,
    cuts=DEFAULT_CUTS,
    numeric_only: bool = False,
    jaccard: str = "equal",
    settings: TileSettings = TileSettings(),
) -> DataFrame:
    """``id`` and ``quality``: best lower approximation over low, middle and high."""
    lower = class_approximations(
        df,
        spec,
        three_classes(cuts),
        which=("lower",),
        numeric_only=numeric_only,
        jaccard=jaccard,
        settings=settings,
    )
    names = [c for c in lower.columns if c.startswith("lower_")]
    return lower.select("id", F.greatest(F.lit(0.0), *names).alias("quality"))
