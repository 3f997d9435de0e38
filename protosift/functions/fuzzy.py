"""Memberships, connectives and small scalar rules as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where the low, middle and high classes meet, as shares of the
# outcome range.
DEFAULT_CUTS = (0.25, 0.5, 0.75)

# Outcome, its minimum and its maximum -> one membership Column per class.
Memberships = Callable[[Column, Column, Column], dict[str, Column]]


def three_classes(cuts=DEFAULT_CUTS) -> Memberships:
    """Low, middle and high outcome with linear slopes between the cuts."""

    def build(y: Column, lo: Column, hi: Column) -> dict[str, Column]:
        a, b, c = (F.lit(cut) * (hi - lo) + lo for cut in cuts)
        return {
            "low": F.when(y <= a, 1.0).when(y < b, (y - b) / (a - b)).otherwise(0.0),
            "mid": F.when((y > a) & (y <= b), (y - a) / (b - a))
            .when((y > b) & (y <= c), (y - c) / (b - c))
            .otherwise(0.0),
            "high": F.when(y >= c, 1.0).when(y > b, (y - b) / (c - b)).otherwise(0.0),
        }

    return build


def identity_class() -> Memberships:
    """One class, whose membership is the outcome itself."""
    return lambda y, lo, hi: {"label": y}


def kleene_dienes(sim: Column, membership: Column) -> Column:
    return F.greatest(F.lit(1.0) - sim, membership)


def minimum_tnorm(sim: Column, membership: Column) -> Column:
    return F.least(sim, membership)


def outcome_similarity(ya: Column, yb: Column) -> Column:
    """Likeness of two min-max scaled outcomes."""
    return F.lit(1.0) - F.abs(ya - yb)


def conflict_degree(sim: Column, outcome_sim: Column) -> Column:
    """Łukasiewicz implicator of a pair in conflict, null for the others."""
    return F.when(sim > outcome_sim, F.lit(1.0) - sim + outcome_sim)


def fold_of(id: Column, folds: int = 10) -> Column:
    """Remainder with the sign of the id."""
    return (id % folds).cast("int")


def block_of(id: Column, blocks: int) -> Column:
    return F.pmod(id, F.lit(blocks)).cast("long")
