"""Sums of 1/r over a run of ranks, for any number of ranks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks up to here are added one by one; beyond, the expansion of the harmonic
# numbers is exact to double precision.
DIRECT = 64
# Coefficients of 1/n, 1/n^2, 1/n^4, 1/n^6 in that expansion.
EXPANSION = ((1, 1 / 2), (2, -1 / 12), (4, 1 / 120), (6, -1 / 252))

_FIRST = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, DIRECT + 1))])


def run_weight(before: str, count: str) -> Column:
    """``1/(before+1) + … + 1/(before+count)`` from two columns of whole numbers."""
    end, limit = f"({before} + {count})", f"{DIRECT}D"
    first = f"array({', '.join(f'{h!r}D' for h in _FIRST.tolist())})"

    def head(n: str) -> str:
        return f"get({first}, CAST(least({n}, {DIRECT}) AS int))"

    low = f"greatest({before}, {limit})"
    tail = f"log1p(({end} - {low}) / {low})" + "".join(
        f" + ({c!r}D) * (power({end}, -{power}D) - power({low}, -{power}D))" for power, c in EXPANSION
    )
    return F.expr(
        f"""CASE WHEN {count} = 1 THEN 1D / ({before} + 1)
                 WHEN {before} >= {DIRECT} THEN {tail}
                 WHEN {end} <= {DIRECT} THEN {head(end)} - {head(before)}
                 ELSE {head(DIRECT)} - {head(before)} + {tail} END"""
    )


def harmonic(n: np.ndarray) -> np.ndarray:
    """Harmonic numbers of an array of counts."""
    n = np.asarray(n, "float64")
    big = np.maximum(n, float(DIRECT))
    rest = np.log(big / DIRECT)
    for power, c in EXPANSION:
        rest = rest + c * (big ** -float(power) - float(DIRECT) ** -float(power))
    return np.where(n <= DIRECT, _FIRST[np.minimum(n, DIRECT).astype("int64")], _FIRST[DIRECT] + rest)
