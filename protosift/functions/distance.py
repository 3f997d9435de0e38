"""Distance and similarity of two rows as Column expressions.

``a`` and ``b`` map an attribute name to a Column of the left and right row.
Terms are added left to right (numeric, sets, strings), the order the in-task
kernels use as well, so both give the same doubles. Missing attributes count as
0, '' or {}.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from protosift.spec import RowSpec

Side = Callable[[str], Column]


def side(alias: str) -> Side:
    return lambda name: F.col(f"{alias}.{name}")


def _total(terms: list[Column]) -> Column:
    return reduce(add, terms) if terms else F.lit(0.0)


def _known(value: Column, missing) -> Column:
    """A missing attribute is 0, '' or {}, as in ``RowSpec.conform``."""
    return F.coalesce(value, F.lit(missing))


def manhattan(names, a: Side, b: Side) -> Column:
    return _total([F.abs(_known(a(c), 0.0) - _known(b(c), 0.0)) for c in names])


def hamming(names, a: Side, b: Side) -> Column:
    return _total([F.when(_known(a(c), "") == _known(b(c), ""), 0.0).otherwise(1.0) for c in names])


def jaccard(x: Column, y: Column, mode: str = "equal") -> Column:
    """Similarity of two bitsets; two empty sets are alike.

    ``"equal"`` (default) is 1 for equal sets and 0 otherwise. ``"ratio"`` is
    the size of the intersection over that of the union.
    """
    if mode == "equal":
        return F.when(x == y, 1.0).otherwise(0.0)
    if mode == "ratio":
        union = F.bit_count(x.bitwiseOR(y))
        return F.when(union == 0, 1.0).otherwise(F.bit_count(x.bitwiseAND(y)) / union)
    raise ValueError(f"unknown jaccard mode {mode!r}")


def set_distance(names, a: Side, b: Side, mode: str = "equal") -> Column:
    return F.lit(float(len(names))) - _total(
        [jaccard(_known(a(c), 0), _known(b(c), 0), mode) for c in names]
    )


def mixed_distance(spec: RowSpec, a: Side, b: Side, jaccard: str = "equal") -> Column:
    total = manhattan(spec.numeric, a, b)
    if spec.bitset:
        total = total + set_distance(spec.bitset, a, b, jaccard)
    for c in spec.string:
        total = total + hamming([c], a, b)
    return total


def normalised_distance(spec: RowSpec, a: Side, b: Side, jaccard: str = "equal") -> Column:
    return mixed_distance(spec, a, b, jaccard) / F.lit(float(spec.size))


def similarity(spec: RowSpec, a: Side, b: Side, jaccard: str = "equal") -> Column:
    m = F.lit(float(spec.size))
    return (m - mixed_distance(spec, a, b, jaccard)) / m
