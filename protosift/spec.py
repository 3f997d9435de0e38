"""Which columns of a table play which part."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class RowSpec:
    """Column names of a row table: id, attributes by kind, and the outcome.

    ``numeric`` columns are compared by absolute difference, ``string`` columns
    by equality and ``bitset`` columns (integers, one bit per set member) by
    Jaccard similarity.

    ``distance`` replaces that comparison. It gets two dictionaries of arrays by
    attribute, the left rows as a column and the right rows as a row, and
    returns the matrix of distances: 0 for equal attributes, at most the number
    of attributes where similarities are formed. With ``metric`` they keep to the
    triangle inequality, so tiles can be left out; otherwise all are compared.

    ``similarity`` is a function of the same kind, 1 for equal attributes and never
    below 0, that jobs on similarities use in place of the one that the distance
    gives.
    """

    id: str = "id"
    numeric: tuple[str, ...] = ()
    string: tuple[str, ...] = ()
    bitset: tuple[str, ...] = ()
    label: str = "label"
    distance: Callable[[dict, dict], np.ndarray] | None = None
    metric: bool = False
    similarity: Callable[[dict, dict], np.ndarray] | None = None

    def __post_init__(self):
        for kind in ("numeric", "string", "bitset"):
            object.__setattr__(self, kind, tuple(getattr(self, kind)))
        names = [self.id, self.label, *self.attributes]
        if len({n.lower() for n in names}) != len(names):
            raise ValueError(f"column named twice in {names}")
        if any(n.startswith("_") for n in names):
            raise ValueError("names that begin with '_' are taken")
        if not self.attributes:
            raise ValueError("a row needs at least one attribute")

    @property
    def attributes(self) -> tuple[str, ...]:
        return self.numeric + self.bitset + self.string

    @property
    def size(self) -> int:
        return len(self.attributes)

    def only_numeric(self) -> RowSpec:
        if not self.numeric:
            raise ValueError("no numeric attribute left")
        if self.distance or self.similarity:
            raise ValueError("an own distance or similarity sees all attributes: pass numeric_only=False")
        return replace(self, string=(), bitset=())

    @property
    def prunable(self) -> bool:
        """Whether least distances to a cell tell what it can hold."""
        return (self.distance is None or self.metric) and self.similarity is None

    def conform(self, df: DataFrame, *extra: str, labelled: bool = True) -> DataFrame:
        """Typed projection of ``df``; a missing attribute becomes 0, '' or {}.

        Not-a-number counts as missing. Rows without a label cannot take part
        in a job and are left out, unless ``labelled`` is off: rows that are only
        predicted need none.
        """
        rows = df.selectExpr(
            f"CAST(`{self.id}` AS long) AS `{self.id}`",
            *[f"coalesce(nanvl(CAST(`{c}` AS double), 0D), 0D) AS `{c}`" for c in self.numeric],
            *[f"coalesce(CAST(`{c}` AS long), 0L) AS `{c}`" for c in self.bitset],
            *[f"coalesce(CAST(`{c}` AS string), '') AS `{c}`" for c in self.string],
            f"nanvl(CAST(`{self.label}` AS double), CAST(NULL AS double)) AS `{self.label}`",
            *[f"`{c}`" for c in extra],
        )
        return rows.where(f"`{self.label}` IS NOT NULL") if labelled else rows

    def require_unique_ids(self, df: DataFrame) -> None:
        """Raise if an id occurs twice; one shuffle with map-side counts."""
        twice = df.groupBy(self.id).count().where("count > 1").take(1)
        if twice:
            raise ValueError(f"id {twice[0][0]} occurs {twice[0][1]} times")


def parse_attr_types(text: str) -> list[str]:
    """Kinds of the attribute tokens of a text row, in column order.

    ``"n2,s,b"`` reads as two numeric tokens, a string and a bitset.
    """
    kinds: list[str] = []
    for part in text.split(","):
        letter, count = part[:1], part[1:] or "1"
        if letter not in ("n", "s", "b") or not count.isdigit():
            raise ValueError(f"unknown attribute type {part!r}")
        kinds += [letter] * int(count)
    return kinds


def spec_of_attr_types(text: str, id: str = "id", label: str = "label") -> RowSpec:
    """A spec with generated names: ``n1, n2, …``, ``s1, …`` and ``b1, …``."""
    kinds = parse_attr_types(text)
    named = {k: tuple(f"{k}{i + 1}" for i in range(kinds.count(k))) for k in "nsb"}
    return RowSpec(id, named["n"], named["s"], named["b"], label)
