"""Distances between a batch of rows and a table that a task holds.

The only array code of the library: small functions that turn two bounded
sets of rows into a matrix of distances, term by term in the order of
``functions.distance``.
"""

from __future__ import annotations

from copy import copy

import numpy as np
import pandas as pd

from protosift.spec import RowSpec

# Doubles in one distance matrix, so that it and its scratch space stay in the
# cache of a core; sixteen times as many made every job several times slower.
MATRIX = 1 << 15


class Held:
    """The rows held by a task, with its strings replaced by codes."""

    def __init__(self, spec: RowSpec, pdf: pd.DataFrame):
        self.spec = spec
        self.size = len(pdf)
        self.numbers = [pdf[c].to_numpy("float64") for c in spec.numeric]
        self.bits = [pdf[c].to_numpy("int64") for c in spec.bitset]
        coded = [pd.factorize(pdf[c]) for c in spec.string]
        self.codes = [codes for codes, _ in coded]
        self.words = [pd.Index(words) for _, words in coded]
        self.raw = _raw(spec, pdf)

    def seen_from(self, pdf: pd.DataFrame) -> Viewer:
        return Viewer(self, pdf)

    def part(self, at) -> Held:
        """Some of the rows, with the codes of all."""
        return _some_rows(self, at)


class Viewer:
    """A batch of rows to be compared with the held ones."""

    def __init__(self, held: Held, pdf: pd.DataFrame):
        spec = held.spec
        self.held = held
        self.size = len(pdf)
        self.numbers = [pdf[c].to_numpy("float64") for c in spec.numeric]
        self.bits = [pdf[c].to_numpy("int64") for c in spec.bitset]
        # A word no held row has becomes -1, which equals no code.
        self.codes = [w.get_indexer(pdf[c]) for w, c in zip(held.words, spec.string)]
        self.raw = _raw(spec, pdf)
        self._make_room()

    def _make_room(self):
        self.step = max(1, MATRIX // max(1, self.held.size))
        shape = (min(self.step, self.size), self.held.size)
        self.scratch = np.empty(shape), np.empty(shape), np.empty(shape, bool)

    def part(self, rows, held: Held) -> Viewer:
        """Some rows of the batch, to be compared with a part of the held ones."""
        some = _some_rows(self, rows)
        some.held = held
        some._make_room()
        return some

    def slices(self):
        """Consecutive slices of the batch, each small enough for one matrix."""
        for start in range(0, self.size, self.step):
            yield slice(start, min(self.size, start + self.step))

    def _sides(self, rows: slice) -> tuple[dict, dict]:
        """Attributes of a slice as columns and of the held rows as rows."""
        return (
            {c: x[rows, None] for c, x in self.raw.items()},
            {c: y[None, :] for c, y in self.held.raw.items()},
        )

    def distances(self, rows: slice, jaccard: str) -> np.ndarray:
        """Distances of a slice; the array is reused for the next slice."""
        held = self.held
        total, term, differ = (a[: rows.stop - rows.start] for a in self.scratch)
        if held.spec.distance:
            total[:] = held.spec.distance(*self._sides(rows))
            return total
        if held.numbers:
            np.subtract(self.numbers[0][rows, None], held.numbers[0][None, :], out=total)
            np.abs(total, out=total)
        else:
            total.fill(0.0)
        for x, y in zip(self.numbers[1:], held.numbers[1:]):
            np.subtract(x[rows, None], y[None, :], out=term)
            total += np.abs(term, out=term)
        if held.bits:
            total += set_distance([x[rows, None] for x in self.bits], [y[None, :] for y in held.bits], jaccard)
        for x, y in zip(self.codes, held.codes):
            total += np.not_equal(x[rows, None], y[None, :], out=differ)
        return total

    def similarities(self, rows: slice, jaccard: str) -> np.ndarray:
        if self.held.spec.similarity:
            shape = (rows.stop - rows.start, self.held.size)
            return np.array(np.broadcast_to(self.held.spec.similarity(*self._sides(rows)), shape), "float64")
        sim = self.distances(rows, jaccard)
        m = float(self.held.spec.size)
        np.subtract(m, sim, out=sim)
        return np.divide(sim, m, out=sim)


def _some_rows(of, rows):
    """A copy of held rows or of a batch that has some of its rows."""
    some = copy(of)
    some.size = len(np.arange(of.size)[rows])
    for name in ("numbers", "bits", "codes"):
        setattr(some, name, [x[rows] for x in getattr(of, name)])
    some.raw = {c: x[rows] for c, x in of.raw.items()}
    return some


def _raw(spec: RowSpec, pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    return {c: pdf[c].to_numpy() for c in spec.attributes} if spec.distance or spec.similarity else {}


def set_distance(mine: list[np.ndarray], held: list[np.ndarray], jaccard: str):
    """Distance of the set-valued attributes; the arrays are matched as numpy does."""
    if jaccard == "equal":
        return sum((x != y).astype("float64") for x, y in zip(mine, held))
    if jaccard != "ratio":
        raise ValueError(f"unknown jaccard mode {jaccard!r}")
    alike = 0.0
    for x, y in zip(mine, held):
        union = np.bitwise_count(x | y)
        alike = alike + np.where(union == 0, 1.0, np.bitwise_count(x & y) / np.maximum(union, 1))
    return len(held) - alike
