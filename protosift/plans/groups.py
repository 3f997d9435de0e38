"""Sample rows in groups, so that a row is compared with few of them.

Passes that compare every row with every pivot grow with the power 1.5 of the rows.
Here a row sees the centres of the groups, about twice the root of the sample in number,
and then only the members of groups that may matter to it, which least distances tell as
they do for cells. What is found is the same as with all members.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

from protosift.plans.blocks import Held, Viewer
from protosift.spec import RowSpec

# Least distances are lowered by this share before they exclude anything.
SLACK = 1e-9


@dataclass
class Around:
    """What lies around sample rows, an entry for each: how far from it at most, within
    which ranges of the numeric attributes, and a bit for each attribute of ``kinds`` in
    which all is like the sample row itself."""

    radius: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    same: np.ndarray

    @staticmethod
    def nothing(held: Held) -> Around:
        """The sample rows themselves and nothing else."""
        return Around(np.zeros(held.size), held.numbers, held.numbers, np.full(held.size, -1, "int64"))


def kinds(jaccard: str, held: Held, view: Viewer) -> list[tuple[np.ndarray, np.ndarray]]:
    """Attributes that count 1 where two rows differ: values of a batch and of held rows."""
    sets = list(zip(view.bits, held.bits)) if jaccard == "equal" else []
    return (list(zip(view.codes, held.codes)) + sets)[:62]


def _ranges_apart(view: Viewer, low: list[np.ndarray], high: list[np.ndarray], width: int) -> np.ndarray:
    """How far each row is from ranges of the numeric attributes, summed up."""
    apart = np.zeros((view.size, width))
    for x, least, most in zip(view.numbers, low, high):
        gap = np.subtract(least[None, :], x[:, None])
        np.maximum(gap, x[:, None] - most[None, :], out=gap)
        apart += np.maximum(gap, 0.0, out=gap)
    return apart


class Groups:
    """Rows of ``sample`` in groups around the first of them. Those left out by ``used``
    belong to none."""

    def __init__(
        self, spec: RowSpec, jaccard: str, sample: pd.DataFrame, around: Around | None = None,
        used: np.ndarray | None = None,
    ):
        self.spec, self.jaccard = spec, jaccard
        self.held = Held(spec, sample)
        self.around = around or Around.nothing(self.held)
        some = np.arange(len(sample)) if used is None else np.flatnonzero(used)
        centres = self.held.part(some[: 2 * math.isqrt(len(some))])
        far = np.empty((len(some), centres.size))
        view = self.held.seen_from(sample).part(some, centres)
        for rows in view.slices():
            far[rows] = view.distances(rows, jaccard) / spec.size
        home = far.argmin(axis=1) if centres.size else np.zeros(0, "int64")
        # Equal centres leave groups without members.
        kept = np.unique(home)
        self.centres = self.held.part(some[kept])
        self.members = [some[home == g] for g in kept]
        self.rows = [self.held.part(m) for m in self.members]
        self.radius = np.array([
            (far[home == g, g] + self.around.radius[m]).max() for g, m in zip(kept, self.members)
        ])
        self.low = [np.array([x[m].min() for m in self.members]) for x in self.around.low]
        self.high = [np.array([x[m].max() for m in self.members]) for x in self.around.high]
        self.values, self.lacks = [], []
        for bit, (_, of_held) in enumerate(kinds(jaccard, self.held, view)):
            values, code = np.unique(of_held, return_inverse=True)
            # The last entry is for values that no sample row has.
            lacks = np.ones((len(values) + 1, len(self.members)), bool)
            for g, m in enumerate(self.members):
                lacks[code[m], g] = False
                if ((self.around.same[m] >> bit) & 1 == 0).any():
                    lacks[:, g] = False
            self.values.append(values)
            self.lacks.append(lacks)

    def seen_from(self, pdf: pd.DataFrame) -> Viewer:
        return self.held.seen_from(pdf)

    def columns(self, table: pd.DataFrame) -> tuple[list[dict], list[dict]]:
        """Columns of ``table``, which has a row for each sample row: those of the members of
        each group, and the least value of each, as arrays."""
        whole = {c: table[c].to_numpy() for c in table.columns}
        own = [{c: x[m] for c, x in whole.items()} for m in self.members]
        return own, [{c: x.min(keepdims=True) for c, x in some.items()} for some in own]

    def least(self, view: Viewer) -> tuple[np.ndarray, np.ndarray]:
        """Least distance of each row to what lies around the members of each group, and
        its distance to their centre."""
        gap, far = (np.empty((view.size, self.centres.size)) for _ in range(2))
        seen = view.part(slice(None), self.centres)
        for rows in seen.slices():
            gap[rows], far[rows] = self._least_of_few(view.part(rows, self.centres))
        return gap, far

    def _least_of_few(self, view: Viewer) -> tuple[np.ndarray, np.ndarray]:
        far = view.distances(slice(0, view.size), self.jaccard) / self.spec.size
        gap = far - self.radius[None, :]
        # The ranges of attributes bound the own distances of no job.
        if self.spec.distance is None:
            apart = _ranges_apart(view, self.low, self.high, len(self.members))
            for (mine, _), values, lacks in zip(kinds(self.jaccard, self.held, view), self.values, self.lacks):
                at = np.searchsorted(values, mine)
                at[values[np.minimum(at, len(values) - 1)] != mine] = len(values)
                apart += lacks[at]
            gap = np.fmax(gap, np.divide(apart, self.spec.size, out=apart))
        return np.nan_to_num(gap - SLACK * (1.0 + far)), far

    def visit(
        self, view: Viewer, wanted: Callable[[int, np.ndarray], np.ndarray]
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """A group, rows and their distances to its members: first to the group with the
        nearest centre, then to others where ``wanted(group, least distances)``, which is
        asked when what was found before is known."""
        least, far = self.least(view)
        home = far.argmin(axis=1)
        for first in (True, False):
            for g, held in enumerate(self.rows):
                asked = home == g if first else (home != g) & wanted(g, least[:, g])
                yield from self._distances(view, g, held, np.flatnonzero(asked))

    def _distances(self, view: Viewer, g: int, held: Held, rows: np.ndarray):
        if len(rows):
            some = view.part(rows, held)
            for part in some.slices():
                yield g, rows[part], some.distances(part, self.jaccard) / self.spec.size

    def nearest(self, view: Viewer) -> tuple[np.ndarray, np.ndarray]:
        """The nearest sample row of each row, the first of equals, and its distance."""
        at, away = np.full(view.size, self.held.size), np.full(view.size, np.inf)
        for g, rows, far in self.visit(view, lambda g, least: least <= away):
            column = far.argmin(axis=1)
            found, place = far[np.arange(len(rows)), column], self.members[g][column]
            closer = (found < away[rows]) | ((found == away[rows]) & (place < at[rows]))
            at[rows[closer]], away[rows[closer]] = place[closer], found[closer]
        # Infinite numbers have no distance to each other.
        away[at == self.held.size] = np.nan
        at[at == self.held.size] = 0
        return at, away

    def needed(
        self, view: Viewer, relevant: Callable[[np.ndarray, np.ndarray, dict], np.ndarray],
        known: np.ndarray, columns: tuple[list[dict], list[dict]],
    ) -> tuple[np.ndarray, np.ndarray]:
        """Rows and sample rows where ``relevant`` says that what lies around a sample row
        may matter; ``columns`` are those that it reads."""
        least, _ = self.least(view)
        found = [(np.empty(0, "int64"), np.empty(0, "int64"))]
        for g, (own, of_group) in enumerate(zip(*columns)):
            rows = np.flatnonzero(relevant(least[:, g : g + 1], known, of_group)[:, 0])
            if not len(rows):
                continue
            some = view.part(rows, self.rows[g])
            for part in some.slices():
                at = rows[part]
                row, column = np.nonzero(relevant(self._gap(some, part, g), known[at], own))
                found.append((at[row], self.members[g][column]))
        return tuple(map(np.concatenate, zip(*found)))

    def _gap(self, some: Viewer, part: slice, g: int) -> np.ndarray:
        """Least distances of some rows to what lies around the members of a group."""
        members, around = self.members[g], self.around
        far = some.distances(part, self.jaccard) / self.spec.size
        gap = far - around.radius[members][None, :]
        if self.spec.distance is None:
            batch = some.part(part, self.rows[g])
            low, high = ([x[members] for x in edge] for edge in (around.low, around.high))
            apart = _ranges_apart(batch, low, high, len(members))
            # Rows of a cell that are all like its pivot differ from whatever it differs from.
            for bit, (mine, of_held) in enumerate(kinds(self.jaccard, self.rows[g], batch)):
                apart += (mine[:, None] != of_held[None, :]) & ((around.same[members] >> bit) & 1 == 1)[None, :]
            gap = np.fmax(gap, apart / self.spec.size)
        return np.nan_to_num(gap - SLACK * (1.0 + far))
