"""Held rows arranged so that conflicts are found without comparing every pair.

Two rows are in conflict when their distance is below the difference of their
outcomes. Held rows are put in groups of alike rows, whose least distance to a
probing row is known, and within a group in the order of their outcomes. Only
rows at both ends of a group, farther off in outcome than the group is in
distance, can conflict with the probing row; they alone are compared.

Where many rows share all attributes, groups of equal rows have one distance to a
probing row. Their conflicts are counted by where they begin; only outcomes that are
too near to that for a search are compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from protosift.plans.blocks import MATRIX, Held, set_distance
from protosift.spec import RowSpec

OUTCOME, BLOCK = "_outcome", "_block"
# Rows of a group: fewer prune better, more cost less for each row compared.
LEAST_GROUP, GROUP = 32, 256
# Pairs that are compared at a time, so that the arrays stay in a core's cache.
PAIRS = 1 << 16
# From this share of candidates on, whole matrices are faster than chosen pairs.
DENSE = 0.3
# Least distances are lowered by this before they exclude anything.
SLACK = 1e-8
# Rows that share their attributes, on average, from which on they are a group.
EQUAL_ROWS = 8


def _ranges(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)


class Arranged:
    """The rows of one file, block by block and group by group."""

    def __init__(self, spec: RowSpec, jaccard: str, rows: pd.DataFrame, equal: bool = False):
        self.spec, self.jaccard, self.size = spec, jaccard, len(rows)
        bounded = spec.distance is None and spec.similarity is None
        if equal:
            group, named = rows.groupby([BLOCK, *spec.attributes], sort=True, dropna=False).ngroup().to_numpy(), []
        else:
            group, named = _groups(spec, jaccard, rows) if bounded else (pd.factorize(rows[BLOCK], sort=True)[0], [])
        rows = rows.iloc[np.lexsort((rows[OUTCOME], group))].reset_index(drop=True)
        group = np.sort(group)
        self.held = Held(spec, rows)
        self.outcomes = rows[OUTCOME].to_numpy("float64")
        self.blocks = rows[BLOCK].to_numpy("int64")
        self.copies = rows["_copies"].to_numpy("int64")
        self.single = bool((self.copies == 1).all())
        self.one_block = self.size > 0 and self.blocks[0] == self.blocks[-1]
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        self.starts, self.stops = starts, np.append(starts[1:], self.size)
        numbers = self.held.numbers if bounded else []
        self.ranges = [_ranges(x, starts) for x in numbers]
        # Attributes in which all rows of a group are alike.
        self.codes = [(i, self.held.codes[i][starts]) for kind, i in named if kind == "string"]
        self.bits = [(i, self.held.bits[i][starts]) for kind, i in named if kind == "bitset"]
        # One sorted array serves the search in all groups; outcomes lie in [0, 1].
        lane = 4.0 * np.arange(len(starts))
        self.lane = lane
        self.ladder = self.outcomes + np.repeat(lane, self.stops - starts)

    def _least(self, view, rows: slice) -> np.ndarray:
        """A lower bound of the distance of each row of a slice to each group."""
        far = np.zeros((rows.stop - rows.start, len(self.starts)))
        for x, (low, high) in zip(view.numbers, self.ranges):
            x = x[rows, None]
            far += np.maximum(np.maximum(low[None, :] - x, x - high[None, :]), 0.0)
        for mine, fixed in ((view.codes, self.codes), (view.bits, self.bits)):
            for i, alike in fixed:
                far += mine[i][rows, None] != alike[None, :]
        far /= self.spec.size
        return np.maximum(far - SLACK, 0.0)

    def candidates(self, view, outcome: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Where the two runs of candidates of each row and group begin, and how
        long they are: arrays of rows by groups by 2."""
        gap, y = self._least(view, rows), outcome[rows, None]
        low = np.searchsorted(self.ladder, self.lane + (y - gap + SLACK), side="left")
        high = np.searchsorted(self.ladder, self.lane + (y + gap - SLACK), side="right")
        # Where the two ends meet, the second run begins after the first.
        high = np.maximum(high, low)
        begin = np.stack([np.broadcast_to(self.starts, low.shape), high], axis=2)
        length = np.stack([low - self.starts, self.stops - high], axis=2)
        return begin, length

    def conflicts(self, view, outcome: np.ndarray):
        """Row of the batch, held position and degree of every conflict, in the
        order of rows and, for a row, of blocks."""
        step = max(1, PAIRS // max(1, 2 * len(self.starts)))
        for start in range(0, view.size, step):
            rows = slice(start, min(view.size, start + step))
            begin, length = self.candidates(view, outcome, rows)
            of_row = length.sum(axis=(1, 2))
            ends = np.cumsum(of_row)
            first = 0
            while first < len(of_row):
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
                piece = slice(start + first, start + last)
                if ends[last - 1] - before > DENSE * self.size * (last - first):
                    yield from self._all(view, outcome, piece)
                else:
                    yield self._chosen(view, outcome, piece, begin[first:last], length[first:last], of_row[first:last])
                first = last

    def summary(self, view, outcome: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many rows conflict with each row of a batch, and the least and greatest
        degree (infinite without conflicts). Groups have to be of equal rows."""
        count = np.zeros(view.size, "int64")
        least, greatest = np.full(view.size, np.inf), np.full(view.size, -np.inf)
        until = np.concatenate([[0], np.cumsum(self.copies)])
        firsts, lasts = self.outcomes[self.starts], self.outcomes[self.stops - 1]
        step = max(1, PAIRS // max(1, len(self.starts)))
        for start in range(0, view.size, step):
            rows = slice(start, min(view.size, start + step))
            sim, y = self._similar(view, rows), outcome[rows, None]
            # 2 * SLACK from where conflicts begin, rounding decides nothing.
            gap = 1.0 - sim
            row, group = np.nonzero((firsts[None, :] < y - gap + SLACK) | (lasts[None, :] > y + gap - SLACK))
            sim, gap, y = sim[row, group], gap[row, group], outcome[rows][row]
            lane, begin, end = self.lane[group], self.starts[group], self.stops[group]
            low = np.searchsorted(self.ladder, lane + (y - gap - SLACK), side="left")
            high = np.searchsorted(self.ladder, lane + (y + gap + SLACK), side="right")
            count[rows] += np.bincount(
                row, (until[low] - until[begin]) + (until[end] - until[high]), rows.stop - rows.start
            ).astype("int64")
            for some, near, far in (
                (np.flatnonzero(low > begin), low - 1, begin), (np.flatnonzero(high < end), high, end - 1)
            ):
                for at, extreme, best in ((far, np.minimum, least), (near, np.maximum, greatest)):
                    alike = 1.0 - np.abs(y[some] - self.outcomes[at[some]])
                    extreme.at(best, row[some] + start, (1.0 - sim[some]) + alike)
            # Between the two searches lie, as a rule, only copies of the row itself.
            open_low = np.flatnonzero((low < end) & (self.outcomes[np.minimum(low, end - 1)] <= y - gap + SLACK))
            open_high = np.flatnonzero((high > begin) & (self.outcomes[np.maximum(high - 1, begin)] >= y + gap - SLACK))
            among = np.union1d(open_low, open_high)
            if not len(among):
                continue
            # One run from the first to the last of them, that leaves out what is counted.
            stop = np.searchsorted(self.ladder, (lane + (y - gap + SLACK))[among], side="right")
            from_ = np.searchsorted(self.ladder, (lane + (y + gap - SLACK))[among], side="left")
            a, b = low[among], high[among]
            stop = np.clip(stop, a, np.maximum(a, b))
            from_ = np.clip(from_, stop, np.maximum(stop, b))
            runs, spans = np.stack([a, from_], axis=1), np.stack([stop - a, np.maximum(b - from_, 0)], axis=1)
            of_row = np.bincount(row[among], spans.sum(axis=1), rows.stop - rows.start).astype("int64")
            found, at, degree = self._chosen(view, outcome, rows, runs, spans, of_row)
            np.add.at(count, found, self.copies[at])
            np.minimum.at(least, found, degree)
            np.maximum.at(greatest, found, degree)
        return count, least, greatest

    def _similar(self, view, rows: slice) -> np.ndarray:
        """Similarity of each row of a slice to the rows of each group, all equal."""
        held, at, size = self.held, self.starts, float(self.spec.size)
        far = np.zeros((rows.stop - rows.start, len(at)))
        for x, y in zip(view.numbers, held.numbers):
            far += np.abs(x[rows, None] - y[None, at])
        if held.bits:
            far += set_distance([x[rows, None] for x in view.bits], [y[None, at] for y in held.bits], self.jaccard)
        for x, y in zip(view.codes, held.codes):
            far += x[rows, None] != y[None, at]
        return (size - far) / size

    def _chosen(self, view, outcome, rows: slice, begin, length, of_row):
        """Conflicts among the candidates."""
        begin, length = begin.ravel(), length.ravel()
        total = int(of_row.sum())
        ends = np.cumsum(length)
        at = np.arange(total)
        at += np.repeat(begin - (ends - length), length)
        held, size = self.held, float(self.spec.size)
        far = np.zeros(total)
        for i, (x, y) in enumerate(zip(view.numbers, held.numbers)):
            term = np.repeat(x[rows], of_row)
            term -= y[at]
            np.abs(term, out=term)
            far = term if i == 0 else np.add(far, term, out=far)
        if held.bits:
            far += set_distance(
                [np.repeat(x[rows], of_row) for x in view.bits], [y[at] for y in held.bits], self.jaccard
            )
        for x, y in zip(view.codes, held.codes):
            far += np.repeat(x[rows], of_row) != y[at]
        np.subtract(size, far, out=far)
        far /= size
        alike = np.repeat(outcome[rows], of_row)
        alike -= self.outcomes[at]
        np.abs(alike, out=alike)
        np.subtract(1.0, alike, out=alike)
        found = np.flatnonzero(far > alike)
        row = np.repeat(np.arange(rows.start, rows.stop), of_row)[found]
        return row, at[found], (1.0 - far[found]) + alike[found]

    def _all(self, view, outcome, rows: slice):
        """Conflicts among all held rows."""
        step = max(1, MATRIX // max(1, self.size))
        for start in range(rows.start, rows.stop, step):
            part = slice(start, min(rows.stop, start + step))
            sim = view.similarities(part, self.jaccard)
            alike = outcome[part, None] - self.outcomes[None, :]
            np.subtract(1.0, np.abs(alike, out=alike), out=alike)
            for i in range(part.stop - part.start):
                at = np.flatnonzero(sim[i] > alike[i])
                yield np.full(len(at), start + i), at, (1.0 - sim[i][at]) + alike[i][at]


class Levels:
    """Held rows of few attribute profiles, all files of them.

    Probing rows that share all attributes have the same distance to a profile. For
    them held rows are put in levels of one block and similarity, each in the order of
    outcomes, so that only rows at both ends of a level are compared.
    """

    def __init__(self, spec: RowSpec, rows: pd.DataFrame):
        rows = rows.iloc[np.argsort(rows[OUTCOME].to_numpy("float64"), kind="stable")]
        group = rows.groupby([BLOCK, *spec.attributes], sort=True, dropna=False).ngroup().to_numpy()
        first = np.unique(group, return_index=True)[1]
        self.groups = Held(spec, rows.iloc[first].reset_index(drop=True))
        self.block_of_group = rows[BLOCK].to_numpy("int64")[first]
        self.group = group.astype("int32")
        self.outcomes, self.copies = rows[OUTCOME].to_numpy("float64"), rows["_copies"].to_numpy("int64")
        self.single = bool((self.copies == 1).all())
        self.span = self.outcomes[-1] - self.outcomes[0]

    def seen_with(self, sim: np.ndarray) -> Level:
        """Levels for probing rows that have these similarities to the groups."""
        live = np.flatnonzero(1.0 - sim < self.span + SLACK)
        values, value = np.unique(sim[live], return_inverse=True)
        blocks, block = np.unique(self.block_of_group[live], return_inverse=True)
        found, level = np.unique(block * max(1, len(values)) + value, return_inverse=True)
        of_group = np.full(self.groups.size, -1, "int32")
        of_group[live] = level
        of_row = of_group[self.group]
        at = np.flatnonzero(of_row >= 0)
        # Rows are in the order of outcomes, and two bytes are sorted by their digits.
        of_row = of_row[at].astype("uint16" if len(found) <= 1 << 16 else "int32")
        at = at[np.argsort(of_row, kind="stable")]
        stops = np.cumsum(np.bincount(of_row, minlength=len(found)))
        block, value = np.divmod(found, max(1, len(values)))
        return Level(values[value], blocks[block], stops, self.outcomes[at], None if self.single else self.copies[at])


class Level:
    """Levels as some probing rows see them: similarity, block and end of each, and the
    outcomes and copies of the rows in them."""

    def __init__(self, sim, block, stops, outcomes, copies):
        self.sim, self.block, self.stops, self.outcomes, self.copies = sim, block, stops, outcomes, copies
        self.starts = np.append(0, stops)[: len(stops)]
        self.lane = 4.0 * np.arange(len(stops))
        self.ladder = outcomes + np.repeat(self.lane, stops - self.starts)

    def conflicts(self, outcome: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """How many rows of each level conflict with each outcome; degree and copies of
        every conflict, in the order of outcomes given and of levels."""
        y, gap = outcome[:, None], (1.0 - self.sim)[None, :]
        low = np.searchsorted(self.ladder, self.lane + (y - gap + SLACK), side="left")
        high = np.searchsorted(self.ladder, self.lane + (y + gap - SLACK), side="right")
        low = np.clip(low, self.starts, self.stops)
        high = np.clip(high, low, self.stops)
        begin = np.stack([np.broadcast_to(self.starts, low.shape), high], axis=2).ravel()
        length = np.stack([low - self.starts, self.stops - high], axis=2)
        count, length = length.sum(axis=2), length.ravel()
        at = np.arange(length.sum())
        at += np.repeat(begin - (np.cumsum(length) - length), length)
        alike = np.repeat(outcome, count.sum(axis=1))
        alike -= self.outcomes[at]
        np.abs(alike, out=alike)
        np.subtract(1.0, alike, out=alike)
        sim = np.repeat(np.tile(self.sim, len(outcome)), count.ravel())
        none = np.flatnonzero(sim <= alike)
        if len(none):  # rows within the slack
            level = np.searchsorted(np.cumsum(count), none, side="right")
            count -= np.bincount(level, minlength=count.size).reshape(count.shape)
            sim, alike, at = (np.delete(x, none) for x in (sim, alike, at))
        np.subtract(1.0, sim, out=sim)
        sim += alike
        return count, sim, None if self.copies is None else self.copies[at]


def _groups(spec: RowSpec, jaccard: str, rows: pd.DataFrame) -> tuple[np.ndarray, list[tuple[str, int]]]:
    """A group for each row, blocks in rising order, and the attributes in which
    the rows of each group are alike."""
    group = pd.factorize(rows[BLOCK], sort=True)[0].astype("int64")
    most = max(1, len(rows) // LEAST_GROUP)
    attributes = [("string", i, c) for i, c in enumerate(spec.string)]
    if jaccard == "equal":
        attributes += [("bitset", i, c) for i, c in enumerate(spec.bitset)]
    coded = [(kind, i, *pd.factorize(rows[c])) for kind, i, c in attributes]
    named = []
    for kind, i, codes, values in sorted(coded, key=lambda x: len(x[3])):
        found, finer = np.unique(group * max(1, len(values)) + codes, return_inverse=True)
        if len(found) <= max(most, group.max() + 1):
            group = finer.astype("int64")
            named.append((kind, i))
    groups = int(group.max()) + 1
    slices = round((len(rows) / groups / GROUP) ** (1 / len(spec.numeric))) if spec.numeric else 1
    for c in spec.numeric if slices > 1 else ():
        group = _sliced(group, rows[c].to_numpy("float64"), slices)
    return group, named


def _sliced(group: np.ndarray, values: np.ndarray, slices: int) -> np.ndarray:
    """Each group cut into slices of equal size by a value."""
    order = np.lexsort((values, group))
    sizes = np.bincount(group)
    rank = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    finer = np.empty_like(group)
    finer[order] = group[order] * slices + rank * slices // np.repeat(sizes, sizes)
    return np.unique(finer, return_inverse=True)[1].astype("int64")
