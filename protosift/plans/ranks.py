"""Averages over all conflicts of a row, ranked only as finely as their decimals need.

Probing rows that share all attributes but one number (the free one) have the same
distance in these to a held row. Held rows lie in the order of the free number. For
probing rows in a short range of it, those beyond the range fall into four runs, by the
side they lie on and by whether their outcome is above or below; the distance from a
conflict is then a key of the held row plus a shift of the probing row, so one order by
key serves all of them. Held rows within the range are compared one by one. Without a
free number there are two runs and nothing else.

A degree is 1 plus the (negative) distance from a conflict. The r-th least of n weighs
``1 / (r * H_n)``. Between two thresholds lie n conflicts, of ranks after a and of known
sum and variance, as searches in the runs tell. If all were equal, they would add
``sum / n * (H_{a+n} - H_a)``. That is too much by the covariance of values and
weights, which ``_too_much`` bounds from both sides. Thresholds are made finer until
what is left open cannot change the rounded result, and all conflicts are ranked where
none is fine enough, so results are those of ranking every conflict.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd

from protosift.functions.harmonic import harmonic
from protosift.plans.blocks import Held, set_distance
from protosift.spec import RowSpec

OUTCOME, BLOCK, COPIES = "_outcome", "_block", "_copies"
# Nearer than this to a conflict, pairs are compared as the definition has it.
TIE = 1e-12
# Rounding errors of a result, generously.
GUARD = 1e-11
# Conflicts between two thresholds, as a share of the ranks before them, at first (for six
# decimals; errors go by its square).
SHARE = 8e-3
# The least conflicts are always ranked one by one, at least about so many.
LEAST = 1500.0
# So many rows are ranked one by one in the time that a bound takes by itself.
RANKED = 32_000
# Thresholds that show how ranks are spread.
COARSE = (np.arange(129) / 128) ** 2
# Time to order a held row for a range of probing rows, by that to compare it with one.
ORDER = 2.0
# Copies of a held row that are held one by one, on average at most.
MOST_EXPANDED = 1.25


@dataclass(frozen=True)
class Run:
    """Keys in rising order, how many conflicts and which sums of keys and of their squares
    lie before each, and where the held rows are (``None``: they are not kept)."""

    keys: np.ndarray
    count: np.ndarray | None
    total: np.ndarray
    squares: np.ndarray
    times: np.ndarray | None
    at: np.ndarray | None

    @staticmethod
    def of(keys: np.ndarray, times: np.ndarray | None, at: np.ndarray | None) -> Run:
        if times is None and at is None:
            keys = np.sort(keys)
        else:
            order = keys.argsort()
            keys = keys[order]
            times, at = (None if x is None else x[order] for x in (times, at))
        total, squares = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
        each = keys if times is None else keys * times
        np.cumsum(each, out=total[1:])
        np.cumsum(each * keys, out=squares[1:])
        return Run(keys, None if times is None else np.append(0, np.cumsum(times)), total, squares, times, at)

    def before(self, position):
        return position if self.count is None else self.count[position]


@dataclass(frozen=True)
class Seen:
    """The conflicts of one row: runs, what to add to their keys, where conflicts end in
    them, and how many more are within ``TIE``."""

    runs: list[Run]
    shifts: list[float]
    ends: list[int]
    ties: int

    @property
    def rows(self) -> int:
        return sum(self.ends)

    @property
    def size(self) -> int:
        return int(sum(run.before(end) for run, end in zip(self.runs, self.ends)))

    def ranked(self, ends: list[int]) -> tuple[float, int]:
        """Sum over rank of the least distances from a conflict, and how many they are."""
        parts = [(run, shift, end) for run, shift, end in zip(self.runs, self.shifts, ends) if end]
        if not parts:
            return 0.0, 0
        # A stable sort merges runs that are sorted already, which pays for two.
        far = np.concatenate([run.keys[:end] + shift for run, shift, end in parts])
        if all(run.times is None for run, _, _ in parts):
            far.sort(kind="stable" if len(parts) < 3 else None)
            return float(far @ _weights(len(far))), len(far)
        times = np.concatenate([np.ones(end, "int64") if run.times is None else run.times[:end] for run, _, end in parts])
        order = far.argsort(kind="stable" if len(parts) < 3 else None)
        after = np.cumsum(times[order])
        return float(far[order] @ np.diff(_harmonic(after), prepend=0.0)), int(after[-1])

    def exact(self) -> float:
        found, n = self.ranked(self.ends)
        return 1.0 + found / float(harmonic(n + self.ties))

    def within(self, share: float) -> tuple[float, float] | None:
        """The average and a bound of its error; ``None`` where ranking all takes less."""
        n, first = self.size, max(LEAST, 1.0 / max(share, 1e-9))
        if n <= first:
            return None
        bins = int(np.log(n / first) / share) + 1
        if self.rows < RANKED + 4.0 * len(self.runs) * bins:
            return None
        least = min(run.keys[0] + shift for run, shift, end in zip(self.runs, self.shifts, self.ends) if end)
        coarse = least * (1.0 - COARSE)
        ranks = self._counts(coarse)
        steps = np.empty(bins + 1)
        steps[:bins] = np.interp(first * np.exp(np.arange(bins) * share), ranks, coarse)
        steps[bins] = 0.0
        count, total, squares, low = np.zeros(bins + 1), np.zeros(bins + 1), np.zeros(bins + 1), []
        for run, shift, end in zip(self.runs, self.shifts, self.ends):
            if not end:
                low.append(0)
                continue
            at = np.minimum(run.keys.searchsorted(steps - shift), end)
            at[-1] = end
            low.append(int(at[0]))
            before = run.before(at)
            count += before
            sums = run.total[at]
            squares += run.squares[at] + shift * (2.0 * sums + shift * before)
            total += sums + shift * before
        found, begun = self.ranked(low)
        if begun < 64 or begun == n:
            return None
        between = np.diff(count)
        some = np.flatnonzero(between)
        between, before, sums = between[some], count[some], np.diff(total)[some]
        weights = _long_harmonic(before + between)
        weights[1:] -= weights[:-1].copy()
        weights[0] -= _long_harmonic(before[:1])[0]
        found += float((sums / between) @ weights)
        spread = np.diff(squares)[some] - sums * sums / between
        unsure = 1e-15 * between * max(1.0, float(np.abs(squares).max()), float(n))
        least, most = _too_much(before, between, np.diff(steps)[some], spread, unsure)
        whole = float(harmonic(n + self.ties))
        return 1.0 + (found - (least + most) / 2.0) / whole, (most - least) / 2.0 / whole + GUARD

    def _counts(self, steps: np.ndarray) -> np.ndarray:
        return sum(
            run.before(np.minimum(run.keys.searchsorted(steps - shift), end))
            for run, shift, end in zip(self.runs, self.shifts, self.ends)
        )


def _too_much(before, between, width, spread, unsure) -> tuple[float, float]:
    """Bounds of the sum over runs of ranks of ``sum((v - mean v) * (mean g - g))``, for rising
    values v within a width and weights g, 1 / rank, of the ranks after ``before``.

    ``spread`` is the sum of squares of v - mean v, known but for ``unsure``. Steps of g
    are from 1 / (before + between)^2 to 1 / (before + 1)^2. Above, the sum is no more than
    Cauchy-Schwarz gives, nor than for values at both ends of the width, whose mean ranks
    are half the run apart. Below, ``2 * sum((v - mean v) * rank)`` is the sum of all
    differences of two values, which are at least their squares divided by the width.
    """
    first, last = before + 1.0, before + between
    most = np.sqrt((spread.clip(0.0) + unsure) * between * between * between / 12.0)
    most = np.minimum(most, width * between * between / 8.0) / (first * first)
    least = (spread - unsure).clip(0.0) * between / (2.0 * np.maximum(width, 1e-300) * last * last)
    return float(np.minimum(least, most).sum()), float(most.sum())


_inverse = np.empty(0)


def _weights(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        _inverse = 1.0 / np.arange(1.0, 2 * n + 1)
    return _inverse[:n]


_FIRST = np.append(0.0, np.cumsum(1.0 / np.arange(1.0, 64)))


def _harmonic(n: np.ndarray) -> np.ndarray:
    """Harmonic numbers of rising counts."""
    few = int(np.searchsorted(n, 64))
    return np.concatenate([_FIRST[n[:few].astype("int64")], _long_harmonic(n[few:]) + np.euler_gamma])


def _long_harmonic(n: np.ndarray) -> np.ndarray:
    """Harmonic numbers, less a constant, of counts of 64 and more."""
    inverse = 1.0 / n
    square = inverse * inverse
    return np.log(n) + inverse * 0.5 - square * (1 / 12 - square * (1 / 120 - square / 252))


def room(value, decimals: int):
    """How far values are from those that are rounded to another number."""
    part = np.abs(value) * 10.0**decimals
    return np.abs(part - np.floor(part) - 0.5) / 10.0**decimals


class Ordered:
    """Held rows by block, each in the order of the free number."""

    def __init__(self, spec: RowSpec, jaccard: str, free: str | None, files: Iterable[pd.DataFrame]):
        self.spec, self.jaccard, self.free = spec, jaccard, free
        self.rest = [c for c in spec.attributes if c != free]
        kinds, columns, count = [], [], 0
        # Words are kept once for each kind of row in a file.
        for rows in files:
            kind = rows.groupby(self.rest, sort=False, dropna=False).ngroup().to_numpy()
            first = np.unique(kind, return_index=True)[1]
            kinds.append(rows.iloc[first][self.rest])
            columns.append((
                (kind + count).astype("int32"), rows[OUTCOME].to_numpy("float64"), rows[COPIES].to_numpy("int64"),
                rows[BLOCK].to_numpy("int64"), rows[free].to_numpy("float64") if free else np.empty(0),
            ))
            count += len(first)
        kinds = pd.concat(kinds, ignore_index=True)
        same = kinds.groupby(self.rest, sort=False, dropna=False).ngroup().to_numpy()
        kinds = kinds.iloc[np.unique(same, return_index=True)[1]].reset_index(drop=True)
        # One column at a time, as a task may hold millions of rows.
        columns = [list(x) for x in zip(*columns)]
        kind, outcome, times, block, number = (np.concatenate(columns.pop(0)) for _ in range(5))
        kind = same.astype("int32")[kind]
        self.single = bool(times.sum() <= MOST_EXPANDED * len(times))
        if self.single and times.max() > 1:
            kind, outcome, block, number = (np.repeat(x, times) if len(x) else x for x in (kind, outcome, block, number))
        order = np.lexsort((number, block)) if free else np.argsort(block, kind="stable")
        self.blocks, first = np.unique(block[order], return_index=True)
        self.spans = [slice(a, b) for a, b in zip(first, np.append(first[1:], len(order)))]
        del block
        self.kind, self.outcome = kind[order], outcome[order]
        del kind, outcome
        self.times = None if self.single else times[order]
        self.number = number[order] if free else None
        numeric = tuple(c for c in spec.numeric if c != free)
        self.kinds = Held(replace(spec, numeric=numeric), kinds)
        # Outcomes as codes, where a level of few of them is a table of counts.
        self.values, self.code = (None, None) if free else np.unique(self.outcome, return_inverse=True)

    def averages(self, rows: pd.DataFrame, decimals: int, combine) -> np.ndarray:
        """What ``combine`` makes of the averages of rows (down) in blocks (across), for
        rows that share all attributes but the free one. Averages without conflicts are
        not-a-number. ``combine`` moves no result by more than the largest error."""
        view = self.kinds.seen_from(rows.iloc[:1])
        far = view.distances(slice(0, 1), self.jaccard)[0].copy()
        number = rows[self.free].to_numpy("float64") if self.free else np.zeros(len(rows))
        outcome = rows[OUTCOME].to_numpy("float64")
        order = np.argsort(number, kind="stable")
        found = None
        pieces = max(1, round(float(np.sqrt(len(rows) / ORDER)))) if self.free else 1
        parts = [_Part(self, span, far) for span in self.spans]
        for piece in np.array_split(order, min(pieces, len(order))):
            # Rows with near outcomes touch the same parts of the runs.
            piece = piece[np.argsort(outcome[piece], kind="stable")]
            seen = [list(part.seen_by(number[piece], outcome[piece], rows.iloc[piece[:1]])) for part in parts]
            result = _resolved(seen, decimals, combine)
            if found is None:
                found = np.empty((len(rows), result.shape[1]))
            found[piece] = result
        return found


def _resolved(seen: list[list[Seen]], decimals: int, combine) -> np.ndarray:
    """Averages of rows in each block, combined, as fine as their decimals need.

    ``seen`` holds a list of rows for each block, which is gone through as a whole, as
    rows in turn touch the same parts of the runs.
    """
    size = len(seen[0]), len(seen)
    values, errors = np.full(size, np.nan), np.zeros(size)
    shares = np.full(size, min(0.1, SHARE * 10.0 ** ((6 - decimals) / 2)))
    todo = np.array([[s.rows > 0 or s.ties > 0 for s in block] for block in seen]).T
    results: list = [None] * size[0]
    rows = range(size[0])
    while len(rows):
        for i, block in enumerate(seen):
            for row in np.flatnonzero(todo[:, i]):
                rough = block[row].within(shares[row, i])
                values[row, i], errors[row, i] = rough or (block[row].exact(), 0.0)
        for row in rows:
            results[row], error = combine(values[row], errors[row])
            spare = np.where(error > 0, room(results[row], decimals) / np.maximum(error, GUARD), np.inf)
            if len(spare) != size[1]:
                spare = np.full(size[1], spare.min())
            todo[row] = (errors[row] > 0) & (spare <= 1)
            # The error goes by the square of the share.
            shares[row] *= 0.8 * np.sqrt(np.minimum(spare, 1.0))
        rows = np.flatnonzero(todo.any(axis=1))
    return np.array(results)


class _Part:
    """Held rows of one block as the rows of one profile see them."""

    def __init__(self, held: Ordered, span: slice, far: np.ndarray):
        self.held = held
        size = float(held.spec.size)
        kind, self.outcome = held.kind[span], held.outcome[span]
        self.times = None if held.single else held.times[span]
        if held.free:
            self.far, self.kind, self.number = far[kind], kind, held.number[span]
            self.scaled = self.number / size
        else:
            # Without a free number rows of one distance and outcome are alike.
            gaps, level = np.unique(far, return_inverse=True)
            wide = len(held.values)
            if 2 * len(gaps) * wide <= len(kind):
                cells = np.bincount(
                    level[kind] * wide + held.code[span], None if self.times is None else self.times, len(gaps) * wide
                )
                filled = np.flatnonzero(cells)
                self.far, self.outcome = gaps[filled // wide], held.values[filled % wide]
                self.times = cells[filled].astype("int64")
            else:
                self.far = far[kind]
            self.kind, self.number, self.scaled = None, np.zeros(len(self.far)), np.zeros(len(self.far))
        self.gap = self.far / size

    def seen_by(self, number: np.ndarray, outcome: np.ndarray, row: pd.DataFrame) -> Iterator[Seen]:
        """The conflicts of rows of near numbers."""
        held, scaled = self.held, number / float(self.held.spec.size)
        if held.free:
            low, high = np.searchsorted(self.number, number.min()), np.searchsorted(self.number, number.max(), "right")
        else:
            low = high = 0
        left, right = slice(0, low), slice(high, len(self.far))
        runs, shifts, ends, lasts = [], [], [], []
        for side, number_sign, outcome_sign in ((right, 1, -1), (right, 1, 1), (left, -1, -1), (left, -1, 1)):
            if side.start == side.stop:
                continue
            key = self.gap[side] + number_sign * self.scaled[side] + outcome_sign * self.outcome[side]
            shift = -number_sign * scaled - outcome_sign * outcome
            some = np.flatnonzero(key <= TIE - shift.min())
            times = None if self.times is None else self.times[side][some]
            # A conflict with a row at its very edge is looked up, which is rare with a free number.
            at = None if held.free and held.single else some + side.start
            run = Run.of(key[some], times, at)
            runs.append(run)
            shifts.append(shift)
            ends.append(run.keys.searchsorted(-TIE - shift))
            lasts.append(run.keys.searchsorted(TIE - shift, "right"))
        middle = slice(low, high)
        gap, number_, outcome_ = self.gap[middle], self.scaled[middle], self.outcome[middle]
        for i in range(len(number)):
            near, own = [], []
            if low < high:
                far = number_ - scaled[i]
                np.abs(far, out=far)
                far += gap
                far -= np.abs(outcome_ - outcome[i])
                some = np.flatnonzero(far <= TIE)
                far = far[some]
                edge = far >= -TIE
                if edge.any():
                    near.append(low + some[edge])
                    some, far = some[~edge], far[~edge]
                own.append(Run.of(far, None if self.times is None else self.times[middle][some], None))
            for run, shift, end, last in zip(runs, shifts, ends, lasts):
                if end[i] < last[i]:
                    near.append(self._at_edge(run, shift[i], end[i], last[i], scaled[i], outcome[i]))
            ties = self._ties(np.unique(np.concatenate(near)), number[i], outcome[i], row) if near else 0
            yield Seen(
                own + runs, [0.0] * len(own) + [float(s[i]) for s in shifts],
                [len(run.keys) for run in own] + [int(end[i]) for end in ends], ties,
            )

    def _at_edge(self, run: Run, shift: float, first: int, last: int, scaled: float, outcome: float) -> np.ndarray:
        if run.at is not None:
            return run.at[first:last]
        away = self.gap + np.abs(self.scaled - scaled) - np.abs(self.outcome - outcome)
        return np.flatnonzero(np.abs(away) <= 2 * TIE)

    def _ties(self, at: np.ndarray, number: float, outcome: float, row: pd.DataFrame) -> int:
        """How many of some held rows are in conflict, by the definition."""
        held, size = self.held, float(self.held.spec.size)
        alike = 1.0 - np.abs(outcome - self.outcome[at])
        if held.free:
            at = at[(self.far[at] != 0) | (self.number[at] != number) | (self.outcome[at] != outcome)]
            if not len(at):
                return 0
            alike = 1.0 - np.abs(outcome - self.outcome[at])
            far = self._distance(at, number, row)
        else:
            far = self.far[at]
        conflict = (size - far) / size > alike
        return int(conflict.sum() if self.times is None else self.times[at][conflict].sum())

    def _distance(self, at: np.ndarray, number: float, row: pd.DataFrame) -> np.ndarray:
        """Distances term by term in the order of the attributes."""
        held, kind = self.held, self.kind[at]
        view, kinds = held.kinds.seen_from(row), held.kinds
        terms = {c: (x[0], y[kind]) for c, x, y in zip(kinds.spec.numeric, view.numbers, kinds.numbers)}
        terms[held.free] = (number, self.number[at])
        far = np.zeros(len(at))
        for c in held.spec.numeric:
            x, y = terms[c]
            far += np.abs(x - y)
        if kinds.bits:
            far += set_distance([x[:1] for x in view.bits], [y[kind] for y in kinds.bits], held.jaccard)
        for x, y in zip(view.codes, kinds.codes):
            far += x[0] != y[kind]
        return far
