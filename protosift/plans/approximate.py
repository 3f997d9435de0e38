"""Bounds of distances over many numeric attributes from a few bits of each.

With many attributes all rows are about equally far from each other, and cells of
rows exclude nothing. Instead each held number is replaced by one of sixteen cells of
its attribute. For a probing row and two attributes there are 256 possible sums of
least distances, which are computed once; a lower bound of the distance to a held row
is then a sum of table entries, one for each byte of the row. Exact distances are
needed only where that bound does not exceed a distance already found.
"""

from __future__ import annotations

import numpy as np

from protosift.plans.blocks import Held, Viewer, set_distance

# From this many numeric attributes on.
LEAST_NUMBERS = 16
# Held rows of a task from which on cells of many numbers are worth making.
LEAST_APPROXIMATED = 4096
CELLS = 16
# Probing rows whose tables are open at a time, and held rows seen at a time.
PROBING, SEEN = 16, 4096
# Bounds are sums of single precision; they are lowered by this share.
SLACK = 1e-5
# Rows of low bounds that are compared first, for each neighbour wanted.
TRIED = 3


class Approximation:
    """Cells of the held rows, two attributes to a byte."""

    def __init__(self, held: Held):
        self.held = held
        self.numbers = np.stack(held.numbers, axis=1)
        columns = held.numbers + [np.zeros(held.size)] * (len(held.numbers) % 2)
        coded, self.low, self.high = [], [], []
        for values in columns:
            # Half way between cells of equal counts and cells of equal widths.
            order = np.sort(values)
            counted = order[np.linspace(0, held.size - 1, CELLS + 1).astype("int64")[1:-1]]
            edges = (counted + np.linspace(order[0], order[-1], CELLS + 1)[1:-1]) / 2
            code = np.searchsorted(edges, values, side="left")
            low, high = np.full(CELLS, np.inf), np.full(CELLS, -np.inf)
            np.minimum.at(low, code, values)
            np.maximum.at(high, code, values)
            # A cell without rows bounds nothing.
            none = low > high
            low[none], high[none] = -np.inf, np.inf
            coded.append(code.astype("uint8"))
            self.low.append(low)
            self.high.append(high)
        self.codes = [x | (y << 4) for x, y in zip(coded[0::2], coded[1::2])]

    def least(self, view: Viewer, rows: slice) -> np.ndarray:
        """Lower bounds, held rows down and the rows of the slice across."""
        return self.bounds(self.tables(view, rows), self.codes)

    def tables(self, view: Viewer, rows: slice) -> list[np.ndarray]:
        """Least distances of the rows of the slice to the cells of two attributes each."""
        count = rows.stop - rows.start
        numbers = [x[rows] for x in view.numbers]
        numbers += [np.zeros(count)] * (len(numbers) % 2)
        far = [
            np.maximum(np.maximum(low[:, None] - x[None, :], x[None, :] - high[:, None]), 0.0)
            for x, low, high in zip(numbers, self.low, self.high)
        ]
        # Entry x + 16 * y of a table is for cell x of one attribute and y of the next.
        return [
            (second[:, None, :] + first[None, :, :]).reshape(CELLS * CELLS, count).astype("float32")
            for first, second in zip(far[0::2], far[1::2])
        ]

    def bounds(self, tables: list[np.ndarray], coded: list[np.ndarray]) -> np.ndarray:
        """Lower bounds of the distances to held rows of these codes."""
        size, count = len(coded[0]), tables[0].shape[1]
        out = np.zeros((size, count), "float32")
        part = np.empty((min(SEEN, size), count), "float32")
        for start in range(0, size, SEEN):
            total = out[start : start + SEEN]
            for table, codes in zip(tables, coded):
                np.take(table, codes[start : start + SEEN], axis=0, out=part[: len(total)], mode="clip")
                total += part[: len(total)]
        out *= 1.0 - SLACK
        return out


def exact(
    cells: Approximation, view: Viewer, numbers: np.ndarray, row, column, jaccard: str, limit=None
) -> np.ndarray:
    """Distances of chosen pairs, terms in the order of whole matrices; infinite
    for pairs whose numbers alone are beyond the ``limit`` of their row."""
    held = view.held
    total = np.empty(len(row))
    for start in range(0, len(row), SEEN):
        some = slice(start, start + SEEN)
        terms = cells.numbers[column[some]]
        terms -= numbers[row[some]]
        np.abs(terms, out=terms)
        if limit is not None:
            near = np.flatnonzero(terms.sum(axis=1) <= limit[some] * (1 + 1e-9))
            total[some] = np.inf
            # Added up one after the other, as whole matrices are.
            total[start + near] = np.add.accumulate(terms[near], axis=1)[:, -1]
        else:
            total[some] = np.add.accumulate(terms, axis=1)[:, -1]
    if held.bits:
        total += set_distance([x[row] for x in view.bits], [y[column] for y in held.bits], jaccard)
    for x, y in zip(view.codes, held.codes):
        total += x[row] != y[column]
    return total


def nearest_pairs(cells: Approximation, view: Viewer, k: int, bounds, spans, folds, jaccard: str):
    """For each slice of rows and each span of held rows: row, column and distance of
    pairs among which the ``k`` nearest of every row are, and the span's number.

    ``bounds`` are upper bounds of the k-th distance, ``spans`` pairs of positions,
    ``folds`` the folds of both sides or None; columns of a row's own fold are left out.
    """
    size, numbers = view.held.spec.size, np.stack(view.numbers, axis=1)
    for start in range(0, view.size, PROBING):
        rows = slice(start, min(view.size, start + PROBING))
        least = cells.least(view, rows)
        for number, (first, last) in enumerate(spans):
            if first == last:
                continue
            part = least[first:last]
            if folds is not None:
                part = np.where(folds[1][first:last, None] == folds[0][None, rows], np.float32(np.inf), part)
            limit = np.minimum(bounds[rows] * (size * (1 + 1e-9)), np.inf)
            tried = min(TRIED * k, last - first)
            if last - first > tried:
                # The k-th least distance to some rows of low bounds bounds the k-th of all.
                some = np.argpartition(part, tried - 1, axis=0)[:tried]
                row = np.tile(np.arange(rows.start, rows.stop), tried)
                reached = exact(cells, view, numbers, row, some.ravel() + first, jaccard).reshape(tried, -1)
                reached[np.take_along_axis(part, some, axis=0) == np.inf] = np.inf
                limit = np.minimum(limit, np.partition(reached, k - 1, axis=0)[k - 1] * (1 + 1e-9))
            column, row = np.nonzero((part <= limit[None, :]) & (part < np.inf))
            far = exact(cells, view, numbers, row + rows.start, column + first, jaccard, limit[row])
            near = far <= limit[row]
            yield number, row[near] + rows.start, column[near] + first, far[near] / size, len(row)


class Ordered:
    """Held rows in the order of a degree of theirs."""

    def __init__(self, cells: Approximation, degree: np.ndarray):
        self.cells = cells
        self.order = degree.argsort(kind="stable")
        self.degree = degree[self.order]
        self.codes = [codes[self.order] for codes in cells.codes]

    def least_of_greatest(self, view: Viewer, best: np.ndarray, jaccard: str) -> np.ndarray:
        """For each row, the least of ``best`` and of the greater of distance and degree.

        Rows are seen in rising degree, only while their degree is below what was found;
        exact distances are needed where the lower bound is below it as well.
        """
        size, numbers, best = float(view.held.spec.size), np.stack(view.numbers, axis=1), best.copy()
        for start in range(0, view.size, PROBING):
            rows = slice(start, min(view.size, start + PROBING))
            found, tables, first = best[rows], None, 0
            while first < len(self.order) and self.degree[first] < found.max():
                tables = tables or self.cells.tables(view, rows)
                last = min(first + SEEN, int(np.searchsorted(self.degree, found.max(), side="left")))
                part = self.cells.bounds(tables, [codes[first:last] for codes in self.codes])
                degree = self.degree[first:last]

                def compared(at: np.ndarray, row: np.ndarray) -> None:
                    limit = found[row] * (size * (1 + 1e-9)) + 1e-9
                    far = exact(self.cells, view, numbers, row + start, self.order[first + at], jaccard, limit)
                    # The arithmetic of whole matrices, so that values are the same.
                    np.minimum.at(found, row, np.maximum(1.0 - (size - far) / size, degree[at]))

                tried = part.argmin(axis=0)
                compared(tried, np.arange(len(found)))
                at, row = np.nonzero((part <= found * size * (1 + 1e-6) + 1e-6) & (degree[:, None] < found))
                compared(at, row)
                first = last
        return best
