"""Quality by ordered weighted averages over the rows in conflict with a row.

Two rows are in conflict when they are more alike than their outcomes are, that
is, when their distance is below the difference of their outcomes. Files and
groups of rows that are too far off for their outcomes are never compared.

A task owns some of the probing rows. It reads the held rows file by file from a
shared table, keeps the conflicts of a few probing rows at a time, and ranks them
when it has seen all files. So one row leaves the task for each probing row, and
neither pairs nor conflicts are shuffled. Where many rows share all attributes, and
the held rows are few enough for a task to keep, probing rows that share theirs see
the held rows in levels of one distance, whose conflicts lie at both ends. Where many
rows share all attributes but one number, and a result is used to some decimals only,
conflicts are ranked as finely as these need (``plans.ranks``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protosift.functions.fuzzy import block_of
from protosift.functions.harmonic import harmonic
from protosift.operators.stats import reusable_with_bounds, scale
from protosift.plans.lineage import cut_lineage
from protosift.plans.outcomes import BLOCK, EQUAL_ROWS, OUTCOME, SLACK, Arranged, Level, Levels
from protosift.plans.profiles import COPIES, RID, Profiles, hand_back, profiles_of
from protosift.plans.ranks import Ordered
from protosift.plans.shared import Reader, SharedTable, read_file, share
from protosift.plans.tiles import MAX_PARTITIONS
from protosift.spec import RowSpec


# Copies of a row in conflict that are ranked one by one, on average at most.
MOST_EXPANDED = 4
# Beyond these, rounding errors of the averages themselves count.
MOST_DECIMALS = 9


@dataclass(frozen=True)
class ConflictSettings:
    """Sizes that change how the work is cut, never its result.

    ``held_rows`` is the size of a file of the shared table, ``kept_rows`` how
    many rows a task keeps in memory from file to file, ``pairs`` how many pairs
    of rows, at most, are open at a time: their conflicts are in memory until
    they are ranked. ``probing_rows`` is the size of a task. Tasks that rank only as
    finely as decimals need keep ``ranked_rows`` at most, and have up to
    ``ranked_probing_rows`` rows each, as they begin by reading the whole table.
    """

    held_rows: int = 65_536
    kept_rows: int = 1 << 22
    pairs: int = 1 << 22
    probing_rows: int = 4096
    least_rows: int = 64
    ranked_rows: int = 1 << 23
    ranked_probing_rows: int = 65_536


@dataclass(frozen=True)
class Conflicts:
    """Conflicts of some rows, ordered by row and block, as segments: the rows and
    blocks, where each segment begins, and the degrees and copies in them."""

    row: np.ndarray
    block: np.ndarray
    starts: np.ndarray
    degree: np.ndarray
    times: np.ndarray | None

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts, append=len(self.degree))


def _segments(found: list[tuple], single: bool) -> Conflicts:
    """Conflicts of several files (row, block, degree, copies) as segments."""
    empty = np.empty(0, "int64")
    if not found:
        return Conflicts(empty, empty, empty, np.empty(0), None if single else empty)
    # Runs of one row and block in each file. Files come in the order of blocks, so a
    # stable order of runs by row is enough, and the conflicts in them move as wholes.
    cuts = [np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0)) for row, block, *_ in found]
    of = np.repeat(np.arange(len(found)), [len(x) for x in cuts])
    row, block = (np.concatenate([x[i][cut] for x, cut in zip(found, cuts)]) for i in (0, 1))
    start = np.concatenate(cuts)
    stop = np.concatenate([np.append(cut, len(x[0]))[1:] for x, cut in zip(found, cuts)])
    if (np.diff(row) < 0).any():
        order = row.argsort(kind="stable")
        row, block, of, start, stop = row[order], block[order], of[order], start[order], stop[order]
        spans = list(zip(of.tolist(), start.tolist(), stop.tolist()))
        degree, times = (np.concatenate([found[k][i][a:b] for k, a, b in spans]) if i == 2 or not single else None for i in (2, 3))
    else:
        degree, times = (np.concatenate([x[i] for x in found]) if i == 2 or not single else None for i in (2, 3))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (block[1:] != block[:-1])
    starts = (np.cumsum(stop - start) - (stop - start))[new]
    return Conflicts(row[new], block[new], starts, degree, times)


def _sorted(found: Conflicts) -> tuple[np.ndarray, np.ndarray | None]:
    """Degrees of each segment in rising order, with their copies."""
    degree, times = found.degree, found.times
    sizes = found.sizes
    if len(sizes) and len(degree) < 32 * len(sizes):
        order = np.lexsort((degree, np.repeat(np.arange(len(sizes)), sizes)))
        return degree[order], None if times is None else times[order]
    for start, size in zip(found.starts.tolist(), sizes.tolist()):
        part = degree[start : start + size]
        if times is None:
            part.sort()
            continue
        order = part.argsort()
        degree[start : start + size] = part[order]
        times[start : start + size] = times[start : start + size][order]
    return degree, times


def averages(found: Conflicts) -> np.ndarray:
    """Ordered weighted average of each segment."""
    if not len(found.starts):
        return np.empty(0)
    starts, sizes = found.starts, found.sizes
    degree, times = _sorted(found)
    if times is None:
        rank = np.arange(1.0, len(degree) + 1)
        rank -= np.repeat(starts, sizes)
        return np.add.reduceat(degree / rank, starts) / harmonic(sizes)
    after = np.cumsum(times)
    after -= np.repeat(after[starts] - times[starts], sizes)
    weight = 1.0 / after
    many = np.flatnonzero(times > 1)
    weight[many] = harmonic(after[many]) - harmonic(after[many] - times[many])
    return np.add.reduceat(degree * weight, starts) / harmonic(np.add.reduceat(times, starts))


@dataclass(frozen=True)
class _Job:
    """What the tasks of one run need; ``files`` are the shared table's."""

    spec: RowSpec
    jaccard: str
    settings: ConflictSettings
    files: pd.DataFrame
    single: bool
    equal: bool = False
    levels: bool = False
    ranked: bool = False
    free: str | None = None

    def matters(self, batch: pd.DataFrame) -> np.ndarray:
        """Which files may hold conflicts of each row of a batch."""
        files, spec = self.files, self.spec
        y = batch[OUTCOME].to_numpy("float64")[:, None]
        apart = np.maximum(y - files["_lo_outcome"].to_numpy()[None, :], files["_hi_outcome"].to_numpy()[None, :] - y)
        if not spec.distance and not spec.similarity:
            far = np.zeros(apart.shape)
            for c in spec.numeric:
                x = batch[c].to_numpy("float64")[:, None]
                low, high = (files[f"_{e}_{c}"].to_numpy("float64")[None, :] for e in ("lo", "hi"))
                far += np.maximum(np.maximum(low - x, x - high), 0.0)
            for c in spec.string + (spec.bitset if self.jaccard == "equal" else ()):
                low, high = (files[f"_{e}_{c}"].to_numpy() for e in ("lo", "hi"))
                x = batch[c].to_numpy()[:, None]
                far += (low == high)[None, :] & (x != low[None, :])
            apart -= far / spec.size
        return apart > -SLACK

    def found_in(self, reader: Reader, batch: pd.DataFrame) -> Conflicts:
        outcome = batch[OUTCOME].to_numpy("float64")
        needed = self.matters(batch)
        found = []
        for i in np.flatnonzero(needed.any(axis=0)):
            rows = np.flatnonzero(needed[:, i])
            held = reader[i]
            view = held.held.seen_from(batch.iloc[rows])
            for row, at, degree in held.conflicts(view, outcome[rows]):
                block = np.full(len(at), held.blocks[0]) if held.one_block else held.blocks[at]
                found.append((rows[row], block, degree, None if self.single else held.copies[at]))
        return _segments(found, self.single)

    def counted_in(self, reader: Reader, batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of conflicts of each row, their least and their greatest degree."""
        outcome = batch[OUTCOME].to_numpy("float64")
        needed = self.matters(batch)
        count = np.zeros(len(batch), "int64")
        least, greatest = np.full(len(batch), np.inf), np.full(len(batch), -np.inf)
        for i in np.flatnonzero(needed.any(axis=0)):
            rows = np.flatnonzero(needed[:, i])
            held = reader[i]
            n, low, high = held.summary(held.held.seen_from(batch.iloc[rows]), outcome[rows])
            count[rows] += n
            least[rows], greatest[rows] = np.minimum(least[rows], low), np.maximum(greatest[rows], high)
        none = count == 0
        return count, np.where(none, np.nan, least), np.where(none, np.nan, greatest)

    def _reader(self) -> Reader:
        return Reader(
            self.files["uri"].tolist(), self.files["rows"].tolist(), self.settings.kept_rows,
            lambda part: Arranged(self.spec, self.jaccard, part, self.equal),
        )

    def run_counted(self, reduce: Callable[..., pd.DataFrame]):
        """As ``run``, with the number and range of conflicts in place of them all."""

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader = self._reader()
            for batch in batches:
                if len(batch):
                    yield reduce(batch, *self.counted_in(reader, batch))

        return work

    def run_levels(self, reduce: Callable[[pd.DataFrame, Conflicts], pd.DataFrame]):
        """As ``run``, for the rows of each profile in turn."""

        def of_profile(level: Level, part: pd.DataFrame) -> Conflicts:
            count, degree, times = level.conflicts(part[OUTCOME].to_numpy("float64"))
            if not len(degree):
                return _segments([], self.single)
            first = np.flatnonzero(np.diff(level.block, prepend=-1))  # blocks are not negative
            sizes = np.add.reduceat(count, first, axis=1).ravel()
            row, block = np.divmod(np.flatnonzero(sizes), len(first))
            sizes = sizes[sizes > 0]
            # Few copies are ranked one by one, many together.
            if times is not None and times.sum() <= MOST_EXPANDED * len(times):
                sizes = np.add.reduceat(times, np.cumsum(sizes) - sizes)
                degree, times = np.repeat(degree, times), None
            return Conflicts(row, level.block[first[block]], np.cumsum(sizes) - sizes, degree, times)

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None
            for batch in batches:
                if not len(batch):
                    continue
                if held is None:
                    held = Levels(self.spec, pd.concat([read_file(x) for x in self.files["uri"]], ignore_index=True))
                kinds = batch.groupby([*self.spec.attributes], sort=False, dropna=False).ngroup().to_numpy()
                first = np.unique(kinds, return_index=True)[1]
                view, found = held.groups.seen_from(batch.iloc[first]), []
                for k in range(len(first)):
                    level = held.seen_with(view.similarities(slice(k, k + 1), self.jaccard)[0])
                    rows = batch.iloc[np.flatnonzero(kinds == k)]
                    step = max(1, self.settings.pairs // max(1, len(level.outcomes)))
                    for i in range(0, len(rows), step):
                        part = rows.iloc[i : i + step]
                        found.append(reduce(part, of_profile(level, part)))
                yield pd.concat(found)

        return work

    def run_ranked(self, decimals: int, combine, named: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]):
        """As ``run``, for results of so many decimals; rows of each profile lie together."""

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = [batch for batch in batches if len(batch)]
            if not rows:
                return
            rows = pd.concat(rows, ignore_index=True)
            held = Ordered(self.spec, self.jaccard, self.free, map(read_file, self.files["uri"]))
            kinds = rows.groupby(held.rest, sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(kinds, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(kinds[order])) + 1):
                part = rows.iloc[at]
                yield named(part, held.averages(part, decimals, combine))

        return work

    def run(self, reduce: Callable[[pd.DataFrame, Conflicts], pd.DataFrame]):
        """A function over batches of probing rows: their conflicts, reduced."""
        if self.levels:
            return self.run_levels(reduce)

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader = self._reader()
            step = max(1, self.settings.pairs // max(1, self.files["rows"].sum()))
            for batch in batches:
                parts = [batch.iloc[i : i + step] for i in range(0, len(batch), step)]
                if parts:
                    yield pd.concat([reduce(part, self.found_in(reader, part)) for part in parts])

        return work


@dataclass(frozen=True)
class _Prepared:
    rows: DataFrame
    spec: RowSpec
    profiles: Profiles
    table: SharedTable
    probing: DataFrame
    blocks: list[int]
    job: _Job

    def reduced(self, work, schema: str) -> DataFrame:
        """One row per profile, kept in the shared folder; the table is dropped."""
        try:
            return cut_lineage(self.probing.mapInPandas(work, schema))
        finally:
            self.table.drop()


def _few_kinds(profiles: Profiles, spec: RowSpec) -> tuple[bool, str | None]:
    """Whether many rows share all attributes, or all but one number, and which."""
    spared = [None, *(c for c in spec.numeric if spec.size > 1)]
    kinds = profiles.df.agg(*[
        F.approx_count_distinct(F.struct(*[x for x in spec.attributes if x != c])) for c in spared
    ]).first()
    if kinds[0] * EQUAL_ROWS <= profiles.rows:
        return True, None
    least = min(range(len(spared)), key=lambda i: kinds[i])
    return kinds[least] * EQUAL_ROWS <= profiles.rows, spared[least]


def _prepare(
    df: DataFrame, spec: RowSpec, blocks: int, jaccard: str, settings: ConflictSettings, counted: bool = False,
    decimals: int | None = None,
) -> _Prepared:
    """The probing rows and the shared table of held rows.

    A row never conflicts with its copies (similarity 1, equal outcome), so
    leaving out the row itself needs no test and copies can be counted. Where conflicts
    are only ``counted`` and many rows share all attributes, these lie together.
    """
    if blocks < 1:
        raise ValueError("blocks has to be at least 1")
    if decimals is not None and not 0 <= decimals <= MOST_DECIMALS:
        raise ValueError(f"decimals has to be 0 to {MOST_DECIMALS}")
    if jaccard not in ("equal", "ratio"):
        raise ValueError(f"unknown jaccard mode {jaccard!r}")
    rows, bounds = reusable_with_bounds(spec.conform(df), [*spec.numeric, spec.label])
    scaled = scale(rows, spec, "minmax", bounds).withColumnRenamed(spec.label, OUTCOME)
    keys = (*spec.attributes, OUTCOME)
    profiles = profiles_of(scaled, keys, spec.id)
    if blocks == 1:
        held, n_held = profiles.df.withColumn(BLOCK, F.lit(0).cast("long")), profiles.rows
    else:
        held = scaled.groupBy(*keys, block_of(F.col(spec.id), blocks).alias(BLOCK)).agg(
            F.min(spec.id).alias(RID), F.count(F.lit(1)).alias(COPIES)
        )
        n_held = min(profiles.source_rows, profiles.rows * blocks)
    # Alike rows side by side: strings and sets, then quarters of each number.
    order = [
        *map(F.col, (BLOCK, *spec.string, *spec.bitset)),
        *[F.floor(F.col(c) * 4) for c in spec.numeric[:8]],
        F.col(OUTCOME),
    ]
    equal, few, free = False, False, None
    own = bool(spec.distance or spec.similarity)
    if decimals is not None and n_held > settings.held_rows and not own:
        few, free = _few_kinds(profiles, spec)
    if not few and (counted or n_held <= settings.kept_rows) and spec.attributes and not own:
        kinds = profiles.df.agg(F.approx_count_distinct(F.struct(*spec.attributes))).first()[0]
        equal = kinds * EQUAL_ROWS <= profiles.rows
    if equal:
        order = [*map(F.col, (BLOCK, *spec.string, *spec.bitset, *spec.numeric, OUTCOME))]
    edges = [
        e(c).alias(f"_{n}_{'outcome' if c == OUTCOME else c}")
        for c in (*keys, BLOCK)
        for n, e in (("lo", F.min), ("hi", F.max))
    ]
    counts = [F.count(F.lit(1)).alias("rows"), F.max(COPIES).alias("_most"), F.collect_set(BLOCK).alias("_blocks")]
    columns = [*keys, COPIES, BLOCK]
    table = share(held.select(*columns), order, -(-n_held // settings.held_rows), [*edges, *counts])
    files = table.files
    ranked = few and files["rows"].sum() <= settings.ranked_rows
    # One value per block of the caller.
    present = sorted({int(b) for found in files["_blocks"] for b in found})
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(
        -(-profiles.rows // settings.probing_rows),
        min(4 * parallelism, -(-profiles.rows // settings.least_rows)),
        1,
    )
    probing, tasks = profiles.df.select(RID, *keys), min(tasks, MAX_PARTITIONS)
    if ranked:
        tasks = max(
            -(-profiles.rows // settings.ranked_probing_rows),
            min(8 * parallelism, -(-profiles.rows // settings.least_rows)),
            1,
        )
        alike = [c for c in spec.attributes if c != free]
        alike += [free or OUTCOME]
        probing = probing.repartitionByRange(min(tasks, MAX_PARTITIONS), *alike)
    # With several files a task's rows should need the same ones.
    elif len(files) > 1:
        probing = probing.withColumn(BLOCK, F.lit(0)).repartitionByRange(tasks, *order).drop(BLOCK)
    else:
        probing = probing.repartition(tasks, RID)
    single = bool((files["_most"] == 1).all()) if len(files) else True
    job = _Job(spec, jaccard, settings, files.drop(columns="_blocks"), single, equal and counted, equal and not counted)
    job = replace(job, ranked=True, free=free) if ranked else job
    return _Prepared(scaled, spec, profiles, table, probing, present, job)


def _by_block(part: pd.DataFrame, found: Conflicts, blocks: np.ndarray, empty: float) -> np.ndarray:
    """Averages of each row (down) in each block (across)."""
    values = np.full((len(part), len(blocks)), empty)
    values[found.row, np.searchsorted(blocks, found.block)] = averages(found)
    return values


def quality_powa(
    df: DataFrame,
    spec: RowSpec,
    *,
    blocks: int = 1,
    empty_value: float = 0.0,
    jaccard: str = "equal",
    decimals: int | None = None,
    settings: ConflictSettings = ConflictSettings(),
) -> DataFrame:
    """``id`` and ``quality``: average over blocks of the averages within them.

    Attributes and outcome are min-max scaled. Compared rows are divided into
    ``blocks`` by id; ``blocks=1`` is the exact average over all conflicts. A
    block without conflicts counts as ``empty_value``: 0 by default, which
    pulls the row down; 1 treats it as perfect. With ``decimals`` the result is only
    used rounded to so many, which then is that of the exact average: larger tables
    are ranked as finely as that needs.
    """
    ready = _prepare(df, spec, blocks, jaccard, settings, decimals=decimals)
    present, empty = np.array(ready.blocks, "int64"), float(empty_value)
    weight = 1.0 / np.arange(1, len(present) + 1)

    def named(part: pd.DataFrame, quality: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({RID: part[RID].to_numpy(), "_quality": quality})

    def reduce(part: pd.DataFrame, found: Conflicts) -> pd.DataFrame:
        each = np.sort(_by_block(part, found, present, empty), axis=1)
        return named(part, (each * weight).sum(axis=1) / weight.sum())

    def combine(values: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        each = np.sort(np.where(np.isnan(values), empty, values))
        return np.array([(each * weight).sum() / weight.sum()]), np.array([errors.max()])

    job = ready.job
    work = job.run_ranked(decimals, combine, lambda part, x: named(part, x[:, 0])) if job.ranked else job.run(reduce)
    best = ready.reduced(work, f"{RID} long, _quality double")
    rows = hand_back(ready.rows, spec.id, best, ready.profiles, "_quality")
    return rows.select(F.col(spec.id).alias("id"), F.col("_quality").alias("quality"))


def owa_blocks(
    df: DataFrame,
    spec: RowSpec,
    *,
    blocks: int,
    empty_value: float = 0.0,
    jaccard: str = "equal",
    decimals: int | None = None,
    settings: ConflictSettings = ConflictSettings(),
) -> DataFrame:
    """``id, block, owa``: the averages within blocks before they are combined.
    ``decimals`` are those of ``quality_powa``."""
    ready = _prepare(df, spec, blocks, jaccard, settings, decimals=decimals)
    present, empty = np.array(ready.blocks, "int64"), float(empty_value)

    def named(part: pd.DataFrame, each: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({RID: part[RID].to_numpy(), "_each": list(each)})

    def reduce(part: pd.DataFrame, found: Conflicts) -> pd.DataFrame:
        return named(part, _by_block(part, found, present, empty))

    def combine(values: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.where(np.isnan(values), empty, values), errors

    job = ready.job
    work = job.run_ranked(decimals, combine, named) if job.ranked else job.run(reduce)
    each = ready.reduced(work, f"{RID} long, _each array<double>")
    rows = hand_back(ready.rows, spec.id, each, ready.profiles, "_each")
    names = F.split(F.lit(",".join(map(str, ready.blocks))), ",").cast("array<long>")
    pairs = F.arrays_zip(names.alias("block"), F.col("_each").alias("owa"))
    return rows.select(F.col(spec.id).alias("id"), F.inline(pairs).alias("block", "owa"))


def conflict_summary(
    df: DataFrame,
    spec: RowSpec,
    *,
    jaccard: str = "equal",
    settings: ConflictSettings = ConflictSettings(),
) -> DataFrame:
    """``id, conflicts, least, greatest``: how many rows conflict with a row,
    and the range of their conflict degrees (null without conflicts)."""
    ready = _prepare(df, spec, 1, jaccard, settings, counted=True)

    def named(part: pd.DataFrame, count, least, greatest) -> pd.DataFrame:
        names = {"_conflicts": count, "_least": least, "_greatest": greatest}
        return pd.DataFrame({RID: part[RID].to_numpy(), **names})

    def reduce(part: pd.DataFrame, found: Conflicts) -> pd.DataFrame:
        count = np.zeros(len(part), "int64")
        least, greatest = np.full(len(part), np.nan), np.full(len(part), np.nan)
        if len(found.row):
            starts, times = found.starts, found.times
            count[found.row] = found.sizes if times is None else np.add.reduceat(times, starts)
            least[found.row] = np.minimum.reduceat(found.degree, starts)
            greatest[found.row] = np.maximum.reduceat(found.degree, starts)
        return named(part, count, least, greatest)

    job = ready.job
    found = ready.reduced(job.run_counted(named) if job.equal else job.run(reduce), f"{RID} long, _conflicts long, _least double, _greatest double")
    rows = hand_back(ready.rows, spec.id, found, ready.profiles, "_conflicts", "_least", "_greatest")

    def known(c: str) -> Column:
        return F.nanvl(c, F.lit(None).cast("double"))

    return rows.select(
        F.col(spec.id).alias("id"),
        F.col("_conflicts").alias("conflicts"),
        known("_least").alias("least"),
        known("_greatest").alias("greatest"),
    )
