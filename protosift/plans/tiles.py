"""Comparing two tables tile by tile, skipping tiles that cannot matter.

The held table is cut into tiles of bounded size: rows near the same pivot form
a cell, and a cell with too many rows is split by a hash of the row id, so no
tile depends on how the data are spread. A task holds one tile in memory, the
probing rows it was sent stream past, and only the reduced result of each
probing row leaves the task. Probing rows of a tile are spread over as many
tasks as their number asks for.

The distance is a metric, so a row far from a pivot has a known least distance
to the cell around it. A row is not sent to a cell only when that least
distance shows that the cell cannot change its result. What the driver sees is
bounded: at most ``MOST_CELLS`` pivots and cell summaries.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protosift.plans.approximate import LEAST_NUMBERS
from protosift.plans.groups import Around, Groups, kinds
from protosift.plans.lineage import cut_lineage
from protosift.plans.profiles import RID
from protosift.spec import RowSpec

# Tasks carry this package with them; executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules["protosift"])

TASK, PROBING, CELL = "_task", "_probing", "_cell"
# Cells grow with the rows; the driver holds a row for each.
MOST_CELLS = 32_768
MAX_PROBES = 16_384
SAMPLED = 4096
MAX_PARTITIONS = 20_000
# Rows that would be sent to more cells than this, on average, are first compared with
# this many rows of their own cell, to know better what they look for.
REFINED, HOME_ROWS = 2, 4096


# Pairs a task should compare, and how many comparisons cost as much as sending
# one row to one more task. Both only steer how the work is cut.
TASK_PAIRS = 1 << 30
COPY_COST = 200
# A task takes some tenths of a second however little it does, so small ones share a
# partition: of this cost, as long as each core gets this many partitions.
PARTITION_COST, CORE_PARTITIONS = 1 << 26, 16


@dataclass(frozen=True)
class TileSettings:
    """Sizes that change how the work is cut, never its result."""

    tile_rows: int | None = None
    cell_rows: int = 1024
    least_rows: int = 256
    max_cells: int | None = None

    def rows(self, spec: RowSpec) -> int:
        """Rows of a tile: about 16 MB of attributes, 65,536 rows at most. Rows of many
        numbers, of which a search reads a few bits each, take 64 MB."""
        numbers = 1 << 23 if len(spec.numeric) >= LEAST_NUMBERS else 1 << 21
        return self.tile_rows or int(np.clip(numbers // (spec.size + 2), 4096, 65_536))


@dataclass
class Reach:
    """What the pruning needs to know about a job.

    ``least_seen(distances, probes, batch, seen)`` gives, from the distances of a batch
    to sample rows and from what it gave for other sample rows (``None`` at first), one
    or more lists of numbers per probing row, ``depth`` in all; the greatest of a list is
    an upper bound.
    ``relevant(least, bounds, cells)`` tells for each probing row and cell
    whether the cell may matter. It reads the columns ``summaries`` of ``cells``: the least
    value that rows of the cell have in a column of the held table. What holds for
    a cell has to hold for a group of cells, with the least of their values. The first bound
    of a row travels with it in the column ``carried``, where one is named. Tables are
    given as arrays by column, those that are no attributes.
    ``tighten(found)`` gives the bounds that
    follow from what the kernel found among some held rows: the id and the bounds.
    """

    least_seen: Callable[[np.ndarray, dict, dict, np.ndarray | None], np.ndarray]
    relevant: Callable[[np.ndarray, np.ndarray, dict], np.ndarray]
    bound_names: list[str]
    summaries: dict[str, str]
    depth: int = 1
    carried: str | None = None
    tighten: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Layout:
    """Cells of the held table, in how many parts and chunks each is worked on,
    and both tables with the cell of held and the bounds of probing rows."""

    held: DataFrame
    probing: DataFrame
    needs: Callable[[], Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]]
    width: int
    parts: np.ndarray
    chunks: np.ndarray
    first_task: np.ndarray
    tasks: int
    cost: float


def _pieces(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Batches cut so that a matrix of their rows by ``width`` stays small."""
    step = max(1, (1 << 20) // width)
    for pdf in batches:
        for start in range(0, len(pdf), step):
            yield pdf.iloc[start : start + step]


def plan_layout(
    spec: RowSpec,
    jaccard: str,
    probing: DataFrame,
    n_probing: int,
    held: DataFrame,
    n_held: int,
    reach: Reach,
    settings: TileSettings,
    kernel,
    schema: str,
) -> Layout | None:
    """Decide cells and tasks from bounded summaries.

    None means that cells would not save work, as
    with attributes that keep all rows about equally far apart.

    Where a row would be sent to many cells, ``kernel`` first compares it with rows of
    its own cell. What it finds only bounds what the row looks for.
    """
    tile = settings.rows(spec)
    columns = held.columns

    # Pivots and probes are held rows, so a distance to one is a real distance.
    wanted = int(np.clip(-(-n_held // min(tile, settings.cell_rows)), 2, settings.max_cells or MOST_CELLS))
    n_probes = int(np.clip(4 * math.isqrt(n_held), max(wanted, 64), max(wanted, MAX_PROBES)))
    probes = _sample(held, n_probes, n_held)
    pivots = probes.head(wanted)

    # A row sees about this many group centres, and keeps as many numbers.
    width = 4 * math.isqrt(n_probes) + reach.depth

    def place_held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups = Groups(spec, jaccard, pivots)
        for pdf in _pieces(batches, width):
            view = groups.seen_from(pdf)
            home, away = groups.nearest(view)
            same = np.zeros(len(pdf), "int64")
            for bit, (mine, of_pivots) in enumerate(kinds(jaccard, groups.held, view)):
                same |= (mine == of_pivots[home]).astype("int64") << bit
            yield pdf.assign(**{CELL: home}, _away=away, _same=same)

    def bound_probing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups, known = Groups(spec, jaccard, pivots), Groups(spec, jaccard, probes)
        read = [c for c in columns if c not in spec.attributes]
        own, _ = known.columns(probes[read])
        _, least_own = known.columns(probes[list(reach.summaries.values())].set_axis(list(reach.summaries), axis=1))
        for pdf in _pieces(batches, width):
            home, _ = groups.nearest(groups.seen_from(pdf))
            bounds, seen = np.full((len(pdf), len(reach.bound_names)), np.inf), None
            batch = {c: pdf[c].to_numpy() for c in read}

            def wanted(g: int, least: np.ndarray) -> np.ndarray:
                return reach.relevant(least[:, None], bounds, least_own[g])[:, 0]

            for g, rows, far in known.visit(known.seen_from(pdf), wanted):
                some = {c: x[rows] for c, x in batch.items()}
                found = reach.least_seen(far, own[g], some, None if seen is None else seen[rows])
                if seen is None:
                    seen = np.full((len(pdf), *found.shape[1:]), np.inf)
                seen[rows] = found
                bounds[rows] = np.nan_to_num(found.max(axis=2), nan=np.inf, posinf=np.inf)
            yield pdf.assign(**dict(zip(reach.bound_names, bounds.T)), **{CELL: home})

    # These are the costly passes over the rows, so their results are kept.
    bounds = "".join(f", {c} double" for c in reach.bound_names)
    held = cut_lineage(
        held.mapInPandas(place_held, f"{_columns(held)}, {CELL} long, _away double, _same long")
    )
    probing = cut_lineage(probing.mapInPandas(bound_probing, f"{_columns(probing)}{bounds}, {CELL} long"))

    cells = (
        held.groupBy(CELL)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.max("_away").alias("radius"),
            F.bit_and("_same").alias("_same"),
            *[F.min(c).alias(f"_lo_{c}") for c in spec.numeric],
            *[F.max(c).alias(f"_hi_{c}") for c in spec.numeric],
            *[F.min(c).alias(name) for name, c in reach.summaries.items()],
        )
        .toPandas()
        .set_index(CELL)
        .reindex(range(len(pivots)))
    )
    rows = cells["rows"].fillna(0).to_numpy("int64")

    def needs() -> Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]:
        """Rows of a batch and cells that may matter to them."""
        low, high = ([cells[f"_{e}_{c}"].to_numpy("float64") for c in spec.numeric] for e in ("lo", "hi"))
        same = cells["_same"].fillna(0).to_numpy("int64")
        around = Around(cells["radius"].to_numpy("float64"), low, high, same)
        groups = Groups(spec, jaccard, pivots, around, rows > 0)
        summaries = groups.columns(cells[list(reach.summaries)])

        def of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            known = pdf[reach.bound_names].to_numpy("float64")
            return groups.needed(groups.seen_from(pdf), reach.relevant, known, summaries)

        return of

    whole = float(n_probing) * n_held + COPY_COST * (n_probing * -(-n_held // tile) + n_held)
    parts = np.maximum(1, -(-rows // tile))

    def estimated() -> tuple[np.ndarray, np.ndarray, float]:
        """Rows that come to each cell, its chunks and what all costs. How many come is
        estimated from a sample; any number would be right."""
        sample = _sample(probing, SAMPLED, n_probing)
        coming = np.bincount(needs()(sample)[1], minlength=len(rows)) * (n_probing / max(1, len(sample)))
        chunks = np.ceil(coming * np.minimum(rows, tile) / TASK_PAIRS).clip(1).astype("int64")
        return coming, chunks, (coming * rows + COPY_COST * (coming * parts + chunks * rows)).sum()

    coming, chunks, cost = estimated()
    if cost <= whole and reach.tighten and coming.sum() > REFINED * n_probing:
        found = _in_home(held, probing, columns, rows, n_probing, reach, kernel, schema)
        closer = reach.tighten(found).select(RID, *[F.col(c).alias(f"{c}_home") for c in reach.bound_names])
        # The greater bound is null where too few rows were seen; ``least`` leaves nulls out.
        closest = {c: F.least(c, f"{c}_home") for c in reach.bound_names}
        probing = cut_lineage(
            probing.join(closer, RID, "left").withColumns(closest).drop(*[f"{c}_home" for c in reach.bound_names])
        )
        coming, chunks, cost = estimated()
    if cost > whole:
        return None
    parallelism = held.sparkSession.sparkContext.defaultParallelism
    tasks = int((chunks * parts).sum())
    if tasks < 2 * parallelism:
        finest = np.ceil(coming / settings.least_rows).astype("int64")
        chunks = np.maximum(chunks, np.minimum(chunks * -(-2 * parallelism // tasks), finest))
    ends = np.cumsum(chunks * parts)
    return Layout(held, probing, needs, width, parts, chunks, ends - chunks * parts, int(ends[-1]), cost)


def _sample(df: DataFrame, rows: int, total: int) -> pd.DataFrame:
    """A repeatable sample of ``rows`` of ``total`` rows, the same however the
    table is partitioned.

    Rows whose hash is low enough are picked where they are, a few more than
    wanted, so the driver gets a small multiple of ``rows`` in all.
    """
    place = F.shiftrightunsigned(F.xxhash64(RID), 11) / F.lit(float(2**53))
    share = (rows + 6 * math.sqrt(rows) + 32) / max(1, total)
    picked = df.withColumn("_place", place)
    picked = picked if share >= 1 else picked.where(F.col("_place") < share)
    found = picked.toPandas().sort_values(["_place", RID], ignore_index=True)
    return found.head(rows).drop(columns="_place")


def _of_cell(values: np.ndarray) -> str:
    """A value that is known for each cell, as SQL."""
    return f"get(array({', '.join(f'{v}L' for v in values.tolist())}), {CELL})"


def _in_home(
    held: DataFrame, probing: DataFrame, columns: list[str], rows: np.ndarray, n_probing: int, reach: Reach,
    kernel, schema: str,
) -> DataFrame:
    """What ``kernel`` finds for each probing row among some rows of its own cell, about
    ``HOME_ROWS`` picked by a hash where the cell has more."""
    seen = np.minimum(rows, HOME_ROWS)
    # About as many probing rows as held ones belong to a cell.
    coming = n_probing * rows / max(1, rows.sum())
    chunks = np.ceil(coming * seen / TASK_PAIRS).clip(1).astype("int64")
    first = np.cumsum(chunks) - chunks
    # Kept rows of 2^20, rounded up.
    kept = -(-(seen << 20) // np.maximum(rows, 1))
    some = held.where(f"pmod(xxhash64({RID}, 1), {1 << 20}) < {_of_cell(kept)}").selectExpr(
        *columns, f"{_of_cell(first)} AS _first", f"{_of_cell(chunks)} AS _chunks"
    )
    some = some.selectExpr(*columns, f"explode(sequence(_first, _first + _chunks - 1)) AS {TASK}", f"0 AS {PROBING}")
    if reach.carried:
        probing = probing.withColumn(reach.carried, F.col(reach.bound_names[0]))
    task = f"{_of_cell(first)} + pmod(xxhash64({RID}), {_of_cell(chunks)}) AS {TASK}"
    coming_home = probing.selectExpr(*columns, task, f"1 AS {PROBING}")
    cost = (coming * seen + COPY_COST * (coming + chunks * seen)).sum()
    return run_tasks(some.unionByName(coming_home), int(chunks.sum()), kernel, schema, cost)


def _send_held(layout: Layout, columns: list[str]) -> DataFrame:
    """One copy of a row for each chunk of probing rows that comes to its tile."""
    sent = layout.held.selectExpr(
        *columns,
        f"{_of_cell(layout.parts)} AS _parts",
        f"{_of_cell(layout.chunks)} AS _chunks",
        f"{_of_cell(layout.first_task)} AS _first",
    )
    start = f"_first + pmod(xxhash64({RID}), _parts)"
    tasks = f"explode(sequence({start}, {start} + (_chunks - 1) * _parts, _parts)) AS {TASK}"
    return sent.selectExpr(*columns, tasks, f"0 AS {PROBING}")


def _send_probing(layout: Layout, carried: str | None, bound: str, columns: list[str]) -> DataFrame:
    """One copy of a row for each held tile that may matter to it."""
    needs, width, parts_of = layout.needs, layout.width, layout.parts
    chunks_of, first_of = layout.chunks, layout.first_task

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = needs()
        for pdf in _pieces(batches, width):
            row, cell = of(pdf)
            parts = parts_of[cell]
            chunk = _spread(pdf[RID])[row] % chunks_of[cell]
            task = np.repeat(first_of[cell] + chunk * parts, parts) + _counting(parts)
            if carried:
                pdf = pdf.assign(**{carried: pdf[bound]})
            yield pdf[columns].iloc[np.repeat(row, parts)].assign(**{TASK: task, PROBING: 1})

    schema = f"{_columns(layout.probing.select(columns))}, {TASK} long, {PROBING} int"
    return layout.probing.mapInPandas(send, schema)


def _spread(ids: pd.Series) -> np.ndarray:
    """Even, repeatable numbers for sharing rows out."""
    mixed = ids.to_numpy("int64").astype("uint64") * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(33)).astype("int64")


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _counting(lengths: np.ndarray) -> np.ndarray:
    """0, 1, … up to each length, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def compare(
    spec: RowSpec,
    jaccard: str,
    probing: DataFrame,
    n_probing: int,
    held: DataFrame,
    n_held: int,
    kernel: Callable[[pd.DataFrame], Callable[[pd.DataFrame], Iterator[pd.DataFrame]]],
    schema: str,
    reach: Reach,
    settings: TileSettings,
) -> DataFrame:
    """Run ``kernel`` on every pair of tiles that can matter.

    Both inputs have the same columns. ``kernel`` gets the held rows of a tile
    and returns the function that reduces a batch of probing rows. A held table
    that fits one tile has nothing to prune.
    """
    tile = settings.rows(spec)
    parallelism = held.sparkSession.sparkContext.defaultParallelism
    # Work that is done in seconds anyway is not worth two passes of planning.
    small = n_held <= tile and n_probing * n_held <= parallelism * TASK_PAIRS // 8
    layout = None
    if not small and spec.prunable:
        probing, held = (_in_parallel(df, parallelism) for df in (probing, held))
        layout = plan_layout(
            spec, jaccard, probing, n_probing, held, n_held, reach, settings, kernel, schema
        )
    if layout is None:
        parts = max(1, -(-n_held // tile))
        finest = -(-n_probing // settings.least_rows)
        chunks = max(
            1,
            -(-n_probing * min(n_held, tile) // TASK_PAIRS),
            min(-(-2 * parallelism // parts), finest),
        )
        routed, tasks = pair_all(held, probing, parts, chunks)
        return run_tasks(routed, tasks, kernel, schema)
    routed = _send_held(layout, held.columns).unionByName(
        _send_probing(layout, reach.carried, reach.bound_names[0], held.columns)
    )
    return run_tasks(routed, layout.tasks, kernel, schema, layout.cost)


def _in_parallel(df: DataFrame, parallelism: int) -> DataFrame:
    """``df`` in enough partitions for work that is heavy per row."""
    if df.rdd.getNumPartitions() >= parallelism:
        return df
    return df.repartition(2 * parallelism, RID)


def pair_all(held: DataFrame, probing: DataFrame, parts: int, chunks: int) -> tuple[DataFrame, int]:
    """Send each of ``parts`` shares of the held rows, by a hash of their id, to every
    chunk of the probing rows."""

    def number(n: int):
        return F.lit(n).cast("long")

    # Task = chunk * parts + part.
    part = F.pmod(F.xxhash64(RID), number(parts))
    chunk = F.pmod(F.xxhash64(RID), number(chunks)) * number(parts)
    to_chunks = F.sequence(part, part + number((chunks - 1) * parts), number(parts))
    to_parts = F.sequence(chunk, chunk + number(parts - 1), number(1))
    return (
        held.withColumns({TASK: F.explode(to_chunks), PROBING: F.lit(0)}).select(*probing.columns, TASK, PROBING).unionByName(
            probing.withColumns({TASK: F.explode(to_parts), PROBING: F.lit(1)})
        ),
        chunks * parts,
    )


def run_tasks(routed: DataFrame, tasks: int, kernel, schema: str, cost: float = math.inf) -> DataFrame:
    """Shuffle routed rows to their task and stream each task through ``kernel``.

    Within a partition the held rows of a task come before its probing rows.
    The number of partitions is explicit: the rows are few and the work on them
    is large, so adaptive coalescing by size must not apply. Where all tasks together
    ``cost`` little, several share a partition and are worked on one after the other.
    """
    enough = max(CORE_PARTITIONS * routed.sparkSession.sparkContext.defaultParallelism, cost / PARTITION_COST)
    partitions = max(1, math.ceil(min(tasks, enough, MAX_PARTITIONS)))
    placed = routed.repartitionById(partitions, F.pmod(F.col(TASK), F.lit(partitions)).cast("int"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held, reduce = None, [], None
        for pdf in batches:
            mark = pdf[TASK].to_numpy() * 2 + pdf[PROBING].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(mark)) + 1), len(pdf)]
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                piece = pdf.iloc[start:stop]
                if mark[start] // 2 != current:
                    current, held, reduce = mark[start] // 2, [], None
                if mark[start] % 2 == 0:
                    held.append(piece)
                    continue
                if held:
                    table = pd.concat(held).sort_values(RID, ignore_index=True)
                    held, reduce = [], kernel(table)
                if reduce is not None:
                    yield from reduce(piece)

    return placed.sortWithinPartitions(TASK, PROBING).mapInPandas(work, schema)
