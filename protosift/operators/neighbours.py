"""k nearest prototypes of each row, and predictions from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protosift.functions.fuzzy import fold_of
from protosift.operators.stats import reusable_with_bounds, scale
from protosift.plans.approximate import LEAST_APPROXIMATED, LEAST_NUMBERS, Approximation, nearest_pairs
from protosift.plans.blocks import Held
from protosift.plans.lineage import cut_and_observe, reusable
from protosift.plans.profiles import RID, Profiles, hand_back, profiles_of
from protosift.plans.tiles import Reach, TileSettings, compare
from protosift.spec import RowSpec

FOLD, STEP, LABEL = "_fold", "_step", "_label"
NO_FOLD = -2_000_000_000
# Largest rank that a window limits before the shuffle, and shares of a key beyond.
RANKED, SALTS = 1000, 64
# Nested prototype sets are searched together up to this many rows, and from there on
# while they grow by no more than this factor.
FIRST_SETS, GROWTH = 4096, 4

# Neighbour rows of a profile -> one Column: the weight of a neighbour, from its
# distance and the least and greatest distance among the k.
Weighting = Callable[[Column, Column, Column], Column]

# The neighbours of a row, an array of structs (rank, neighbour_id, distance,
# neighbour_label) from the nearest on -> the predicted outcome.
Predictor = Callable[[Column], Column]

WEIGHTINGS: dict[str, Weighting] = {
    # The farthest of the k neighbours weighs 1 and the nearest 0.
    "reference": lambda d, least, most: (d - least) / (most - least),
    "nearest": lambda d, least, most: (most - d) / (most - least),
    "uniform": lambda d, least, most: F.lit(1.0),
}


@dataclass(frozen=True)
class Search:
    """Nearest prototypes of each test profile, one row per neighbour."""

    tests: DataFrame
    profiles: Profiles
    found: DataFrame


def _nearest_in_tile(spec: RowSpec, k: int, steps: int, folded: bool, jaccard: str):
    """Kernel: the k nearest of each step's prototypes by (distance, id)."""

    def kernel(rows: pd.DataFrame):
        # Each step's prototypes side by side, in the order of their ids.
        rows = rows.sort_values([STEP, RID], ignore_index=True)
        held = Held(spec, rows)
        ids, labels = rows[RID].to_numpy(), rows[LABEL].to_numpy("float64")
        folds = rows[FOLD].to_numpy()
        ends = np.searchsorted(rows[STEP].to_numpy(), np.arange(steps + 1))
        spans = list(zip(ends.tolist(), ends[1:].tolist()))
        many = len(spec.numeric) >= LEAST_NUMBERS and not spec.distance and len(rows) >= LEAST_APPROXIMATED
        cells = Approximation(held) if many else None

        def reduce_many(batch):
            view = held.seen_from(batch)
            bounds = batch[LABEL].to_numpy("float64")
            both = (batch[FOLD].to_numpy(), folds) if folded else None
            found = []
            for step, row, at, away, _ in nearest_pairs(cells, view, k, bounds, spans, both, jaccard):
                found.append((step, *_first(row, at, away, k)))
            yield named(batch, found)

        def reduce(batch):
            view = held.seen_from(batch)
            test_folds = batch[FOLD].to_numpy()
            bounds = batch[LABEL].to_numpy("float64")
            found = []
            for part in view.slices():
                far = view.distances(part, jaccard)
                for step, (start, stop) in enumerate(zip(ends, ends[1:])):
                    if start == stop:
                        continue
                    same = (test_folds[part], folds[start:stop]) if folded else None
                    row, column, away = _least_of_rows(
                        far[:, start:stop], spec.size, k, bounds[part], same
                    )
                    found.append((step, row + part.start, column + start, away))
            yield named(batch, found)

        def named(batch, found):
            step = np.concatenate([np.full(len(row), step) for step, row, _, _ in found])
            row, at, away = map(np.concatenate, list(zip(*found))[1:])
            if np.count_nonzero(np.diff(ends)) > 1:
                best = _of_nested(row, step, ids[at], away, k)
                step, row, at, away = step[best], row[best], at[best], away[best]
            values = (batch[RID].to_numpy()[row], step, ids[at], away, labels[at])
            return pd.DataFrame(dict(zip((RID, STEP, "neighbour_id", "distance", "neighbour_label"), values)))

        return reduce_many if cells else reduce

    return kernel


def _least_of_rows(far, size: int, k: int, bounds: np.ndarray, folds):
    """Row, column and normalised distance of the k nearest columns of each row.

    Distances above the row's bound are of no use, nor is a column of the row's
    own fold. Of equal distances the lower column, that is the lower id, wins.
    """
    some = slice(None, None, max(1, min(16, far.shape[1] // (4 * k))))
    few = far[:, some]
    if folds:
        few = np.where(folds[0][:, None] == folds[1][None, some], np.inf, few)
    if few.shape[1] > k:
        # The k-th least of some columns is no less than that of all.
        bounds = np.minimum(bounds, np.partition(few, k - 1, axis=1)[:, k - 1] / size)
    limit = bounds * (size * (1 + 1e-9))
    row, column = np.divmod(np.flatnonzero(far <= limit[:, None]), far.shape[1])
    if folds:
        other = folds[0][row] != folds[1][column]
        row, column = row[other], column[other]
    return _first(row, column, far[row, column] / size, k)


def _first(row: np.ndarray, column: np.ndarray, away: np.ndarray, k: int):
    """The k nearest pairs of each row, lower columns first among equals."""
    order = np.lexsort((column, away, row))
    row, column, away = row[order], column[order], away[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return row[keep], column[keep], away[keep]


def _nested(row: np.ndarray, step: np.ndarray, ids: np.ndarray, away: np.ndarray, k: int):
    """For each step that occurs, the pairs that are the k nearest of their row among
    the pairs up to that step, by row and from the nearest on."""
    best = np.empty(0, "int64")
    for s in np.unique(step):
        some = np.concatenate([best, np.flatnonzero(step == s)])
        best = some[_first_of(row[some], ids[some], away[some], k)]
        yield s, best


def _first_of(row: np.ndarray, ids: np.ndarray, away: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest pairs of each row, lower ids first among equals."""
    order = np.lexsort((ids, away, row))
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row, side="left") < k]


def _of_nested(row: np.ndarray, step: np.ndarray, ids: np.ndarray, away: np.ndarray, k: int) -> np.ndarray:
    """Positions of the pairs that are among the k nearest up to their own step; the
    others are not in the result of any step."""
    kept = [best[step[best] == s] for s, best in _nested(row, step, ids, away, k)]
    return np.concatenate(kept) if kept else np.empty(0, "int64")


def _merge_steps(found: DataFrame, k: int, steps: int) -> DataFrame:
    """The k nearest of every step from what tiles found, ``rank`` among them and the
    least and greatest distance among them, in ``_least`` and ``_most``.

    Rows are shuffled once, by the probing row, and none is copied from one step to
    the next before that.
    """

    def whole_rows(batches):
        """Batches in which all rows of a probing row are together."""
        waiting: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            ids = batch[RID].to_numpy()
            cut = int(np.searchsorted(ids, ids[-1], side="left"))
            if cut or (waiting and waiting[0][RID].iat[0] != ids[0]):
                if waiting and waiting[0][RID].iat[0] != ids[0]:
                    yield pd.concat(waiting)
                    waiting = []
                if cut:
                    yield pd.concat([*waiting, batch.iloc[:cut]])
                    waiting = []
            waiting.append(batch.iloc[cut:])
        if waiting:
            yield pd.concat(waiting)

    def merge(batches):
        for rows in whole_rows(batches):
            names, row = np.unique(rows[RID].to_numpy(), return_inverse=True)
            step, ids = rows[STEP].to_numpy(), rows["neighbour_id"].to_numpy()
            away, labels = rows["distance"].to_numpy(), rows["neighbour_label"].to_numpy()
            at_step = dict(_nested(row, step, ids, away, k))
            best = None
            for s in range(steps):
                best = at_step.get(s, best)
                if best is None:
                    continue
                own = row[best]
                first = np.searchsorted(own, own, side="left")
                last = np.searchsorted(own, own, side="right") - 1
                far = away[best]
                yield pd.DataFrame({
                    RID: names[own], STEP: np.full(len(best), s, "int32"), "neighbour_id": ids[best],
                    "distance": far, "neighbour_label": labels[best],
                    "rank": (np.arange(len(best)) - first + 1).astype("int32"), "_least": far[first], "_most": far[last],
                })

    schema = (
        f"{RID} long, {STEP} int, neighbour_id long, distance double, neighbour_label double, "
        "rank int, _least double, _most double"
    )
    return found.repartition(RID).sortWithinPartitions(RID).mapInPandas(merge, schema)


def _reach(k: int, steps: int) -> Reach:
    """Pruning for top-k: the k-th nearest sample row bounds the k-th nearest."""

    def least_seen(
        distances: np.ndarray, probes: dict, batch: dict, seen: np.ndarray | None
    ) -> np.ndarray:
        """The k least distances to probes of each step."""
        usable = np.where(batch[FOLD][:, None] == probes[FOLD][None, :], np.inf, distances)
        out = np.full((len(distances), steps, k), np.inf) if seen is None else seen
        for step in range(steps):
            some = np.concatenate([out[:, step], usable[:, probes[STEP] <= step]], axis=1)
            out[:, step] = np.partition(some, k - 1, axis=1)[:, :k]
        return out

    def relevant(least: np.ndarray, bound: np.ndarray, cells: dict) -> np.ndarray:
        # A prototype matters from its own step on, where bounds only shrink.
        return least <= bound[:, cells["_first_step"].astype("int64")]

    def tighten(found: DataFrame) -> DataFrame:
        """The k-th least distance found up to each step, null where fewer were found."""
        seen = found.groupBy(RID).agg(F.sort_array(F.collect_list(F.struct("distance", STEP))).alias("_seen"))

        def kth(step: int) -> Column:
            return F.get(F.filter("_seen", lambda n: n[STEP] <= step), F.lit(k - 1))["distance"]

        return seen.select(RID, *[kth(s).alias(f"_bound_{s}") for s in range(steps)])

    return Reach(
        least_seen, relevant, [f"_bound_{s}" for s in range(steps)], {"_first_step": STEP}, steps * k,
        carried=LABEL, tighten=tighten,
    )


def lowest(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The ``k`` first rows of each key, with their rank in ``_rank``.

    Up to ``RANKED`` the limit is applied before rows are shuffled. For larger k,
    where it is not, rows of a key are first ranked in ``SALTS`` shares, so
    that a key with very many rows is never sorted by one task.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    if k > RANKED:
        share = Window.partitionBy(*keys, "_salt").orderBy(*order)
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
        df = salted.withColumn("_rank", F.row_number().over(share)).where(F.col("_rank") <= k).drop("_salt", "_rank")
    return df.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= k)


def search(
    tests: DataFrame,
    prototypes: DataFrame,
    spec: RowSpec,
    k: int,
    *,
    folds: int | None = None,
    steps: int = 1,
    jaccard: str = "equal",
    settings: TileSettings = TileSettings(),
) -> Search:
    """Nearest prototypes per step; with ``folds`` only those of other folds.

    ``prototypes`` may carry a ``_step`` column: the first of ``steps`` nested
    prototype sets that has the row. All sets are searched in one pass.
    """
    if k < 1:
        raise ValueError("k has to be at least 1")

    def folded(df: DataFrame, otherwise: int) -> DataFrame:
        fold = fold_of(F.col(spec.id), folds) if folds else F.lit(otherwise)
        return df.withColumn(FOLD, fold.cast("int"))

    tests = folded(tests, NO_FOLD)
    prototypes = folded(prototypes, NO_FOLD + 1)
    if STEP not in prototypes.columns:
        prototypes = prototypes.withColumn(STEP, F.lit(0))
    profiles = profiles_of(tests, (*spec.attributes, FOLD), spec.id)

    # Of many copies only the k lowest ids can be neighbours.
    held, seen = cut_and_observe(
        lowest(prototypes, [*spec.attributes, FOLD, STEP], [spec.id], k)
        .select(
            F.col(spec.id).alias(RID), *spec.attributes, FOLD,
            F.col(STEP).cast("int").alias(STEP), F.col(spec.label).alias(LABEL),
        ),
        **{f"rows_{s}": F.count_if(F.col(STEP) == s) for s in range(steps)},
    )
    probing = profiles.df.select(
        RID, *spec.attributes, FOLD, F.lit(0).alias(STEP), F.lit(float("inf")).alias(LABEL)
    )
    # Sets of about one size have about one bound: rows of later ones are not sent
    # where only a row of a far smaller set would matter.
    found = None
    for first, last in _step_groups([seen[f"rows_{s}"] for s in range(steps)]):
        some = held
        if steps > 1:
            some = held.where(F.col(STEP).between(first, last)).withColumn(STEP, F.col(STEP) - F.lit(first))
        part = compare(
            spec,
            jaccard,
            probing,
            profiles.rows,
            some,
            sum(seen[f"rows_{s}"] for s in range(first, last + 1)),
            _nearest_in_tile(spec, k, last - first + 1, folds is not None, jaccard),
            f"{RID} long, {STEP} int, neighbour_id long, distance double, neighbour_label double",
            _reach(k, last - first + 1),
            settings,
        )
        if first:
            part = part.withColumn(STEP, F.col(STEP) + F.lit(first))
        found = part if found is None else found.unionByName(part)
    if steps > 1:
        return Search(tests, profiles, _merge_steps(found, k, steps))
    found = lowest(found, [RID, STEP], ["distance", "neighbour_id"], k).withColumnRenamed("_rank", "rank")
    return Search(tests, profiles, found)


def _step_groups(sizes: list[int]) -> list[tuple[int, int]]:
    """Steps, first and last of each group, whose nested sets are searched together."""
    totals = np.cumsum(sizes).tolist()
    groups, first = [], 0
    for step in range(1, len(sizes) + 1):
        if step == len(sizes) or totals[step] > max(FIRST_SETS, GROWTH * totals[first]):
            groups.append((first, step - 1))
            first = step
    return groups


def _weight_of(weighting: str | Weighting) -> Column:
    """Weight of a neighbour, from its ``distance``, ``_least`` and ``_most``. Equal
    distances, where the weights are undefined, weigh the same."""
    weigh = WEIGHTINGS[weighting] if isinstance(weighting, str) else weighting
    return F.when(
        F.col("_most") > F.col("_least"),
        weigh(F.col("distance"), F.col("_least"), F.col("_most")),
    ).otherwise(1.0)


def predictions_by_step(found: DataFrame, weighting: str | Weighting, names: list[str]) -> DataFrame:
    """One row per test profile: the outcome predicted in every step, by its name.

    The rows of a profile lie together, so they are added up before any shuffle.
    """
    weighed = found.withColumn("_weight", _weight_of(weighting))

    def in_step(step: int) -> Column:
        here = F.col(STEP) == step
        total = F.sum(F.when(here, F.col("_weight") * F.col("neighbour_label")))
        return total / F.sum(F.when(here, F.col("_weight")))

    return weighed.groupBy(RID).agg(*[in_step(step).alias(name) for step, name in enumerate(names)])


def predictions_of(found: DataFrame, weighting: str | Weighting) -> DataFrame:
    """One predicted outcome per test profile and step.

    Equal distances, where the weights are undefined, give the plain mean.
    """
    group = Window.partitionBy(RID, STEP)
    least, most = F.min("distance").over(group), F.max("distance").over(group)
    return (
        found.withColumns({"_least": least, "_most": most})
        .withColumn("_weight", _weight_of(weighting))
        .groupBy(RID, STEP)
        .agg((F.sum(F.col("_weight") * F.col("neighbour_label")) / F.sum("_weight")).alias("predicted"))
    )


def predictions_by(found: DataFrame, predictor: Predictor) -> DataFrame:
    """One predicted outcome per test profile and step, from its neighbours in order."""
    nearest = F.sort_array(F.collect_list(F.struct("rank", "neighbour_id", "distance", "neighbour_label")))
    return found.groupBy(RID, STEP).agg(nearest.alias("_nearest")).select(RID, STEP, predictor(F.col("_nearest")).alias("predicted"))


def _prepared(tests: DataFrame, prototypes: DataFrame, spec: RowSpec, scaling: str | None):
    """Conformed tables; ranges, when asked for, are those of the prototypes."""
    if scaling not in (None, "range"):
        raise ValueError("neighbours are scaled by 'range' or not at all")
    same = tests is prototypes
    prototypes, bounds = reusable_with_bounds(spec.conform(prototypes), spec.numeric if scaling else ())
    tests = prototypes if same else reusable(spec.conform(tests, labelled=False))
    if scaling is None:
        return tests, prototypes
    return scale(tests, spec, "range", bounds), scale(prototypes, spec, "range", bounds)


def knn_topk(
    tests: DataFrame,
    prototypes: DataFrame,
    spec: RowSpec,
    k: int,
    *,
    folds: int | None = None,
    scaling: str | None = None,
    jaccard: str = "equal",
    settings: TileSettings = TileSettings(),
) -> DataFrame:
    """``id, rank, neighbour_id, distance, neighbour_label`` of the k nearest.

    Distances are divided by the number of attributes; ties go to the lower id.
    With ``folds``, rows of the test row's own fold (id modulo ``folds``) are
    left out. Ids of both tables have to be unique.
    """
    tests, prototypes = _prepared(tests, prototypes, spec, scaling)
    result = search(tests, prototypes, spec, k, folds=folds, jaccard=jaccard, settings=settings)
    each = result.found.groupBy(RID).agg(
        F.sort_array(
            F.collect_list(F.struct("rank", "neighbour_id", "distance", "neighbour_label"))
        ).alias("_nearest")
    )
    rows = hand_back(result.tests, spec.id, each, result.profiles, "_nearest")
    return rows.select(F.col(spec.id).alias("id"), F.inline("_nearest"))


def knn_predict(
    tests: DataFrame,
    prototypes: DataFrame,
    spec: RowSpec,
    k: int,
    *,
    weighting: str | Weighting = "reference",
    predictor: Predictor | None = None,
    on_empty: str = "own_label",
    folds: int | None = None,
    scaling: str | None = None,
    jaccard: str = "equal",
    settings: TileSettings = TileSettings(),
) -> DataFrame:
    """``id``, ``actual`` and ``predicted`` of every test row.

    ``predictor`` replaces the weighted mean by any expression over the array of
    a row's neighbours. Test rows need no label; ``actual`` is null then.

    ``weighting="reference"`` gives the farthest of the k neighbours weight 1
    and the nearest weight 0; ``"nearest"`` turns that round and ``"uniform"``
    is the mean. A row without neighbours
    gets its own label, or null with ``on_empty="null"``.
    """
    if on_empty not in ("own_label", "null"):
        raise ValueError(f"unknown on_empty {on_empty!r}")
    tests, prototypes = _prepared(tests, prototypes, spec, scaling)
    result = search(tests, prototypes, spec, k, folds=folds, jaccard=jaccard, settings=settings)
    found = predictions_by(result.found, predictor) if predictor else predictions_of(result.found, weighting)
    predicted = found.withColumnRenamed("predicted", "_predicted")
    rows = hand_back(result.tests, spec.id, predicted, result.profiles, "_predicted")
    actual = F.col(spec.label)
    value = F.coalesce("_predicted", actual) if on_empty == "own_label" else F.col("_predicted")
    return rows.select(
        F.col(spec.id).alias("id"), actual.alias("actual"), value.alias("predicted")
    )
