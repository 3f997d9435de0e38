"""What jobs keep, send and compare as tables grow."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import protosift as ps
from protosift.operators import conflicts, neighbours
from protosift.operators.conflicts import ConflictSettings
from protosift.operators.neighbours import FOLD, LABEL, STEP
from protosift.plans import approximate, groups, tiles
from protosift.plans.blocks import Held, Viewer
from protosift.plans.outcomes import BLOCK, OUTCOME, Arranged
from protosift.plans.profiles import COPIES, RID
from protosift.plans.tiles import TileSettings

POINT = ps.RowSpec("id", ("x",), (), (), "label")


def _points(n: int, steps: int, seed: int = 5) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        RID: np.arange(n), "x": rng.integers(0, 3 * n, n) / 7.0, FOLD: np.arange(n) % 3,
        STEP: rng.integers(0, steps, n), LABEL: rng.random(n),
    })


def test_a_tile_emits_only_what_some_step_uses():
    rows, k, steps = _points(200, 6), 3, 6
    tests = rows.assign(**{STEP: 0, LABEL: np.inf})
    found = pd.concat(neighbours._nearest_in_tile(POINT, k, steps, True, "equal")(rows)(tests))
    for row in tests.itertuples():
        others = rows[rows[FOLD] != rows[FOLD][row.Index]]
        away = (others["x"] - row.x).abs()
        used = set()
        for step in range(steps):
            some = others.assign(away=away)[others[STEP] <= step].sort_values(["away", RID]).head(k)
            used |= set(zip(some[STEP], some[RID]))
        mine = found[found[RID] == row.Index]
        assert set(zip(mine[STEP], mine["neighbour_id"])) == used and len(mine) == len(used)


def test_nested_sets_of_very_different_sizes_are_searched_apart(spark, monkeypatch):
    assert neighbours._step_groups([1, 12, 0, 600, 89_000]) == [(0, 3), (4, 4)]
    assert neighbours._step_groups([9000, 9000, 9000, 9000, 9000]) == [(0, 3), (4, 4)]
    assert neighbours._step_groups([0, 0]) == [(0, 1)] and neighbours._step_groups([7]) == [(0, 0)]

    rows = _points(300, 1).rename(columns={RID: "id", LABEL: "label"})[["id", "x", "label"]]
    quality = pd.DataFrame({"id": rows["id"], "quality": (rows["id"] % 50 == 0) + (rows["id"] % 5 == 0) + rows["label"] / 4})
    tables = [spark.createDataFrame(t) for t in (rows, quality)]

    def sweep(**options):
        found = ps.threshold_sweep(*tables, POINT, 3, **options).orderBy("threshold").collect()
        return [(round(r["threshold"], 9), round(r["rmse"], 9), r["n_folds"], r["size"]) for r in found]

    whole = sweep()
    monkeypatch.setattr(neighbours, "FIRST_SETS", 8)
    monkeypatch.setattr(neighbours, "GROWTH", 2)
    assert sweep(settings=TileSettings(tile_rows=20, cell_rows=8, least_rows=16)) == whole
    sizes = [int((quality["quality"] >= t - 1e-9).sum()) for t, *_ in whole]
    assert [size for *_, size in whole] == sizes


def test_steps_are_merged_by_one_shuffle(spark):
    columns = [RID, STEP, "neighbour_id", "distance", "neighbour_label"]
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({
        RID: rng.integers(0, 40, 900), STEP: rng.integers(0, 4, 900).astype("int32"), "neighbour_id": np.arange(900),
        "distance": rng.integers(0, 30, 900) / 8.0, "neighbour_label": rng.random(900),
    })[columns]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        merged = neighbours._merge_steps(spark.createDataFrame(rows), 3, 5)
        assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        got = {(r[RID], r[STEP], r["rank"]): (r["neighbour_id"], r["_least"], r["_most"]) for r in merged.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for rid, of in rows.groupby(RID):
        for step in range(5):
            some = of[of[STEP] <= step].sort_values(["distance", "neighbour_id"]).head(3)
            for rank, id in enumerate(some["neighbour_id"], 1):
                want[rid, step, rank] = (id, some["distance"].min(), some["distance"].max())
    assert got == want


def _equal_rows(n: int, seed: int) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        "a": rng.integers(0, 5, n) / 4, "s": rng.choice(list("xyz"), n), "b": rng.integers(0, 3, n),
        OUTCOME: rng.integers(0, 41, n) / 40, BLOCK: 0, COPIES: rng.integers(1, 4, n),
    })


MIXED = ps.RowSpec("id", ("a",), ("s",), ("b",), "label")


@pytest.mark.parametrize("jaccard", ["equal", "ratio"])
def test_conflicts_with_groups_of_equal_rows_are_counted_by_search(monkeypatch, jaccard):
    rows = _equal_rows(3000, 3)
    probes = rows.sample(200, random_state=1, ignore_index=True)
    probes.loc[:20, "a"] += 0.01
    outcome = probes[OUTCOME].to_numpy()
    pairs = Arranged(MIXED, jaccard, rows)
    count, least, greatest = np.zeros(200, "int64"), np.full(200, np.inf), np.full(200, -np.inf)
    for row, at, degree in pairs.conflicts(pairs.held.seen_from(probes), outcome):
        np.add.at(count, row, pairs.copies[at])
        np.minimum.at(least, row, degree)
        np.maximum.at(greatest, row, degree)

    equal, compared = Arranged(MIXED, jaccard, rows, True), []
    chosen = Arranged._chosen
    monkeypatch.setattr(Arranged, "_chosen", lambda self, *a: compared.append(a[-1].sum()) or chosen(self, *a))
    found = equal.summary(equal.held.seen_from(probes), outcome)
    for got, want in zip(found, (count, least, greatest)):
        assert np.array_equal(got, want)
    assert sum(compared) < count.sum() / 10


def test_conflict_summary_is_the_same_with_and_without_equal_groups(spark, monkeypatch):
    rows = _equal_rows(700, 8).rename(columns={OUTCOME: "label"}).drop(columns=[BLOCK, COPIES])
    rows["id"] = np.arange(len(rows))
    table = spark.createDataFrame(rows)
    small = ConflictSettings(held_rows=100, probing_rows=50, least_rows=16)
    used = []
    summary = conflicts._Job.run_counted
    monkeypatch.setattr(conflicts._Job, "run_counted", lambda self, f: used.append(self.equal) or summary(self, f))

    def result():
        found = ps.conflict_summary(table, MIXED, settings=small).orderBy("id").collect()
        return [(r["id"], r["conflicts"], r["least"], r["greatest"]) for r in found]

    counted = result()
    assert used == [True]
    monkeypatch.setattr(conflicts, "EQUAL_ROWS", 1000)
    assert result() == counted and used == [True]


@pytest.mark.parametrize("job", ["upper", "nearest"])
def test_rows_go_to_few_cells_once_their_own_cell_is_searched(spark, monkeypatch, job):
    rng = np.random.default_rng(11)
    rows = pd.DataFrame({
        "id": np.arange(1500), "x": rng.random(1500), "y": rng.random(1500), "s": rng.choice(list("pqrs"), 1500),
        "b": rng.integers(0, 3, 1500), "label": rng.random(1500),
    })
    spec = ps.RowSpec("id", ("x", "y"), ("s",), ("b",), "label")
    table = spark.createDataFrame(rows)
    small = TileSettings(tile_rows=200, cell_rows=40, least_rows=1000)
    send, sent = tiles._send_probing, []

    def counted(*args):
        found = send(*args).localCheckpoint()
        sent[-1] += found.count()
        return found

    monkeypatch.setattr(tiles, "_send_probing", counted)

    def result():
        sent.append(0)
        if job == "upper":
            found = ps.class_approximations(table, spec, which=("upper",), settings=small)
        else:
            found = ps.knn_topk(table, table, spec, 3, folds=10, scaling="range", settings=small)
        return sorted(map(tuple, found.select(*[F.round(c, 9) for c in found.columns]).collect()))

    closer = result()
    monkeypatch.setattr(tiles, "REFINED", float("inf"))
    assert result() == closer
    assert 0 < sent[0] < sent[1] * 0.7, sent


def _mixed_points(n: int, seed: int) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        RID: np.arange(n), "x": rng.integers(0, 400, n) / 400, "s": rng.choice(list("pqrs"), n), "b": rng.integers(0, 3, n),
        FOLD: np.arange(n) % 10, STEP: rng.integers(0, 3, n), LABEL: rng.random(n),
    })


@pytest.mark.parametrize("jaccard", ["equal", "ratio"])
def test_rows_are_compared_with_few_pivots_and_probes(monkeypatch, jaccard):
    spec, k, steps = ps.RowSpec("id", ("x",), ("s",), ("b",), "label"), 2, 3
    sample, batch = _mixed_points(1600, 1), _mixed_points(500, 2)
    batch.loc[0, ["s", "b"]] = "unseen", 7
    view = Held(spec, sample).seen_from(batch)
    far = np.concatenate([view.distances(part, jaccard) / spec.size for part in view.slices()])
    seen, distances = [], Viewer.distances

    def counted(self, *args):
        found = distances(self, *args)
        seen.append(found.size)
        return found

    monkeypatch.setattr(Viewer, "distances", counted)
    grouped = groups.Groups(spec, jaccard, sample)
    del seen[:]
    at, away = grouped.nearest(grouped.seen_from(batch))
    assert np.array_equal(at, far.argmin(axis=1)) and np.array_equal(away, far.min(axis=1))
    assert sum(seen) < far.size / 4

    # Cells of whole ranges: the same as by all least distances, or fewer.
    reach, known = neighbours._reach(k, steps), np.full((500, steps), 0.002)
    around = groups.Around(np.full(1600, 0.001), [sample["x"] - 0.004], [sample["x"] + 0.004], np.full(1600, -1))
    around.low, around.high = ([x.to_numpy() for x in edge] for edge in (around.low, around.high))
    cells = groups.Groups(spec, jaccard, sample, around, np.arange(1600) % 7 > 0)
    first = pd.DataFrame({"_first_step": np.zeros(1600)})
    del seen[:]
    row, cell = cells.needed(cells.seen_from(batch), reach.relevant, known, cells.columns(first))
    assert sum(seen) < far.size / 4
    sent = set(zip(row.tolist(), cell.tolist()))
    assert len(sent) == len(row) and not (cell % 7 == 0).any()
    useful = (far <= 0.002) & (np.arange(1600) % 7 > 0)[None, :]
    assert set(zip(*map(np.ndarray.tolist, np.nonzero(useful)))) <= sent
    assert (far[row, cell] - 0.001 <= 0.002 + 1e-6).all()


@pytest.mark.parametrize("steps", [1, 3])
def test_bounds_are_those_of_all_probes(spark, monkeypatch, steps):
    spec, k = ps.RowSpec("id", ("x",), ("s",), ("b",), "label"), 3
    rows = _mixed_points(3000, 4).assign(**{STEP: lambda t: t[STEP] % steps})
    kept, layouts = tiles.cut_lineage, []
    monkeypatch.setattr(tiles, "cut_lineage", lambda df: layouts.append(kept(df)) or layouts[-1])
    monkeypatch.setattr(tiles, "REFINED", float("inf"))
    sampled = []
    sample = tiles._sample
    monkeypatch.setattr(tiles, "_sample", lambda *a: sampled.append(sample(*a)) or sampled[-1])
    table = spark.createDataFrame(rows)
    tiles.plan_layout(
        spec, "equal", table, 3000, table, 3000, neighbours._reach(k, steps), TileSettings(tile_rows=100, cell_rows=20),
        neighbours._nearest_in_tile(spec, k, steps, True, "equal"), "",
    )
    probes, bounded = sampled[0], layouts[1].toPandas().sort_values(RID, ignore_index=True)
    view = Held(spec, probes).seen_from(bounded)
    far = np.concatenate([view.distances(part, "equal").copy() / spec.size for part in view.slices()])
    far[bounded[FOLD].to_numpy()[:, None] == probes[FOLD].to_numpy()[None, :]] = np.inf
    for step in range(steps):
        seen = np.sort(far[:, probes[STEP].to_numpy() <= step], axis=1)[:, k - 1]
        assert np.array_equal(bounded[f"_bound_{step}"].to_numpy(), seen)


def test_small_tasks_share_a_partition(spark):
    rows = pd.DataFrame({RID: np.arange(2000), tiles.TASK: np.arange(2000) % 500, tiles.PROBING: np.arange(2000) // 1000})
    routed = spark.createDataFrame(rows.astype("int64"))

    def kernel(held):
        return lambda batch: iter([pd.DataFrame({RID: batch[RID], "n": held[RID].sum()})])

    def result(cost):
        found = tiles.run_tasks(routed, 500, kernel, f"{RID} long, n long", cost)
        return found.rdd.getNumPartitions(), sorted(map(tuple, found.collect()))

    parallelism = spark.sparkContext.defaultParallelism
    few, shared = result(1e6)
    many, apart = result(float("inf"))
    assert (few, many) == (min(500, tiles.CORE_PARTITIONS * parallelism), 500) and few < 500
    assert shared == apart and len(shared) == 1000
    assert dict(shared)[1003] == 3 + 503


def test_bounds_of_each_step_come_from_what_was_found_up_to_it(spark):
    found = [(1, 0, 0.5), (1, 1, 0.25), (1, 2, 0.125), (2, 1, 0.75), (3, 2, 0.5), (3, 2, 0.625)]
    table = spark.createDataFrame(found, f"{RID} long, {STEP} int, distance double")
    got = {r[RID]: tuple(r)[1:] for r in neighbours._reach(2, 3).tighten(table).collect()}
    assert got == {1: (None, 0.5, 0.25), 2: (None, None, None), 3: (None, None, 0.625)}


@pytest.mark.parametrize("outcomes", [1, 9])
def test_approximations_of_many_numbers_compute_few_distances(monkeypatch, outcomes):
    rng = np.random.default_rng(4)
    spec = ps.RowSpec("id", tuple(f"e{i}" for i in range(20)), (), (), "label")
    held = pd.DataFrame(rng.random((900, 20)), columns=spec.numeric)
    held.loc[850:, :] = held.loc[:49, :].to_numpy()
    degree = rng.integers(0, 10, 900) * outcomes / 9.0
    probes = held.iloc[rng.permutation(900)[:70]]
    best = rng.integers(0, 10, 70) * outcomes / 9.0
    view, far = Held(spec, held).seen_from(probes), np.empty((70, 900))
    for part in view.slices():
        far[part] = 1.0 - view.similarities(part, "equal")
    counted, exact = [], approximate.exact
    monkeypatch.setattr(approximate, "SEEN", 100)
    monkeypatch.setattr(approximate, "exact", lambda *a: counted.append(len(a[3])) or exact(*a))
    ordered = approximate.Ordered(approximate.Approximation(view.held), degree)
    got = ordered.least_of_greatest(view, best, "equal")
    assert np.array_equal(got, np.minimum(best, np.maximum(far, degree[None, :]).min(axis=1)))
    assert sum(counted) < far.size / 4
