"""Pairwise jobs against brute force, cut into few and into very many tiles.

A third of the rows are copies of one row, and ids may be negative.
"""

import sys
from os.path import dirname

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import protosift as ps
from protosift.functions.fuzzy import identity_class
from protosift.operators import conflicts, neighbours
from protosift.operators.conflicts import ConflictSettings
from protosift.plans import profiles, tiles
from protosift.plans.approximate import Approximation, nearest_pairs
from protosift.plans.blocks import Held
from protosift.plans.outcomes import BLOCK, OUTCOME, Arranged, Levels
from protosift.plans.profiles import COPIES, RID
from protosift.plans.tiles import TileSettings, _sample

sys.path.insert(0, dirname(__file__))
import brute  # noqa: E402

SPEC = ps.RowSpec("key", ("x", "z"), ("s",), ("bits",), "y")
SETTINGS = {
    "whole": TileSettings(),
    "cells": TileSettings(tile_rows=40, cell_rows=12, least_rows=8),
    "split cells": TileSettings(tile_rows=7, cell_rows=40, least_rows=8, max_cells=3),
}


def table(seed=1, n=240, spread=1.0):
    r = np.random.default_rng(seed)
    df = pd.DataFrame(
        {
            "key": r.permutation(np.arange(-40, n - 40)),
            "x": np.round(r.normal(0, spread, n), 3),
            "z": np.round(r.random(n) * spread, 3) - 5.0,
            "s": r.choice(["red", "green", "blue", ""], n),
            "bits": r.choice([0, 1, 3, 6, 7], n),
            "y": np.round(r.normal(0, 100, n), 2),
        }
    )
    hot = df.index[: n // 3]
    for c in ("x", "z", "s", "bits"):
        df.loc[hot, c] = df[c].iloc[0]
    df.loc[hot[: n // 6], "y"] = df["y"].iloc[0]
    return df


@pytest.fixture(scope="module")
def data(spark):
    pdf = table()
    return pdf, spark.createDataFrame(pdf).repartition(3).cache()


@pytest.fixture(scope="module", autouse=True)
def always_prune():
    """Plan cells for the small fixtures too."""
    kept, tiles.COPY_COST = tiles.COPY_COST, 0
    yield
    tiles.COPY_COST = kept


def values(df, column, id="id"):
    return {r[id]: r[column] for r in df.collect()}


def same(found, ids, wanted):
    assert set(found) == set(ids)
    assert [found[i] for i in ids] == pytest.approx(list(wanted), abs=1e-9)


@pytest.mark.parametrize("settings", list(SETTINGS))
@pytest.mark.parametrize("jaccard", ["equal", "ratio"])
def test_hml(data, settings, jaccard):
    pdf, df = data
    found = ps.quality_hml(df, SPEC, jaccard=jaccard, settings=SETTINGS[settings])
    same(values(found, "quality"), pdf["key"], brute.hml(pdf, SPEC, jaccard))


def test_hml_numeric_only(data):
    pdf, df = data
    found = ps.quality_hml(df, SPEC, numeric_only=True, settings=SETTINGS["cells"])
    same(values(found, "quality"), pdf["key"], brute.hml(pdf, SPEC.only_numeric()))


def test_class_approximations_enclose_membership(data):
    pdf, df = data
    found = {r["id"]: r for r in ps.class_approximations(df, SPEC, settings=SETTINGS["cells"]).collect()}
    for name, degree in zip(("low", "mid", "high"), brute.memberships(pdf["y"].to_numpy())):
        for id, c in zip(pdf["key"], degree):
            assert found[id][f"lower_{name}"] <= c + 1e-9 and c <= found[id][f"upper_{name}"] + 1e-9


@pytest.mark.parametrize(
    "settings",
    [
        ConflictSettings(),
        ConflictSettings(held_rows=17, probing_rows=50),
        ConflictSettings(held_rows=30, kept_rows=40, pairs=100),
    ],
    ids=["one file", "several files", "files read again"],
)
@pytest.mark.parametrize("blocks,empty", [(1, 0.0), (3, 0.0), (3, 1.0)])
def test_powa(data, settings, blocks, empty):
    pdf, df = data
    found = ps.quality_powa(df, SPEC, blocks=blocks, empty_value=empty, settings=settings)
    same(values(found, "quality"), pdf["key"], brute.powa(pdf, SPEC, blocks, empty))


def test_powa_when_one_block_is_hot(spark):
    pdf = table(seed=3, n=150)
    pdf["key"] = np.where(np.arange(150) < 100, np.arange(150) * 5, np.arange(150))
    pdf = pdf.drop_duplicates("key")
    settings = ConflictSettings(held_rows=40, probing_rows=50)
    found = ps.quality_powa(spark.createDataFrame(pdf), SPEC, blocks=5, settings=settings)
    same(values(found, "quality"), pdf["key"], brute.powa(pdf, SPEC, 5))


@pytest.mark.parametrize("settings", list(SETTINGS))
@pytest.mark.parametrize("folds", [None, 10])
def test_nearest(spark, settings, folds):
    protos, tests = table(), table(seed=2, n=90, spread=3.0)
    found = {}
    job = ps.knn_topk(
        spark.createDataFrame(tests), spark.createDataFrame(protos), SPEC, 4, folds=folds,
        settings=SETTINGS[settings],
    )
    for r in job.collect():
        found.setdefault(r["id"], []).append((r["rank"], r["neighbour_id"], r["distance"]))
    wanted = brute.nearest(tests, protos, SPEC, 4, folds)
    assert set(found) == set(wanted)
    for id, near in wanted.items():
        assert [x[1] for x in sorted(found[id])] == [n[0] for n in near]
        assert [x[2] for x in sorted(found[id])] == pytest.approx([n[1] for n in near])


@pytest.mark.parametrize("settings", ["whole", "cells"])
def test_sweep_equals_separate_runs(data, spark, settings):
    pdf, df = data
    r = np.random.default_rng(5)
    quality = pd.DataFrame({"id": pdf["key"], "quality": np.round(r.random(len(pdf)), 2)})[:-10]
    lines = ps.threshold_sweep(
        df, spark.createDataFrame(quality), SPEC, 3, settings=SETTINGS[settings]
    ).collect()
    assert len(lines) == 11
    rated = pdf.merge(quality, left_on="key", right_on="id").drop(columns="id")
    for line in lines:
        kept = rated[rated["quality"] >= line["threshold"]]
        assert line["size"] == len(kept)
        assert line["rmse"] == pytest.approx(brute.rmse(pdf, kept, SPEC, 3))


def test_hot_profiles_are_spread(data, monkeypatch):
    """Handing results back with every frequent profile salted changes nothing."""
    pdf, df = data
    monkeypatch.setattr(profiles, "HOT_FLOOR", 3)
    found = ps.quality_hml(df, SPEC)
    same(values(found, "quality"), pdf["key"], brute.hml(pdf, SPEC))
    assert "_salt" in found._jdf.queryExecution().toString()


def wide_table(seed, n, numbers=20):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (6, numbers))
    x = centres[r.integers(0, 6, n)] + r.normal(0, 0.3, (n, numbers))
    x[: n // 4] = x[0]  # copies tie
    x[:, 3] = 7.0
    pdf = pd.DataFrame(np.round(x, 3), columns=[f"e{i}" for i in range(numbers)])
    return pdf.assign(key=r.permutation(n), s=r.choice(["a", "b"], n), bits=r.choice([1, 3], n), y=r.random(n))


@pytest.mark.parametrize("folds", [None, 10])
@pytest.mark.parametrize("tile_rows", [None, 90])
def test_nearest_by_cells_of_many_numbers(spark, monkeypatch, folds, tile_rows):
    monkeypatch.setattr(neighbours, "LEAST_APPROXIMATED", 1)
    spec = ps.RowSpec("key", tuple(f"e{i}" for i in range(20)), ("s",), ("bits",), "y")
    protos, tests = wide_table(1, 300), wide_table(2, 70)
    job = ps.knn_topk(
        spark.createDataFrame(tests), spark.createDataFrame(protos), spec, 4, folds=folds, jaccard="ratio",
        settings=TileSettings(tile_rows=tile_rows),
    )
    found = {}
    for r in job.collect():
        found.setdefault(r["id"], []).append((r["rank"], r["neighbour_id"]))
    wanted = brute.nearest(tests, protos, spec, 4, folds, "ratio")
    assert {i: [x[1] for x in sorted(v)] for i, v in found.items()} == {i: [x[0] for x in v] for i, v in wanted.items()}


def test_sweep_by_cells_of_many_numbers(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_APPROXIMATED", 1)
    spec = ps.RowSpec("key", tuple(f"e{i}" for i in range(20)), ("s",), ("bits",), "y")
    pdf = wide_table(3, 150)
    quality = pd.DataFrame({"id": pdf["key"], "quality": np.round(np.random.default_rng(5).random(150), 2)})
    rated = pdf.merge(quality, left_on="key", right_on="id").drop(columns="id")
    for line in ps.threshold_sweep(spark.createDataFrame(pdf), spark.createDataFrame(quality), spec, 3).collect():
        kept = rated[rated["quality"] >= line["threshold"]]
        assert line["rmse"] == pytest.approx(brute.rmse(pdf, kept, spec, 3))


def test_few_exact_distances_of_many_numbers():
    pdf = wide_table(4, 6000, 64)
    spec = ps.RowSpec("key", tuple(f"e{i}" for i in range(64)), label="y")
    held = Held(spec, pdf)
    view = held.seen_from(pdf.iloc[3000:3100])
    pairs = nearest_pairs(Approximation(held), view, 5, np.full(100, np.inf), [(0, 6000)], None, "equal")
    assert sum(x[4] for x in pairs) < 0.15 * 100 * 6000, "the six groups hold a sixth each"


def test_cells_are_skipped(spark, monkeypatch):
    """Far-apart groups of rows are not compared with each other."""
    r = np.random.default_rng(7)
    n = 400
    pdf = pd.DataFrame({"key": np.arange(n), "x": r.integers(0, 8, n) * 1000.0 + r.random(n), "y": r.random(n)})
    spec = ps.RowSpec("key", ("x",), label="y")
    sent = []
    run = tiles.run_tasks
    monkeypatch.setattr(
        tiles, "run_tasks", lambda routed, *rest: sent.append(routed.where("_probing = 1").count()) or run(routed, *rest)
    )
    df = spark.createDataFrame(pdf)
    job = ps.knn_topk(df, df, spec, 2, settings=TileSettings(tile_rows=60, cell_rows=25))
    near = {}
    for row in job.collect():
        near.setdefault(row["id"], []).append((row["rank"], row["neighbour_id"]))
    wanted = brute.nearest(pdf, pdf, spec, 2)
    assert {i: [x[1] for x in sorted(v)] for i, v in near.items()} == {
        i: [x[0] for x in v] for i, v in wanted.items()
    }
    assert sent[0] < 5 * n, "each row should reach few of the sixteen cells"


@pytest.mark.parametrize("parts", [1, 7])
def test_owa_of_hot_group(spark, parts):
    r = np.random.default_rng(11)
    g = np.where(r.random(3000) < 0.9, "hot", "cold")
    v = np.where(r.random(3000) < 0.4, 5.0, r.random(3000) * 10)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v})).repartition(parts)
    for row in ps.owa(df, ["g"], "v").collect():
        mine = v[g == row["g"]]
        assert row["owa"] == pytest.approx(brute.owa(mine), rel=1e-12)
        assert (row["n_values"], row["least"], row["greatest"]) == (len(mine), mine.min(), mine.max())


def test_own_distance(data):
    pdf, df = data

    def largest_gap(a, b):
        return np.maximum(np.minimum(np.abs(a["x"] - b["x"]), 1.0), 2.0 * (a["s"] != b["s"]))

    spec = ps.RowSpec("key", ("x",), ("s",), label="y", distance=largest_gap)
    columns = lambda f: {c: f(pdf[c].to_numpy()) for c in spec.attributes}
    far = largest_gap(columns(lambda v: v[:, None]), columns(lambda v: v[None, :])) / 2
    ids = pdf["key"].to_numpy()
    found = {}
    for r in ps.knn_topk(df, df, spec, 3, settings=TileSettings(tile_rows=50)).collect():
        found.setdefault(r["id"], []).append((r["rank"], r["neighbour_id"]))
    for i, id in enumerate(ids):
        assert [x[1] for x in sorted(found[id])] == list(ids[np.lexsort((ids, far[i]))[:3]])


def test_chained_selection(data):
    pdf, df = data
    for method in ("hml", "powa"):
        kept, report, threshold = ps.choose_prototypes(df, SPEC, 3, method)
        lines = report.collect()
        best = min(lines, key=lambda r: (r["rmse"], -r["threshold"]))
        assert threshold == best["threshold"] and kept.count() == best["size"]
        assert kept.columns == df.columns


# Memberships, labels, samples and predictors beyond the usual


def test_approximations_of_outcomes_outside_the_unit_range(spark):
    rng = np.random.default_rng(3)
    x, y = np.round(rng.random(120), 2), np.round(rng.uniform(-5, 9, 120), 1)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    spec = ps.RowSpec("id", ("x",), label="y")
    for settings in (TileSettings(), TileSettings(tile_rows=9, cell_rows=20, least_rows=8)):
        found = ps.approximations(df, spec, identity_class(), settings=settings)
        sim = 1 - np.abs(x[:, None] - x[None, :]) / (x.max() - x.min())
        upper = np.maximum(0, np.minimum(sim, y[None, :]).max(axis=1))
        lower = np.clip(np.maximum(1 - sim, y[None, :]).min(axis=1), 0, 1)
        for r in found.collect():
            assert (r["upper"], r["lower"]) == pytest.approx((upper[r["id"]], lower[r["id"]]))


def test_rows_without_a_label(spark):
    rows = [(1, 0.0, 1.0), (2, 1.0, None), (3, 2.0, 5.0), (4, 3.0, float("nan")), (5, 0.4, 3.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    spec = ps.RowSpec("id", ("x",), label="y")
    for job in (ps.quality_hml, ps.quality_powa, ps.conflict_summary, ps.approximations):
        assert {r["id"] for r in job(df, spec).collect()} == {1, 3, 5}
    near = ps.knn_topk(df, df, spec, 3)
    assert {r["id"] for r in near.collect()} == {r["neighbour_id"] for r in near.collect()} == {1, 3, 5}
    tests, protos = df.where("id in (2, 4)"), df.where("id not in (2, 4)")
    found = {r["id"]: r for r in ps.knn_predict(tests, protos, spec, 2, weighting="uniform").collect()}
    assert {i: r["predicted"] for i, r in found.items()} == {2: 2.0, 4: 4.0} and found[2]["actual"] is None
    quality = ps.quality_hml(df, spec)
    assert {r["size"] for r in ps.threshold_sweep(df, quality, spec, 1).collect()} <= {1, 2, 3}


def test_samples_do_not_depend_on_partitions(spark):
    ids = spark.range(100_000).select(F.col("id").alias(RID), (F.col("id") * 2.0).alias("x"))
    found = [_sample(ids.repartition(n), 500, 100_000) for n in (1, 300)]
    assert found[0].equals(found[1]) and len(found[0]) == 500
    place = "shiftrightunsigned(xxhash64(`%s`), 11) / 9007199254740992D" % RID
    assert ids.where(f"{place} < {(500 + 6 * 500 ** 0.5 + 32) / 100_000}").count() < 1000


def test_k_above_the_window_limit(spark):
    df = spark.createDataFrame([(i, 1.0 if i % 3 == 0 else float(i), float(i)) for i in range(3600)], "id long, x double, y double")
    spec = ps.RowSpec("id", ("x",), label="y")
    tests = df.where("id = 0")
    found = sorted((r["rank"], r["neighbour_id"]) for r in ps.knn_topk(tests, df, spec, 1500).collect())
    order = sorted(range(3600), key=lambda i: (abs((1.0 if i % 3 == 0 else i) - 1.0), i))
    assert found == list(enumerate(order[:1500], 1))


def arranged_parts():
    """Rows like those of the provided parts, scaled, with their outcomes."""
    r = np.random.default_rng(4)
    n = 6000
    return pd.DataFrame({
        RID: np.arange(n), "size": r.integers(0, 50, n) / 49.0, "brand": r.integers(0, 25, n).astype(str),
        "type": r.integers(0, 6, n).astype(str), OUTCOME: r.permutation(n) / (n - 1.0), COPIES: 1, BLOCK: 0,
    })


def test_conflict_search_compares_a_part_of_the_pairs():
    rows = arranged_parts()
    spec = ps.RowSpec("id", ("size",), ("brand", "type"), label="y")
    held = Arranged(spec, "equal", rows)
    probing = rows.sample(300, random_state=1)
    view, y = held.held.seen_from(probing), probing[OUTCOME].to_numpy()
    compared = held.candidates(view, y, slice(0, 300))[1].sum()
    found = [np.concatenate(x) for x in zip(*held.conflicts(view, y))]
    far = np.abs(probing["size"].to_numpy()[:, None] - rows["size"].to_numpy()[None, :])
    for c in ("brand", "type"):
        far = far + (probing[c].to_numpy()[:, None] != rows[c].to_numpy()[None, :])
    wanted = (3.0 - far) / 3.0 > 1.0 - np.abs(y[:, None] - rows[OUTCOME].to_numpy()[None, :])
    assert len(found[0]) == wanted.sum() and len(found[0]) < compared < 0.3 * wanted.size
    assert (np.bincount(found[0], minlength=300) == wanted.sum(axis=1)).all()
    assert (np.diff(found[0]) >= 0).all(), "in the order of rows"


@pytest.mark.parametrize("pairs", [1 << 22, 500])
@pytest.mark.parametrize("blocks", [1, 4])
@pytest.mark.parametrize("expanded", [0, 4])
def test_powa_of_few_profiles(spark, monkeypatch, pairs, blocks, expanded):
    """Rows that share all attributes are ranked by levels, with copies or without."""
    r = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame({
        "key": r.permutation(np.arange(-100, n - 100)), "x": r.integers(0, 4, n) / 10.0, "z": 1.0,
        "s": r.choice(["red", "green", ""], n), "bits": 3, "y": np.round(r.normal(0, 100, n), -1),
    })
    jobs, made = [], conflicts._Prepared.reduced

    def seen(self, work, schema):
        jobs.append(self.job)
        return made(self, work, schema)

    monkeypatch.setattr(conflicts._Prepared, "reduced", seen)
    monkeypatch.setattr(conflicts, "MOST_EXPANDED", expanded)
    settings = ConflictSettings(held_rows=50, probing_rows=64, pairs=pairs)
    found = ps.quality_powa(spark.createDataFrame(pdf), SPEC, blocks=blocks, settings=settings)
    same(values(found, "quality"), pdf["key"], brute.powa(pdf, SPEC, blocks))
    each = ps.owa_blocks(spark.createDataFrame(pdf), SPEC, blocks=blocks, settings=settings)
    assert each.count() == n * blocks and all(job.levels for job in jobs)


def test_levels_compare_little_but_conflicts():
    rows = arranged_parts()
    spec = ps.RowSpec("id", ("size",), ("brand", "type"), label="y")
    held, probing = Levels(spec, rows), rows.sample(40, random_state=1)
    sims = held.groups.seen_from(probing)
    for k, y in enumerate(probing[OUTCOME]):
        sim = sims.similarities(slice(k, k + 1), "equal")[0]
        level = held.seen_with(sim)
        degree = (1.0 - sim[held.group]) + (1.0 - np.abs(y - held.outcomes))
        wanted = degree[sim[held.group] > 1.0 - np.abs(y - held.outcomes)]
        count, found, copies = level.conflicts(np.array([y]))
        assert copies is None and count.sum() == len(found)
        assert (np.sort(found) == np.sort(wanted)).all()


def test_conflict_jobs_shuffle_rows_only(data, monkeypatch):
    """Neither held rows nor conflicts are sent to the tasks, however small the files."""
    pdf, df = data
    plans, made = [], conflicts._Prepared.reduced

    def seen(self, reduce, schema):
        plans.append((self.probing.count(), len(self.table.files), self.probing._jdf.queryExecution().toString()))
        return made(self, reduce, schema)

    monkeypatch.setattr(conflicts._Prepared, "reduced", seen)
    settings = ConflictSettings(held_rows=17, probing_rows=50, kept_rows=20, pairs=500)
    found = ps.conflict_summary(df, SPEC, settings=settings)
    whole = ps.conflict_summary(df, SPEC)
    assert sorted(found.collect()) == sorted(whole.collect())
    ps.quality_powa(df, SPEC, blocks=3, settings=settings).count()
    assert all(n <= len(pdf) and "Join" not in plan for n, _, plan in plans) and plans[0][1] > 5


def test_files_without_conflicts_are_not_read(spark, monkeypatch):
    """Rows far off in a string and near in outcome need no other file than theirs."""
    n = 400
    pdf = pd.DataFrame({"key": np.arange(n), "s": [f"s{i * 4 // n}" for i in range(n)], "y": [float(i % 5) for i in range(n)]})
    pdf.loc[n - 1, "y"] = 100.0
    spec = ps.RowSpec("key", (), ("s",), label="y")
    needed, made = [], conflicts._Prepared.reduced

    def seen(self, reduce, schema):
        needed.append(self.job.matters(self.probing.toPandas()).mean())
        return made(self, reduce, schema)

    monkeypatch.setattr(conflicts._Prepared, "reduced", seen)
    settings = ConflictSettings(held_rows=5)
    found = ps.quality_powa(spark.createDataFrame(pdf), spec, settings=settings)
    same(values(found, "quality"), pdf["key"], brute.powa(pdf, spec, 1))
    assert needed[0] < 0.7


def test_many_blocks(data):
    pdf, df = data
    found = ps.quality_powa(df, SPEC, blocks=5000)
    same(values(found, "quality"), pdf["key"], brute.powa(pdf, SPEC, 5000))


def test_predictor_and_own_similarity(spark):
    rows = [(i, float(i), float(i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    spec = ps.RowSpec("id", ("x",), label="y")
    last = ps.knn_predict(df, df, spec, 3, predictor=lambda near: F.element_at(near, -1)["neighbour_label"])
    near = {(r["id"], r["rank"]): r["neighbour_label"] for r in ps.knn_topk(df, df, spec, 3).collect()}
    assert {r["id"]: r["predicted"] for r in last.collect()} == {i: near[i, 3] for i in range(40)}
    alike = ps.RowSpec("id", ("x",), label="y", similarity=lambda a, b: 1.0 * (a["x"] == b["x"]))
    found = ps.approximations(df, alike, identity_class(), numeric_only=False)
    assert {r["id"]: r["upper"] for r in found.collect()} == {i: min(1.0, i % 4) for i in range(40)}
    with pytest.raises(ValueError):
        ps.approximations(df, alike)
