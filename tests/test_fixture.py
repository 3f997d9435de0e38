"""The worked fixture: eight rows with values computed by hand from the formulas."""

import pytest

import protosift as ps
from protosift.operators.conflicts import ConflictSettings
from protosift.plans.tiles import TileSettings
from protosift.sources.text import parse_rows
from protosift.spec import spec_of_attr_types

LINES = """1,1.0,10.0,a,101,10.0
2,2.0,10.0,a,101,20.0
3,3.0,30.0,b,100,40.0
4,5.0,20.0,b,000,45.0
5,4.0,50.0,a,011,90.0
6,5.0,40.0,c,000,110.0
11,1.0,20.0,c,011,15.0
12,4.0,10.0,a,100,60.0""".splitlines()
SPEC = spec_of_attr_types("n2,s1,b1")
TILES = [TileSettings(), TileSettings(tile_rows=2, cell_rows=2, least_rows=1)]
HELD = [ConflictSettings(), ConflictSettings(held_rows=2, probing_rows=3)]

HML = {
    "equal": [0.4375, 0.375, 0.4375, 0.375, 0.5, 0.375, 0.625, 0.375],
    "ratio": [0.3125, 0.25, 0.4375, 0.375, 0.5, 0.375, 0.625, 0.25],
}
POWA = {
    ("equal", 1): [0.9165, 0.948, 0.9875, 0.725, 0.8875, 0.784489, 0.741667, 0.95],
    ("equal", 2): [0.905682, 0.95, 0.329167, 0.241667, 0.894444, 0.805051, 0.741667, 0.95],
    ("equal", 3): [0.419318, 0.944318, 0.179545, 0.131818, 0.404167, 0.819318, 0.343182, 0.432955],
    ("ratio", 1): [0.8465, 0.879, 0.9875, 0.725, 0.827273, 0.784489, 0.741667, 0.825],
    ("ratio", 2): [0.827399, 0.885185, 0.329167, 0.241667, 0.832407, 0.805051, 0.741667, 0.825],
    ("ratio", 3): [0.388763, 0.877273, 0.179545, 0.131818, 0.374369, 0.819318, 0.343182, 0.376136],
}
NEIGHBOURS = {
    1: [(2, 0.25), (12, 1), (4, 4)],
    2: [(1, 0.25), (11, 3.25), (4, 3.75)],
    3: [(4, 3.25), (6, 3.5), (11, 3.5)],
    4: [(11, 1.5), (3, 3.25), (12, 3.25)],
    5: [(6, 3.25), (3, 5.75), (4, 8.25)],
    6: [(5, 3.25), (3, 3.5), (4, 5.25)],
    11: [(4, 1.5), (2, 3.25), (3, 3.5)],
    12: [(1, 1), (4, 3.25), (11, 3.75)],
}
PREDICTED = {
    "reference": [47.5, 31.153846, 62.5, 50.0, 43.333333, 44.444444, 30.666667, 28.5],
    "nearest": [37.777778, 10.625, 45.0, 15.0, 86.666667, 66.666667, 42.222222, 15.384615],
    "uniform": [41.666667, 23.333333, 56.666667, 38.333333, 65.0, 58.333333, 35.0, 23.333333],
}
SCORES = {
    "reference": (19.208877, 32.014795),
    "nearest": (14.140487, 23.567479),
    "uniform": (15.251791, 25.419652),
}


@pytest.fixture(scope="module")
def rows(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "line string")
    return parse_rows(lines, "n2,s1,b1").cache()


def by_id(df, *columns):
    return [tuple(r[c] for c in columns) for r in sorted(df.collect(), key=lambda r: r["id"])]


def close(found, wanted):
    assert [x for (x,) in found] == pytest.approx(wanted, abs=1e-6)


@pytest.mark.parametrize("settings", TILES)
@pytest.mark.parametrize("jaccard", ["equal", "ratio"])
def test_hml(rows, jaccard, settings):
    close(by_id(ps.quality_hml(rows, SPEC, jaccard=jaccard, settings=settings), "quality"), HML[jaccard])


@pytest.mark.parametrize("settings", HELD)
@pytest.mark.parametrize("jaccard,blocks", list(POWA))
def test_powa(rows, jaccard, blocks, settings):
    found = ps.quality_powa(rows, SPEC, blocks=blocks, jaccard=jaccard, settings=settings)
    close(by_id(found, "quality"), POWA[jaccard, blocks])


@pytest.mark.parametrize("settings", TILES)
def test_numeric_approximations(rows, settings):
    def membership(y, lo, hi):
        return {"share": (y - 10.0) / 100.0}

    found = by_id(ps.approximations(rows, SPEC, membership, settings=settings), "upper", "lower")
    assert [u for u, _ in found] == pytest.approx([0.5, 0.5, 0.625, 0.75, 0.8, 1.0, 0.5, 0.5])
    assert [x for _, x in found] == pytest.approx([0, 0.1, 0.3, 0.35, 0.375, 0.35, 0.05, 0.25])


@pytest.mark.parametrize("settings", TILES)
def test_neighbours(rows, settings):
    found = ps.knn_topk(rows, rows, SPEC, 3, folds=10, settings=settings).collect()
    for id, wanted in NEIGHBOURS.items():
        mine = sorted((r for r in found if r["id"] == id), key=lambda r: r["rank"])
        assert [(r["neighbour_id"], r["distance"]) for r in mine] == wanted


@pytest.mark.parametrize("settings", TILES[:1])
@pytest.mark.parametrize("weighting", list(PREDICTED))
def test_predictions(rows, weighting, settings):
    found = ps.knn_predict(rows, rows, SPEC, 3, folds=10, weighting=weighting, settings=settings)
    close(by_id(found, "predicted"), PREDICTED[weighting])


@pytest.mark.parametrize("weighting", list(SCORES))
def test_scores(rows, weighting):
    tenth, present = SCORES[weighting]
    (score,) = ps.rmse_cv(rows, rows, SPEC, 3, weighting=weighting).collect()
    assert score["rmse"] == pytest.approx(tenth, abs=1e-6) and score["n_folds"] == 6
    folds = ps.rmse_by_fold(rows, rows, SPEC, 3, weighting=weighting).collect()
    assert sum(r["rmse"] for r in folds) / 6 == pytest.approx(present, abs=1e-6)
