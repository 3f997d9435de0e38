"""Hard negatives against plain integer products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from protosift.llm import hard_negatives
from protosift.llm.hard_negatives import HardNegatives, pack, scores, subset_sums, unpack


@pytest.mark.parametrize("width,planes", [(1, 2), (8, 10), (13, 5), (64, 10)])
def test_table_sums_are_inner_products(width, planes):
    r = np.random.default_rng(width)
    half = 1 << (planes - 1)
    a, c = r.integers(-half, half, (9, width)), r.integers(-half, half, (40, width))
    c[0], c[1] = -half, half - 1
    packed = pack(c, planes)
    assert (unpack(packed)[:, :width] == c).all()
    tables = subset_sums(unpack(pack(a, planes)), np.int64)
    assert tables.shape[1] == 256 and (scores(tables, packed) == c @ a.T).all()


def plain(rows, positives=5, negatives=10):
    rows = [
        (i, l, [math.floor(256 * float(x)) for x in v]) for i, l, v, _ in rows
        if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, (i, label, v) in enumerate(rows):
        if i % 100:
            continue
        near = sorted(
            (-sum(x * y for x, y in zip(v, w)), j) for m, (j, other, w) in enumerate(rows) if m != n and other == label
        )[:positives]
        far = sorted((-sum(x * y for x, y in zip(v, w)), j) for j, other, w in rows if other != label)
        for p, j in near:
            fit = [(s, k) for s, k in far if 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(fit, 1)]
    return sorted(out)


def table(n=700, seed=3):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = [float(np.float32(x)) for x in r.normal(0.02, 0.3, 12)]
        if i % 3 == 0:
            v = [0.125, -0.25] * 6  # a third of the rows are the same
        rows.append((i * 5, int(r.integers(0, 4)) if i % 4 else 1, v, "x"))
    rows[10] = (50, 1, [0.0] * 12, "x")
    rows += [
        (100, 2, [0.5] * 12, "again"), (100, 2, [0.5] * 12, "again"), (None, 1, [0.1] * 12, ""), (9000, None, [0.1] * 12, ""),
        (9100, 1, None, ""), (9200, 1, [None] + [0.1] * 11, ""), (9300, 1, [math.nan] * 12, ""), (9400, 1, [math.inf] * 12, ""),
        (9500, 2, [0.5, 0.5], "short"), (9600, 3, [], "none"), (9700, 77, [1.0] * 12, "alone"),
    ]
    return rows


SCHEMA = "vec_id long, label int, embedding array<float>, rank string"


@pytest.mark.parametrize("sizes", [{}, {"slice_rows": 50, "chunk_rows": 3}])
def test_negatives_equal_plain_version(spark, monkeypatch, sizes):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4 if sizes else 128)
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 33 if sizes else 1024)
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = HardNegatives(**sizes).mine(df, F.col("vec_id") % 100 == 0, id="vec_id")
    assert found.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
                            ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert sorted(tuple(r) for r in found.collect()) == plain(rows)


def test_large_components_use_wider_sums(spark):
    r = np.random.default_rng(1)
    rows = [(i * 20, i % 3, [float(x) for x in r.integers(-9000, 9000, 9)], "") for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, rank string")
    found = HardNegatives().mine(df, F.col("vec_id") % 100 == 0, id="vec_id")
    assert sorted(tuple(r) for r in found.collect()) == plain(rows)
    with pytest.raises(ValueError, match="63 bits"):
        HardNegatives().mine(df.withColumn("embedding", F.array(F.lit(1e300))), F.lit(True), id="vec_id")


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert HardNegatives().mine(none, F.lit(True), id="vec_id").collect() == []
    some = spark.createDataFrame(table(20), SCHEMA)
    assert HardNegatives().mine(some, F.lit(False), id="vec_id").collect() == []
