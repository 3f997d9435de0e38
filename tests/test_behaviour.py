"""Chosen behaviours at the edges, and the shape of the plans."""

import pytest
from pyspark.sql import functions as F

import protosift as ps
from protosift.functions import distance, fuzzy
from protosift.functions.harmonic import harmonic, run_weight
from protosift.operators.stats import scale

SPEC = ps.RowSpec("id", ("x",), ("s",), (), "y")


def rows(spark, *data):
    return spark.createDataFrame(list(data), "id long, x double, s string, y double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_constant_column_contributes_nothing(spark):
    df = rows(spark, (1, 5.0, "a", 0.0), (2, 5.0, "b", 1.0))
    assert [r["x"] for r in scale(df, SPEC, "range").collect()] == [0.0, 0.0]
    assert [r["x"] for r in scale(df, SPEC, "minmax").collect()] == [0.0, 0.0]
    assert all(0 <= r["quality"] <= 1 for r in ps.quality_hml(df, SPEC).collect())


def test_all_negative_column_has_its_true_range(spark):
    df = rows(spark, (1, -5.0, "a", 0.0), (2, -3.0, "b", 1.0))
    assert ps.column_ranges(df, SPEC).first()["x_range"] == 2.0
    found = ps.column_minmax(df, SPEC).first().asDict()
    assert found == {"x_min": -5.0, "x_max": -3.0, "y_min": 0.0, "y_max": 1.0}


def test_sets(spark):
    df = spark.createDataFrame([(0, 0), (6, 3), (5, 5), (4, 0)], "a long, b long")
    for mode, wanted in (("equal", [1, 0, 1, 0]), ("ratio", [1, 1 / 3, 1, 0])):
        found = [r[0] for r in df.select(distance.jaccard(F.col("a"), F.col("b"), mode)).collect()]
        assert found == pytest.approx(wanted)


def test_connectives(spark):
    df = spark.createDataFrame([(0.75, 0.5)], "sim double, c double")
    sim, c = F.col("sim"), F.col("c")
    found = df.select(
        fuzzy.kleene_dienes(sim, c), fuzzy.minimum_tnorm(sim, c), fuzzy.outcome_similarity(sim, c),
        fuzzy.conflict_degree(sim, c), fuzzy.conflict_degree(c, sim),
    ).first()
    assert tuple(found) == (0.5, 0.5, 0.75, 0.75, None)


def test_folds_keep_the_sign_and_blocks_do_not(spark):
    df = spark.createDataFrame([(-13,), (13,)], "id long")
    found = df.select(fuzzy.fold_of(F.col("id")), fuzzy.block_of(F.col("id"), 10)).collect()
    assert [tuple(r) for r in found] == [(-3, 7), (3, 3)]


def test_rank_weights(spark):
    cases = [(0, 1), (3, 1), (0, 64), (10, 40), (60, 20), (64, 5), (1000, 3), (0, 5000), (10**6, 10)]
    df = spark.createDataFrame(cases, "b long, n long").withColumn("w", run_weight("b", "n"))
    for r in df.collect():
        exact = sum(1 / i for i in range(r["b"] + 1, r["b"] + r["n"] + 1))
        assert r["w"] == pytest.approx(exact, rel=1e-13)
    assert harmonic([0, 1, 64, 65, 5000]) == pytest.approx(
        [sum(1 / i for i in range(1, n + 1)) for n in (0, 1, 64, 65, 5000)], rel=1e-14
    )


def test_row_without_conflict(spark):
    df = rows(spark, (1, 0.0, "a", 3.0), (2, 0.0, "a", 3.0))
    assert [r["quality"] for r in ps.quality_powa(df, SPEC).collect()] == [0.0, 0.0]
    assert [r["quality"] for r in ps.quality_powa(df, SPEC, empty_value=1.0).collect()] == [1.0, 1.0]
    assert [tuple(r)[1:] for r in ps.conflict_summary(df, SPEC).collect()] == [(0, None, None)] * 2
    with pytest.raises(ValueError):
        ps.quality_powa(df, SPEC, blocks=0)


def test_few_prototypes(spark):
    protos = rows(spark, (10, 0.0, "a", 7.0))
    tests = rows(spark, (1, 1.0, "a", 3.0), (20, 2.0, "b", 4.0))
    near = ps.knn_topk(tests, protos, SPEC, 5).collect()
    assert sorted((r["id"], r["rank"], r["neighbour_id"]) for r in near) == [(1, 1, 10), (20, 1, 10)]
    # Row 20 shares the fold of the only prototype: its own label, or nothing.
    own = {r["id"]: r["predicted"] for r in ps.knn_predict(tests, protos, SPEC, 5, folds=10).collect()}
    assert own == {1: 7.0, 20: 4.0}
    none = ps.knn_predict(tests, protos, SPEC, 5, folds=10, on_empty="null").collect()
    assert {r["id"]: r["predicted"] for r in none} == {1: 7.0, 20: None}
    with pytest.raises(ValueError):
        ps.knn_topk(tests, protos, SPEC, 0)


def test_own_weighting(spark):
    protos = rows(spark, (1, 0.0, "a", 1.0), (2, 1.0, "a", 5.0))
    tests = rows(spark, (9, 0.25, "a", 0.0))
    found = ps.knn_predict(tests, protos, SPEC, 2, weighting=lambda d, least, most: 1 / d)
    assert found.first()["predicted"] == pytest.approx((1 / 0.25 * 1 + 1 / 0.75 * 5) / (1 / 0.25 + 1 / 0.75))


def test_equal_qualities_give_one_threshold(spark):
    df = rows(spark, *[(i, float(i), "a", float(i)) for i in range(12)])
    quality = df.select("id", F.lit(0.5).alias("quality"))
    (line,) = ps.threshold_sweep(df, quality, SPEC, 2).collect()
    assert (line["threshold"], line["size"], line["n_folds"]) == (0.5, 12, 10)
    assert ps.best_threshold(ps.threshold_sweep(df, quality, SPEC, 2)).first()["threshold"] == 0.5


def test_ties_keep_the_higher_threshold(spark):
    report = spark.createDataFrame(
        [(0.9, 2.0), (0.8, 1.0), (0.7, 1.0)], "threshold double, rmse double"
    )
    assert ps.best_threshold(report).first()["threshold"] == 0.8
    # Sums of equal errors may differ in the last bits.
    noisy = [(0.8, 3076.0671281235664), (0.7, 3076.0671281235655), (0.9, 3076.0671281235660), (1.0, 4000.0)]
    report = spark.createDataFrame(noisy, "threshold double, rmse double")
    assert ps.best_threshold(report).first()["threshold"] == 0.9


def test_selection_keeps_rows_as_they_are(spark):
    df = rows(spark, (1, 1.0, "a", 1.0), (2, 2.0, "b", 2.0), (3, 3.0, "c", 3.0))
    quality = spark.createDataFrame([(1, 0.2), (2, 0.6)], "id long, quality double")
    kept = ps.select_prototypes(df, quality, SPEC, 0.6)
    assert [tuple(r) for r in kept.collect()] == [(2, 2.0, "b", 2.0)]
    assert sorted(r["id"] for r in ps.join_quality(df, quality, SPEC).collect()) == [1, 2]


def test_missing_attributes(spark):
    df = rows(spark, (1, None, None, 0.0), (2, 0.0, "", 1.0), (3, 1.0, "a", 2.0), (4, float("nan"), "", 1.0))
    near = ps.knn_topk(df, df, SPEC, 3).where("id = 1").orderBy("rank").collect()
    assert [(r["neighbour_id"], r["distance"]) for r in near] == [(1, 0.0), (2, 0.0), (4, 0.0)]


def test_pair_plans(spark):
    df = rows(spark, *[(i, float(i % 7), "a", float(i)) for i in range(50)])
    # Conflicts are ranked before the job returns, so its plan only joins results.
    for job, placings in (
        (ps.quality_hml(df, SPEC), 1), (ps.quality_powa(df, SPEC, blocks=2), 0), (ps.knn_predict(df, df, SPEC, 3), 1),
    ):
        shown = plan(job)
        assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown
        assert "BatchEvalPython" not in shown and "ArrowEvalPython" not in shown
        # Pairs never travel: one exchange places rows, one combines results.
        assert shown.count("REPARTITION_BY_NUM") == placings
    assert "WindowGroupLimit" in plan(ps.knn_topk(df, df, SPEC, 3))


def test_lazy_scalars_stay_in_the_jvm(spark, tmp_path):
    df = rows(spark, (1, 1.0, "a", 1.0), (2, 2.0, "b", 2.0))
    path = str(tmp_path / "rows")
    df.withColumn("unused", F.lit(1)).write.parquet(path)
    read = spark.read.parquet(path)
    a, b = read.alias("a"), read.alias("b")
    far = distance.mixed_distance(SPEC, distance.side("a"), distance.side("b"))
    shown = plan(a.join(b, F.col("a.id") == F.col("b.id")).select(far))
    assert "unused" not in shown and "Python" not in shown


def test_columns_may_be_named_like_results(spark):
    spec = ps.RowSpec("predicted", ("distance", "owa"), ("rank",), (), "quality")
    df = spark.createDataFrame(
        [(i, i * 0.5, float(i % 3), "a", float(i)) for i in range(1, 9)],
        "predicted long, distance double, owa double, rank string, quality double",
    )
    quality = ps.quality_hml(df, spec)
    assert quality.count() == ps.quality_powa(df, spec, blocks=2).count() == 8
    assert ps.knn_topk(df, df, spec, 2).count() == 16
    assert ps.knn_predict(df, df, spec, 2).count() == ps.conflict_summary(df, spec).count() == 8
    assert ps.threshold_sweep(df, quality, spec, 2).count() == 11
    with pytest.raises(ValueError):
        ps.RowSpec("id", ("_x",))


def test_empty_tables(spark):
    none, some = rows(spark), rows(spark, (1, 1.0, "a", 3.0), (2, 2.0, "b", 4.0))
    for job in (
        ps.quality_hml(none, SPEC), ps.quality_powa(none, SPEC), ps.quality_powa(none, SPEC, blocks=3),
        ps.conflict_summary(none, SPEC), ps.knn_topk(none, some, SPEC, 2), ps.knn_topk(some, none, SPEC, 2),
        ps.owa(none, ["s"], "y"),
    ):
        assert job.collect() == []
    assert {r["predicted"] for r in ps.knn_predict(some, none, SPEC, 2).collect()} == {3.0, 4.0}


def test_single_row(spark):
    one = rows(spark, (1, 1.0, "a", 3.0))
    assert [tuple(r) for r in ps.quality_hml(one, SPEC).collect()] == [(1, 1.0)]
    assert [tuple(r) for r in ps.quality_powa(one, SPEC).collect()] == [(1, 0.0)]


def test_decimals_scale_like_doubles(spark):
    df = rows(spark, (1, 0.5, "a", 1.0), (2, 2.5, "b", 3.0)).withColumns(
        {"x": F.col("x").cast("decimal(10,2)"), "y": F.col("y").cast("decimal(10,2)")}
    )
    assert [r["x"] for r in scale(df, SPEC, "range").orderBy("id").collect()] == [0.25, 1.25]
    assert [(r["x"], r["y"]) for r in scale(df, SPEC, "minmax").orderBy("id").collect()] == [(0.0, 0.0), (1.0, 1.0)]


def test_distances_of_missing_attributes(spark):
    df = spark.createDataFrame([(None, 2.0, None, "", None, 1)], "ax double, bx double, as string, bs string, ab long, bb long")
    a, b = (lambda c, p=p: F.col(p + c) for p in "ab")
    spec = ps.RowSpec("id", ("x",), ("s",), ("b",), "y")
    assert df.select(distance.mixed_distance(spec, a, b)).first()[0] == 3.0
