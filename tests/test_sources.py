"""Reading and writing the text forms."""

import glob

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from protosift.sources import sinks, text
from protosift.spec import RowSpec, parse_attr_types, spec_of_attr_types


def lines_of(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "line string")


def test_attr_types():
    assert parse_attr_types("n2,s,b") == ["n", "n", "s", "b"]
    assert spec_of_attr_types("n2,s,b").attributes == ("n1", "n2", "b1", "s1")
    with pytest.raises(ValueError):
        parse_attr_types("n2,x3")
    with pytest.raises(ValueError):
        parse_attr_types("n2,snow")


def test_kinds_may_be_mixed(spark):
    (row,) = text.parse_rows(lines_of(spark, "7,red,1.5,101,blue,-2,4"), "s,n,b,s,n").collect()
    assert row.asDict() == {
        "id": 7, "s1": "red", "n1": 1.5, "b1": 5, "s2": "blue", "n2": -2.0, "label": 4.0,
    }


def test_trailing_commas_are_not_labels(spark):
    (row,) = text.parse_rows(lines_of(spark, "7,1,2.5,,,"), "n").collect()
    assert row["label"] == 2.5


def test_bad_numbers(spark):
    lines = lines_of(spark, "7,oops,2")
    assert text.parse_rows(lines, "n").first()["n1"] == 0.0
    assert text.parse_rows(lines, "n", on_bad_number="null").first()["n1"] is None
    with pytest.raises(PySparkException):
        text.parse_rows(lines, "n", on_bad_number="fail").collect()
    with pytest.raises(ValueError):
        text.parse_rows(lines, "n", on_bad_number="guess")


def test_bitsets(spark):
    tokens = spark.createDataFrame([("0",), ("110",), ("1" * 31,), ("1" * 64,), ("2x",)], "t string")
    found = [r[0] for r in tokens.select(text.parse_bitset(F.col("t"), "null")).collect()]
    assert found == [0, 6, 2**31 - 1, -1, None]
    with pytest.raises(PySparkException):
        tokens.select(text.parse_bitset(F.col("t"), "fail")).collect()


def test_round_trip(spark, tmp_path):
    spec = spec_of_attr_types("n,s")
    rows = text.parse_rows(lines_of(spark, "1,2.5,a,3.0", "2,0.1,b,4.0"), "n,s", keep_line=True)
    sinks.write_rows(rows, str(tmp_path / "lines"))
    sinks.write_rows(rows, str(tmp_path / "columns"), ["id", "n1", "s1", "label"])
    for folder in ("lines", "columns"):
        again = text.read_rows(spark, str(tmp_path / folder), "n,s", spec=spec)
        assert sorted(map(tuple, again.collect())) == [(1, 2.5, "a", 3.0), (2, 0.1, "b", 4.0)]


def test_quality_file(spark, tmp_path):
    quality = spark.createDataFrame([(1, 0.25), (2, 1.0)], "id long, quality double")
    sinks.write_quality(quality, str(tmp_path / "q"))
    assert sorted(map(tuple, text.read_quality(spark, str(tmp_path / "q")).collect())) == [(1, 0.25), (2, 1.0)]


def written(path):
    return sorted(line.strip() for part in glob.glob(f"{path}/part-*") for line in open(part))


def test_other_outputs(spark, tmp_path):
    approx = spark.createDataFrame([(1, 0.5, 0.25)], "id long, upper double, lower double")
    sinks.write_approximations(approx, str(tmp_path / "a"))
    assert written(tmp_path / "a") == ["1,0.5,0.25"]
    predicted = spark.createDataFrame([(1, 2.0, 2.5)], "id long, actual double, predicted double")
    sinks.write_predictions(predicted, str(tmp_path / "p"))
    assert written(tmp_path / "p") == ["(1,2.0,2.5)"]
    report = spark.createDataFrame(
        [(0.5, 3.0, 10, 4), (1.0, 2.0, 10, 2)], "threshold double, rmse double, n_folds long, size long"
    )
    sinks.write_report(report, str(tmp_path / "r"))
    (part,) = glob.glob(f"{tmp_path}/r/part-*")
    assert open(part).read().splitlines() == ["quality,rmse,size", "1.0,2.0,2", "0.5,3.0,4"]


def test_spec_rejects_repeated_columns_and_ids(spark):
    with pytest.raises(ValueError):
        RowSpec("id", ("x", "x"))
    with pytest.raises(ValueError):
        RowSpec("id")
    spec = RowSpec("id", ("x",))
    spec.require_unique_ids(spark.createDataFrame([(1, 1.0), (2, 1.0)], "id long, x double"))
    with pytest.raises(ValueError, match="occurs 2 times"):
        spec.require_unique_ids(spark.createDataFrame([(1, 1.0), (1, 2.0)], "id long, x double"))
