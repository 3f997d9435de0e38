"""Headerless comma text: ``id,attribute,…,attribute,label``, one row per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protosift.spec import RowSpec, parse_attr_types, spec_of_attr_types


def parse_number(token: Column, on_bad: str = "zero") -> Column:
    """A double; a bad token is 0 (``"zero"``), null, or an error (``"fail"``)."""
    return _handled(token, token.try_cast("double"), token.cast("double"), F.lit(0.0), on_bad)


def parse_bitset(token: Column, on_bad: str = "zero") -> Column:
    """Base-2 text as a bitset of up to 64 members."""
    clean = F.trim(token)
    value = F.when(clean.rlike("^[01]{1,64}$"), F.conv(clean, 2, -10).cast("long"))
    failing = F.coalesce(value, F.raise_error(F.concat(F.lit("bad bitset: "), token)).cast("long"))
    return _handled(token, value, failing, F.lit(0).cast("long"), on_bad)


def _handled(token: Column, value: Column, failing: Column, zero: Column, on_bad: str) -> Column:
    if on_bad == "zero":
        return F.coalesce(value, zero)
    if on_bad == "null":
        return value
    if on_bad == "fail":
        return failing
    raise ValueError(f"unknown handling {on_bad!r} of bad numbers")


def parse_rows(
    lines: DataFrame,
    attr_types: str,
    *,
    line: str = "line",
    on_bad_number: str = "zero",
    keep_line: bool = False,
    spec: RowSpec | None = None,
) -> DataFrame:
    """Typed rows from text lines; names come from ``spec`` or ``spec_of_attr_types``.

    The first token is the id and the last non-empty one the label; attributes
    start at the second token, of the kinds ``attr_types`` lists.
    """
    kinds = parse_attr_types(attr_types)
    spec = spec or spec_of_attr_types(attr_types)
    names = {"n": list(spec.numeric), "s": list(spec.string), "b": list(spec.bitset)}
    for kind, given in names.items():
        if len(given) != kinds.count(kind):
            raise ValueError(f"{attr_types!r} does not fit the spec's columns of kind {kind!r}")
    tokens = F.split(F.regexp_replace(F.col(line), ",+$", ""), ",")
    split = lines.withColumn("_tokens", tokens)

    def attribute(position: int, kind: str) -> Column:
        token = F.get("_tokens", F.lit(position))
        if kind == "n":
            parsed = parse_number(token, on_bad_number)
        elif kind == "b":
            parsed = parse_bitset(token, on_bad_number)
        else:
            parsed = token
        return parsed.alias(names[kind].pop(0))

    return split.select(
        F.get("_tokens", F.lit(0)).cast("long").alias(spec.id),
        *[attribute(i + 1, kind) for i, kind in enumerate(kinds)],
        F.element_at("_tokens", -1).cast("double").alias(spec.label),
        *([F.col(line)] if keep_line else []),
    )


def read_rows(spark: SparkSession, path: str, attr_types: str, **options) -> DataFrame:
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return parse_rows(lines, attr_types, **options)


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="id long, quality double")


def read_approximations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="id long, upper double, lower double")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``(id,actual,predicted)``; a row without an outcome has an empty one."""
    tokens = F.split(F.regexp_extract("value", r"^\((.*)\)$", 1), ",")
    return spark.read.text(path).select(
        F.get(tokens, F.lit(0)).cast("long").alias("id"),
        F.get(tokens, F.lit(1)).try_cast("double").alias("actual"),
        F.get(tokens, F.lit(2)).try_cast("double").alias("predicted"),
    )


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``quality,rmse,size`` under a header."""
    return spark.read.csv(path, schema="quality double, rmse double, size long", header=True)


def to_line(*columns: str) -> Column:
    """The text form of a row from its columns, in order."""
    return F.concat_ws(",", *[F.col(c).cast("string") for c in columns])
