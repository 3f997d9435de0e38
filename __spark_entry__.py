"""

``queries()`` runs every job over whole tables; ``oracle_sql()`` states the same
results as plain all-pairs SQL.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from dataclasses import replace

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import protosift as ps  # noqa: E402
from protosift.functions import distance as dist  # noqa: E402
from protosift.functions.fuzzy import fold_of, identity_class, three_classes  # noqa: E402
from protosift.operators.stats import Bounds  # noqa: E402
from protosift.plans.lineage import reusable, shared_folder  # noqa: E402
from protosift.sources import sinks, text  # noqa: E402
from protosift.sources.text import parse_bitset, parse_rows, to_line  # noqa: E402

try:
    from protosift.llm import queries as corpus
except ImportError:
    corpus = None
try:
    import corpus_pipeline
except ImportError:
    corpus_pipeline = None

PART = ps.RowSpec("id", ("size",), ("brand", "type"), (), "label")
CUST = ps.RowSpec("id", ("n_orders", "top_order"), ("segment",), ("priorities",), "label")
TRADE = ps.RowSpec("id", ("volume", "top"), ("nation",), (), "label")
# Attributes of a customer in the order of a text line of types n2,s1,b1.
CUST_FILE = ("n_orders", "top_order", "segment", "priorities")
VECTOR = ps.RowSpec("id", tuple(f"e{i}" for i in range(1, 65)), (), (), "label")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_rows(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_size").cast("double").alias("size"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"),
        F.col("p_retailprice").alias("label"),
    )


def cust_rows(spark, sf_dir):
    orders = (
        _table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("n_orders"),
            F.max("o_totalprice").alias("top_order"),
            F.bit_or(F.expr("shiftleft(1L, cast(substr(o_orderpriority, 1, 1) AS int))")).alias("priorities"),
        )
    )
    return (
        _table(spark, sf_dir, "customer")
        .join(orders, "c_custkey", "left")
        .select(
            F.col("c_custkey").alias("id"),
            F.coalesce("n_orders", F.lit(0.0)).alias("n_orders"),
            F.coalesce("top_order", F.lit(0.0)).alias("top_order"),
            F.col("c_mktsegment").alias("segment"),
            F.coalesce("priorities", F.lit(0)).alias("priorities"),
            F.col("c_acctbal").alias("label"),
        )
    )


def customer_trade(spark, sf_dir):
    orders = (
        _table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count(F.lit(1)).cast("double").alias("volume"), F.max("o_totalprice").alias("top"))
    )
    return _table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").select(
        F.col("c_custkey").alias("id"),
        F.coalesce("volume", F.lit(0.0)).alias("volume"),
        F.coalesce("top", F.lit(0.0)).alias("top"),
        F.col("c_nationkey").cast("string").alias("nation"),
        F.col("c_acctbal").alias("label"),
    )


def supplier_trade(spark, sf_dir):
    lines = (
        _table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("s_suppkey"))
        .agg(F.count(F.lit(1)).cast("double").alias("volume"), F.max("l_extendedprice").alias("top"))
    )
    return _table(spark, sf_dir, "supplier").join(lines, "s_suppkey", "left").select(
        F.col("s_suppkey").alias("id"),
        F.coalesce("volume", F.lit(0.0)).alias("volume"),
        F.coalesce("top", F.lit(0.0)).alias("top"),
        F.col("s_nationkey").cast("string").alias("nation"),
        F.col("s_acctbal").alias("label"),
    )


def vector_rows(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS id",
        *[f"CAST(embedding[{i}] AS double) AS e{i + 1}" for i in range(64)],
        "label / 9D AS label",
    )


def raw_vector_rows(spark, sf_dir):
    """Vectors with their outcome as it is, 0 to 9."""
    return vector_rows(spark, sf_dir).withColumn("label", F.col("label") * 9)


def next_pairs(df: DataFrame) -> DataFrame:
    """Each row ``a`` beside the row ``b`` with the following id."""
    a = df.withColumn("_next", F.col("id") + 1).alias("a")
    return a.join(df.alias("b"), F.col("a._next") == F.col("b.id"))


def _pairs(rows, value, name):
    def query(spark, sf_dir):
        return next_pairs(rows(spark, sf_dir)).select(
            F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), F.round(value(), 6).alias(name)
        )

    return query


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


A, B = dist.side("a"), dist.side("b")


def _parse_rows(spark, sf_dir):
    lines = part_rows(spark, sf_dir).select(to_line("id", "size", "brand", "type", "label").alias("line"))
    return parse_rows(lines, "n,s2")


def _parse_bitset(spark, sf_dir):
    text = cust_rows(spark, sf_dir).select("id", F.bin("priorities").alias("members"))
    return text.withColumn("bits", parse_bitset(F.col("members")))


def _similarity_pairs(spark, sf_dir):
    scaled = ps.scale(part_rows(spark, sf_dir), PART, "range")
    return next_pairs(scaled).select(
        F.col("a.id").alias("a_id"),
        F.col("b.id").alias("b_id"),
        F.round(dist.similarity(PART, A, B), 6).alias("similarity"),
    )


def _class_membership(spark, sf_dir):
    rows = part_rows(spark, sf_dir)
    bounds = Bounds.of(rows, ["label"])
    classes = three_classes()(
        F.col("label"), F.lit(bounds.low["label"]), F.lit(bounds.high["label"])
    )
    return rows.select("id", *[F.round(c, 6).alias(name) for name, c in classes.items()])


def _fold_assign(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("id"), fold_of(F.col("o_orderkey")).alias("fold"))


def _scaled(mode, *columns):
    def query(spark, sf_dir):
        scaled = ps.scale(CUST.conform(cust_rows(spark, sf_dir)), CUST, mode)
        return rounded(scaled.select("id", *columns), *columns)

    return query


def _lower_approx_classes(spark, sf_dir):
    found = ps.class_approximations(part_rows(spark, sf_dir), PART, which=("lower",))
    return rounded(found, "lower_low", "lower_mid", "lower_high")


def _upper_approx_classes(spark, sf_dir):
    found = ps.class_approximations(cust_rows(spark, sf_dir), CUST, which=("upper",))
    return rounded(found, "upper_low", "upper_mid", "upper_high")


def _approx_upper_lower(spark, sf_dir):
    found = ps.approximations(vector_rows(spark, sf_dir), VECTOR, identity_class())
    return rounded(found, "upper", "lower")


def _approx_raw_outcomes(spark, sf_dir):
    found = ps.approximations(raw_vector_rows(spark, sf_dir), VECTOR, identity_class())
    return rounded(found, "upper", "lower")


def _approx_negative_outcomes(spark, sf_dir):
    rows = part_rows(spark, sf_dir).withColumn("label", (F.col("label") - 920) / 10)
    found = ps.approximations(rows, PART, identity_class(), numeric_only=False)
    return rounded(found, "upper", "lower")


def _approx_own_similarity(spark, sf_dir):
    alike = replace(PART, similarity=closeness)
    found = ps.approximations(part_rows(spark, sf_dir), alike, numeric_only=False)
    return rounded(found, "upper", "lower")


def _quality_hml(spark, sf_dir):
    return rounded(ps.quality_hml(cust_rows(spark, sf_dir), CUST), "quality")


def _quality_hml_numeric(spark, sf_dir):
    return rounded(ps.quality_hml(cust_rows(spark, sf_dir), CUST, numeric_only=True), "quality")


def _conflict_pairs(spark, sf_dir):
    return rounded(ps.conflict_summary(part_rows(spark, sf_dir), PART), "least", "greatest")


def _owa(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem")
    found = ps.owa(lines, ["l_returnflag"], "l_extendedprice")
    return rounded(found.select("l_returnflag", "owa", "n_values"), "owa")


def _owa_partial(spark, sf_dir):
    return rounded(ps.owa_blocks(cust_rows(spark, sf_dir), CUST, blocks=4, decimals=6), "owa")


def _quality_powa(spark, sf_dir):
    return rounded(ps.quality_powa(cust_rows(spark, sf_dir), CUST, decimals=6), "quality")


def _quality_powa_blocks(spark, sf_dir):
    return rounded(ps.quality_powa(part_rows(spark, sf_dir), PART, blocks=4, decimals=6), "quality")


def _knn_topk(spark, sf_dir):
    rows = vector_rows(spark, sf_dir)
    return rounded(ps.knn_topk(rows, rows, VECTOR, 5), "distance", "neighbour_label")


def _knn_topk_cv(spark, sf_dir):
    rows = part_rows(spark, sf_dir)
    return rounded(ps.knn_topk(rows, rows, PART, 5, folds=10), "distance", "neighbour_label")


def _knn_topk_cv_scaled(spark, sf_dir):
    rows = cust_rows(spark, sf_dir)
    found = ps.knn_topk(rows, rows, CUST, 5, folds=10, scaling="range", jaccard="ratio")
    return rounded(found, "distance", "neighbour_label")


def _knn_predict(weighting):
    def query(spark, sf_dir):
        found = ps.knn_predict(
            supplier_trade(spark, sf_dir), customer_trade(spark, sf_dir), TRADE, 5, weighting=weighting
        )
        return rounded(found, "actual", "predicted")

    return query


def median_of_five(nearest):
    """The middle outcome of five neighbours."""
    return F.element_at(F.array_sort(F.transform(nearest, lambda n: n["neighbour_label"])), 3)


def _knn_predict_median(spark, sf_dir):
    found = ps.knn_predict(
        supplier_trade(spark, sf_dir), customer_trade(spark, sf_dir), TRADE, 5, predictor=median_of_five
    )
    return rounded(found, "actual", "predicted")


def root_distance(a, b):
    """Own distance: the root of the difference in size, and whether the words differ."""
    return np.sqrt(np.abs(a["size"] - b["size"])) + (a["brand"] != b["brand"]) + (a["type"] != b["type"])


def closeness(a, b):
    """Own similarity: how near the scaled sizes are, if the brand is the same."""
    return (a["brand"] == b["brand"]) * (1.0 - np.abs(a["size"] - b["size"]))


def _knn_own_distance(spark, sf_dir):
    rows = part_rows(spark, sf_dir)
    found = ps.knn_topk(rows, rows, replace(PART, distance=root_distance, metric=True), 5)
    return rounded(found, "distance", "neighbour_label")


def _rmse_by_fold(spark, sf_dir):
    rows = cust_rows(spark, sf_dir)
    return rounded(ps.rmse_by_fold(rows, rows, CUST, 5), "rmse")


def _rmse_cv(spark, sf_dir):
    rows = part_rows(spark, sf_dir)
    return rounded(ps.rmse_cv(rows, rows, PART, 5), "rmse")


def _rmse_cv_scaled(spark, sf_dir):
    return rounded(ps.rmse_cv_scaled(cust_rows(spark, sf_dir), CUST, 5), "rmse")


def _rated_customers(spark, sf_dir):
    """Customers, computed once, and their quality as a quality file would keep it."""
    rows = reusable(cust_rows(spark, sf_dir))
    return rows, rounded(ps.quality_hml(rows, CUST), "quality")


def _quality_join(spark, sf_dir):
    rows, quality = _rated_customers(spark, sf_dir)
    return ps.join_quality(rows, quality, CUST).select("id", *CUST.attributes, "label", "quality")


def _sweep(spark, sf_dir):
    rows, quality = _rated_customers(spark, sf_dir)
    return ps.threshold_sweep(rows, quality, CUST, 5)


def _threshold_sweep(spark, sf_dir):
    return rounded(_sweep(spark, sf_dir), "threshold", "rmse")


def _best_threshold(spark, sf_dir):
    return rounded(ps.best_threshold(_sweep(spark, sf_dir)), "threshold", "rmse")


def _select_prototypes(spark, sf_dir):
    rows, quality = _rated_customers(spark, sf_dir)
    quality = reusable(quality)
    bounds = Bounds.of(quality, ["quality"])
    middle = (bounds.low["quality"] + bounds.high["quality"]) / 2
    return ps.select_prototypes(rows, quality, CUST, middle)


def _folder(spark: SparkSession) -> str:
    """A new folder for files, where all executors reach it."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _customer_lines(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Customers through a text file: written as lines, read by their attribute types."""
    path = _folder(spark)
    sinks.write_rows(rows.withColumn("priorities", F.bin("priorities")), path, ["id", *CUST_FILE, "label"])
    return text.read_rows(spark, path, "n2,s1,b1", spec=CUST)


def _file_rows(spark, sf_dir):
    return _customer_lines(spark, cust_rows(spark, sf_dir))


def _file_quality(spark, sf_dir):
    path = _folder(spark)
    sinks.write_quality(_quality_hml(spark, sf_dir), path)
    return text.read_quality(spark, path)


def _file_approximations(spark, sf_dir):
    path = _folder(spark)
    sinks.write_approximations(_approx_negative_outcomes(spark, sf_dir), path)
    return text.read_approximations(spark, path)


def _file_predictions(spark, sf_dir):
    path = _folder(spark)
    sinks.write_predictions(_knn_predict("reference")(spark, sf_dir), path)
    return text.read_predictions(spark, path)


def _file_report(spark, sf_dir):
    path = _folder(spark)
    sinks.write_report(_threshold_sweep(spark, sf_dir), path)
    return text.read_report(spark, path)


def _chained_run(spark, sf_dir):
    """Rows from a file, their quality to and from a file, the sweep, and the rows
    that are kept as a file again."""
    rows = _customer_lines(spark, cust_rows(spark, sf_dir))
    CUST.require_unique_ids(rows)
    path = _folder(spark)
    sinks.write_quality(rounded(ps.quality_hml(rows, CUST), "quality"), path)
    kept, _, _ = ps.choose_prototypes(rows, CUST, 5, text.read_quality(spark, path))
    return _customer_lines(spark, kept)


def entry(spark: SparkSession) -> DataFrame:
    """Row quality of the smallest ``part`` table."""
    return ps.quality_hml(part_rows(spark, "/root/testdata/sf0.001"), PART)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator of the library, and those of ``protosift.llm`` if it is there."""
    more = corpus.queries() if corpus else {}
    return core_queries() | more | ({"pipeline": corpus_pipeline.run} if corpus_pipeline else {})


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "parse_rows": _parse_rows,
        "parse_bitset": _parse_bitset,
        "dist_manhattan": _pairs(cust_rows, lambda: dist.manhattan(CUST.numeric, A, B), "distance"),
        "dist_hamming": _pairs(part_rows, lambda: dist.hamming(PART.string, A, B), "distance"),
        "dist_mixed": _pairs(cust_rows, lambda: dist.mixed_distance(CUST, A, B), "distance"),
        "jaccard_equal": _pairs(
            cust_rows, lambda: dist.jaccard(A("priorities"), B("priorities"), "equal"), "similarity"
        ),
        "jaccard_ratio": _pairs(
            cust_rows, lambda: dist.jaccard(A("priorities"), B("priorities"), "ratio"), "similarity"
        ),
        "similarity_pairs": _similarity_pairs,
        "scale_range": _scaled("range", "n_orders", "top_order"),
        "scale_minmax": _scaled("minmax", "n_orders", "top_order", "label"),
        "class_membership": _class_membership,
        "fold_assign": _fold_assign,
        "column_ranges": lambda spark, d: ps.column_ranges(cust_rows(spark, d), CUST),
        "column_minmax": lambda spark, d: ps.column_minmax(cust_rows(spark, d), CUST),
        "lower_approx_classes": _lower_approx_classes,
        "upper_approx_classes": _upper_approx_classes,
        "approx_upper_lower": _approx_upper_lower,
        "approx_raw_outcomes": _approx_raw_outcomes,
        "approx_negative_outcomes": _approx_negative_outcomes,
        "approx_own_similarity": _approx_own_similarity,
        "knn_predict_median": _knn_predict_median,
        "knn_own_distance": _knn_own_distance,
        "quality_hml": _quality_hml,
        "quality_hml_numeric": _quality_hml_numeric,
        "conflict_pairs": _conflict_pairs,
        "owa": _owa,
        "owa_partial": _owa_partial,
        "quality_powa": _quality_powa,
        "quality_powa_blocks": _quality_powa_blocks,
        "knn_topk": _knn_topk,
        "knn_topk_cv": _knn_topk_cv,
        "knn_topk_cv_scaled": _knn_topk_cv_scaled,
        "knn_predict": _knn_predict("reference"),
        "knn_predict_nearest": _knn_predict("nearest"),
        "knn_predict_uniform": _knn_predict("uniform"),
        "rmse_by_fold": _rmse_by_fold,
        "rmse_cv": _rmse_cv,
        "rmse_cv_scaled": _rmse_cv_scaled,
        "quality_join": _quality_join,
        "select_prototypes": _select_prototypes,
        "threshold_sweep": _threshold_sweep,
        "best_threshold": _best_threshold,
        "file_rows": _file_rows,
        "file_quality": _file_quality,
        "file_approximations": _file_approximations,
        "file_predictions": _file_predictions,
        "file_report": _file_report,
        "chained_run": _chained_run,
    }


# --- The same results as SQL -------------------------------------------------

PART_SQL = """
part_rows AS (
  SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS size, p_brand AS brand, p_type AS type,
         p_retailprice AS label
  FROM part)"""
CUST_SQL = """
per_customer AS (
  SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n_orders, max(o_totalprice) AS top_order,
         bit_or(CAST(1 AS BIGINT) << CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS priorities
  FROM orders GROUP BY o_custkey),
cust_rows AS (
  SELECT c_custkey AS id, coalesce(n_orders, 0e0) AS n_orders, coalesce(top_order, 0e0) AS top_order,
         c_mktsegment AS segment, CAST(coalesce(priorities, 0) AS BIGINT) AS priorities,
         c_acctbal AS label
  FROM customer LEFT JOIN per_customer ON o_custkey = c_custkey)"""
TRADE_SQL = """
prototypes AS (
  SELECT c_custkey AS id, coalesce(volume, 0e0) AS volume, coalesce(top, 0e0) AS top,
         CAST(c_nationkey AS VARCHAR) AS nation, c_acctbal AS label
  FROM customer LEFT JOIN (
    SELECT o_custkey, CAST(count(*) AS DOUBLE) AS volume, max(o_totalprice) AS top
    FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey),
tests AS (
  SELECT s_suppkey AS id, coalesce(volume, 0e0) AS volume, coalesce(top, 0e0) AS top,
         CAST(s_nationkey AS VARCHAR) AS nation, s_acctbal AS label
  FROM supplier LEFT JOIN (
    SELECT l_suppkey, CAST(count(*) AS DOUBLE) AS volume, max(l_extendedprice) AS top
    FROM lineitem GROUP BY l_suppkey) ON l_suppkey = s_suppkey)"""
VECTOR_SQL = f"""
vector_rows AS (
  SELECT vec_id AS id,
         {', '.join(f'CAST(embedding[{i}] AS DOUBLE) AS e{i}' for i in range(1, 65))},
         label / 9e0 AS label
  FROM embeddings)"""
TABLE_SQL = {"part_rows": (PART, PART_SQL), "cust_rows": (CUST, CUST_SQL), "vector_rows": (VECTOR, VECTOR_SQL)}


def sql_distance(spec: ps.RowSpec, jaccard: str = "equal") -> str:
    terms = []
    if spec.numeric:
        terms.append(" + ".join(f"abs(a.{c} - b.{c})" for c in spec.numeric))
    if spec.bitset:
        alike = [
            f"CASE WHEN a.{c} = b.{c} THEN 1e0 ELSE 0e0 END"
            if jaccard == "equal"
            else f"CASE WHEN (a.{c} | b.{c}) = 0 THEN 1e0"
            f" ELSE CAST(bit_count(a.{c} & b.{c}) AS DOUBLE) / bit_count(a.{c} | b.{c}) END"
            for c in spec.bitset
        ]
        terms.append(f"({len(alike)}e0 - ({' + '.join(alike)}))")
    terms += [f"CASE WHEN a.{c} = b.{c} THEN 0e0 ELSE 1e0 END" for c in spec.string]
    return " + ".join(terms)


def sql_similarity(spec: ps.RowSpec, jaccard: str = "equal") -> str:
    return f"(({spec.size}e0 - ({sql_distance(spec, jaccard)})) / {spec.size}e0)"


def sql_scaled(name: str, mode: str) -> str:
    spec, rows = TABLE_SQL[name]
    columns = [*spec.numeric, *(["label"] if mode == "minmax" else [])]
    stats = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in columns)
    scaled = ", ".join(
        f"CASE WHEN hi_{c} > lo_{c} THEN {c if mode == 'range' else f'({c} - lo_{c})'}"
        f" / (hi_{c} - lo_{c}) ELSE 0e0 END AS {c}"
        for c in columns
    )
    return f"""{rows},
stats AS (SELECT {stats} FROM {name}),
scaled AS (SELECT * REPLACE ({scaled}) FROM {name}, stats)"""


def sql_classes(name: str) -> str:
    return f"""
cuts AS (
  SELECT 0.25e0 * (max(label) - min(label)) + min(label) AS ca,
         0.5e0 * (max(label) - min(label)) + min(label) AS cb,
         0.75e0 * (max(label) - min(label)) + min(label) AS cc
  FROM {name}),
classes AS (
  SELECT id AS class_id,
         CASE WHEN label <= ca THEN 1e0 WHEN label < cb THEN (label - cb) / (ca - cb) ELSE 0e0 END AS low,
         CASE WHEN label > ca AND label <= cb THEN (label - ca) / (cb - ca)
              WHEN label > cb AND label <= cc THEN (label - cc) / (cb - cc) ELSE 0e0 END AS mid,
         CASE WHEN label >= cc THEN 1e0 WHEN label > cb THEN (label - cb) / (cc - cb) ELSE 0e0 END AS high
  FROM {name}, cuts)"""


def sql_approximations(name: str, spec: ps.RowSpec) -> str:
    """CTEs up to ``approx``: id, lower_… and upper_… of the three classes."""
    return f"""{sql_scaled(name, 'range')},{sql_classes(name)},
compared AS (SELECT * FROM scaled JOIN classes ON class_id = id),
pairs AS (
  SELECT a.id, {sql_similarity(spec)} AS sim, b.low, b.mid, b.high
  FROM scaled a CROSS JOIN compared b),
approx AS (
  SELECT id,
         {', '.join(f'min(greatest(1e0 - sim, {c})) AS lower_{c}' for c in ('low', 'mid', 'high'))},
         {', '.join(f'max(least(sim, {c})) AS upper_{c}' for c in ('low', 'mid', 'high'))}
  FROM pairs GROUP BY id)"""


def sql_hml(name: str, spec: ps.RowSpec) -> str:
    return f"""{sql_approximations(name, spec)},
quality AS (
  SELECT id, round(greatest(0e0, lower_low, lower_mid, lower_high), 6) AS quality FROM approx)"""


def sql_conflicts(name: str, blocks: int) -> str:
    """CTEs up to ``averages``: id, block, owa of conflicts inside each block."""
    spec = TABLE_SQL[name][0]
    return f"""{sql_scaled(name, 'minmax')},
pairs AS (
  SELECT a.id, ((b.id % {blocks}) + {blocks}) % {blocks} AS block, {sql_similarity(spec)} AS sim,
         1e0 - abs(a.label - b.label) AS alike
  FROM scaled a JOIN scaled b ON a.id <> b.id),
conflicts AS (SELECT id, block, 1e0 - sim + alike AS degree FROM pairs WHERE sim > alike),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id, block ORDER BY degree) AS r FROM conflicts),
found AS (SELECT id, block, sum(degree / r) / sum(1e0 / r) AS owa FROM ranked GROUP BY id, block),
blocks AS (SELECT DISTINCT ((id % {blocks}) + {blocks}) % {blocks} AS block FROM scaled),
averages AS (
  SELECT s.id, k.block, coalesce(f.owa, 0e0) AS owa
  FROM scaled s CROSS JOIN blocks k LEFT JOIN found f ON f.id = s.id AND f.block = k.block)"""


def sql_powa(name: str, blocks: int) -> str:
    return f"""WITH {sql_conflicts(name, blocks)},
again AS (SELECT id, owa, row_number() OVER (PARTITION BY id ORDER BY owa) AS r FROM averages)
SELECT id, round(sum(owa / r) / sum(1e0 / r), 6) AS quality FROM again GROUP BY id"""


def sql_nearest(spec, tests, prototypes, k, folds=False, jaccard="equal") -> str:
    """CTE ``nearest``: the k nearest prototypes of each test row."""
    fold = "WHERE a.id % 10 <> b.id % 10" if folds else ""
    return f"""
away AS (
  SELECT a.id, b.id AS neighbour_id, ({sql_distance(spec, jaccard)}) / {spec.size}e0 AS distance,
         b.label AS neighbour_label
  FROM {tests} a CROSS JOIN {prototypes} b {fold}),
nearest AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour_id) AS rank
  FROM away QUALIFY rank <= {k})"""


WEIGHT_SQL = {
    "reference": "distance - least",
    "nearest": "most - distance",
    "uniform": "1e0",
}


def sql_predicted(tests, weighting="reference", by="id") -> str:
    """CTE ``predicted``: id, actual and predicted (own label without neighbours)."""
    weight = WEIGHT_SQL[weighting]
    scaled = weight if weighting == "uniform" else f"({weight}) / (most - least)"
    return f"""
spread AS (
  SELECT *, min(distance) OVER (PARTITION BY {by}) AS least, max(distance) OVER (PARTITION BY {by}) AS most
  FROM nearest),
weighted AS (
  SELECT *, CASE WHEN most > least THEN {scaled} ELSE 1e0 END AS w FROM spread),
means AS (SELECT {by}, sum(w * neighbour_label) / sum(w) AS mean FROM weighted GROUP BY {by}),
predicted AS (
  SELECT t.id, t.label AS actual, coalesce(m.mean, t.label) AS predicted
  FROM {tests} t LEFT JOIN means m ON m.id = t.id)"""


FOLDS_SQL = """
fold_errors AS (
  SELECT CAST(id % 10 AS INTEGER) AS fold,
         sqrt(sum((predicted - actual) * (predicted - actual)) / count(*)) AS rmse, count(*) AS n_rows
  FROM predicted GROUP BY 1)"""
NEIGHBOUR_COLUMNS = """id, CAST(rank AS INTEGER) AS rank, neighbour_id, round(distance, 6) AS distance,
  round(neighbour_label, 6) AS neighbour_label"""


def sql_sweep() -> str:
    """CTEs up to ``report``: every threshold with its error and size."""
    return f"""{sql_hml('cust_rows', CUST)},
edge AS (SELECT min(quality) AS low, max(quality) AS high FROM quality),
thresholds AS (
  SELECT i AS step, CASE WHEN i = 10 THEN low ELSE high - i * ((high - low) / 10) END AS threshold
  FROM edge, range(0, 11) t(i)
  WHERE high > low OR i = 0),
away AS (
  SELECT a.id, b.id AS neighbour_id, ({sql_distance(CUST)}) / {CUST.size}e0 AS distance,
         b.label AS neighbour_label, q.quality
  FROM cust_rows a JOIN cust_rows b ON a.id % 10 <> b.id % 10 JOIN quality q ON q.id = b.id),
nearest AS (
  SELECT step, away.*,
         row_number() OVER (PARTITION BY step, away.id ORDER BY distance, neighbour_id) AS rank
  FROM thresholds JOIN away ON quality >= threshold QUALIFY rank <= 5),
spread AS (
  SELECT *, min(distance) OVER (PARTITION BY step, id) AS least,
         max(distance) OVER (PARTITION BY step, id) AS most
  FROM nearest),
weighted AS (
  SELECT *, CASE WHEN most > least THEN (distance - least) / (most - least) ELSE 1e0 END AS w FROM spread),
means AS (SELECT step, id, sum(w * neighbour_label) / sum(w) AS mean FROM weighted GROUP BY step, id),
errors AS (
  SELECT t.step, c.id % 10 AS fold, coalesce(m.mean, c.label) - c.label AS off
  FROM thresholds t CROSS JOIN cust_rows c LEFT JOIN means m ON m.step = t.step AND m.id = c.id),
fold_errors AS (
  SELECT step, fold, sqrt(sum(off * off) / count(*)) AS rmse FROM errors GROUP BY step, fold),
sizes AS (
  SELECT step, count(quality) AS size
  FROM thresholds LEFT JOIN quality ON quality >= threshold GROUP BY step),
report AS (
  SELECT threshold, sum(rmse) / 10 AS rmse, count(*) AS n_folds, any_value(size) AS size
  FROM thresholds JOIN fold_errors USING (step) JOIN sizes USING (step) GROUP BY step, threshold),
best AS (SELECT * FROM report ORDER BY round(rmse, 9), threshold DESC LIMIT 1)"""


def oracle_sql() -> dict[str, str]:
    """SQL for those of ``queries()`` that SQL can express."""
    more = corpus.oracle_sql() if corpus else {}
    whole = corpus_pipeline.ORACLE_SQL if corpus_pipeline else None
    return core_sql() | more | ({"pipeline": whole} if whole else {})


APPROX_SQL = """SELECT id, round(greatest(0e0, max(least(sim, member))), 6) AS upper,
       round(greatest(0e0, least(1e0, min(greatest(1e0 - sim, member)))), 6) AS lower
FROM pairs GROUP BY id"""


def core_sql() -> dict[str, str]:
    """The same results by all-pairs SQL."""

    def next_row(rows: str, name: str, value: str, column: str) -> str:
        return f"""WITH {rows}
SELECT a.id AS a_id, b.id AS b_id, round({value}, 6) AS {column}
FROM {name} a JOIN {name} b ON b.id = a.id + 1"""

    numeric = CUST.only_numeric()
    sets = ps.RowSpec("id", (), (), ("priorities",), "label")
    report = "round(threshold, 6) AS threshold, round(rmse, 6) AS rmse, n_folds, size"
    customer = "id, n_orders, top_order, segment, priorities, label"
    said = {
        "parse_rows": f"""WITH {PART_SQL}
SELECT id, size AS n1, brand AS s1, type AS s2, label FROM part_rows""",
        "parse_bitset": f"""WITH {CUST_SQL}
SELECT id, bin(priorities) AS members, priorities AS bits FROM cust_rows""",
        "dist_manhattan": next_row(CUST_SQL, "cust_rows", sql_distance(numeric), "distance"),
        "dist_hamming": next_row(
            PART_SQL, "part_rows", sql_distance(ps.RowSpec("id", (), PART.string)), "distance"
        ),
        "dist_mixed": next_row(CUST_SQL, "cust_rows", sql_distance(CUST), "distance"),
        "jaccard_equal": next_row(CUST_SQL, "cust_rows", f"1e0 - {sql_distance(sets)}", "similarity"),
        "jaccard_ratio": next_row(
            CUST_SQL, "cust_rows", f"1e0 - {sql_distance(sets, 'ratio')}", "similarity"
        ),
        "similarity_pairs": next_row(
            sql_scaled("part_rows", "range"), "scaled", sql_similarity(PART), "similarity"
        ),
        "scale_range": f"""WITH {sql_scaled('cust_rows', 'range')}
SELECT id, round(n_orders, 6) AS n_orders, round(top_order, 6) AS top_order FROM scaled""",
        "scale_minmax": f"""WITH {sql_scaled('cust_rows', 'minmax')}
SELECT id, round(n_orders, 6) AS n_orders, round(top_order, 6) AS top_order, round(label, 6) AS label
FROM scaled""",
        "class_membership": f"""WITH {PART_SQL},{sql_classes('part_rows')}
SELECT class_id AS id, round(low, 6) AS low, round(mid, 6) AS mid, round(high, 6) AS high FROM classes""",
        "fold_assign": "SELECT o_orderkey AS id, CAST(o_orderkey % 10 AS INTEGER) AS fold FROM orders",
        "column_ranges": f"""WITH {CUST_SQL}
SELECT max(n_orders) - min(n_orders) AS n_orders_range,
       max(top_order) - min(top_order) AS top_order_range FROM cust_rows""",
        "column_minmax": f"""WITH {CUST_SQL}
SELECT {', '.join(f'min({c}) AS {c}_min, max({c}) AS {c}_max' for c in (*CUST.numeric, 'label'))}
FROM cust_rows""",
        "lower_approx_classes": f"""WITH {sql_approximations('part_rows', PART)}
SELECT id, {', '.join(f'round(lower_{c}, 6) AS lower_{c}' for c in ('low', 'mid', 'high'))} FROM approx""",
        "upper_approx_classes": f"""WITH {sql_approximations('cust_rows', CUST)}
SELECT id, {', '.join(f'round(upper_{c}, 6) AS upper_{c}' for c in ('low', 'mid', 'high'))} FROM approx""",
        "approx_upper_lower": f"""WITH {sql_scaled('vector_rows', 'range')},
pairs AS (
  SELECT a.id, {sql_similarity(VECTOR)} AS sim, b.label AS member FROM scaled a CROSS JOIN scaled b)
SELECT id, round(greatest(0e0, max(least(sim, member))), 6) AS upper,
       round(greatest(0e0, least(1e0, min(greatest(1e0 - sim, member)))), 6) AS lower
FROM pairs GROUP BY id""",
        "approx_raw_outcomes": f"""WITH {VECTOR_SQL.replace("label / 9e0", "CAST(label AS DOUBLE)")},
{sql_scaled('vector_rows', 'range').removeprefix(VECTOR_SQL + ",")},
pairs AS (
  SELECT a.id, {sql_similarity(VECTOR)} AS sim, b.label AS member FROM scaled a CROSS JOIN scaled b)
{APPROX_SQL}""",
        "approx_negative_outcomes": f"""WITH {sql_scaled('part_rows', 'range')},
pairs AS (
  SELECT a.id, {sql_similarity(PART)} AS sim, (b.label - 920) / 10 AS member FROM scaled a CROSS JOIN scaled b)
{APPROX_SQL}""",
        "approx_own_similarity": f"""WITH {sql_scaled('part_rows', 'range')},{sql_classes('part_rows')},
pairs AS (
  SELECT a.id, CASE WHEN a.brand = b.brand THEN 1e0 - abs(a.size - b.size) ELSE 0e0 END AS sim, c.low, c.mid, c.high
  FROM scaled a CROSS JOIN scaled b JOIN classes c ON c.class_id = b.id)
SELECT id, round(greatest(0e0, max(least(sim, greatest(low, mid, high)))), 6) AS upper,
       round(least(1e0, greatest(0e0, min(greatest(1e0 - sim, low)), min(greatest(1e0 - sim, mid)),
                               min(greatest(1e0 - sim, high)))), 6) AS lower
FROM pairs GROUP BY id""",
        "knn_predict_median": f"""WITH {TRADE_SQL},{sql_nearest(TRADE, 'tests', 'prototypes', 5)}
SELECT t.id, round(t.label, 6) AS actual, round(median(neighbour_label), 6) AS predicted
FROM tests t JOIN nearest n ON n.id = t.id GROUP BY t.id, t.label""",
        "knn_own_distance": f"""WITH {PART_SQL},{sql_nearest(PART, 'part_rows', 'part_rows', 5).replace("abs(a.size - b.size)", "sqrt(abs(a.size - b.size))")}
SELECT {NEIGHBOUR_COLUMNS} FROM nearest""",
        "quality_hml": f"WITH {sql_hml('cust_rows', CUST)} SELECT id, quality FROM quality",
        "quality_hml_numeric": f"WITH {sql_hml('cust_rows', numeric)} SELECT id, quality FROM quality",
        "conflict_pairs": f"""WITH {sql_conflicts('part_rows', 1)}
SELECT s.id, count(c.degree) AS conflicts, round(min(c.degree), 6) AS least,
       round(max(c.degree), 6) AS greatest
FROM scaled s LEFT JOIN conflicts c ON c.id = s.id GROUP BY s.id""",
        "owa": """WITH ranked AS (
  SELECT l_returnflag, l_extendedprice AS v,
         row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r
  FROM lineitem)
SELECT l_returnflag, round(sum(v / r) / sum(1e0 / r), 6) AS owa, count(*) AS n_values
FROM ranked GROUP BY l_returnflag""",
        "owa_partial": f"""WITH {sql_conflicts('cust_rows', 4)}
SELECT id, block, round(owa, 6) AS owa FROM averages""",
        "quality_powa": sql_powa("cust_rows", 1),
        "quality_powa_blocks": sql_powa("part_rows", 4),
        "knn_topk": f"""WITH {VECTOR_SQL},{sql_nearest(VECTOR, 'vector_rows', 'vector_rows', 5)}
SELECT {NEIGHBOUR_COLUMNS} FROM nearest""",
        "knn_topk_cv": f"""WITH {PART_SQL},{sql_nearest(PART, 'part_rows', 'part_rows', 5, True)}
SELECT {NEIGHBOUR_COLUMNS} FROM nearest""",
        "knn_topk_cv_scaled": f"""WITH {sql_scaled('cust_rows', 'range')},
{sql_nearest(CUST, 'scaled', 'scaled', 5, True, 'ratio')}
SELECT {NEIGHBOUR_COLUMNS} FROM nearest""",
        **{
            name: f"""WITH {TRADE_SQL},{sql_nearest(TRADE, 'tests', 'prototypes', 5)},
{sql_predicted('tests', weighting)}
SELECT id, round(actual, 6) AS actual, round(predicted, 6) AS predicted FROM predicted"""
            for name, weighting in (
                ("knn_predict", "reference"),
                ("knn_predict_nearest", "nearest"),
                ("knn_predict_uniform", "uniform"),
            )
        },
        "rmse_by_fold": f"""WITH {CUST_SQL},{sql_nearest(CUST, 'cust_rows', 'cust_rows', 5, True)},
{sql_predicted('cust_rows')},{FOLDS_SQL}
SELECT fold, round(rmse, 6) AS rmse, n_rows FROM fold_errors""",
        "rmse_cv": f"""WITH {PART_SQL},{sql_nearest(PART, 'part_rows', 'part_rows', 5, True)},
{sql_predicted('part_rows')},{FOLDS_SQL}
SELECT round(sum(rmse) / 10, 6) AS rmse, count(*) AS n_folds FROM fold_errors""",
        "rmse_cv_scaled": f"""WITH {sql_scaled('cust_rows', 'range')},
{sql_nearest(CUST, 'scaled', 'scaled', 5, True)},{sql_predicted('scaled')},{FOLDS_SQL}
SELECT round(avg(rmse), 6) AS rmse, count(*) AS n_folds FROM fold_errors""",
        "quality_join": f"""WITH {sql_hml('cust_rows', CUST)}
SELECT c.*, quality FROM cust_rows c JOIN quality q ON q.id = c.id""",
        "select_prototypes": f"""WITH {sql_hml('cust_rows', CUST)}
SELECT c.* FROM cust_rows c JOIN quality q ON q.id = c.id
WHERE quality >= (SELECT (min(quality) + max(quality)) / 2 FROM quality)""",
        "threshold_sweep": f"WITH {sql_sweep()} SELECT {report} FROM report",
        "best_threshold": f"WITH {sql_sweep()} SELECT {report} FROM best",
    }
    # What files give back is what was written to them.
    return said | {
        "file_rows": f"WITH {CUST_SQL} SELECT {customer} FROM cust_rows",
        "file_quality": said["quality_hml"],
        "file_approximations": said["approx_negative_outcomes"],
        "file_predictions": said["knn_predict"],
        "file_report": f"""WITH {sql_sweep()}
SELECT round(threshold, 6) AS quality, round(rmse, 6) AS rmse, size FROM report""",
        "chained_run": f"""WITH {sql_sweep()}
SELECT {customer} FROM cust_rows SEMI JOIN (
  SELECT q.id FROM quality q JOIN best b ON q.quality >= b.threshold) USING (id)""",
    }
