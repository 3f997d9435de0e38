"""A pipeline over documents: language, near duplicates, leaks, secrets, tokens.

Every stage takes (spark, docs, sf_dir) and returns a table, which is written and
read again as the next one's ``docs``. All but the last return the columns of
``documents``, whatever their names. An empty table gives an empty result.

1. Language: documents without a letter, or without text, go.
2. Near duplicates: of the documents that shingles of five words link at a Jaccard
   of 0.8 or more, the one of the smallest id stays (ids may be null, which come
   last, or repeat). Documents without words link with nothing.
3. Decontamination: documents with a window like a benchmark item (0.8 or more) go.
4. Secrets: spans of secrets become ``[SECRET]``, and ``n_chars`` follows the text.
5. SentencePiece: documents become ids.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from protosift.llm.decontaminate import Decontaminator  # noqa: E402
from protosift.llm.jaccard_join import JaccardJoin  # noqa: E402
from protosift.llm.language_id import UNKNOWN, LanguageId  # noqa: E402
from protosift.llm.piece_transducer import PieceCoder  # noqa: E402
from protosift.llm.queries import vocabulary  # noqa: E402
from protosift.llm.scratch import Scratch  # noqa: E402
from protosift.llm.secret_scan import SecretScan  # noqa: E402


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted language; ``lang`` stays as it was given."""
    finder, name = LanguageId(), _unused(docs, "_predicted")
    predicted = finder.label(docs, finder.fit(docs), name)
    return predicted.where(F.col(name) != UNKNOWN).drop(name)


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    key = _unused(docs, "_row")
    rows = Scratch(spark, "rows").keep(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    gone = JaccardJoin().row_classes(rows, key).where("not first").select(key)
    return rows.join(gone, key, "left_anti").select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    name = _unused(docs, "_leaks")
    leaks = Decontaminator().flag(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name)
    return leaks.where(F.col(name) == 0).drop(name)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked."""
    scan = SecretScan()
    masked = scan.redact(docs, scan.fit(docs))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.length("text").cast(kind))
    return masked


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids) of every document."""
    ids = PieceCoder(vocabulary("piece_bpe_32k.model")).encode(docs.select("doc_id", "text"))
    return ids.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids")


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", first_of_near_copies),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("SentencePiece encoding", encoded),
]

#: Models and encodings have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if number:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
