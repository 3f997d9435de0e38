"""Registered queries of the operators, on the provided tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protosift.llm.chat_template import ChatFormatter
from protosift.llm.decontaminate import Decontaminator
from protosift.llm.embedding_dedup import EmbeddingDedup
from protosift.llm.exact_dedup import ExactDedup
from protosift.llm.hard_negatives import HardNegatives
from protosift.llm.jaccard_join import JaccardJoin
from protosift.llm.language_id import LanguageId
from protosift.llm.pii import KINDS as PII_KINDS
from protosift.llm.pii import Pseudonymiser
from protosift.llm.piece_transducer import PieceCoder
from protosift.llm.quality import QualityClassifier
from protosift.llm.scratch import Scratch
from protosift.llm.secret_scan import SecretScan
from protosift.llm.token_alignment import TokenAligner
from protosift.llm.token_store import TokenStore
from protosift.llm.training import learnable


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of equal labels linked by a cosine of 0.93 or more."""
    found = EmbeddingDedup(0.93).classify(_table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by three-word shingles with a Jaccard of 0.9 or more."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    rows = Scratch(spark, "rows").keep(docs, "keyed")
    found = JaccardJoin(Fraction(9, 10), width=3).row_classes(rows, "_row")
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, as digests."""
    docs = _table(spark, sf_dir, "documents")
    scan = SecretScan()
    spans = scan.scan(docs, scan.fit(docs))

    def joined(kept):
        parts = F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(parts, ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return spans.select(
        F.col("id").alias("doc_id"),
        *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(joined(of("assign", "access", "hex")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, exactly or nearly."""
    found = Decontaminator().leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one of control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    read = ChatFormatter.read_back(ChatFormatter().format(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms in place of personal values."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = Pseudonymiser(b"registered query: not a secret").apply(docs, "text_out")
    counts = (F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in PII_KINDS)
    return found.select("doc_id", *counts, F.col("text_out").alias("text"))


def op7_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as SentencePiece ids, and whether they decode to its text."""
    coder = PieceCoder(vocabulary("piece_bpe_32k.model"))
    coded = coder.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids", "restored")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as token ids, read back from files of addressable codes."""
    store = TokenStore(vocabulary("word_bpe_49k.json"), end_id=2)
    return store.round_trip(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely every document is of good quality."""
    docs = _table(spark, sf_dir, "documents")
    classifier = QualityClassifier()
    model = classifier.fit(docs, _table(spark, sf_dir, "labels"), "quality")
    found = classifier.score(docs, model).withColumnRenamed("id", "doc_id")
    return found.select(
        "doc_id", (~learnable("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = _table(spark, sf_dir, "documents")
    finder = LanguageId()
    found = finder.predict(docs, finder.fit(docs)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (~learnable("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of other labels that score a little below an anchor's best positives."""
    rows = _table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "embedding",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
    )
    found = HardNegatives(scale=256, positives=5, negatives=10, least=(30, 100), most=(90, 100)).mine(
        rows, F.col("vec_id") % 100 == 0, id="vec_id"
    )
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers overlap in every document."""
    aligner = TokenAligner(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    documents = _table(spark, sf_dir, "documents")
    found = aligner.summary(documents, groups=lambda written: F.sha2(written.cast("binary"), 256))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        "n_best",
        "count_sum",
        F.when(F.col("n_a") > 0, F.col("groups")).otherwise("").alias("groups_sha256"),
    )


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays of every group of documents with equal texts."""
    found = ExactDedup().groups(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_secret_scan": op3_secret_scan,
        "op4_decontaminate": op4_decontaminate,
        "op5_chat_format": op5_chat_format,
        "op6_pseudonyms": op6_pseudonyms,
        "op7_piece_transducer": op7_piece_transducer,
        "op8_token_store": op8_token_store,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_language_id": op10_language_id,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_token_alignment": op12_token_alignment,
        "op13_exact_dedup": op13_exact_dedup,
    }


EMBEDDING_SQL = """WITH RECURSIVE links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b
    ON a.label = b.label AND a.vec_id <> b.vec_id
    AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c.component_id,
       c.component_id = e.vec_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id"""


JACCARD_SQL = """WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b
    ON a.token = b.token AND a.doc_id <> b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = s.doc_id"""


CHAT_SQL = """WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
parts AS (
  SELECT *, role || text AS said FROM turns),
sized AS (
  SELECT *, length(said) + length(said) - length(replace(said, chr(92), ''))
    + len(regexp_extract_all(role, '</?s>|\\[/?INST\\]')) + len(regexp_extract_all(text, '</?s>|\\[/?INST\\]')) + 22 AS chars
  FROM parts)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""


NEGATIVE_SQL = """WITH vectors AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS alike,
         CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.id % 100 = 0 AND a.id <> b.id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10"""


EXACT_SQL = """SELECT doc_id, max(doc_id) OVER alike AS keep_id, count(*) OVER alike AS group_size,
       doc_id = max(doc_id) OVER alike AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW alike AS (PARTITION BY coalesce(text, ''))"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_dedup": EMBEDDING_SQL,
        "op2_jaccard_join": JACCARD_SQL,
        "op5_chat_format": CHAT_SQL,
        "op11_hard_negatives": NEGATIVE_SQL,
        "op13_exact_dedup": EXACT_SQL,
    }
