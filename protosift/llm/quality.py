"""Quality by compression: which of two dictionaries shortens a text more.

Zstandard dictionaries are made of text labelled good and of text labelled bad: parts
of many learning rows, one after the other. A text that is like one of them
compresses better with its dictionary. The difference of the two sizes, divided by
the size of the text, is all that the score sees; a rising curve of it, fitted on
labelled rows that the dictionaries have not seen, turns it into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protosift.llm.scratch import once_in_worker
from protosift.llm.training import bounded_sample, learnable

#: Bytes of a dictionary, and learning rows of a label at most, as a rule.
DICTIONARY_BYTES = 400_000
SAMPLE_ROWS = 3000
#: Least characters that a learning row gives to a dictionary.
LEAST_PART = 200
LEVEL = 6
#: Bytes compressed at a time, so that a long text cannot become its own dictionary.
PIECE_BYTES = 2048


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    #: Differences and the share of good rows there; straight lines between them.
    places: np.ndarray = field(default_factory=lambda: np.zeros(1))
    shares: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))

    def measurer(self) -> Measurer:
        return once_in_worker((self.good, self.bad), lambda: Measurer(self.good, self.bad))

    def scores(self, differences: np.ndarray) -> np.ndarray:
        """Probabilities; beyond the curve's ends they go on towards 0 and 1."""
        inside = np.interp(differences, self.places, self.shares)
        if len(self.places) < 2:
            return inside
        reach = max(float(np.ptp(self.places)), 1e-9)
        below = np.exp(-np.maximum(self.places[0] - differences, 0) / reach)
        above = np.exp(-np.maximum(differences - self.places[-1], 0) / reach)
        return 1 - (1 - inside * below) * above


class Measurer:
    """Sizes of texts compressed with two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        flags = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self.good, self.bad = (
            zstandard.ZstdCompressor(level=LEVEL, **flags, **({"dict_data": zstandard.ZstdCompressionDict(d, dict_type=raw)} if d else {}))
            for d in (good, bad)
        )

    def difference(self, text: bytes) -> float:
        """Bytes that the good dictionary saves beyond the bad one, per byte of text."""
        saved = 0
        for at in range(0, len(text), PIECE_BYTES):
            piece = text[at : at + PIECE_BYTES]
            saved += len(self.bad.compress(piece)) - len(self.good.compress(piece))
        return saved / max(1, len(text))


def rising_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising curve nearest to ``y`` by weighted squares.

    Neighbours whose means fall are pooled until none do. A point is the mean of a
    pool; pools at the ends are kept off 0 and 1 by half a row.
    """
    pools: list[list[float]] = []
    for at, value, w in zip(*(v[x.argsort(kind="stable")].tolist() for v in (x, y, weight))):
        pools.append([w, w * at, w * value])
        while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    whole, places, sums = np.array(pools).T
    half = float(weight.mean()) / 2
    return places / whole, (sums + half) / (whole + 2 * half)


class QualityClassifier:
    """Scores texts from dictionaries of labelled ones.

    Null texts count as empty. Empty texts, which no dictionary shortens, have the
    score of a difference of 0. Ids may be null or repeat; every row has its result,
    and columns other than the id and the text are not read. With no label of one
    kind all scores are 0.5. A dictionary takes a part of each of its rows, which
    begins anywhere in the text.
    """

    def __init__(self, id_col="doc_id", text_col="text", sample_rows=SAMPLE_ROWS, dictionary_bytes=DICTIONARY_BYTES):
        self.id_col, self.text_col = id_col, text_col
        self.sample_rows, self.dictionary_bytes = sample_rows, dictionary_bytes

    def fit(self, docs: DataFrame, labels: DataFrame, label_col: str) -> QualityModel:
        """From at most about ``sample_rows`` labelled rows of each kind: half for
        the dictionaries, half for the curve, which takes whole texts and weighs
        rows so that labels have their shares of all labelled rows."""
        kept = labels.where(learnable(self.id_col) & F.col(label_col).isin(0, 1)).select(
            F.col(self.id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")
        )
        rows = docs.select(F.col(self.id_col).alias("_id"), F.coalesce(F.col(self.text_col).cast("string"), F.lit("")).alias("_text"))
        # Two labels at most.
        shares = {r["_label"]: r["count"] for r in kept.groupBy("_label").count().collect()}
        picked = bounded_sample(kept, "_label", "_id", self.sample_rows)  # so small that it can be broadcast
        sample = rows.join(F.broadcast(picked), "_id").dropDuplicates(["_label", "_text"])
        half = F.pmod(F.xxhash64(F.lit(2), "_text"), F.lit(2)) == 0
        # Rows share a dictionary evenly: the fewer there are, the longer their parts.
        good_part, bad_part = (
            max(LEAST_PART, 2 * self.dictionary_bytes // max(1, min(shares.get(k, 0), self.sample_rows))) for k in (1, 0)
        )
        part = F.when(F.col("_label") == 1, good_part).otherwise(bad_part)
        start = F.pmod(F.xxhash64(F.lit(3), "_text"), F.greatest(F.lit(1), F.length("_text") - part + 1)).cast("int")
        parts = sample.where(half).select("_label", F.substring("_text", start + 1, part).alias("_text"))
        found = parts.orderBy("_label", F.xxhash64("_text"), "_text").collect()
        good, bad = (
            b"\n".join(r["_text"].encode() for r in found if r["_label"] == k)[: self.dictionary_bytes] for k in (1, 0)
        )
        model = QualityModel(good, bad)
        rest = self._differences(sample.where(~half).select("_label", "_text"), model, "_label").collect()
        y, x = np.array([r[0] for r in rest], float), np.array([r[1] for r in rest])
        if not 0 < y.sum() < len(y):
            return model
        weight = np.where(y == 1, shares[1] / y.sum(), shares[0] / (len(y) - y.sum()))
        model.places, model.shares = rising_curve(x, y, weight)
        return model

    def _differences(self, rows: DataFrame, model: QualityModel, key: str) -> DataFrame:
        def run(batches):
            measurer = model.measurer()
            for batch in batches:
                found = [measurer.difference((t or "").encode()) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["key", "difference"])

        return rows.select(F.col(key).cast("long"), "_text").mapInArrow(run, "key long, difference double")

    def score(self, docs: DataFrame, model: QualityModel) -> DataFrame:
        """(id, score) of every document, from its whole text."""

        def run(batches):
            measurer = model.measurer()
            for batch in batches:
                found = np.array([measurer.difference((t or "").encode()) for t in batch.column(1).to_pylist()], float)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(found))], names=["id", "score"])

        rows = docs.select(F.col(self.id_col).cast("long").alias("id"), F.col(self.text_col).cast("string").alias("text"))
        return rows.mapInArrow(run, "id long, score double")
