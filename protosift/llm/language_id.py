"""Language identification in two levels: family first, then its languages.

A text becomes a vector of hashed letter n-gram frequencies. Families are groups
of languages whose mean vectors are alike, found from the learning rows; a
one-versus-rest linear support vector machine predicts the family. Within a
family every two languages have a support vector machine of their own, and
the language that wins most of its duels, by summed margins in a tie, is
predicted.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from protosift.llm.scratch import forget_in_worker, small_batches
from protosift.llm.training import bounded_sample, learnable
from protosift.llm.words import chunks, rechunked

#: Size of the hashed vectors; n-grams of one to three bytes of lower-cased letters.
DIMENSIONS = 2048
#: Learning rows per language at most, as a rule, and characters of each.
SAMPLE_ROWS = 600
SAMPLE_CHARS = 4000
#: Texts of so many characters whose margins are all below this are in no learned language.
UNCLAIMED_MARGIN = -0.1
UNCLAIMED_CHARS = 250
UNKNOWN = "und"

_LETTERS = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])


def features(texts: list[bytes]) -> np.ndarray:
    """Rows of square-rooted n-gram frequencies, each of length one; zero for no letter."""
    joined = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    begins = np.cumsum([1] + [len(t) + 1 for t in texts])
    spaced = np.where(_LETTERS[joined], joined, 0x20).astype(np.uint32)
    kept = np.concatenate([[True], (spaced[1:] != 0x20) | (spaced[:-1] != 0x20)])
    owner = np.searchsorted(begins, np.flatnonzero(kept), "right") - 1
    codes = spaced[kept]
    out = np.zeros(len(texts) * DIMENSIONS)
    owner = np.clip(owner, 0, len(texts) - 1).astype(np.int64)
    gram = np.zeros(len(codes), np.uint32)
    for n in range(1, 4):
        gram = gram[: len(codes) - n + 1] * np.uint32(257) + codes[n - 1 :]
        if n == 1:
            slot = gram % 256
        else:
            slot = 256 + ((gram * np.uint32(2654435761)) >> np.uint32(7)) % (DIMENSIONS - 256)
        real = (codes[: len(slot)] != 0x20) | (n > 1)
        where = owner[: len(slot)][real] * DIMENSIONS + slot[real]
        out += np.bincount(where, minlength=len(out))
    out = np.sqrt(out.reshape(len(texts), DIMENSIONS))
    out[:, 0x20] = 0
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(length == 0, 1, length)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, rounds: int = 150) -> np.ndarray:
    """Weights, the last one a bias, of a squared-hinge support vector machine.

    ``y`` holds 1 and -1; classes weigh the same. Accelerated gradient descent.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])  # rows of squared length 2 at most
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    step = 1 / (1 / c + 4)
    share, y = share.astype(np.float32), y.astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    k = 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        after = ahead - np.float32(step) * (ahead / np.float32(c) - 2 * ((share * y * slack) @ x))
        k_after = (1 + np.sqrt(1 + 4 * k * k)) / 2
        ahead = after + np.float32((k - 1) / k_after) * (after - w)
        w, k = after, k_after
    return w


def families_of(means: np.ndarray) -> np.ndarray:
    """Family number of every language, from cosines of centred mean vectors.

    Two languages are family if their centred means point the same way
    (a positive cosine), and so are those that such links join.
    """
    centred = means - means.mean(axis=0)
    alike = (centred @ centred.T > 0) | np.eye(len(means), dtype=bool)
    family = np.arange(len(means))
    for _ in range(len(means)):
        family = np.array([family[alike[i]].min() for i in range(len(means))])
    return np.unique(family, return_inverse=True)[1]


@dataclass
class LanguageModel:
    languages: list[str]
    family: np.ndarray
    #: One row of weights per family.
    family_weights: np.ndarray
    #: Weights of each two languages of a family: positive for the first.
    duels: dict[tuple[int, int], np.ndarray]
    #: Margins are divided by this before they become a score.
    scale: float = 0.25

    @staticmethod
    def fit(texts: list[bytes], labels: list[str]) -> LanguageModel:
        languages = sorted(set(labels))
        y = np.array([languages.index(x) for x in labels], int)
        if not languages:
            return LanguageModel([], np.zeros(0, int), np.zeros((0, DIMENSIONS + 1)), {})
        x = features(texts)
        family = families_of(np.stack([x[y == k].mean(axis=0) for k in range(len(languages))]))
        of = family[y]
        rest = [
            linear_svm(x, np.where(of == k, 1.0, -1.0)) if family.max() else np.zeros(DIMENSIONS + 1)
            for k in range(family.max() + 1)
        ]
        duels = {}
        for a, b in combinations(range(len(languages)), 2):
            if family[a] == family[b]:
                both = (y == a) | (y == b)
                duels[a, b] = linear_svm(x[both], np.where(y[both] == a, 1.0, -1.0))
        return LanguageModel(languages, family, np.stack(rest), duels)

    def unclaimed(self, x: np.ndarray) -> np.ndarray:
        """Rows of features that every family's machine turns down clearly."""
        return (x @ self.family_weights[:, :-1].T + self.family_weights[:, -1]).max(axis=1) < UNCLAIMED_MARGIN

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score of every row of features."""
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        margins = x @ self.family_weights.T
        family = margins.argmax(axis=1)
        if margins.shape[1] > 1:
            ordered = np.sort(margins, axis=1)
            sure = 1 / (1 + np.exp(-(ordered[:, -1] - ordered[:, -2]) / self.scale))
        else:
            sure = np.ones(len(x))
        votes = np.where(self.family[None, :] == family[:, None], 0.0, -np.inf)
        closest = np.full((len(x), len(self.languages)), np.inf)
        for (a, b), w in self.duels.items():
            m = x @ w
            votes[:, a] += (m > 0) + 1e-3 * np.tanh(m)
            votes[:, b] += (m <= 0) - 1e-3 * np.tanh(m)
            closest[:, a] = np.minimum(closest[:, a], m)
            closest[:, b] = np.minimum(closest[:, b], -m)
        best = votes.argmax(axis=1)
        duel = closest[np.arange(len(x)), best]
        return best, sure / (1 + np.exp(-duel / self.scale))


class LanguageId:
    """Predicts the language of texts from a model fitted on labelled ones.

    A text that is null, or holds no letter of any script, is ``und`` with a
    score of 0, and so is every text if there was nothing to learn from. Scores
    lie from 0 to 1. Ids may be null or repeat; every row has its result, and
    other columns stay out of it.
    """

    def __init__(self, id_col="doc_id", text_col="text", lang_col="lang", sample_rows=SAMPLE_ROWS, sample_chars=SAMPLE_CHARS):
        self.id_col, self.text_col, self.lang_col = id_col, text_col, lang_col
        self.sample_rows, self.sample_chars = sample_rows, sample_chars

    def fit(self, docs: DataFrame) -> LanguageModel:
        """From at most about ``sample_rows`` rows per language with a label."""
        rows = docs.where(learnable(self.id_col)).select(
            F.col(self.lang_col).cast("string").alias("label"), F.col(self.text_col).cast("string").alias("text")
        )
        sample = bounded_sample(rows, "label", "text", self.sample_rows)
        part = F.lit(self.sample_chars)
        start = F.pmod(F.xxhash64(F.lit(3), "text"), F.greatest(F.lit(1), F.length("text") - part + 1)).cast("int")
        found = sample.select("label", F.substring("text", start + 1, part).alias("text")).orderBy("label", "text").collect()
        return LanguageModel.fit([r.text.lower().encode() for r in found], [r.label for r in found])

    def _predicted(self, texts: list[str | None], model: LanguageModel, reject=False) -> tuple[np.ndarray, np.ndarray]:
        names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        for begin, end in chunks([len(t or "") for t in texts]):
            known = [t is not None and any(map(str.isalpha, t)) and bool(model.languages) for t in texts[begin:end]]
            at = begin + np.flatnonzero(known)
            if len(at):
                x = features([texts[i].lower().encode() for i in at])
                best, score = model.predict(x)
                names[at], scores[at] = np.array(model.languages, object)[best], score
                if reject:
                    none = at[model.unclaimed(x) & (np.array([len(texts[i]) for i in at]) >= UNCLAIMED_CHARS)]
                    names[none], scores[none] = UNKNOWN, 0.0
        return names, scores

    @staticmethod
    def _batch_rows(docs: DataFrame) -> int:
        """Rows of a batch; a score depends a little on the texts that are scored with it."""
        most = int(docs.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return most if most > 0 else 1 << 62

    def predict(self, docs: DataFrame, model: LanguageModel) -> DataFrame:
        """(id, lang_pred, score) of every document, from its whole text."""

        most = self._batch_rows(docs)

        def run(batches):
            forget_in_worker()
            for batch in rechunked(batches, 1, most):
                names, scores = self._predicted(batch.column(1).to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["id", "lang_pred", "score"]
                )

        small_batches(docs.sparkSession)
        rows = docs.select(F.col(self.id_col).cast("long").alias("id"), F.col(self.text_col).cast("string").alias("text"))
        return rows.mapInArrow(run, "id long, lang_pred string, score double")

    def label(self, docs: DataFrame, model: LanguageModel, out_col: str = "lang_pred", reject=False) -> DataFrame:
        """The table with a column of predicted languages, which replaces one of its name.

        With ``reject``, texts of ``UNCLAIMED_CHARS`` or more that no family claims
        are ``und`` as well. (Of two families one or the other claims every text, so
        that takes three.)
        """
        small_batches(docs.sparkSession)
        docs = docs.drop(out_col)
        at = docs.columns.index(self.text_col)
        schema = StructType([*docs.schema.fields, StructField(out_col, StringType())])
        most = self._batch_rows(docs)

        def run(batches):
            forget_in_worker()
            for batch in rechunked(batches, at, most):
                names, _ = self._predicted(batch.column(at).to_pylist(), model, reject)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], names=[*batch.schema.names, out_col])

        return docs.mapInArrow(run, schema)
