"""Benchmark decontamination: SimHash of windows of an item's size.

Every document window of as many words as a benchmark item has, and with a
shingle of such an item in it (without one it shares nothing), gets a fingerprint
of 256 bits from its weighted shingles. Fingerprints are cut into blocks: two
that differ in no more than ``RADIUS`` bits differ in some block by no more than
their share, so an index of every block of the items, under all values within
that share, finds all fingerprints within the radius. Candidates are verified
by exact weighted similarity: sum of smaller over sum of larger shingle
weights, a shingle weighing as often as it occurs.

At a similarity of 0.8 fingerprints differ in 39 of 256 bits, with a standard
deviation of 6; the radius lies three of them above.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protosift.llm.scratch import Scratch, forget_in_worker, small_batches
from protosift.llm.words import WORDS_ONLY, chunks, grams, mix, shingles_of, words_of

BITS, BLOCKS, RADIUS = 256, 16, 56
_BLOCK_BITS = BITS // BLOCKS
#: Characters of items, and bytes of their index, that a task searches for at once;
#: more take several passes. An item has 697 values of two bytes, with its number
#: of four, in each block.
ITEM_CHARS = 4 << 20
INDEX_BYTES = 256 << 20
_U = np.uint64


#: Characters beyond ASCII that are neither letters nor digits.
_OTHER = re.compile(r"[^\x00-\x7f\w]+")


def normal(text: str | None) -> bytes:
    """UTF-8 of the text in lower case, where only letters and digits lie beyond ASCII."""
    low = (text or "").lower()
    return (low if low.isascii() else _OTHER.sub(" ", low)).encode()


def _bits(shingles: np.ndarray) -> np.ndarray:
    """Rows of 256 signs, 1 and -1, of shingle hashes."""
    words = np.stack([mix(shingles ^ _U(k * 0x9E3779B1 + 1)) for k in range(BITS // 64)], axis=1)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, as 16 blocks of 16 bits."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def _masks() -> np.ndarray:
    share = RADIUS // BLOCKS
    return np.array([sum(1 << i for i in on) for k in range(share + 1) for on in combinations(range(_BLOCK_BITS), k)], np.uint16)


def _items_at_once() -> int:
    return max(1, INDEX_BYTES // (BLOCKS * len(_masks()) * 6))


class ItemIndex:
    """Benchmark items by shingle and by blocks of their fingerprints."""

    def __init__(self, items: list[tuple[int | None, str]], width: int):
        self.width = width
        words = words_of([normal(t) for _, t in items], WORDS_ONLY)
        sizes = np.diff(words.first)
        shingles, owner = shingles_of(words, width)
        self.ids = [i for i, _ in items]
        self.shingles = np.split(shingles, np.searchsorted(owner, np.arange(1, len(items)))) if items else []
        self.sizes = sizes
        full = np.flatnonzero(sizes > 0)
        prints = np.zeros((len(items), BLOCKS), np.uint16)
        for k in full:
            prints[k] = _packed(_bits(self.shingles[k]).sum(axis=0, keepdims=True))[0]
        self.prints = prints
        #: of each number of words: the items, and (block value, item) sorted by value for each block
        self.by_size = {}
        masks = _masks()
        for size in np.unique(sizes[full]):
            some = full[sizes[full] == size]
            tables = []
            for block in range(BLOCKS):
                values = (prints[some, block][:, None] ^ masks[None, :]).ravel()
                order = np.argsort(values, kind="stable")
                tables.append((values[order], np.repeat(some, len(masks))[order].astype(np.int32)))
            self.by_size[int(size)] = tables
        #: widths in use, and for each its shingles with the sizes of items that have them
        self.anchors = {}
        of_width = np.minimum(sizes[owner], width)
        for w in np.unique(of_width):
            pairs = np.unique(np.stack([shingles[of_width == w], sizes[owner][of_width == w].astype(_U)]), axis=1)
            seen = np.zeros(1 << 20, bool)
            seen[(pairs[0] >> _U(44)).astype(np.int64)] = True
            self.anchors[int(w)] = (pairs[0], pairs[1].astype(np.int64), seen)

    def candidates(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item): fingerprints of windows within the radius of an item."""
        found = []
        for block, (values, owner) in enumerate(self.by_size[size]):
            wanted = prints[:, block]
            low, high = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
            count = high - low
            at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            found.append(np.repeat(np.arange(len(prints)), count).astype(np.int64) << 32 | owner[at])
        both = np.unique(np.concatenate(found))
        window, item = both >> 32, both & 0xFFFFFFFF
        near = np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1, dtype=np.int64) <= RADIUS
        return window[near], item[near]


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger weights of two shingle multisets."""
    both, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    in_a, in_b = np.bincount(where[: len(a)], minlength=len(both)), np.bincount(where[len(a) :], minlength=len(both))
    return float(np.minimum(in_a, in_b).sum() / max(1, np.maximum(in_a, in_b).sum()))


def leaks_of(texts: list[bytes], index: ItemIndex, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, similarity, begin, end) of the best window, in words, of each item in each text."""
    words = words_of(texts, WORDS_ONLY)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for w, (hashes, sizes, seen) in index.anchors.items():
        all_grams = grams(words.hashes, w)
        hit = np.flatnonzero(seen[(all_grams >> _U(44)).astype(np.int64)])
        hit = hit[words.owner[hit] == words.owner[hit + w - 1]]
        low, high = np.searchsorted(hashes, all_grams[hit], "left"), np.searchsorted(hashes, all_grams[hit], "right")
        count = high - low
        size_of = sizes[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        at = np.repeat(hit, count)
        order = np.lexsort((at, size_of))
        at, size_of = at[order], size_of[order]
        for size in np.unique(size_of):
            here = at[size_of == size]
            owner = words.owner[here]
            begin, end = words.first[owner], words.first[owner + 1]
            # starts of windows with the anchor in them, within its text
            first = np.maximum(begin, np.minimum(here + w - size, end - size))
            last = np.maximum(first, np.minimum(here, end - size))
            edges = np.maximum(first[1:], last[:-1] + 1)
            spans = zip(np.concatenate([first[:1], edges]), last, owner, strict=True)
            runs: list[list[int]] = []
            for a, b, o in spans:
                if a > b:
                    continue
                if runs and runs[-1][1] + 1 == a and runs[-1][2] == o:
                    runs[-1][1] = b
                else:
                    runs.append([a, b, o])
            for a, b, o in runs:
                stop = min(b + size, words.first[o + 1])
                inside = all_grams[a : stop - w + 1]
                per = min(size, stop - a) - w + 1
                sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_bits(inside), axis=0, dtype=np.int32)])
                prints = _packed(sums[per:] - sums[:-per])
                for window, item in zip(*index.candidates(int(size), prints), strict=True):
                    alike = weighted_similarity(inside[window : window + per], index.shingles[item])
                    if alike >= threshold:
                        start = int(a + window - words.first[o])
                        key = (int(o), int(item))
                        if key not in best or (-alike, start) < (-best[key][0], best[key][1]):
                            best[key] = (alike, start, start + per + w - 1)
    return [(t, index.ids[item], *found) for (t, item), found in sorted(best.items())]


class Decontaminator:
    """Finds windows of documents that are like an item of a benchmark.

    Words are runs of letters and digits, lower-cased; a text without spaces is
    cut by its punctuation alone. Shingles take ``width``
    words; an item of fewer words is one shingle and looks for windows of as
    many. A document shorter than an item is a window as a whole. Null and
    wordless texts and items match nothing. Ids of documents may repeat and
    every row has its results; null ids stay null. So do those of items, and items
    whose ids are null or repeat are looked for each by itself. Other columns are not
    read. An empty table on either side gives an empty result.
    """

    def __init__(self, threshold=0.8, width=5, id_col="doc_id", text_col="text"):
        self.threshold, self.width, self.id_col, self.text_col = threshold, width, id_col, text_col

    def leaks(self, docs: DataFrame, items: DataFrame, item_id="item_id", item_text="text") -> DataFrame:
        """(id, item_id, similarity, begin, end): the best window of each item, in words."""
        found = None
        for rows in self._item_groups(items, item_id, item_text):
            part = self._leaks(docs, rows)
            found = part if found is None else found.unionByName(part)
        return found

    @staticmethod
    def _item_groups(items: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple[int | None, str]]]:
        """The items in groups of about ``ITEM_CHARS`` and ``INDEX_BYTES``; each takes a
        pass over the documents."""
        items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
        total, count = items.agg(F.sum(F.length("text")), F.count(F.lit(1))).first()
        passes = max(1 + (total or 0) // ITEM_CHARS, -(-count // _items_at_once()), 1)
        # Equal items are dealt out too, by a number of their own that is kept.
        numbered = items.withColumn("_number", F.monotonically_increasing_id())
        if passes > 1:
            numbered = Scratch(items.sparkSession, "benchmark").keep(numbered, "items")
        for k in range(passes):
            some = numbered.where(F.pmod(F.xxhash64("item_id", "text", "_number"), F.lit(passes)) == k).drop("_number")
            yield sorted(((r.item_id, r.text or "") for r in some.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))

    def _leaks(self, docs: DataFrame, items: list[tuple[int | None, str]]) -> DataFrame:
        small_batches(docs.sparkSession)
        known, width, threshold = docs.sparkSession.sparkContext.broadcast(items), self.width, self.threshold

        def run(batches):
            forget_in_worker()
            index = ItemIndex(known.value, width)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for begin, end in chunks([len(t or "") for t in texts]):
                    found = leaks_of([normal(t) for t in texts[begin:end]], index, threshold)
                    if found:
                        text, item, alike, a, b = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([ids[begin + t] for t in text], pa.int64()), pa.array(item, pa.int64()), pa.array(alike), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                            names=["id", "item_id", "similarity", "begin", "end"],
                        )

        rows = docs.select(F.col(self.id_col).cast("long").alias("id"), F.col(self.text_col).cast("string").alias("text"))
        return rows.mapInArrow(run, "id long, item_id long, similarity double, begin long, end long")

    def flag(self, docs: DataFrame, items: DataFrame, out_col: str = "leaks", item_id="item_id", item_text="text") -> DataFrame:
        """The table with a column that counts the items found in each document;
        it replaces one of that name."""
        small_batches(docs.sparkSession)
        docs = docs.drop(out_col).withColumn(out_col, F.lit(0).cast("long"))
        at, width, threshold = docs.columns.index(self.text_col), self.width, self.threshold
        for rows in self._item_groups(items, item_id, item_text):
            known = docs.sparkSession.sparkContext.broadcast(rows)

            def run(batches, known=known):
                forget_in_worker()
                index = ItemIndex(known.value, width)
                for batch in batches:
                    texts = batch.column(at).to_pylist()
                    counts = batch.column(out_col).to_numpy().copy()
                    for begin, end in chunks([len(t or "") for t in texts]):
                        for text, *_ in leaks_of([normal(t) for t in texts[begin:end]], index, threshold):
                            counts[begin + text] += 1
                    yield batch.set_column(batch.schema.names.index(out_col), out_col, pa.array(counts))

            docs = docs.mapInArrow(run, docs.schema)
        return docs
