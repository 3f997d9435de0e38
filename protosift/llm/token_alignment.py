"""Tokens of two tokenizers side by side, by products of sparse incidence matrices.

A token of a text covers a range of its bytes. The incidence matrix of a tokenizer
has a row for each token and a column for each byte. With A and B the matrices of two
tokenizers, the non-zero entries of A·Bᵀ are the pairs of tokens that overlap, and
their values are the bytes shared. Bytes after which tokens of both end cut the text
into groups; the products of the matrices of tokens and groups give the pairs of
tokens in the same group. Matrices are kept by compressed rows, and products are taken
row by row: each entry of a row of the left matrix brings a row of the right one,
and entries of the same column are added up. A batch of texts is one
block-diagonal matrix.

How often two ids overlap in all texts tells which are each other's counterpart.
Counts of frequent pairs, which by their share of all overlaps are few, are read by
the tasks from a shared file; overlaps of other pairs, none of which is frequent, are
joined with their counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protosift.llm.scratch import Scratch, once_in_worker

# Bytes of text that are aligned at a time, and entries of a task's table of counts.
BATCH_BYTES = 1 << 19
BATCH_PAIRS = 1 << 19
PAIRS_KEPT = 1 << 20
# At most this many pairs are frequent: 24 bytes each in every worker.
MOST_FREQUENT = 1 << 20
# Bits of an id in a number that stands for a pair of ids, or for a text and a pair.
ID_BITS = 21


@dataclass(frozen=True)
class Rows:
    """A sparse matrix by compressed rows: where each row begins, the columns of its
    entries, and their values."""

    begin: np.ndarray
    column: np.ndarray
    value: np.ndarray
    width: int

    @staticmethod
    def of(row: np.ndarray, column: np.ndarray, value: np.ndarray, height: int, width: int) -> Rows:
        """From entries in the order of rows."""
        begin = np.zeros(height + 1, "int64")
        np.cumsum(np.bincount(row, minlength=height), out=begin[1:])
        return Rows(begin, column, value, width)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))

    def transposed(self) -> Rows:
        if not (np.diff(self.column) < 0).any():
            return Rows.of(self.column, self.row, self.value, self.width, len(self.begin) - 1)
        order = self.column.argsort(kind="stable")
        return Rows.of(self.column[order], self.row[order], self.value[order], self.width, len(self.begin) - 1)

    def times(self, other: Rows) -> Rows:
        """Product with a matrix whose rows are this one's columns."""
        sizes = np.diff(other.begin)[self.column]
        total = int(sizes.sum())
        at = np.arange(total) + np.repeat(other.begin[self.column] - (np.cumsum(sizes) - sizes), sizes)
        row = np.repeat(self.row, sizes)
        column, value = other.column[at], np.repeat(self.value, sizes) * other.value[at]
        key = row * other.width + column
        if (np.diff(key) < 0).any():
            order = key.argsort(kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        value = np.add.reduceat(value, first) if total else value
        row, column = np.divmod(key[first], other.width) if total else (row, column)
        return Rows.of(row, column, value, len(self.begin) - 1, other.width)


def byte_incidence(sizes: np.ndarray) -> Rows:
    """Tokens by bytes, for tokens of the given sizes one after the other."""
    begin = np.zeros(len(sizes) + 1, "int64")
    np.cumsum(sizes, out=begin[1:])
    total = int(begin[-1])
    return Rows(begin, np.arange(total), np.ones(total, "int32"), total)


def group_incidence(ends: np.ndarray, cuts: np.ndarray) -> Rows:
    """Tokens by groups, for tokens that end at ``ends`` and groups at ``cuts``."""
    return Rows(np.arange(len(ends) + 1), np.searchsorted(cuts, ends), np.ones(len(ends), "int64"), len(cuts))


@dataclass(frozen=True)
class Aligned:
    """Texts of a batch: ids of both sides one after the other, their incidence with
    groups, the links, and where each text's tokens and groups begin."""

    a: np.ndarray
    b: np.ndarray
    links: Rows
    groups_a: Rows
    groups_b: Rows
    first_a: np.ndarray
    first_b: np.ndarray
    first_group: np.ndarray

    def shared(self) -> np.ndarray:
        """Pairs of tokens in the same group, counted by text: the product of the
        group matrices, added up group by group and so without forming it."""
        sizes = np.diff(self.groups_a.transposed().begin) * np.diff(self.groups_b.transposed().begin)
        return np.diff(np.append(0, np.cumsum(sizes))[self.first_group])


def align(a: list[np.ndarray], b: list[np.ndarray], bytes_a: np.ndarray, bytes_b: np.ndarray) -> Aligned:
    """Texts by the ids of their tokens; ``bytes_a`` and ``bytes_b`` are the ids'
    sizes. Both sides of a text have the same bytes."""

    def side(ids: list[np.ndarray], sizes: np.ndarray):
        first = np.zeros(len(ids) + 1, "int64")
        np.cumsum([len(x) for x in ids], out=first[1:])
        flat = np.concatenate(ids) if first[-1] else np.empty(0, "int64")
        return flat, first, byte_incidence(sizes[flat])

    flat_a, first_a, whole_a = side(a, bytes_a)
    flat_b, first_b, whole_b = side(b, bytes_b)
    ends_a, ends_b = whole_a.begin[1:], whole_b.begin[1:]
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    first_group = np.searchsorted(cuts, whole_a.begin[first_a], side="right")
    return Aligned(
        flat_a, flat_b, whole_a.times(whole_b.transposed()), group_incidence(ends_a, cuts),
        group_incidence(ends_b, cuts), first_a, first_b, first_group,
    )


class ByteLevel:
    """Ids of a byte-level tokenizer file, with special tokens' strings as plain text.

    Where the file's merges come in the order of their ids, texts whose characters
    belong to the same classes for all libraries are encoded by ranks, which is faster;
    other texts are handed to the file's own library.
    """

    # Fixed value: the pattern by which byte-level tokenizers of this kind split words.
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f]")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.path, self._library, self.by_rank = path, None, None
        vocabulary, added = said["model"]["vocab"], {t["content"]: t["id"] for t in said["added_tokens"]}
        decoded = {c: bytes([b]) for b, c in _byte_names().items()}
        self.tokens = [b""] * (1 + max([*vocabulary.values(), *added.values()]))
        for token, id in vocabulary.items():
            self.tokens[id] = token.encode() if token in added else b"".join(map(decoded.__getitem__, token))
        for token, id in added.items():
            self.tokens[id] = token.encode()
        plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        merges = ("".join(m.split(" ") if isinstance(m, str) else m) for m in said["model"]["merges"])
        if said["pre_tokenizer"] == plain and said["normalizer"] is None and all(
            vocabulary.get(merged) == 256 + i for i, merged in enumerate(merges)
        ):
            from tiktoken import Encoding

            ranks = {self.tokens[id]: id for token, id in vocabulary.items() if token not in added}
            self.by_rank = Encoding("by rank", pat_str=self.WORDS, mergeable_ranks=ranks, special_tokens={})

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.encode_special_tokens = True
        return self._library

    def encode(self, texts: list[str]) -> list[list[int]]:
        whole = [i for i, text in enumerate(texts) if not self.by_rank or self.UNUSUAL.search(text)]
        found = self.library.encode_batch([texts[i] for i in whole], add_special_tokens=False) if whole else []
        ids = {i: encoding.ids for i, encoding in zip(whole, found)}
        return [ids[i] if i in ids else self.by_rank.encode_ordinary(text) for i, text in enumerate(texts)]


def _byte_names() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if
    it is printable in Latin-1, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class Pieces:
    """Ids of a SentencePiece model file, which puts a space before a text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        self.tokens = [
            bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


class Tokens:
    """The bytes of all tokens of a tokenizer, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], "int64")
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), "uint8")

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens in a row."""
        sizes = self.sizes[ids]
        at = np.repeat(self.begin[ids] - (np.cumsum(sizes) - sizes), sizes)
        at += np.arange(len(at))
        return self.bytes[at]


class TokenAligner:
    """Overlaps of the tokens of a byte-level and of a SentencePiece tokenizer.

    Texts get a space in front: the first tokenizer is given it, the second adds it.
    A text that is null or empty, or that one of the tokenizers does not give back
    byte by byte, has no tokens. Ids may be null and may repeat; every row is
    answered. Other columns are not read, and an empty table gives an empty result.
    A text is held by one task, and memory grows with the longest text.
    """

    def __init__(self, byte_level: str, pieces: str, *, most_frequent: int = MOST_FREQUENT):
        self.paths, self.most_frequent = (byte_level, pieces), most_frequent

    def _coders(self):
        def made():
            sides = ByteLevel(self.paths[0]), Pieces(self.paths[1])
            if max(len(x.tokens) for x in sides) >= 1 << ID_BITS:
                raise ValueError(f"ids of {ID_BITS} bits at most")
            return [(x, Tokens(x.tokens)) for x in sides]

        return once_in_worker(("token-alignment", self.paths), made)

    def _aligned(self, texts: list[str]) -> tuple[list[int], Aligned]:
        """Which of the texts have tokens, and these texts."""
        whole = [" " + text for text in texts]
        want = [np.frombuffer(text.encode(), "uint8") for text in whole]
        sides = []
        for (coder, tokens), given in zip(self._coders(), (whole, texts)):
            sides.append((tokens, [np.array(ids, "int64") for ids in coder.encode(given)]))
        kept = [
            i for i, x in enumerate(want) if all(np.array_equal(tokens.joined(ids[i]), x) for tokens, ids in sides)
        ]
        (left, a), (right, b) = sides
        return kept, align([a[i] for i in kept], [b[i] for i in kept], left.sizes, right.sizes)

    def alignments(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
        """Per row ``id, n_a, n_b, n_groups, n_shared, groups`` and ``links``: the pairs of
        ids that overlap, as ``(a, b, n)`` with the number of their overlaps."""
        aligned = self._aligned

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or "" for t in batch.column("_text").to_pylist()]
                for start, stop in _portions(texts):
                    yield _described(batch.column("id").slice(start, stop - start), texts[start:stop], aligned)

        kind = dict(docs.dtypes)[id]
        schema = (
            f"id {kind}, n_a long, n_b long, n_groups long, n_shared long, groups string, "
            "a array<int>, b array<int>, n array<int>"
        )
        return docs.select(F.col(id).alias("id"), F.col(text).alias("_text")).mapInArrow(work, schema)

    def counts(self, alignments: DataFrame) -> DataFrame:
        """``a, b, count, best``: how many overlaps of all texts hold a pair of ids, and
        whether no id has more with ``b``."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pair, count in _added_up(batches):
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(count)], ["pair", "count"])

        added = alignments.select("a", "b", "n").mapInArrow(work, "pair long, count long")
        counted = added.groupBy("pair").agg(F.sum("count").alias("count"))
        # Pairs of an id are at most as many as the other side has ids.
        most = F.max("count").over(Window.partitionBy("b"))
        return counted.withColumn("b", F.expr(f"pair & {(1 << ID_BITS) - 1}L")).select(
            F.expr(f"shiftright(pair, {ID_BITS})").alias("a"), "b", "pair", "count", (F.col("count") == most).alias("best")
        )

    def summary(
        self,
        docs: DataFrame,
        id: str = "doc_id",
        text: str = "text",
        *,
        groups: Callable[[Column], Column] = lambda written: written,
    ) -> DataFrame:
        """Per row ``id, n_a, n_b, n_groups, n_shared, groups``, and of its overlaps:
        ``n_links``, how many; ``n_best``, those of a pair that is the most frequent of its
        ``b``; ``count_sum``, the counts of their pairs added up. ``groups`` makes of the
        written groups what is to be kept of them, such as a digest."""
        scratch = Scratch(docs.sparkSession, "token-alignment")
        found = self.alignments(docs, id, text).withColumn("groups", groups(F.col("groups")))
        kept = scratch.keep(found.withColumn("_row", F.monotonically_increasing_id()), "links")
        counts = scratch.keep(self.counts(kept), "counts")
        # A pair with at least this share of all overlaps: at most ``most_frequent`` have it.
        total = counts.agg(F.sum("count")).first()[0] or 0
        least = total // self.most_frequent + 1
        frequent = scratch.keep(counts.where(F.col("count") >= least).select("pair", "count", "best"), "frequent")
        found = scratch.keep(self._looked_up(kept, frequent.inputFiles()), "found")
        rest = (
            found.where("pair IS NOT NULL")
            .join(counts.where(F.col("count") < least).select("pair", "count", "best"), "pair")
            .groupBy("_row")
            .agg(
                F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("_best"),
                F.sum(F.col("n") * F.col("count")).alias("_sum"),
            )
        )
        return (
            found.where("pair IS NULL")
            .join(rest, "_row", "left")
            .select(
                "id", "n_a", "n_b", "n_groups", "n_shared", "groups", "n_links",
                (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
                (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"),
            )
        )

    def _looked_up(self, alignments: DataFrame, files: list[str]) -> DataFrame:
        """Rows with the sums over frequent pairs, and a row more, with its ``pair`` and
        ``n``, for every pair of theirs that is not frequent."""
        facts = ["id", "n_a", "n_b", "n_groups", "n_shared", "groups"]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs, counts, best = once_in_worker(("frequent pairs", tuple(files)), lambda: _read(files))
            for batch in _parts(batches):
                sizes = np.diff(batch.column("a").offsets.to_numpy())
                row = np.repeat(np.arange(len(batch)), sizes)
                pair, n = _pairs(batch)
                at = np.searchsorted(pairs, pair)
                hit = pairs[np.minimum(at, len(pairs) - 1)] == pair if len(pairs) else np.zeros(len(pair), bool)
                at, of, times = at[hit], row[hit], n[hit]

                def total(values: np.ndarray) -> pa.Array:
                    out = np.zeros(len(batch), "int64")
                    np.add.at(out, of, values)
                    return pa.array(out)

                links = np.zeros(len(batch), "int64")
                np.add.at(links, row, n)
                sums = [pa.array(links), total(times * best[at]), total(times * counts[at])]
                none = pa.nulls(len(batch), pa.int64())
                own = [batch.column("_row"), *(batch.column(c) for c in facts)]
                yield pa.RecordBatch.from_arrays([*own, *sums, none, none], names)
                if not hit.all():
                    rare = [batch.column("_row").take(pa.array(row[~hit])), *(pa.nulls(int((~hit).sum()), f.type) for f in own[1:] + sums)]
                    yield pa.RecordBatch.from_arrays([*rare, pa.array(pair[~hit]), pa.array(n[~hit])], names)

        fields = dict(alignments.dtypes)
        schema = {"_row": "long"} | {c: fields[c] for c in facts}
        schema |= {c: "long" for c in ("n_links", "n_best", "count_sum", "pair", "n")}
        names = list(schema)
        return alignments.mapInArrow(work, ", ".join(f"{c} {t}" for c, t in schema.items()))


def _portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BATCH_BYTES`` each."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BATCH_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _described(ids: pa.Array, texts: list[str], aligned) -> pa.RecordBatch:
    """A row for each text: sizes, groups in writing, and its different pairs of ids."""
    some = [i for i, t in enumerate(texts) if t]
    kept, found = aligned([texts[i] for i in some])
    where = np.array(some, "int64")[kept]
    height = len(texts)

    def spread(values: np.ndarray) -> np.ndarray:
        out = np.zeros(height, "int64")
        out[where] = values
        return out

    row = found.links.row
    text = np.repeat(np.arange(len(kept)), np.diff(found.first_a))[row]
    # One number for a text and a pair of ids; a batch has far fewer texts than 2^21.
    key = (text << 2 * ID_BITS) | (found.a[row] << ID_BITS) | found.b[found.links.column]
    key.sort()
    new = np.flatnonzero(np.diff(key, prepend=-1))
    times, key = np.diff(np.append(new, len(key))), key[new]
    starts = np.zeros(height + 1, "int32")
    np.cumsum(spread(np.bincount(key >> 2 * ID_BITS, minlength=len(kept))), out=starts[1:])
    mask = (1 << ID_BITS) - 1

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(starts), pa.array(values.astype("int32")))

    written = np.full(height, "", object)
    written[where] = _written(found)
    numbers = [np.diff(found.first_a), np.diff(found.first_b), np.diff(found.first_group), found.shared()]
    return pa.RecordBatch.from_arrays(
        [ids, *(pa.array(spread(x)) for x in numbers), pa.array(written, pa.string()),
         lists(key >> ID_BITS & mask), lists(key & mask), lists(times)],
        ["id", "n_a", "n_b", "n_groups", "n_shared", "groups", "a", "b", "n"],
    )


def _written(found: Aligned) -> list[str]:
    """Groups of each text as ``a1,a2|b1;a3|b2,b3``: ids, each with what follows it."""
    group_a, group_b = found.groups_a.column, found.groups_b.column
    last_a, last_b = (np.diff(g, append=-1) != 0 for g in (group_a, group_b))
    order = np.concatenate([2 * group_a, 2 * group_b + 1]).argsort(kind="stable")
    ids = np.concatenate([found.a, found.b])[order]
    follows = np.concatenate([last_a * 1, last_b * 2])[order]
    # Different tokens are written once.
    seen, inverse = np.unique(ids * 3 + follows, return_inverse=True)
    texts = [str(x // 3) + ",|;"[x % 3] for x in seen.tolist()]
    bounds = (found.first_a + found.first_b).tolist()
    inverse = inverse.tolist()
    return ["".join(map(texts.__getitem__, inverse[i:j]))[:-1] for i, j in zip(bounds, bounds[1:])]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their rows hold about ``BATCH_PAIRS`` pairs; a row stays whole."""
    for batch in batches:
        ends = batch.column("a").offsets.to_numpy()[1:]
        start, before = 0, int(batch.column("a").offsets[0].as_py())
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(ends, before + BATCH_PAIRS, side="right")))
            yield batch.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ids of a batch as one number each, and how often each occurs."""
    a, b, n = (batch.column(c).flatten().to_numpy().astype("int64") for c in ("a", "b", "n"))
    return (a << ID_BITS) | b, n


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts of a task's pairs, handed on whenever too many are held."""
    pairs, counts = np.empty(0, "int64"), np.empty(0, "int64")
    for batch in _parts(batches):
        pair, n = _pairs(batch)
        pairs, inverse = np.unique(np.append(pairs, pair), return_inverse=True)
        counts = np.bincount(inverse, weights=np.append(counts, n)).astype("int64")
        if len(pairs) > PAIRS_KEPT:
            yield pairs, counts
            pairs, counts = pairs[:0], counts[:0]
    if len(pairs):
        yield pairs, counts


def _read(files: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequent pairs in rising order, their counts, and which are a ``b``'s best."""
    tables = []
    for uri in files:
        store, path = fs.FileSystem.from_uri(uri)
        tables.append(pyarrow.parquet.read_table(path, filesystem=store, use_threads=False))
    if not tables:
        return np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0, "int64")
    whole = pa.concat_tables(tables)
    pairs = whole["pair"].to_numpy()
    order = pairs.argsort()
    return pairs[order], whole["count"].to_numpy()[order], whole["best"].to_numpy(zero_copy_only=False)[order].astype("int64")
