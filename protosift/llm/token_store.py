"""Token-id files with directly addressable codes.

An id is split into chunks of bits, lowest first. Level k holds the k-th chunk of
all ids that have one, packed back to back; a bitmap of each level but the last
tells which of its ids go on, and a directory holds the number of such ids
before every 512th. So the id at any position is read by one chunk and one rank
per level, without decoding a block. Documents lie one after the other; a
table of starts and ids makes each of them addressable as well.

Layout, little-endian: ``DAC1``, u32 length of a JSON header, the header, then
the sections it lists as (name, dtype, bytes), each padded to 8 bytes.
"""

from __future__ import annotations

import json
import os
import unicodedata
import uuid
import zlib
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protosift.llm.scratch import Scratch, once_in_worker
from protosift.llm.words import chunks

MAGIC = b"DAC1"
RANK_STEP = 512
#: Widths in bits that a file may choose from for its levels.
SPLITS = ((8, 8, 16), (8, 8, 8, 8), (16, 16))
#: Characters of the texts of one file, as a rule; longer texts have their own.
FILE_CHARS = 2 << 20
#: Words whose ids a Python worker remembers at most, twice.
MEMORY_WORDS = 600_000


class Level:
    """Chunks of one level, and which of its ids go on to the next."""

    def __init__(self, width: int, chunk: np.ndarray, going: np.ndarray | None, directory: np.ndarray | None):
        self.width, self.chunk, self.going, self.directory = width, chunk, going, directory

    def span_goes_on(self, begin: int, end: int) -> np.ndarray:
        """Which of the ids at ``begin:end`` go on."""
        bits = np.unpackbits(self.going[begin >> 3 : -(-end // 8)], bitorder="little")
        return bits[begin & 7 : (begin & 7) + end - begin].view(bool)

    def goes_on(self, at: np.ndarray) -> np.ndarray:
        return (self.going[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ids before ``at`` go on."""
        block = at // RANK_STEP
        begin = block * (RANK_STEP // 8)
        count = self.directory[block].astype(np.int64)
        for k in range(RANK_STEP // 8):
            byte = begin + k
            whole, partly = byte < at >> 3, byte == at >> 3
            if not (whole | partly).any():
                break
            value = self.going[np.minimum(byte, len(self.going) - 1)]
            value = np.where(whole, value, np.where(partly, value & ((1 << (at & 7)) - 1).astype(np.uint8), 0))
            count += np.bitwise_count(value.astype(np.uint8))
        return count


def _split_size(lengths: np.ndarray, split: tuple[int, ...]) -> int:
    """Bits of a file whose ids have these numbers of bits (counts by length)."""
    size, covered = 0, 0
    for k, width in enumerate(split):
        size += int(lengths[covered + 1 :].sum() + (lengths[0] if k == 0 else 0)) * (width + (k < len(split) - 1))
        covered += width
    return size


def encode(ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray, unnamed: np.ndarray | None = None) -> bytes:
    """The file of token ids below 2**32, of documents that end at ``ends``;
    ``unnamed`` tells which documents have no id of their own."""
    rest = ids.astype(np.uint32)
    lengths = np.bincount(np.frexp(ids.astype(np.float64))[1], minlength=33)
    split = min(SPLITS, key=lambda s: _split_size(lengths, s))
    sections: list[tuple[str, np.ndarray]] = [("docs", doc_ids.astype("<i8")), ("ends", ends.astype("<i8"))]
    if unnamed is not None and unnamed.any():
        sections.append(("unnamed", np.packbits(unnamed, bitorder="little")))
    widths = []
    for k, width in enumerate(split):
        widths.append(width)
        sections.append((f"chunk{k}", rest.astype(f"<u{width // 8}")))  # keeps the lowest bits
        rest = rest >> np.uint32(width)
        going = rest > 0
        if k == len(split) - 1 or not going.any():
            break
        padded = np.zeros(-(-len(going) // RANK_STEP) * RANK_STEP, bool)
        padded[: len(going)] = going
        per_block = padded.reshape(-1, RANK_STEP).sum(axis=1)
        sections.append((f"going{k}", np.packbits(padded, bitorder="little")))
        sections.append((f"ranks{k}", (np.cumsum(per_block) - per_block).astype("<u4")))
        rest = rest[going]
    body = [(name, x.dtype.str, x.tobytes()) for name, x in sections]
    header = {"ids": len(ids), "documents": len(doc_ids), "widths": widths, "crc32": 0}
    header["sections"] = [(name, kind, len(raw)) for name, kind, raw in body]
    data = b"".join(raw + bytes(-len(raw) % 8) for _, _, raw in body)
    header["crc32"] = zlib.crc32(data)
    head = json.dumps(header).encode()
    head += b" " * (-(len(head) + 8) % 8)
    return MAGIC + len(head).to_bytes(4, "little") + head + data


class TokenFile:
    """A file in memory: random access to tokens and documents."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(raw[4:8], "little")
        header = json.loads(raw[8 : 8 + size])
        if zlib.crc32(memoryview(raw)[8 + size :]) != header["crc32"]:
            raise ValueError("the file is damaged")
        at, found = 8 + size, {}
        for name, kind, length in header["sections"]:
            found[name] = np.frombuffer(raw, np.dtype(kind), length // np.dtype(kind).itemsize, at)
            at += length + -length % 8
        self.size, self.docs, self.ends = header["ids"], found["docs"], found["ends"]
        n = len(self.docs)
        self.unnamed = np.unpackbits(found["unnamed"], count=n, bitorder="little").astype(bool) if "unnamed" in found else np.zeros(n, bool)
        self.levels = [
            Level(w, found[f"chunk{k}"], found.get(f"going{k}"), found.get(f"ranks{k}")) for k, w in enumerate(header["widths"])
        ]

    def tokens(self, at: np.ndarray) -> np.ndarray:
        """The ids at any positions."""
        at = np.asarray(at, np.int64)
        out, shift, where = np.zeros(len(at), np.uint32), 0, np.arange(len(at))
        for level in self.levels:
            out[where] |= level.chunk[at].astype(np.uint32) << np.uint32(shift)
            if level.going is None or not len(at):
                break
            on = level.goes_on(at)
            where, at = where[on], level.rank(at[on])
            shift += level.width
        return out

    def span(self, begin: int, end: int) -> np.ndarray:
        """The ids of ``begin:end``; ranks are counted once for the whole span."""
        out, shift = self.levels[0].chunk[begin:end].astype(np.uint32), 0
        first, last, where = begin, end, None
        for level, after in zip(self.levels, self.levels[1:], strict=False):
            on = np.flatnonzero(level.span_goes_on(first, last))
            where = on if where is None else where[on]
            if not len(where):
                break
            shift += level.width
            first = int(level.rank(np.array([first]))[0])
            last = first + len(where)
            out[where] |= after.chunk[first:last].astype(np.uint32) << np.uint32(shift)
        return out

    def document(self, number: int) -> np.ndarray:
        return self.span(int(self.ends[number - 1]) if number else 0, int(self.ends[number]))


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores of an executor have tasks of their own
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Ids of texts by a tokenizer that lower-cases, takes white space as a mere
    divider, and never joins letters with other characters.

    Such a tokenizer's ids of a text are those of its words in turn, so a word is
    encoded once and remembered. Only ASCII white space divides words here; the
    tokenizer sees any other as part of a word and handles it itself. Texts that
    may hold an added token, such as ``<|endoftext|>``, are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.ends_word[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.added = sorted({_white(x.content).lower() for x in self.tokenizer.get_added_tokens_decoder().values()})
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, each text's followed by ``end_id``, and where texts end."""
        split, whole = [], []
        for number, text in enumerate(texts):
            low = _white(text).lower()
            if any(x in low for x in self.added):
                whole.append(number)
                split.append([])
            else:
                split.append(_spaced(text, low).split(" "))
        if len(self.memory) > MEMORY_WORDS:  # what is still in use comes back from the older half
            self.older, self.memory = self.memory, {}
        memory, older, ended = self.memory, self.older, []
        new = set()
        for word in set().union(*split) - memory.keys():
            if word in older:
                memory[word] = older[word]
                continue
            # Full stops and commas behind a letter are never part of its token.
            stem = word.rstrip(".,")
            if stem != word and stem and stem[-1].isalpha():
                ended.append((word, stem, word[len(stem) :]))
                new.update(x for x in ended[-1][1:] if x not in memory)
            else:
                new.add(word)
        self._look_up([w for w in new if w.isalpha()], joined=True)
        self._look_up([w for w in new if not w.isalpha()], joined=False)
        for word, stem, end in ended:
            memory[word] = memory[stem] + memory[end]
        last = array("I", [end_id]).tobytes()
        raw = [b"".join(map(memory.__getitem__, words)) + last for words in split]
        for number in whole:
            found = self.tokenizer.encode_batch_fast([texts[number]], add_special_tokens=False)[0]
            raw[number] = array("I", found.ids).tobytes() + last
        return np.frombuffer(b"".join(raw), np.uint32), np.cumsum([len(x) // 4 for x in raw], dtype=np.int64)


    def _look_up(self, words: list[str], joined: bool) -> None:
        """Remember the ids of words. Words of letters alone end with their only
        end-of-word token, so many are encoded as one text and cut there."""
        for begin in range(0, len(words), 1000):
            some = words[begin : begin + 1000]
            if joined:
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) == len(some):
                    raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                    self.memory.update(zip(some, (raw[a:b] for a, b in pairwise(cuts)), strict=True))
                    continue
            for word, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.memory[word] = array("I", found.ids).tobytes()


def _white(text: str) -> str:
    """The text with ASCII white space as spaces."""
    for space in "\t\n\v\f\r":
        if space in text:
            text = text.replace(space, " ")
    return text


def _spaced(text: str, low: str) -> str:
    """The text with ASCII white space as spaces, in lower case (``low``) if that is
    what the tokenizer makes of it.

    Capital sigma and dotted I, whose lower case depends on the library, are left
    to the tokenizer with their whole text. So are texts that NFC changes before
    or after lower-casing: the tokenizer composes first, and some letters with
    marks are composed only in lower case.
    """
    if text.isascii():
        return low
    as_it_is = "Σ" in text or "İ" in text or not all(unicodedata.is_normalized("NFC", t) for t in (text, low))
    return _white(text) if as_it_is else low


def _write(path: str, raw: bytes) -> None:
    """Write a whole file, or none of it: executors may end at any time."""
    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as out:
        out.write(raw)
    store.move(part, at)


class TokenStore:
    """Encodes documents to token files in the order of their ids, and reads them.

    Null texts count as empty; every document ends with ``end_id``. Null ids come
    first and stay null; rows with the same id stay next to each other, in the order
    of their texts. Other columns are not read. An empty table gives no files.
    """

    def __init__(self, tokenizer_path: str, end_id: int, id_col="doc_id", text_col="text"):
        self.path, self.end_id, self.id_col, self.text_col = tokenizer_path, end_id, id_col, text_col

    def write(self, docs: DataFrame, folder: str) -> DataFrame:
        """(file, path, n_tokens, n_documents) of the files written to ``folder``.

        Documents are dealt out by ranges of ids; a task writes the files of its
        range. ``file`` numbers follow the order of ids. The folder is a URI that
        all executors reach.
        """
        path, end_id = self.path, self.end_id

        def run(batches):
            part, number = TaskContext.get().partitionId(), 0
            encoder = once_in_worker(("words", path), lambda: WordEncoder(path))
            for batch in batches:
                # Never as floating numbers, which null ids would make of all others.
                unnamed = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                ids, texts = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
                for begin, end in chunks([len(t) for t in texts], FILE_CHARS):
                    tokens, ends = encoder.encode(texts[begin:end], end_id)
                    name = f"{folder}/{part:06d}-{number:06d}.dac"
                    _write(name, encode(tokens, ids[begin:end], ends, unnamed[begin:end]))
                    yield pa.RecordBatch.from_pydict(
                        {"file": [part << 32 | number], "path": [name], "n_tokens": [len(tokens)], "n_documents": [end - begin]}
                    )
                    number += 1

        rows = docs.select(
            F.col(self.id_col).cast("long").alias("id"), F.coalesce(F.col(self.text_col).cast("string"), F.lit("")).alias("text")
        )
        ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
        return ordered.mapInArrow(run, "file long, path string, n_tokens long, n_documents long")

    @staticmethod
    def documents(files: DataFrame) -> DataFrame:
        """(id, file, start, n_tokens, ids_crc32) of every document, read from the
        files; ``start`` adds the ids of the file before it to the file's ``base``."""

        def run(batches):
            for batch in batches:
                for number, path, base in zip(*(batch.column(k).to_pylist() for k in ("file", "path", "base")), strict=True):
                    store, at = fs.FileSystem.from_uri(path)
                    with store.open_input_file(at) as source:
                        found = TokenFile(source.read())
                    all_ids = found.span(0, found.size).astype("<u4")
                    starts = np.concatenate([[0], found.ends[:-1]]).astype(np.int64)
                    crc = [zlib.crc32(all_ids[a:b].tobytes()) for a, b in zip(starts, found.ends, strict=True)]
                    n = len(starts)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(found.docs.astype(np.int64), mask=found.unnamed),
                            pa.array(np.full(n, number)),
                            pa.array(starts + base),
                            pa.array(found.ends - starts),
                            pa.array(crc, pa.int64()),
                        ],
                        names=["id", "file", "start", "n_tokens", "ids_crc32"],
                    )

        schema = "id long, file long, start long, n_tokens long, ids_crc32 long"
        return files.mapInArrow(run, schema)

    def round_trip(self, docs: DataFrame) -> DataFrame:
        """(id, start, n_tokens, ids_crc32) of all documents, from files in the
        shared folder; ``start`` counts the ids of all documents before."""
        spark = docs.sparkSession
        scratch = Scratch(spark, "tokens")
        written = scratch.keep(self.write(docs, scratch.path("files")), "manifest")
        placed = written.select("file", "path").join(self.bases(written), "file")
        files = placed.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "file")
        return self.documents(files).select("id", "start", "n_tokens", "ids_crc32")

    @staticmethod
    def bases(written: DataFrame) -> DataFrame:
        """(file, base): ids in all files before each one.

        A running sum in two steps: over the files of a range of documents, and
        over the ranges, of which there are as many as tasks.
        """
        written = written.withColumn("part", F.shiftright("file", 32))
        totals = written.groupBy("part").agg(F.sum("n_tokens").alias("total"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        ranges = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("range_base"))
        within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        placed = written.select("file", "part", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("local"))
        return placed.join(ranges, "part").select("file", (F.col("range_base") + F.col("local")).alias("base"))
