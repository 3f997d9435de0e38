"""SentencePiece encoding and decoding as a weighted transducer.

The model file is compiled to three parts that are composed with every input:

* the normaliser, one state that turns a space into U+2581, with a first arc
  that puts one in front;
* the pieces, arcs that read the characters of a piece and write its id, with
  the negated score as weight (a table by hash of the characters);
* byte fallback, arcs that read a character without a piece of its own and
  write the ids of its bytes, with a weight above that of any piece.

The path of the least total weight (tropical semiring) is taken. In a unigram
model a path weighs the sum of its arcs. A model of merges (BPE) does not
minimise a sum, so there the arcs keep their last piece as state, and to put two
pieces next to each other weighs nothing if the merges would leave them apart and
infinity otherwise. Merging leaves exactly one path of finite weight: a
sequence is what the merges give if and only if that holds for every two
neighbours.

The composition factors between two characters that are next to each other in no
piece, so shortest paths between such places are found once for each distinct
stretch of text, for many at a time.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from protosift.llm.scratch import forget_in_worker, once_in_worker, small_batches
from protosift.llm.words import chunks, mix

SPACE = "▁"
#: Stretches of text whose ids a Python worker remembers at most, twice.
MEMORY = 150_000
#: Characters of stretches whose paths are found at once.
AT_ONCE = 1 << 16
#: Places of the table of known neighbours, a power of two.
NEIGHBOUR_PLACES = 1 << 20
_NONE = -1
_U = np.uint64
_BASE, _INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 2**64)
_FALLBACK = 1 << 20


def _merged(symbols: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Symbols after all merges of the best rank first, leftmost first; the last merge."""
    symbols, last = list(symbols), None
    while len(symbols) > 1:
        best = min(range(len(symbols) - 1), key=lambda i: (rank.get(symbols[i] + symbols[i + 1], 1 << 40), i))
        if symbols[best] + symbols[best + 1] not in rank:
            break
        last = (symbols[best], symbols[best + 1])
        symbols[best : best + 2] = ["".join(last)]
    return symbols, last


def _hashed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash of code points, and inverse powers."""
    steps = np.full(len(codes) + 1, _BASE, _U)
    back = np.full(len(codes) + 1, _INVERSE, _U)
    steps[0] = back[0] = 1
    powers, inverse = np.multiply.accumulate(steps), np.multiply.accumulate(back)
    sums = np.zeros(len(codes) + 1, _U)
    np.cumsum(mix(codes.astype(_U)) * powers[:-1], out=sums[1:])
    return sums, inverse


class _Table:
    """Numbers by 64-bit keys, in arrays; ``missing`` for unknown keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int = _NONE):
        order = np.argsort(keys)
        self.keys, self.values, self.missing = keys[order], values[order], missing
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(mix(self.keys) >> _U(44)).astype(np.int64)] = True

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.missing, np.int64)
        maybe = np.flatnonzero(self.seen[(mix(keys) >> _U(44)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == keys[maybe]
            out[maybe[hit]] = self.values[at[hit]]
        return out


@dataclass
class PieceModel:
    """What a model file says, compiled for arrays. ``of`` reads a file."""

    pieces: list[str]
    weights: np.ndarray
    merges: bool
    prefix: bool
    bytes_first: dict[int, int]
    unknown: int
    reachable: np.ndarray
    #: Of each piece: the two pieces that its last merge joins, itself if none.
    left: np.ndarray
    right: np.ndarray
    rank: np.ndarray
    kinds: np.ndarray

    @staticmethod
    def of(path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, trained = proto.normalizer_spec, proto.trainer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or trained.treat_whitespace_as_suffix:
            raise ValueError("this normaliser is not supported: only spaces may be rewritten")
        if trained.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        pieces = [p.piece for p in proto.pieces]
        kinds = np.array([p.type for p in proto.pieces])
        weights = np.array([-p.score for p in proto.pieces])
        normal = {p: i for i, p in enumerate(pieces) if kinds[i] == 1}
        rank_of = np.unique(weights, return_inverse=True)[1]
        left = right = np.arange(len(pieces))
        reachable = kinds == 1
        merges = trained.model_type == 2
        if merges:
            left, right = left.copy(), right.copy()
            ranks = {p: int(rank_of[i]) for p, i in normal.items()}
            for p, i in normal.items():
                if len(p) > 1:
                    whole, last = _merged(list(p), ranks)
                    reachable[i] = len(whole) == 1 and all(x in normal for x in last)
                    if reachable[i]:
                        left[i], right[i] = normal[last[0]], normal[last[1]]
        by_byte = {int(p[1:-1], 16): i for i, p in enumerate(pieces) if kinds[i] == 6}
        return PieceModel(
            pieces, weights, merges, spec.add_dummy_prefix, by_byte, int(np.flatnonzero(kinds == 2)[0]), reachable, left, right, rank_of, kinds
        )


class Transducer:
    """Encodes and decodes texts by a model."""

    def __init__(self, model: PieceModel):
        self.model = model
        used = np.flatnonzero(model.reachable)
        spelled = [np.array([ord(c) for c in model.pieces[i]]) for i in used]
        keys = np.array([self._key(*_hashed(s), np.array([0]), len(s))[0] for s in spelled], _U)
        self.longest = max(map(len, spelled), default=1)
        self.arcs = _Table(keys, used)
        self.spelled = self.decoder()
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Two pieces and what they join to, for all pieces that merges can make.
        split = used[model.left[used] != used]
        self.joins = None
        if model.merges:
            codes, ranks = array("Q"), array("q", [])
            for i in split.tolist():
                p = model.pieces[i]
                for k in range(1, len(p)):
                    a, b = self._id(p[:k]), self._id(p[k:])
                    if a >= 0 and b >= 0:
                        codes.append(a << 32 | b)
                        ranks.append(int(model.rank[i]))
            if not codes:
                codes, ranks = array("Q", [0]), array("q", [1 << 40])
            self.joins = _Table(np.array(codes, _U), np.array(ranks), 1 << 40)
        self.known_key = np.full(NEIGHBOUR_PLACES, np.iinfo(np.uint64).max, _U)
        self.known = np.zeros(NEIGHBOUR_PLACES, bool)
        # Neighbouring characters of any piece; between others no piece lies.
        together = {pair for i in used for pair in pairwise(model.pieces[i])}
        inner = sorted({c for pair in together for c in pair})
        self.inner = np.zeros(max(map(ord, inner), default=0) + 2, np.int32)
        self.inner[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.together = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for a, b in together:
            self.together[self.inner[ord(a)], self.inner[ord(b)]] = True

    def _stretches(self, text: str) -> list[str]:
        """The normalised text, cut wherever no piece can lie across."""
        if not text:
            return []
        text = (SPACE if self.model.prefix else "") + text.replace(" ", SPACE)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        known = self.inner[np.minimum(codes, len(self.inner) - 1)]
        cuts = np.flatnonzero(~self.together[known[:-1], known[1:]]) + 1
        return [text[a:b] for a, b in pairwise([0, *cuts.tolist(), len(text)])]

    def _id(self, piece: str) -> int:
        if not hasattr(self, "_ids"):
            self._ids = {p: i for i, p in enumerate(self.model.pieces) if self.model.reachable[i]}
        return self._ids.get(piece, _NONE)

    @staticmethod
    def _key(sums: np.ndarray, inverse: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
        return (sums[begin + length] - sums[begin]) * inverse[begin] + _U(length)

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merges leave the pieces a, then b, next to each other."""
        codes = a.astype(_U) << _U(32) | b.astype(_U)
        place = (mix(codes) >> _U(44)).astype(np.int64)
        out = self.known[place]
        new = np.flatnonzero(self.known_key[place] != codes)
        if len(new):
            some, back = np.unique(codes[new], return_inverse=True)
            fresh = self._left_apart((some >> _U(32)).astype(np.int64), (some & _U(0xFFFFFFFF)).astype(np.int64))
            out[new] = fresh[back]
            at = (mix(some) >> _U(44)).astype(np.int64)
            self.known_key[at], self.known[at] = some, fresh
        return out

    def _left_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the merges on both sides of the border, latest first: the merge
        across it must never have come before the one that is undone next."""
        m = self.model
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), 1 << 40)
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            across = self.joins.get(a[live].astype(_U) << _U(32) | b[live].astype(_U))
            out[live[across < limit[live]]] = False
            live = live[across >= limit[live]]
            whole_a, whole_b = m.left[a[live]] == a[live], m.left[b[live]] == b[live]
            live, whole_a, whole_b = (x[~(whole_a & whole_b)] for x in (live, whole_a, whole_b))
            undo_a = ~whole_a & (whole_b | (m.rank[a[live]] > m.rank[b[live]]))
            limit[live] = np.where(undo_a, m.rank[a[live]], m.rank[b[live]] + 1)
            x, y = live[undo_a], live[~undo_a]
            a[x], b[y] = m.right[a[x]], m.left[b[y]]
        return out

    def _shortest(self, stretches: list[str]) -> list[bytes]:
        """Ids of the shortest path of each stretch as 32-bit numbers, all at once."""
        m = self.model
        sizes = np.array([len(s) for s in stretches])
        joined = "".join(stretches)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        end = begins[1:][owner]
        sums, inverse = _hashed(codes)
        n = len(codes)
        starts, lengths, ids = [], [], []
        begin, room = np.arange(n), end - np.arange(n)
        for length in range(1, self.longest + 1):
            begin = begin[room[begin] >= length]
            if not len(begin):
                break
            found = self.arcs.get(self._key(sums, inverse, begin, length))
            if length == 1:
                found = np.where(found == _NONE, _FALLBACK + codes, found)
            hit = found != _NONE
            starts.append(begin[hit])
            ids.append(found[hit])
            lengths.append(np.full(hit.sum(), length))
        start, piece, length = (np.concatenate(x) for x in (starts, ids, lengths))
        order = np.argsort(start, kind="stable")
        start, piece, stop = start[order], piece[order], (start + length)[order]
        fallback = piece >= _FALLBACK
        own = np.where(fallback, m.weights[m.kinds == 1].max(initial=0) + 10, m.weights[np.where(fallback, 0, piece)])
        if m.merges:
            own = np.where(fallback, 1.0, 0.0)
        of = owner[start]
        cost = np.where(start == begins[of], own, np.inf)
        before = np.full(len(start), -1)
        first = np.searchsorted(start, np.arange(n + 1))  # arcs that leave a place
        by_stop = np.argsort(stop, kind="stable")
        last = np.searchsorted(stop[by_stop], np.arange(n + 2))  # arcs that reach a place
        depth = np.arange(n) - begins[:-1][owner]
        places = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[places], np.arange(1, sizes.max(initial=0) + 1))
        for d in range(1, sizes.max(initial=0)):
            here = places[cuts[d - 1] : cuts[d]]
            ins, outs = last[here + 1] - last[here], first[here + 1] - first[here]
            arcs_in = by_stop[np.repeat(last[here] - (np.cumsum(ins) - ins), ins) + np.arange(ins.sum())]
            place = np.repeat(np.arange(len(here)), ins)
            finite = cost[arcs_in] < np.inf
            arcs_in, place = arcs_in[finite], place[finite]
            count = outs[place]
            left = np.repeat(arcs_in, count)
            right = np.repeat(first[here][place] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            if m.merges:
                plain = ~(fallback[left] | fallback[right])
                fits = np.ones(len(left), bool)
                fits[plain] = self._apart(piece[left[plain]], piece[right[plain]])
                left, right = left[fits], right[fits]
            total = cost[left] + own[right]
            # the dearest first, so that the cheapest stays; merges leave one path to an arc
            order = slice(None) if m.merges else np.argsort(-total, kind="stable")
            cost[right[order]], before[right[order]] = total[order], left[order]
        # the cheapest arc that ends each stretch, then back along the path
        ending = np.flatnonzero(stop == end[start])
        order = np.lexsort((cost[ending], of[ending]))
        ending = ending[order][np.concatenate([[True], np.diff(of[ending][order]) > 0])]
        owners, steps, at = [], [], ending
        while len(at):
            owners.append(of[at])
            steps.append(at)
            at = before[at]
            at = at[at >= 0]
        owners, steps = np.concatenate(owners), np.concatenate(steps)
        order = np.lexsort((start[steps], owners))
        owners, steps = owners[order], steps[order]
        spelled = np.where(fallback, -(piece - _FALLBACK) - 1, piece)[steps]
        ends = np.searchsorted(owners, np.arange(1, len(sizes) + 1)).tolist()
        odd = set(owners[spelled < 0].tolist())
        flat, paths, at = spelled.astype(np.int32).tobytes(), [], 0
        for k, stop_at in enumerate(ends):
            if k in odd:
                paths.append(array("i", self._written(spelled[at:stop_at].tolist())).tobytes())
            else:
                paths.append(flat[4 * at : 4 * stop_at])
            at = stop_at
        return paths

    def _written(self, path: list[int]) -> list[int]:
        out: list[int] = []
        for p in path:
            if p >= 0:
                out.append(p)
            elif self.model.bytes_first:
                out += [self.model.bytes_first[b] for b in chr(-p - 1).encode()]
            else:
                out.append(self.model.unknown)
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; an empty text has none."""
        return [np.frombuffer(x, np.int32).tolist() for x in self.encode_raw(texts)]

    def encode_raw(self, texts: list[str]) -> list[bytes]:
        """The same as 32-bit numbers."""
        split = [self._stretches(t) for t in texts]
        if len(self.memory) > MEMORY:  # what is still in use comes back from the older half
            self.older, self.memory = self.memory, {}
        memory, older, new = self.memory, self.older, []
        for s in set().union(*split) - memory.keys():
            if s in older:
                memory[s] = older[s]
            else:
                new.append(s)
        for begin, end in chunks([len(s) for s in new], AT_ONCE):
            memory.update(zip(new[begin:end], self._shortest(new[begin:end]), strict=True))
        raw = [b"".join(map(memory.__getitem__, s)) for s in split]
        return raw if self.model.bytes_first else [self._one_unknown(x) for x in raw]

    def _one_unknown(self, raw: bytes) -> bytes:
        """Unknown characters in a row are one id where there is no byte fallback."""
        ids = np.frombuffer(raw, np.int32)
        unknown = ids == self.model.unknown
        return ids[~(unknown & np.concatenate([[False], unknown[:-1]]))].tobytes() if len(ids) else raw

    def decoder(self) -> tuple[list[bytes], bool]:
        """Bytes of every id, and whether a text begins with a space of the normaliser."""
        of_byte = {i: bytes([b]) for b, i in self.model.bytes_first.items()}
        spelled = [
            b"" if self.model.kinds[i] in (3, 4) else of_byte.get(i, b" \xe2\x81\x87 " if i == self.model.unknown else p.replace(SPACE, " ").encode())
            for i, p in enumerate(self.model.pieces)
        ]
        return spelled, self.model.prefix

    def decode(self, ids: Iterable[list[int]]) -> list[str]:
        """Texts of ids, as far as the bytes are UTF-8; others become U+FFFD."""
        spelled, prefix = self.spelled
        raw = (b"".join(map(spelled.__getitem__, x)) for x in ids)
        return [(r[1:] if prefix and r[:1] == b" " else r).decode("utf-8", "replace") for r in raw]


def _coded(batches: Iterator[pa.RecordBatch], at: int, transducer: Transducer) -> Iterator[tuple[pa.RecordBatch, list, list[bytes]]]:
    """Rows of batches, a bounded number of characters at a time, with their ids."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(at)).fill_null(0).to_pylist()
        for begin, end in chunks(sizes):
            part = batch.slice(begin, end - begin)
            texts = part.column(at).to_pylist()
            yield part, texts, transducer.encode_raw([t or "" for t in texts])


def _ids_column(texts: list[str | None], raw: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0] + [len(x) // 4 for x in raw]).astype(np.int32)
    null = np.append(np.array([t is None for t in texts]), False)
    ends = pa.array(offsets, mask=null) if null.any() else pa.array(offsets)
    return pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(raw), np.int32)))


class PieceCoder:
    """Encodes and decodes a column of whole texts.

    A null text has null ids and an empty one none; null ids decode to null.
    Other columns stay as they are, rows may repeat, and an empty table
    stays empty. The model is compiled on the driver and sent to tasks.
    """

    def __init__(self, model_path: str, text_col="text"):
        self.path, self.text_col = model_path, text_col

    def _compiled(self, docs: DataFrame):
        small_batches(docs.sparkSession)
        model = docs.sparkSession.sparkContext.broadcast(PieceModel.of(self.path))
        path = self.path

        def get() -> Transducer:
            forget_in_worker(("pieces", path))
            return once_in_worker(("pieces", path), lambda: Transducer(model.value))

        return get

    def encode(self, docs: DataFrame, ids_col: str = "ids") -> DataFrame:
        """The table with an array column of ids; it replaces one of that name."""
        docs = docs.drop(ids_col)
        get, at = self._compiled(docs), docs.columns.index(self.text_col)
        schema = StructType([*docs.schema.fields, StructField(ids_col, ArrayType(IntegerType()))])

        def run(batches):
            for part, texts, raw in _coded(batches, at, get()):
                yield pa.RecordBatch.from_arrays([*part.columns, _ids_column(texts, raw)], names=[*part.schema.names, ids_col])

        return docs.mapInArrow(run, schema)

    def round_trip(self, docs: DataFrame, ids_col: str = "ids", same_col: str = "restored") -> DataFrame:
        """The table with ids and whether they decode to the text again (U+2581,
        which stands for a space, counts as one). Null texts are restored as null."""
        docs = docs.drop(ids_col, same_col)
        get, at = self._compiled(docs), docs.columns.index(self.text_col)
        schema = StructType([*docs.schema.fields, StructField(ids_col, ArrayType(IntegerType())), StructField(same_col, BooleanType())])

        def run(batches):
            transducer = get()
            for part, texts, raw in _coded(batches, at, transducer):
                back = transducer.decode(np.frombuffer(x, np.int32).tolist() for x in raw)
                same = [(t or "").replace(SPACE, " ") == b for t, b in zip(texts, back, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, _ids_column(texts, raw), pa.array(same)], names=[*part.schema.names, ids_col, same_col])

        return docs.mapInArrow(run, schema)

    def decode(self, encoded: DataFrame, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
        """The table with a column of the texts that the ids spell."""
        encoded = encoded.drop(out_col)
        get, at = self._compiled(encoded), encoded.columns.index(ids_col)
        schema = StructType([*encoded.schema.fields, StructField(out_col, StringType())])

        def run(batches):
            transducer = get()
            for batch in batches:
                ids = batch.column(at)
                # one row of Python numbers at a time
                texts = transducer.decode(ids[k].values.to_numpy().tolist() if ids[k].is_valid else [] for k in range(len(ids)))
                valid = ids.is_valid().to_pylist()
                column = pa.array([t if v else None for t, v in zip(texts, valid, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out_col])

        return encoded.mapInArrow(run, schema)
