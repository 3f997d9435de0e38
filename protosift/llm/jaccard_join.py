"""Similarity join on n-gram sets: Jaccard by partitioned universes, exact.

Two sets with a Jaccard of at least t = num/den differ in at most
``H = (den - num) * (|a| + |b|) / (den + num)`` tokens. The hashed universe is
cut into m segments, so a similar pair splits its few differences over them: if
segment i is given ``u_i`` units with ``sum(u_i) > H``, some segment has fewer
than ``u_i`` differences. One unit looks for equal segments; two units look for
segments that differ in at most one token, by hashes of the segment and of all
its one-deletion neighbours; a segment without units is not looked at.

Sizes fall into bands whose limits grow by 1/t, so a set only meets sets of its
own band and of the band below. A set is indexed in all segments of its own
band. It searches (as the larger of a pair) only as many segments as its
own size calls for: units go to the segments with the most tokens first, whose
equality by chance is the rarest, and the cheapest choice is left out.
How many segments of a band are searched with two units follows from its sizes:
as few as leave ``SEGMENT_TOKENS`` tokens to a segment.

Candidates are verified on whole sets of 64-bit token hashes, after a bound from
parity sketches: bit i of a sketch tells whether an odd number of tokens falls
into cell i, so two sketches differ in no more bits than their sets in tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protosift.llm.components import components
from protosift.llm.scratch import Scratch, forget_in_worker, groups, small_batches
from protosift.llm.words import ascii_lower, chunks, mix, shingles_of, spaced, words_of

#: Tokens that a segment should have at least, on average.
SEGMENT_TOKENS = 3

#: Documents, and tokens, of a part of a cluster on average at most.
PART_ROWS, PART_TOKENS = 1024, 1 << 20

_U = np.uint64


class Bands:
    """Limits of sizes, segments and two-unit segments of every band."""

    def __init__(self, threshold: Fraction, largest: int):
        self.t = threshold
        self.lower = [1]
        while self.lower[-1] <= largest:
            self.lower.append(floor(self.lower[-1] / threshold) + 1)
        top = np.array(self.lower[1:] + [floor(self.lower[-1] / threshold) + 1]) - 1
        pairs = np.array([self.differences(int(n), floor(n / threshold)) for n in top])
        wide = np.maximum(0, pairs + 1 - np.maximum(1, np.array(self.lower) // SEGMENT_TOKENS))
        self.doubled = np.minimum(wide, (pairs + 1) // 2)
        self.segments = pairs + 1 - self.doubled
        self.top = top

    def differences(self, a: int, b: int) -> int:
        t = self.t
        return floor((t.denominator - t.numerator) * Fraction(a + b) / (t.denominator + t.numerator))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.lower), sizes, "right") - 1


def token_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [ascii_lower(t or "") for t in texts]
    hashes, owner = shingles_of(words_of(raw, spaced()), width)
    ends = np.searchsorted(owner, np.arange(len(raw) + 1))
    return [np.unique(hashes[ends[i] : ends[i + 1]]) for i in range(len(raw))]


def _signatures(sets: list[np.ndarray], ids: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets, the ids of the sets, and whether they search by them or
    are indexed only."""
    sizes = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    spread, mixed = mix(tokens ^ _U(0xA5A5A5A5)), mix(tokens)
    bands = Bands(threshold, int(sizes.max()))
    own = bands.of(sizes)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for below in (0, 1):
        band = own - below
        reach = np.array([-(-threshold.numerator * int(n) // threshold.denominator) for n in sizes])
        here = (band >= 0) & (reach <= bands.top[band])
        if not here.any():
            continue
        partner = np.minimum(sizes, bands.top[band])
        needed = ((threshold.denominator - threshold.numerator) * (sizes + partner)) // (
            threshold.denominator + threshold.numerator
        ) + 1
        m = np.where(here, bands.segments[band], 0)
        base = np.concatenate([[0], np.cumsum(m)])
        live = here[owner]
        slot = (spread[live] % m[owner[live]].astype(_U)).astype(np.int64) + base[:-1][owner[live]]
        sums = np.zeros(base[-1], _U)
        np.add.at(sums, slot, mixed[live])
        counts = np.bincount(slot, minlength=base[-1])
        of = np.repeat(np.arange(len(sets)), m)
        place = np.arange(base[-1]) - base[:-1][of]
        seed = mix((band[of] * 1_000_003 + place).astype(_U))
        two = place < bands.doubled[band[of]]
        # units: two to segments that may have them, one to others, most tokens first
        order = np.lexsort((-counts, of))
        units = np.where(two[order], 2, 1)
        run = np.cumsum(units) - units
        used = np.zeros(base[-1], bool)
        used[order] = run - run[np.minimum(base[:-1], len(run) - 1)][of[order]] < needed[of[order]]
        keep = used | (below == 0)  # all of the own band are indexed
        parts.append((mix(sums ^ seed)[keep], of[keep], used[keep]))
        if two.any():  # one-deletion neighbours of the segments with two units
            where = np.flatnonzero((two & keep)[slot])
            at = slot[where]
            parts.append((mix((sums[at] - mixed[live][where]) ^ seed[at]), of[at], used[at]))
    sig, of, used = (np.concatenate(x) for x in zip(*parts, strict=True))
    return sig.view(np.int64), ids[of], used


def _sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens in two to four times as many cells, a power of two."""
    words = 1
    while words * 32 < len(tokens):
        words *= 2
    cell = mix(tokens ^ _U(0x5BD1E995)) % _U(words * 64)
    out = np.zeros(words, _U)
    np.bitwise_xor.at(out, (cell >> _U(6)).astype(np.int64), _U(1) << (cell & _U(63)))
    return out.tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of the fewest cells that one of them has."""
    least = min(map(len, sketches)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, _U).reshape(-1, least), axis=0) for x in sketches])


def one_of_alike(shared: DataFrame) -> DataFrame:
    """(sig, c) of signatures that several documents have, and of how many; of those
    that the same documents have, the smallest, as the others lead to the same pairs."""
    members = [F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")]
    found = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("c"), *members).where("c > 1")
    return found.groupBy("c", "x", "y").agg(F.min("sig").alias("sig")).select("sig", "c")


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        for begin, end in chunks([len(t or "") for t in texts]):
            yield ids[begin:end], token_sets(texts[begin:end], width)


class JaccardJoin:
    """Links documents whose n-gram sets have a Jaccard of ``threshold`` or more.

    Words are runs of other characters than ASCII white space, A-Z lower-cased;
    a token is a run of ``width`` words, or the whole sequence of a shorter
    text. Null and wordless texts have the empty set and no links. Rows whose
    ids agree count as one document each time they occur; ids are unique and
    not null, but for ``row_classes``. Columns other than ``id_col`` and ``text_col`` are not read. An
    empty table gives empty results.
    """

    def __init__(self, threshold: Fraction = Fraction(4, 5), width: int = 5, id_col: str = "doc_id", text_col: str = "text"):
        if not 0 < threshold <= 1:
            raise ValueError("threshold lies above 0 and up to 1")
        self.threshold, self.width, self.id_col, self.text_col = Fraction(threshold), width, id_col, text_col

    def _read(self, docs: DataFrame) -> DataFrame:
        small_batches(docs.sparkSession)
        return docs.select(F.col(self.id_col).cast("long").alias("id"), F.col(self.text_col).cast("string").alias("text"))

    def sizes(self, docs: DataFrame) -> DataFrame:
        """(id, n, print, sketch): set size, a 128-bit digest that stands for the set, parities."""
        width = self.width

        def run(batches):
            forget_in_worker()
            from hashlib import blake2b

            for ids, sets in _batches(batches, width):
                prints = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(map(_sketch, sets), pa.binary())],
                    names=["id", "n", "print", "sketch"],
                )

        return self._read(docs).mapInArrow(run, "id long, n long, print binary, sketch binary")

    def buckets(self, docs: DataFrame) -> DataFrame:
        """(sig, id) of signatures that several documents have, and that at least
        one of them searches by. Any two sets that are alike share one.

        Rows of a signature stream past, those that search first, so one of
        very many documents needs no memory. By what nobody searches, such as a
        segment that happens to be empty, nobody is met. A signature is shuffled as
        47 bits and one that tells whether it is indexed only: documents that meet by
        chance are told apart when they are verified.
        """
        width, threshold = self.width, self.threshold

        def local(batches):
            forget_in_worker()
            for ids, sets in _batches(batches, width):
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    sig, own, used = _signatures([sets[i] for i in full], ids[full], threshold)
                    key = ((sig.view(_U) >> _U(17)) << _U(1)) | (~used).astype(_U)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own)], names=["key", "id"])

        def across(batches):
            forget_in_worker()
            last, waiting = None, None  # a signature that is searched by, and its row if there was but one
            for batch in batches:
                keys, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
                if not len(keys):
                    continue
                sig, indexed = keys >> 1, keys & 1
                first = np.concatenate([[True], sig[1:] != sig[:-1]])
                group = np.cumsum(first) - 1
                searched, size = ~indexed.astype(bool)[first], np.bincount(group)
                if sig[0] == last:
                    searched[0] = True
                keep = searched[group] & ((size[group] > 1) | (sig == last))
                out_sig, out_ids = sig[keep], ids[keep]
                if sig[0] == last and waiting is not None:
                    out_sig, out_ids = np.append(out_sig, last), np.append(out_ids, waiting)
                alone = size[-1] == 1 and sig[-1] != last
                last, waiting = (sig[-1], ids[-1] if alone else None) if searched[-1] else (None, None)
                yield pa.RecordBatch.from_arrays([pa.array(out_sig), pa.array(out_ids)], names=["sig", "id"])

        rows = self._read(docs).mapInArrow(local, "key long, id long")
        return rows.repartition(F.shiftright("key", 1)).sortWithinPartitions("key").mapInArrow(across, "sig long, id long")

    def _near(self, tiles: DataFrame) -> DataFrame:
        """Links (a, b) that span those rows of a tile whose sketches allow them to be alike."""
        t = self.threshold
        spread, total = t.denominator - t.numerator, t.denominator + t.numerator

        def run(batches):
            forget_in_worker()
            for rows in groups(batches, ("sig", "i", "j")):
                if rows.num_rows < 2:
                    continue
                ids, n, part = (rows.column(c).to_numpy() for c in ("id", "n", "part"))
                same = rows.column("i")[0] == rows.column("j")[0]
                sketch, root = _folded(rows.column("sketch").to_pylist()), np.arange(len(n))
                a, b = [], []
                for x in range(1, len(n)):
                    near = np.flatnonzero(((part[:x] != part[x]) | same) & (root[:x] != root[x]))
                    near = near[np.minimum(n[near], n[x]) * t.denominator >= np.maximum(n[near], n[x]) * t.numerator]
                    apart = np.bitwise_count(sketch[near] ^ sketch[x]).sum(axis=1, dtype=np.int64)
                    for y in near[apart * total <= (n[near] + n[x]) * spread]:
                        if root[y] != root[x]:
                            a.append(ids[x])
                            b.append(ids[y])
                            low, high = sorted((root[x], root[y]))
                            root[root == high] = low
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        keys = ["sig", "i", "j"]
        return tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")

    def _sets(self, docs: DataFrame, ids: DataFrame) -> DataFrame:
        width = self.width

        def run(batches):
            forget_in_worker()
            for keys, sets in _batches(batches, width):
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "tokens"]
                )

        return self._read(docs).join(ids, "id", "left_semi").mapInArrow(run, "id long, tokens array<long>")

    def _verified(self, tiles: DataFrame) -> DataFrame:
        """Links (a, b) that span those between documents of a tile.

        A tile compares the rows of two parts of a cluster (or of one part with
        itself). Parity sketches bound the differences of a pair from below; the
        pairs that they leave are compared by whole sets, nearest first, unless
        links have joined the two already.
        """
        t = self.threshold
        spread, total = t.denominator - t.numerator, t.denominator + t.numerator

        def links_of(rows: pa.Table) -> tuple[list[int], list[int]]:
            ids, part = rows.column("id").to_numpy(), rows.column("part").to_numpy()
            same = rows.column("i")[0] == rows.column("j")[0]
            column = rows.column("tokens").combine_chunks()
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            n = np.diff(offsets)
            values = values[offsets[0] :].view(np.uint64)
            starts = offsets[:-1] - offsets[0]
            words = max(1, int(n.max()) * 2 // 64)
            cell = (mix(values ^ _U(0x5BD1E995)) % _U(words * 64)).astype(np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            sketch = np.zeros((len(n), words), _U)
            np.bitwise_xor.at(sketch, (owner, cell // 64), _U(1) << (cell % 64).astype(_U))
            root = np.arange(len(n))
            a, b = [], []
            for x in range(1, len(n)):
                near = np.flatnonzero((part[:x] != part[x]) | same)
                near = near[root[near] != root[x]]
                near = near[np.minimum(n[near], n[x]) * t.denominator >= np.maximum(n[near], n[x]) * t.numerator]
                apart = np.bitwise_count(sketch[near] ^ sketch[x]).sum(axis=1, dtype=np.int64)
                fits = apart * total <= (n[near] + n[x]) * spread
                for y in near[fits][np.argsort(apart[fits], kind="stable")]:
                    if root[y] == root[x]:
                        continue
                    shared = len(np.intersect1d(*(values[starts[k] : starts[k] + n[k]] for k in (x, y)), assume_unique=True))
                    if shared * total >= t.numerator * int(n[x] + n[y]):
                        a.append(ids[x])
                        b.append(ids[y])
                        low, high = sorted((root[x], root[y]))
                        root[root == high] = low
            return a, b

        def run(batches):
            forget_in_worker()
            for rows in groups(batches, ("cluster", "i", "j")):
                a, b = links_of(rows)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        keys = ["cluster", "i", "j"]
        return tiles.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(run, "a long, b long")

    def classes(self, docs: DataFrame) -> DataFrame:
        """(id, n_shingles, component_id) of every document: its set's size and
        the smallest id that links reach, itself included.

        Equal sets are one class with one representative. Documents that share a
        signature, and whose sketches allow them to be alike, belong to a cluster of
        candidates. Clusters are cut into parts of bounded size and verified two
        parts at a time, so no pairs are ever shuffled.
        """
        scratch = Scratch(docs.sparkSession, "jaccard")
        sizes = scratch.keep(self.sizes(docs), "sizes")
        firsts = sizes.where("n > 0").groupBy("print").agg(F.min("id").alias("rep"))
        members = scratch.keep(
            sizes.join(firsts, "print", "left").select("id", "n", F.coalesce("rep", "id").alias("rep")), "members"
        )
        shared = scratch.keep(
            self.buckets(docs).join(members, "id").select("sig", F.col("rep").alias("id"), "n").distinct(), "buckets"
        )
        cuts = one_of_alike(shared).select("sig", F.ceil(F.col("c") / PART_ROWS).cast("int").alias("parts"))
        near = (
            shared.join(cuts, "sig")
            .join(sizes.select("id", "sketch"), "id")
            .withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("sig", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "n", "sketch")
        )
        clusters = scratch.keep(components(self._near(near), scratch).withColumnRenamed("component_id", "cluster"), "clusters")
        scratch.drop(shared, sizes)
        parts = (
            clusters.join(members.select("id", "n"), "id")
            .groupBy("cluster")
            .agg(F.ceil(F.greatest(F.count(F.lit(1)) / PART_ROWS, F.sum("n") / PART_TOKENS)).cast("int").alias("parts"))
        )
        tiles = (
            self._sets(docs, clusters.select("id"))
            .join(clusters, "id")
            .join(parts, "cluster")
            .withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("cluster", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "tokens")
        )
        links = scratch.keep(self._verified(tiles), "links")
        joined = components(links, scratch).withColumnRenamed("id", "rep")
        return members.join(joined, "rep", "left").select(
            "id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep").alias("component_id")
        )

    def row_classes(self, rows: DataFrame, row_col: str) -> DataFrame:
        """(row_col, id, n_shingles, component_id, first) of every row of a stored
        table whose ``row_col`` is unique and not null, while ids may be null or
        repeat. ``component_id`` is the smallest id of a component (null if all
        are), and ``first`` marks its row of the smallest id and key, nulls last."""
        own = JaccardJoin(self.threshold, self.width, row_col, self.text_col).classes(rows)
        ids = rows.select(F.col(row_col).alias("id"), F.col(self.id_col).cast("long").alias("own_id"))
        own = own.join(ids, "id")
        least = F.min(F.struct(F.col("own_id").isNull().alias("none"), "own_id", "id")).alias("least")
        firsts = own.groupBy("component_id").agg(least)
        return own.join(firsts, "component_id").select(
            F.col("id").alias(row_col),
            F.col("own_id").alias("id"),
            "n_shingles",
            F.col("least.own_id").alias("component_id"),
            (F.col("id") == F.col("least.id")).alias("first"),
        )
