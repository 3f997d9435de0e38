"""Hard negatives by exact integer scores, added up from tables of subset sums.

Components are scaled to integers, and a vector is kept as bit planes: for each bit
of the integers and each group of eight dimensions one byte, whose bits say in which
of the eight the bit is set. For an anchor and a group there are 256 possible sums
of its components, one for each such byte; they are computed once. The inner product
with a candidate is then a sum of table entries, one for each of its bytes: the
planes are gone through from the sign on, and the total is doubled from plane to plane.

Candidates are compared with all anchors: anchors in chunks, candidates in slices, a
task for each pair of them. Two passes are made: the first finds the best
positives of an anchor, the second the negatives within the bounds that they set.
Only the best of a slice leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protosift.llm.scratch import Scratch

GROUP = 8
# Anchors whose tables are open at a time, and candidates scored at a time.
ANCHORS, CANDIDATES = 128, 1024
SLICE, CHUNK = 1 << 20, 4096
LEAST_SLICE = 1024
MOST_TASKS = 20_000


def pack(values: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes of rows of integers: an array of rows by planes by groups, the
    plane of the sign first."""
    rows, width = values.shape
    groups = -(-width // GROUP)
    padded = np.zeros((rows, groups * GROUP), "int64")
    padded[:, :width] = values
    bits = (padded[:, None, :] >> np.arange(planes - 1, -1, -1)[None, :, None]) & 1
    return np.packbits(bits.astype("uint8"), axis=2, bitorder="little")


def unpack(packed: np.ndarray) -> np.ndarray:
    """The integers of bit planes, padded to whole groups."""
    bits = np.unpackbits(packed, axis=2, bitorder="little").astype("int64")
    weights = 1 << np.arange(packed.shape[1] - 1, -1, -1, dtype="int64")
    weights[0] = -weights[0]
    return np.einsum("rpd,p->rd", bits, weights)


def subset_sums(anchors: np.ndarray, dtype) -> np.ndarray:
    """Sums of every subset of every group of eight components: groups by 256 by anchors."""
    rows, width = anchors.shape
    groups = anchors.reshape(rows, width // GROUP, GROUP)
    tables = np.zeros((width // GROUP, 1 << GROUP, rows), dtype)
    for i in range(GROUP):
        size = 1 << i
        tables[:, size : 2 * size] = tables[:, :size] + groups[:, :, i].T[:, None, :]
    return tables


def scores(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Inner products of packed candidates (down) with the anchors of the tables (across)."""
    total = np.zeros((len(packed), tables.shape[2]), tables.dtype)
    part = np.empty_like(total)
    for plane in range(packed.shape[1]):
        if plane:
            total += total
        for group, table in enumerate(tables):
            np.take(table, packed[:, plane, group], axis=0, out=part, mode="clip")
            if plane:
                total += part
            else:
                total -= part
    return total


class _Best:
    """The ``count`` highest scores of a key so far, ties by the smaller id."""

    def __init__(self, count: int, least: int, most: int):
        self.count, self.least, self.most = count, least, most
        self.score, self.id = np.empty(0, "int64"), np.empty(0, "int64")

    def see(self, score: np.ndarray, id: np.ndarray) -> None:
        near = np.flatnonzero((score >= self.least) & (score <= self.most))
        if not len(near):
            return
        score, id = np.append(self.score, score[near]), np.append(self.id, id[near])
        if len(score) > 8 * self.count:
            last = np.partition(score, len(score) - self.count)[len(score) - self.count]
            score, id = score[score >= last], id[score >= last]
        order = np.lexsort((id, -score))[: self.count]
        self.score, self.id = score[order], id[order]
        if len(order) == self.count:
            self.least = max(self.least, int(self.score[-1]))


class HardNegatives:
    """Negatives that score high, but clearly below an anchor's positives.

    A component x counts as ``floor(scale * x)``. The first ``positives`` other rows
    with an anchor's label, by score and then by id, are its positives. For each of
    them the first ``negatives`` rows of other labels are returned whose score lies
    between the fractions ``least`` and ``most`` of the positive's, bounds included.

    Rows with a null id, label or vector, or a null or non-finite component take no
    part. A vector that is shorter than others counts as filled up with zeros. Ids may
    repeat: every row is a row of its own, and an anchor is only not its own positive.
    Other columns are not read; an empty table gives an empty result. Components have
    to be so small that scores fit 63 bits; otherwise an error says so.
    """

    def __init__(
        self,
        *,
        scale: int = 256,
        positives: int = 5,
        negatives: int = 10,
        least: tuple[int, int] = (30, 100),
        most: tuple[int, int] = (90, 100),
        slice_rows: int = SLICE,
        chunk_rows: int = CHUNK,
    ):
        if min(positives, negatives, slice_rows, chunk_rows, least[1], most[1]) < 1:
            raise ValueError("numbers of rows and denominators have to be at least 1")
        self.scale, self.positives, self.negatives = scale, positives, negatives
        self.least, self.most = least, most
        self.slice_rows, self.chunk_rows = slice_rows, chunk_rows

    def mine(
        self, rows: DataFrame, anchors: Column, id: str = "id", vector: str = "embedding", label: str = "label"
    ) -> DataFrame:
        """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

        ``anchors`` is a condition on ``rows`` that chooses the anchors.
        """
        scratch = Scratch(rows.sparkSession, "hard-negatives")
        whole = self._whole(rows, anchors, id, vector, label)
        # One row of four numbers.
        count, chosen, width, greatest = whole.agg(
            F.count(F.lit(1)), F.count_if("_anchor"), F.max(F.size("_v")),
            F.max(F.aggregate("_v", F.lit(0.0), lambda most, x: F.greatest(most, F.abs(x.cast("double"))))),
        ).first()
        width, greatest = max(1, width or 0), greatest or 0.0
        if width * max(1.0, greatest) ** 2 * 2 >= 2.0**63:
            raise ValueError(f"components of up to {greatest:.4g} over {width} dimensions do not fit scores of 63 bits")
        planes = int(greatest).bit_length() + 1
        packed = scratch.keep(self._packed(whole, width, planes), "packed")
        grid = _Grid(rows.sparkSession, count, chosen, self.slice_rows, self.chunk_rows)
        shape = (planes, -(-width // GROUP), np.int32 if width * max(1.0, greatest) ** 2 * 2 < 2.0**31 else np.int64)

        found = grid.run(packed, None, self._nearest(shape), "_anchor long, _id long, _score long, anchor_id long")
        first = Window.partitionBy("_anchor").orderBy(F.col("_score").desc(), "_id")
        best = found.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= self.positives)
        # At most ``positives`` entries for an anchor.
        wanted = scratch.keep(
            best.groupBy("_anchor").agg(
                F.array_sort(F.collect_list(F.struct("_nth", "_score", "_id"))).alias("_positives")
            ),
            "positives",
        )
        schema = "_anchor long, anchor_id long, positive_id long, _nth int, positive_score long, negative_id long, negative_score long"
        found = grid.run(packed, wanted, self._between(shape), schema)
        # A slice returns at most ``negatives`` rows for an anchor and positive.
        first = Window.partitionBy("_anchor", "_nth").orderBy(F.col("negative_score").desc(), "negative_id")
        return (
            found.withColumn("rank", F.row_number().over(first))
            .where(F.col("rank") <= self.negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        )

    def _whole(self, rows, anchors, id, vector, label) -> DataFrame:
        finite = F.forall(
            vector,
            lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
        )
        # The row's key is fixed when the packed table is written.
        return rows.where(
            F.col(id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite
        ).select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(id).cast("long").alias("_id"),
            F.col(label).cast("string").alias("_label"),
            F.coalesce(anchors, F.lit(False)).alias("_anchor"),
            F.transform(vector, lambda x: F.floor(x.cast("double") * self.scale)).alias("_v"),
        )

    def _packed(self, whole: DataFrame, width: int, planes: int) -> DataFrame:
        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("_v")
                ends = np.diff(lists.offsets.to_numpy())
                values = np.zeros((len(batch), width), "int64")
                row = np.repeat(np.arange(len(batch)), ends)
                at = np.arange(len(row)) - np.repeat(np.cumsum(ends) - ends, ends)
                values[row, at] = lists.flatten().to_numpy(zero_copy_only=False).astype("int64")
                bits = [x.tobytes() for x in pack(values, planes)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("_row", "_id", "_label", "_anchor")), pa.array(bits, pa.binary())],
                    ["_row", "_id", "_label", "_anchor", "_bits"],
                )

        return whole.mapInArrow(packed, "_row long, _id long, _label string, _anchor boolean, _bits binary")

    def _nearest(self, shape):
        """Of a slice, the best rows with the label of each anchor."""

        def reduce(anchors: pa.Table, slices: Iterator[pa.Table]) -> Iterator[dict]:
            own = anchors["_row"].to_numpy()
            best = [_Best(self.positives, -(2**62), 2**62) for _ in own]
            for alike, candidates, first, block in _scored(anchors, slices, shape):
                ids, rows = candidates["_id"].to_numpy(), candidates["_row"].to_numpy()
                for i, score in enumerate(block):
                    near = np.flatnonzero(alike[i] & (score >= best[first + i].least))
                    near = near[rows[near] != own[first + i]]
                    best[first + i].see(score[near], ids[near])
            for i, found in enumerate(best):
                yield {"_anchor": np.full(len(found.id), own[i]), "_id": found.id, "_score": found.score,
                       "anchor_id": np.full(len(found.id), anchors["_id"][i].as_py())}

        return reduce

    def _between(self, shape):
        """Of a slice, the best rows of other labels within the bounds of each positive."""
        (a, b), (c, d) = self.least, self.most

        def reduce(anchors: pa.Table, slices: Iterator[pa.Table]) -> Iterator[dict]:
            positives = anchors["_positives"].to_pylist()
            # a/b of a score, rounded up, to c/d of it, rounded down.
            best = [
                [_Best(self.negatives, -(-a * p["_score"] // b), c * p["_score"] // d) for p in each or []]
                for each in positives
            ]
            for alike, candidates, first, block in _scored(anchors, slices, shape):
                ids = candidates["_id"].to_numpy()
                for i, score in enumerate(block):
                    wanted = best[first + i]
                    if not wanted:
                        continue
                    lowest, highest = min(x.least for x in wanted), max(x.most for x in wanted)
                    near = np.flatnonzero((score >= lowest) & (score <= highest) & ~alike[i])
                    if len(near):
                        near_scores, near_ids = score[near], ids[near]
                        for x in wanted:
                            x.see(near_scores, near_ids)
            for i, wanted in enumerate(best):
                for p, found in zip(positives[i] or [], wanted):
                    n = len(found.id)
                    yield {
                        "_anchor": np.full(n, anchors["_row"][i].as_py()), "anchor_id": np.full(n, anchors["_id"][i].as_py()),
                        "positive_id": np.full(n, p["_id"]), "_nth": np.full(n, p["_nth"], "int32"),
                        "positive_score": np.full(n, p["_score"]), "negative_id": found.id, "negative_score": found.score,
                    }

        return reduce


def _scored(anchors: pa.Table, slices: Iterator[pa.Table], shape):
    """For anchors and candidates, a block at a time: which have equal labels, the
    candidates, the block's first anchor, and scores, one row for each anchor."""
    planes, groups, dtype = shape

    def bits(table: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(table["_bits"].to_pylist()), "uint8").reshape(-1, planes, groups)

    values = unpack(bits(anchors))
    labels = {}
    named = np.array([labels.setdefault(x, len(labels)) for x in anchors["_label"].to_pylist()], "int64")
    starts = range(0, len(values), ANCHORS)
    # Tables of all anchors of a chunk: 2 KB an anchor and group at most.
    tables = [subset_sums(values[s : s + ANCHORS], dtype) for s in starts]
    for batch in slices:
        packed = bits(batch)
        label = np.array([labels.get(x, -1) for x in batch["_label"].to_pylist()], "int64")
        for at in range(0, len(packed), CANDIDATES):
            some = slice(at, at + CANDIDATES)
            rows = batch.slice(at, CANDIDATES)
            for first, table in zip(starts, tables):
                mine = named[first : first + ANCHORS]
                yield mine[:, None] == label[None, some], rows, first, np.ascontiguousarray(scores(table, packed[some]).T).astype("int64")


class _Grid:
    """Chunks of anchors by slices of candidates."""

    def __init__(self, spark, count: int, anchors: int, slice_rows: int, chunk_rows: int):
        parallelism = spark.sparkContext.defaultParallelism
        self.chunks = max(1, -(-anchors // chunk_rows))
        least = -(-2 * parallelism // self.chunks)
        self.slices = max(1, -(-count // slice_rows), min(least, -(-count // LEAST_SLICE)))

    def run(self, packed: DataFrame, positives: DataFrame | None, reduce, schema: str) -> DataFrame:
        """Every chunk meets every slice in a task; ``reduce`` gets both."""
        chunks, slices = self.chunks, self.slices

        def number(n: int):
            return F.lit(n).cast("long")

        place = F.xxhash64("_row")
        kind = "array<struct<_nth:int,_score:long,_id:long>>"
        anchors = packed.where("_anchor")
        if positives is None:
            anchors = anchors.withColumn("_positives", F.lit(None).cast(kind))
        else:
            anchors = anchors.join(positives.withColumnRenamed("_anchor", "_row"), "_row")
        chunk = F.pmod(place, number(chunks)) * number(slices)
        to_slices = F.sequence(chunk, chunk + number(slices - 1))
        part = F.pmod(place, number(slices))
        to_chunks = F.sequence(part, part + number((chunks - 1) * slices), number(slices))
        columns = ["_row", "_id", "_label", "_bits", "_positives"]
        sent = anchors.select(*columns, F.explode(to_slices).alias("_task"), F.lit(0).alias("_kind")).unionByName(
            packed.withColumn("_positives", F.lit(None).cast(kind))
            .select(*columns, F.explode(to_chunks).alias("_task"), F.lit(1).alias("_kind"))
        )
        partitions = max(1, min(chunks * slices, MOST_TASKS))
        placed = sent.repartitionById(partitions, F.pmod(F.col("_task"), F.lit(partitions)).cast("int"))
        names = [part.split()[0] for part in schema.split(", ")]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for anchors, candidates in _tasks(batches):
                found = [x for x in reduce(anchors, candidates) if len(x[names[0]])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in found])) for c in names], names)

        return placed.sortWithinPartitions("_task", "_kind").mapInArrow(work, schema)


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Iterator[pa.Table]]]:
    """Anchors of each task, as a table, and its candidates, batch by batch."""

    def pieces():
        for batch in batches:
            mark = batch.column("_task").to_numpy() * 2 + batch.column("_kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(batch)]
            for start, stop in zip(cuts, cuts[1:]):
                if stop > start:
                    yield int(mark[start]), pa.Table.from_batches([batch.slice(start, stop - start)])

    stream = pieces()
    ahead = next(stream, None)
    while ahead:
        task, held = ahead[0] // 2, []
        while ahead and ahead[0] == 2 * task:
            held.append(ahead[1])
            ahead = next(stream, None)

        def candidates():
            nonlocal ahead
            while ahead and ahead[0] == 2 * task + 1:
                yield ahead[1]
                ahead = next(stream, None)

        rest = candidates()
        if held:
            yield pa.concat_tables(held), rest
        for _ in rest:
            pass
