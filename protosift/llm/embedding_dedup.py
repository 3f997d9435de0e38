"""Near duplicates among embeddings: sorted projection passes.

A pass orders the vectors of a group by a key of concatenated random hashes, one
sign bit per random hyperplane, and compares every vector with its neighbours in
a window of that order. Similar vectors share long prefixes of most keys, so they
stand close to each other in some pass. How often a pair at the threshold meets
depends on how the vectors of its group lie, as hyperplanes hardly divide a
narrow cone. So vectors planted at the threshold are placed as well, and passes
go on until a share ``recall`` of them has met.

A group that fits into a block of memory is shipped once, and its passes are
made where it lies. A larger group is shipped several times, each time in the
order of another key; blocks of that order, half of each shared with the next,
are then taken through passes of their own. The first shipments measure, by
planted vectors again, how many are needed. A group that needs more of them than
it has blocks is compared exactly, block by block, which ships less.

Pairs are verified by cosine in double precision inside the tasks; of a block
only a spanning set of its links leaves a task. Once these have been united into
components, links are counted exactly within each component, tile by tile, so
that dense groups wider than a window lose none.
"""

from __future__ import annotations

from math import acos, ceil, inf, lgamma, log, log2, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protosift.llm.components import components
from protosift.llm.scratch import Scratch, groups

KEY_BITS = 62
TILE_ROWS = 1024
SEED = 7919
#: Shipments that measure a group of several blocks.
PILOT_PASSES = 4
#: Rows and numbers of a block at most.
PART_ROWS = 1 << 14
PART_VALUES = 1 << 20
#: Vectors of a block that have another planted at the threshold, at least.
PROBES = 512
PROBE_EVERY = 16
#: Passes by one width of window before it is doubled.
PASSES_BY_WIDTH = 16
#: Rows that are multiplied with their neighbours at once.
STEP_ROWS = 256


def passes_needed(largest: int, window: int, threshold: float, recall: float) -> int:
    """Passes by which a pair at the threshold shares a window with probability
    ``recall``: it has to agree in the bits that cut ``largest`` to a window."""
    agree = 1 - acos(min(1.0, threshold)) / pi
    meets = min(agree ** max(0.0, log2(max(1, largest) / window)), 0.999)
    return max(1, ceil(log(1 - recall) / log(1 - meets)))


def passes_measured(probes: int, tries: int, met: int, pairs: int, met_twice: int, recall: float) -> float:
    """Passes by which a share ``recall`` of planted pairs has met.

    The chance to meet in a pass differs between vectors. Its distribution is
    taken as a beta of the mean, lowered by two standard errors, and the variance
    that ``met`` of ``tries``, and ``met_twice`` of ``pairs`` of tries of the same
    vector, tell.
    """
    mean = met / tries if tries else 0.0
    low = mean - 2 * sqrt(mean * (1 - mean) / probes) if probes else 0.0
    if low <= 0:
        return inf
    low = min(low, 0.999)
    spread = met_twice / pairs - mean * mean if pairs else 0.0
    if spread <= 1e-6:
        return max(1, ceil(log(1 - recall) / log(1 - low)))
    weight = max(low * (1 - low) / spread - 1, 1e-3)
    alpha, beta = low * weight, (1 - low) * weight

    def missed(n: int) -> float:
        return lgamma(beta + n) + lgamma(weight) - lgamma(beta) - lgamma(weight + n)

    end = 1
    while missed(end) > log(1 - recall):
        end *= 2
        if end > 1 << 20:
            return inf
    begin = end // 2
    while begin + 1 < end:
        middle = (begin + end) // 2
        begin, end = (middle, end) if missed(middle) > log(1 - recall) else (begin, middle)
    return end


def _units(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    full = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    full = full / np.abs(full).max(axis=1, keepdims=True)
    return full / np.linalg.norm(full, axis=1, keepdims=True)


def _planes(dim: int, number: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, number]).standard_normal((dim, KEY_BITS))


def _keys(units: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Concatenated sign bits, the first one highest."""
    return (units @ planes > 0) @ (1 << np.arange(KEY_BITS, dtype=np.int64)[::-1])


def _planted(units: np.ndarray, at: np.ndarray, threshold: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors at the threshold from rows ``at``, and which of them lie towards
    another row (every other one; the rest lie in a random direction)."""
    away = rng.standard_normal((len(at), units.shape[1]))
    other = rng.integers(0, max(1, len(units)), len(at))
    toward = (np.arange(len(at)) % 2 == 1) & (other != at)
    away[toward] = units[other[toward]] - units[at[toward]]
    away -= (away * units[at]).sum(axis=1, keepdims=True) * units[at]
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
    return toward, threshold * units[at] + sqrt(max(0.0, 1 - threshold**2)) * away


def _united(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest index that links (a, b), and those that ``root`` stands for, reach from each of n rows."""
    root = np.arange(n) if root is None else root
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = np.minimum(after, after[after])
        if (after == root).all():
            return root
        root = after


def _window_links(units: np.ndarray, order: np.ndarray, width: int, threshold: float, root: np.ndarray) -> np.ndarray:
    """Roots after the links between rows at most ``width`` apart in ``order``."""
    ordered, step = units[order], min(width, STEP_ROWS)
    for begin in range(0, len(order), step):
        x, y = np.nonzero(ordered[begin : begin + step] @ ordered[begin : begin + step + width].T >= threshold)
        near = (y > x) & (y - x <= width)
        a, b = order[begin + x[near]], order[begin + y[near]]
        apart = root[a] != root[b]
        if apart.any():
            root = _united(len(order), a[apart], b[apart], root)
    return root


def block_links(units: np.ndarray, window: int, threshold: float, recall: float) -> tuple[np.ndarray, list[int]]:
    """Of each vector of a block, the smallest row its links reach, and the width of
    each pass: passes end when a share ``recall`` of planted vectors has met."""
    n, dim = units.shape
    root, widths = np.arange(n), []
    rng = np.random.default_rng([SEED, n, dim])
    at = rng.permutation(n)[: max(PROBES, n // PROBE_EVERY)]
    toward, planted = _planted(units, at, threshold, rng)
    missing = np.ones(len(at), bool)
    while True:
        width, planes = window << len(widths) // PASSES_BY_WIDTH, _planes(dim, len(widths))
        keys = _keys(units, planes)
        order = np.argsort(keys, kind="stable")
        root = _window_links(units, order, width, threshold, root)
        widths.append(width)
        if width >= n - 1:
            return root, widths
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        missing &= np.abs(np.searchsorted(keys[order], _keys(planted, planes)) - place[at]) > width
        if all(missing[kind].sum() <= (1 - recall) / 2 * kind.sum() for kind in (toward, ~toward)):
            return root, widths


def _tile_links(units: np.ndarray, part: np.ndarray, i: int, j: int, threshold: float) -> np.ndarray:
    """Roots by all links of rows of part ``i`` with part ``j``, or within it."""
    first, second = np.flatnonzero(part == i), np.flatnonzero(part == j)
    root = np.arange(len(units))
    for begin in range(0, len(first), STEP_ROWS):
        some = first[begin : begin + STEP_ROWS]
        x, y = np.nonzero(units[some] @ units[second].T >= threshold)
        a, b = some[x], second[y]
        apart = root[a] != root[b]
        if apart.any():
            root = _united(len(units), a[apart], b[apart], root)
    return root


def _link_batch(ids: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    linked = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_pydict({"a": pa.array(ids[linked], pa.int64()), "b": pa.array(ids[root[linked]], pa.int64())})


def _blocks(batches, keys: list[str], rows_of_block):
    """(rows, from, to) of blocks of ordered rows with equal ``keys``. The second half
    of a block is the first of the next; each row is in the middle, between ``from``
    and ``to``, of one block."""
    held, key, count, fresh, first = [], None, 0, 0, True

    def block(last: bool):
        quarter = size // 4
        return pa.Table.from_batches(held), 0 if first else quarter, count if last else count - quarter

    for batch in batches:
        values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        begin = 0
        while begin < len(values):
            if values[begin] != key:
                if fresh:
                    yield block(True)
                held, key, count, fresh, first = [], values[begin], 0, 0, True
                size = rows_of_block(key)
            end = begin
            while end < len(values) and values[end] == key and count + end - begin < size:
                end += 1
            if end == begin:  # full, and there is more
                yield block(False)
                kept = pa.Table.from_batches(held).slice(count - size // 2)
                held, count, fresh, first = kept.to_batches(), kept.num_rows, 0, False
                continue
            held.append(batch.slice(begin, end - begin))
            count, fresh, begin = count + end - begin, fresh + end - begin, end
    if fresh:
        yield block(True)


class EmbeddingDedup:
    """Links vectors of the same group whose cosine is ``threshold`` or more.

    Vectors that are null, empty, zero, or hold null or non-finite components,
    and those of a null group, link with nothing. Vectors of different length
    never link. Equal vectors of a group are one class. Rows that repeat an id are
    rows of their own, which share it in the result; rows without an id take part,
    but name no component unless all its rows lack one. Columns other than the three
    named are not read. An empty table gives an empty result. Without
    ``group_col`` all vectors are compared.
    """

    def __init__(self, threshold=0.93, id_col="vec_id", vector_col="embedding", group_col: str | None = "label", window=64, recall=0.99, part_rows=PART_ROWS):
        self.threshold, self.window, self.recall, self.part_rows = threshold, window, recall, part_rows
        self.id_col, self.vector_col, self.group_col = id_col, vector_col, group_col

    def _read(self, vectors: DataFrame) -> DataFrame:
        bucket = F.col(self.group_col).cast("string") if self.group_col else F.lit("")
        rows = vectors.select(
            F.col(self.id_col).cast("long").alias("id"),
            bucket.alias("bucket"),
            F.col(self.vector_col).cast("array<double>").alias("vector"),
        )
        finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        usable = F.col("bucket").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
        return rows.withColumn("vector", F.when(usable, F.transform("vector", lambda x: x + F.lit(0.0))))

    def classify(self, vectors: DataFrame) -> DataFrame:
        """(id, n_links, component_id, kept) of every vector."""
        scratch = Scratch(vectors.sparkSession, "embeddings")
        rows = self._read(vectors)
        usable = rows.where("vector is not null").withColumn("h", F.xxhash64("vector"))
        firsts = scratch.keep(
            usable.groupBy("bucket", "h", "vector")
            .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
            .withColumn("dim", F.size("vector"))
            .withColumn("row", F.monotonically_increasing_id()),
            "classes",
        )
        found = scratch.keep(
            components(self._links(firsts, scratch), scratch).select(F.col("id").alias("row"), F.col("component_id").alias("root")), "components"
        )
        counts = self._count(firsts, found, scratch)
        names = found.join(firsts.select("row", "id"), "row").groupBy("root").agg(F.min("id").alias("component_id"))
        of_row = found.join(names, "root").join(counts, "row", "left").select("row", "root", "component_id", "linked")
        classes = firsts.join(of_row, "row", "left").select(
            "bucket",
            "h",
            F.col("vector").alias("same"),
            (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        placed = usable.join(classes, ["bucket", "h"]).where("vector = same").select("id", "n_links", "component_id")
        alone = rows.where("vector is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        return placed.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))

    def _rows_of_block(self, dim: int) -> int:
        return max(4, min(self.part_rows, PART_VALUES // dim))

    def _links(self, firsts: DataFrame, scratch: Scratch) -> DataFrame:
        """(a, b) that span the links that passes find."""
        rows_of_block = F.greatest(F.lit(4), F.least(F.lit(self.part_rows), F.floor(F.lit(PART_VALUES) / F.col("dim"))))
        sizes = scratch.keep(
            firsts.groupBy("bucket", "dim").count().withColumn("parts", F.ceil(F.col("count") / rows_of_block).cast("int")), "sizes"
        )
        large = sizes.where("parts > 1")
        links = [self._small(firsts, sizes.where("parts = 1"), scratch)]
        if not large.isEmpty():
            pilot = self._shipments(firsts, large.select("bucket", "dim", F.lit(0).alias("begin"), F.lit(PILOT_PASSES).alias("end")), scratch, probes=True)
            plan = scratch.keep(self._planned(large, pilot), "plan")
            more = plan.where(f"passes > {PILOT_PASSES} and passes <= parts + {PILOT_PASSES}")
            dense = plan.where(f"passes > parts + {PILOT_PASSES}")
            links.append(pilot)
            if not more.isEmpty():
                span = more.select("bucket", "dim", F.lit(PILOT_PASSES).alias("begin"), F.col("passes").cast("int").alias("end"))
                links.append(self._shipments(firsts, span, scratch))
            if not dense.isEmpty():
                links.append(self._exact(firsts, dense.select("bucket", "dim", "parts"), scratch))
        all_links = links[0]
        for some in links[1:]:
            all_links = all_links.unionByName(some.where("a is not null").select("a", "b"))
        return all_links.distinct() if len(links) > 1 else all_links

    def _tasks(self, df: DataFrame) -> int:
        spark = df.sparkSession
        return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def _small(self, firsts: DataFrame, plan: DataFrame, scratch: Scratch) -> DataFrame:
        """Links of groups that fit into a block, shipped once."""
        window, threshold, recall, keys = self.window, self.threshold, self.recall, ["bucket", "dim"]
        placed = (
            firsts.join(plan.select(*keys), keys)
            .select(*keys, "row", "vector")
            .repartition(self._tasks(firsts), *keys)
            .sortWithinPartitions(*keys, "row")
        )

        def passes(batches):
            for rows in groups(batches, keys):
                if len(rows) > 1:
                    root, _ = block_links(_units(rows["vector"], rows["dim"][0].as_py()), window, threshold, recall)
                    yield _link_batch(rows["row"].to_numpy(), root)

        return scratch.keep(placed.mapInArrow(passes, "a long, b long"), "links")

    def _shipments(self, firsts: DataFrame, span: DataFrame, scratch: Scratch, probes=False) -> DataFrame:
        """Links (a, b) found in blocks of large groups by shipments begin to end, and
        whether planted vectors (row, kind) fell into the block of theirs."""
        window, threshold, recall = self.window, self.threshold, self.recall
        shipped = "bucket string, dim int, pass int, key long, row long, vector array<double>, kind int, probe long"
        order = ["bucket", "dim", "pass", "key", "row"]

        def keyed(batches):
            for batch in batches:
                for rows in groups([batch], ["bucket", "dim", "begin", "end"]):
                    bucket, dim, begin, end = (rows[c][0].as_py() for c in ("bucket", "dim", "begin", "end"))
                    units, ids = _units(rows["vector"], dim), rows["row"].to_numpy()
                    kind, probe = np.zeros(len(ids), np.int32), np.full(len(ids), -1, np.int64)
                    if probes:
                        drawn = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
                        at = np.flatnonzero(drawn % PROBE_EVERY == 0)
                        toward, planted = _planted(units, at, threshold, np.random.default_rng([SEED, int(ids[0])]))
                        kind[at] = 1 + toward
                    for number in range(begin, end):
                        planes = _planes(dim, -1 - number & 0xFFFFFFFF)  # not those of passes within a block
                        if probes:
                            probe[at] = _keys(planted, planes)
                        columns = [[bucket] * len(ids), np.full(len(ids), dim, np.int32), np.full(len(ids), number, np.int32), _keys(units, planes), ids]
                        columns += [rows["vector"].combine_chunks(), kind, probe]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], ["bucket", "dim", "pass", "key", "row", "vector", "kind", "probe"]
                        )

        def rows_of_block(key):
            return self._rows_of_block(key[1])

        def passes(batches):
            for rows, begin, end in _blocks(batches, ["bucket", "dim", "pass"], rows_of_block):
                ids = rows["row"].to_numpy()
                root, _ = block_links(_units(rows["vector"], rows["dim"][0].as_py()), window, threshold, recall)
                linked = np.flatnonzero(root != np.arange(len(ids)))
                key, probe, kind = (rows[c].to_numpy() for c in ("key", "probe", "kind"))
                at = begin + np.flatnonzero(kind[begin:end])
                met = ((key[0] <= probe[at]) & (probe[at] <= key[-1])).astype(np.int32)
                n, m = len(linked), len(at)
                none, bucket, dim = pa.nulls, rows["bucket"][0].as_py(), rows["dim"][0].as_py()
                columns = {
                    "a": [pa.array(ids[linked], pa.int64()), none(m, pa.int64())],
                    "b": [pa.array(ids[root[linked]], pa.int64()), none(m, pa.int64())],
                    "bucket": [pa.array([bucket] * (n + m), pa.string())],
                    "dim": [pa.array(np.full(n + m, dim, np.int32))],
                    "row": [none(n, pa.int64()), pa.array(ids[at], pa.int64())],
                    "kind": [none(n, pa.int32()), pa.array(kind[at], pa.int32())],
                    "met": [none(n, pa.int32()), pa.array(met)],
                }
                yield pa.RecordBatch.from_pydict({c: pa.concat_arrays(v) for c, v in columns.items()})

        ordered = (
            firsts.join(span, ["bucket", "dim"])
            .select("bucket", "dim", "row", "vector", "begin", "end")
            .mapInArrow(keyed, shipped)
            .repartitionByRange(*order)
            .sortWithinPartitions(*order)
        )
        return scratch.keep(ordered.mapInArrow(passes, "a long, b long, bucket string, dim int, row long, kind int, met int"), "blocks")

    def _planned(self, large: DataFrame, pilot: DataFrame) -> DataFrame:
        """(bucket, dim, parts, passes): shipments that the worst kind of planted vectors of each group needs."""
        recall, threshold = self.recall, self.threshold
        each = pilot.where("met is not null").groupBy("bucket", "dim", "kind", "row")
        each = each.agg(F.sum("met").alias("h"), F.count(F.lit(1)).alias("k"))
        totals = each.groupBy("bucket", "dim", "kind").agg(
            F.count(F.lit(1)).alias("n"), *(F.sum(F.expr(x)).alias(c) for c, x in (("k", "k"), ("h", "h"), ("kk", "k * (k - 1)"), ("hh", "h * (h - 1)")))
        )

        def measured(batches):
            for rows in batches:
                passes = [min(passes_measured(*r, recall), 1 << 30) for r in rows[["n", "k", "h", "kk", "hh"]].itertuples(index=False, name=None)]
                yield rows[["bucket", "dim"]].assign(measured=passes)

        def least(batches):
            for rows in batches:
                blocks = [self._rows_of_block(d) for d in rows["dim"]]
                found = [passes_needed(n, b // 2, threshold, recall) for n, b in zip(rows["count"], blocks, strict=True)]
                yield rows.assign(least=found)

        worst = totals.mapInPandas(measured, "bucket string, dim int, measured long").groupBy("bucket", "dim").agg(F.max("measured").alias("measured"))
        rows = large.select("bucket", "dim", "count", "parts").mapInPandas(least, "bucket string, dim int, count long, parts int, least long")
        passes = F.greatest("least", F.coalesce("measured", F.lit(1 << 30))).alias("passes")
        return rows.join(worst, ["bucket", "dim"], "left").select("bucket", "dim", "parts", passes)

    def _exact(self, firsts: DataFrame, plan: DataFrame, scratch: Scratch) -> DataFrame:
        """Links of groups that passes would ship more often than comparing their blocks pair by pair."""
        threshold, keys = self.threshold, ["bucket", "dim", "i", "j"]
        tiles = (
            firsts.join(plan, ["bucket", "dim"])
            .withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("bucket", "dim", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "row", "vector")
            .repartition(2 * self._tasks(firsts), *keys)
            .sortWithinPartitions(*keys)
        )

        def compare(batches):
            for rows in groups(batches, keys):
                dim, i, j = (rows[c][0].as_py() for c in ("dim", "i", "j"))
                root = _tile_links(_units(rows["vector"], dim), rows["part"].to_numpy(), i, j, threshold)
                yield _link_batch(rows["row"].to_numpy(), root)

        return scratch.keep(tiles.mapInArrow(compare, "a long, b long"), "exact")

    def _count(self, firsts: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
        """(row, linked): vectors, copies counted, that each one links with."""
        threshold = self.threshold
        sizes = found.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("parts"))
        rows = (
            firsts.join(found, "row")
            .join(sizes, "root")
            .withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "row", "copies", "vector")
        )

        def tile(rows: pd.DataFrame) -> pd.DataFrame:
            full = np.stack(rows["vector"].to_numpy())
            full = full / np.abs(full).max(axis=1, keepdims=True)
            units = full / np.linalg.norm(full, axis=1, keepdims=True)
            part, copies = rows["part"].to_numpy(), rows["copies"].to_numpy()
            linked = units @ units.T >= threshold
            if rows["i"].iat[0] != rows["j"].iat[0]:
                linked &= part[:, None] != part[None, :]
            np.fill_diagonal(linked, False)
            return pd.DataFrame({"row": rows["row"], "linked": linked @ copies})

        tiles = rows.groupBy("root", "i", "j").applyInPandas(tile, "row long, linked long")
        return tiles.groupBy("row").agg(F.sum("linked").alias("linked"))
