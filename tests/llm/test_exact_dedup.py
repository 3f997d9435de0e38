"""Exact deduplication by merged runs against plain grouping."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from protosift.llm.exact_dedup import ExactDedup


def table():
    texts = ["", None, "a", "A", "a ", "é", "é", "x" * 100_000, "x" * 100_000, "x" * 99_999 + "y"]
    rows = [(i * 7 % 1009, texts[i % len(texts)]) for i in range(300)]
    rows += [(5000 + i, "hot") for i in range(200)] + [(9999, "hot"), (9999, "hot"), (None, "hot"), (None, "lonely"), (None, "lonely")]
    return rows


def check(found, rows):
    groups = defaultdict(list)
    for id, text in rows:
        groups[text or ""].append(id)
    want, got = defaultdict(list), defaultdict(list)
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        for id in ids:
            want[hashlib.sha256(text.encode()).hexdigest()].append((str(id), max(known) if known else None, len(ids)))
    for r in found:
        got[r["digest"].hex()].append((str(r["id"]), r["keep_id"], r["group_size"]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    kept = defaultdict(list)
    for r in found:
        if r["kept"]:
            kept[r["digest"].hex()].append(r)
    assert set(kept) == set(want) and all(len(v) == 1 and v[0]["id"] == v[0]["keep_id"] for v in kept.values())


@pytest.mark.parametrize("parts,fan_in,most_runs", [(1, 8, 64), (5, 2, 64), (13, 4, 64), (13, 8, 4), (3, 2, 1)])
def test_groups(spark, parts, fan_in, most_runs):
    rows = table()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, digest string, _run int")
    check(ExactDedup(fan_in=fan_in, most_runs=most_runs).groups(df.repartition(parts)).collect(), rows)


def test_equal_digests_of_different_texts_stay_apart(spark):
    """Merging is verified: here all digests are one of three."""
    rows = [(i, f"text {i % 50}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    weak = ExactDedup(digest=lambda t: F.unhex(F.hex(F.pmod(F.crc32(t.cast("binary")), F.lit(3)))))
    for r in weak.groups(df).collect():
        assert r["keep_id"] == 350 + r["id"] % 50 and r["group_size"] == 8 and r["kept"] == (r["id"] >= 350)


def test_native_plan_without_hot_keys(spark):
    """No Python in the plan, and no task gets more of a text than runs are merged."""
    rows = [(i, "hot") for i in range(3000)] + [(10_000 + i, f"t{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    sent, exchange = [], ExactDedup._exchange

    class Seen(ExactDedup):
        def _exchange(self, runs, level, count):
            low = (1 << level) - 1
            place = F.col("_run").bitwiseAND(F.lit(~low)).bitwiseOR(F.col("_home").bitwiseAND(F.lit(low)))
            sent.append(runs.groupBy(place.alias("_to"), "_digest").count().agg(F.max("count")).first()[0])
            return exchange(self, runs, level, count)

    found = Seen(fan_in=2).groups(df)
    shown = found._jdf.queryExecution().toString()
    assert "Python" not in shown and "Arrow" not in shown and "Pandas" not in shown
    assert sent == [2] * 4 and found.where("kept").count() == 1001


def test_empty_table(spark):
    assert ExactDedup().groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
