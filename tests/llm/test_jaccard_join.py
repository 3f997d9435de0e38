"""The Jaccard join against all pairs of word sets."""

import random
from fractions import Fraction

import pyarrow as pa
import pytest

from protosift.llm import jaccard_join
from protosift.llm.jaccard_join import Bands, JaccardJoin
from protosift.llm.language_id import LanguageId
from protosift.llm.scratch import BATCH_BYTES, BATCH_LIMIT
from protosift.llm.words import chunks, rechunked

SCHEMA = "doc_id long, text string"


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\v\f\r":
        lowered = lowered.replace(space, " ")
    return [w for w in lowered.split(" ") if w]


def brute(rows, t, width):
    sets = {}
    for i, text in rows:
        w = words_of(text)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and Fraction(both, len(sets[a] | sets[b])) >= t:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed, count):
    """Texts of 1 to 300 words, and chains of copies with some words changed."""
    rng = random.Random(seed)
    texts = []
    while len(texts) < count:
        text = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 5, 9, 14, 25, 60, 120, 300]))]
        for _ in range(rng.choice([1, 2, 6])):
            texts.append(" ".join(text))
            text = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                at = rng.randrange(len(text))
                text[at : at + rng.choice([0, 1, 1])] = [f"w{rng.randrange(400)}"]
    rng.shuffle(texts)
    return list(enumerate(texts[:count]))


@pytest.mark.parametrize(("t", "width"), [(Fraction(9, 10), 3), (Fraction(4, 5), 5), (Fraction(1, 2), 2), (Fraction(1), 3)])
def test_links_equal_all_pairs(spark, t, width):
    rows = near_copies(int(100 * t), 260)
    found = JaccardJoin(t, width).classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in found} == brute(rows, t, width)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "oNE"), (6, "É b"), (7, "é b"), (8, long), (9, long + " y"), (10, "a b c"), (11, "A\vb\tC")]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA + ", id string, rep int")
    found = {r.id: (r.n_shingles, r.component_id) for r in JaccardJoin(Fraction(9, 10), 3).classes(docs).collect()}
    assert found == brute(rows, Fraction(9, 10), 3)
    assert found[1] == (0, 1) and found[5][1] == 4 and found[7][1] == 7 and found[9][1] == 8 and found[11][1] == 10
    assert JaccardJoin().classes(docs.limit(0)).collect() == []


def test_many_near_copies_of_a_text(spark):
    """A group wider than a part of a cluster, so that tiles meet."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(1500):
        text = list(base)
        for _ in range(rng.choice([1, 2, 4])):
            text[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    found = JaccardJoin(Fraction(9, 10), 3).classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in found} == brute(rows, Fraction(9, 10), 3)


@pytest.mark.parametrize("t", [Fraction(9, 10), Fraction(4, 5), Fraction(1, 2)])
def test_units_cover_all_differences(t):
    bands = Bands(t, 3000)
    assert (bands.segments + bands.doubled > [bands.differences(int(n), int(n / t)) for n in bands.top]).all()
    for n in range(2, 3000, 7):
        band = bands.of([n])[0]
        least = -(-t.numerator * n // t.denominator)
        assert bands.of([least])[0] >= band - 1


def test_repeated_and_null_ids_leave_one_row_of_a_group(spark):
    import corpus_pipeline

    copy = " ".join(f"word{k}" for k in range(40))
    other = " ".join(f"term{k}" for k in range(40))
    rows = [(7, copy), (7, copy), (None, copy), (9, copy + " more"), (7, other), (3, None), (3, None), (None, "alone in the world"), (None, other), (2, "a b"), (2, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = sorted(corpus_pipeline.first_of_near_copies(spark, docs, "").collect(), key=str)
    wanted = [(7, copy), (7, other), (3, None), (3, None), (None, "alone in the world"), (2, "a b")]
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, wanted))


def test_signatures_of_the_same_documents_are_followed_once(spark):
    rows = [(s, i) for s in (5, 6, 7) for i in (1, 2)] + [(8, 1), (8, 3), (9, 4), (10, 1), (10, 2), (10, 3)]
    shared = spark.createDataFrame(rows, "sig long, id long")
    assert sorted(map(tuple, jaccard_join.one_of_alike(shared).collect())) == [(5, 2), (8, 2), (10, 3)]


def test_shuffled_signatures_are_two_numbers_a_row(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 3, 60))) for i in range(12)], "doc_id long, text string")
    found = JaccardJoin().buckets(docs)
    assert "indexed" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert {r["id"] for r in rows} == set(range(12)) and all(0 <= r["sig"] < 1 << 47 for r in rows)


def test_long_texts_come_in_small_batches(spark):
    """Batches are bounded by bytes, unless the session has a limit of its own."""
    spark.conf.unset(BATCH_LIMIT)
    docs = spark.range(0, 1200, 1, 1).selectExpr("id AS doc_id", "repeat('ab cd ef ', 1000) || id AS text")

    def measured(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    def largest():
        return docs.mapInArrow(measured, "bytes long").agg({"bytes": "max"}).first()[0]

    assert JaccardJoin().sizes(docs).count() == 1200
    assert largest() < 2 * BATCH_BYTES
    spark.conf.set(BATCH_LIMIT, str(1 << 30))
    JaccardJoin().sizes(docs).count()
    assert largest() > 2 * BATCH_BYTES
    spark.conf.unset(BATCH_LIMIT)


def test_language_scores_do_not_depend_on_the_size_of_batches(spark):
    words = ["der hund und die katze", "the dog and the cat", "le chien et le chat"]
    rows = [(i, " ".join(words[(i + k) % 3 if k % 9 == 8 else i % 3] for k in range(40 + i % 7)), "deenfr"[i % 3 * 2 :][:2]) for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    finder = LanguageId()
    model, found = finder.fit(docs), []
    for limit in (1 << 30, 1 << 16):
        spark.conf.set(BATCH_LIMIT, str(limit))
        found.append(sorted(finder.predict(docs, model).collect()))
    spark.conf.unset(BATCH_LIMIT)
    assert found[0] == found[1]


def test_rechunked_batches_are_those_of_whole_ones():
    texts = [None if i % 11 == 0 else "x" * (i * 7919 % 90_000) for i in range(400)]
    whole = pa.record_batch([pa.array(range(400)), pa.array(texts, pa.string())], names=["id", "text"])
    wanted = []
    for begin in range(0, 400, 150):
        sizes = [len(t or "") for t in texts[begin : begin + 150]]
        wanted += [list(range(begin + a, begin + b)) for a, b in chunks(sizes)]
    for step in (1, 7, 150, 400):
        parts = (whole.slice(i, step) for i in range(0, 400, step))
        assert [b.column(0).to_pylist() for b in rechunked(parts, 1, 150)] == wanted
    assert list(rechunked(iter([]), 1, 150)) == list(rechunked(iter([whole.slice(0, 0)]), 1, 150)) == []
