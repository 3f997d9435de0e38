"""Sorted projection passes against all pairs."""

import numpy as np

from protosift.llm.embedding_dedup import EmbeddingDedup, _united, block_links, passes_measured, passes_needed

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, t):
    links, root = {i: set() for i, *_ in rows}, {i: i for i, *_ in rows}
    usable = {}
    for i, v, label in rows:
        if v is None or label is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, np.float32).astype(float)
        usable[i] = (label, x / np.linalg.norm(x))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(usable)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            (la, x), (lb, y) = usable[a], usable[b]
            if la == lb and len(x) == len(y) and x @ y >= t:
                links[a].add(b)
                links[b].add(a)
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(links[i]), find(i), find(i) == i) for i in links}


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows, number = [], 0
    for group, noise in ((1, 0.0), (2, 0.04), (90, 0.03), (6, 0.05), (160, 0.02), (3, 0.0)):
        for _ in range(6 if group < 50 else 1):
            base, label = rng.standard_normal(24), int(rng.integers(2))
            for _ in range(group):
                rows.append((number, [float(np.float32(x)) for x in base + noise * rng.standard_normal(24)], label))
                number += 1
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [1.0] * 23 + [None], [float("inf")] * 24, [1.0, 2.0]]
    rows += [(number + k, v, 0) for k, v in enumerate(odd)] + [(number + 50, rows[0][1], None)]
    found = EmbeddingDedup(0.93, window=16).classify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.id: (r.n_links, r.component_id, r.kept) for r in found} == brute(rows, 0.93)


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert EmbeddingDedup().classify(empty).collect() == []
    rows = [(1, [1.0, 0.0], 3, 9, "x"), (2, [2.0, 0.0], 3, 9, "x"), (3, [0.0, 1.0], 3, 9, "x")]
    table = spark.createDataFrame(rows, SCHEMA + ", id int, bucket string")
    found = {r.id: (r.n_links, r.component_id) for r in EmbeddingDedup().classify(table).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_passes_grow_with_the_table():
    assert passes_needed(10, 64, 0.93, 0.99) == 1
    assert passes_needed(10**4, 64, 0.93, 0.99) < passes_needed(10**7, 64, 0.93, 0.99)


def cone(n, pairs, seed):
    """Vectors of one label in a narrow cone, and others at a cosine of 0.94 to some."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal(64) + 0.8 * rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal((pairs, 64))
    away -= (away * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    return np.concatenate([x, 0.94 * x[:pairs] + np.sqrt(1 - 0.94**2) * away]).astype(np.float32)


def test_pairs_of_a_narrow_cone_are_found(spark):
    rows = [(k, v, 0) for k, v in enumerate(cone(2500, 300, 1).tolist())]
    wanted = brute_matrix(rows, 0.93)
    table = spark.createDataFrame(rows, SCHEMA)
    for part_rows, least in ((1 << 14, 0.995), (700, 0.985), (40, 0.985)):  # a block; shipments; more blocks
        found = EmbeddingDedup(0.93, part_rows=part_rows).classify(table).collect()
        assert np.mean([wanted[r.id] == (r.n_links, r.component_id) for r in found]) >= least


def test_passes_end_when_planted_vectors_have_met():
    x = cone(6000, 1000, 2).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    root, widths = block_links(x, 64, 0.93, 0.99)
    assert 1 < len(widths) < 64 and 2 * sum(widths) < len(x)  # fewer pairs than all
    wanted = np.array([r for _, r in brute_matrix([(k, v, 0) for k, v in enumerate(x)], 0.93).values()])
    assert np.mean(root == wanted) >= 0.999
    assert block_links(x[:60], 64, 0.93, 0.99)[1] == [64]  # a window holds the whole group


def test_repeated_and_missing_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (None, [1.0, 0.02], 0), (None, None, 0), (None, [-1.0, 0.0], 0)]
    found = EmbeddingDedup().classify(spark.createDataFrame(rows, SCHEMA)).collect()
    wanted = [(1, 2, 1, True), (1, 0, 1, True), (2, 2, 1, False), (None, 2, 1, False), (None, 0, None, True), (None, 0, None, True)]
    assert sorted(map(str, ((r.id, r.n_links, r.component_id, r.kept) for r in found))) == sorted(map(str, wanted))


def brute_matrix(rows, t):
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= t
    np.fill_diagonal(near, False)
    root = _united(len(x), *np.nonzero(near))
    return {i: (int(near[i].sum()), int(root[i])) for i in range(len(x))}


def test_measured_passes():
    assert passes_measured(10**6, 8 * 10**6, 4 * 10**6, 56 * 10**6, 14 * 10**6, 0.99) == 7
    assert passes_measured(10**6, 8 * 10**6, 4 * 10**6, 56 * 10**6, 20 * 10**6, 0.99) > 20
    assert passes_measured(100, 800, 0, 5600, 0, 0.99) == float("inf")
