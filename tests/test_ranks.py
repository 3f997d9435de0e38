"""Averages ranked as finely as their decimals need."""

import numpy as np
import pandas as pd
import pytest

import protosift as ps
from protosift.operators import conflicts
from protosift.operators.conflicts import ConflictSettings
from protosift.plans import ranks
from protosift.plans.profiles import COPIES
from protosift.plans.ranks import BLOCK, OUTCOME, Ordered

import brute

SPEC = ps.RowSpec("key", ("x", "z"), ("s",), ("bits",), "y")


def made(n: int, seed: int, whole: bool = False, copies: int = 1) -> pd.DataFrame:
    """Few values of all attributes but ``z``, and of that too if ``whole``."""
    r = np.random.default_rng(seed)
    rows = pd.DataFrame({
        "x": r.integers(0, 4, n) / 3.0, "z": r.integers(0, 3, n) / 2.0 if whole else np.sqrt(r.random(n)),
        "s": r.choice(["red", "green", ""], n), "bits": r.integers(0, 3, n),
        "y": r.integers(0, 31, n) / 30 if whole else r.random(n),
    })
    rows.loc[0, ["z", "y"]], rows.loc[1, ["z", "y"]] = 0.0, 1.0
    rows = pd.concat([rows] * copies, ignore_index=True)
    return rows.assign(key=r.permutation(len(rows)) - 50)


def each(values, errors):
    return np.where(np.isnan(values), 0.0, values), errors


def conflicts_of(rows: pd.DataFrame, probe) -> np.ndarray:
    far = sum((rows[c] - probe[c]).abs() for c in ("x", "z")) + (rows["bits"] != probe["bits"]) + (rows["s"] != probe["s"])
    sim, alike = (4.0 - far.to_numpy()) / 4.0, 1.0 - np.abs(rows[OUTCOME].to_numpy() - probe[OUTCOME])
    return np.where(sim > alike, (1.0 - sim) + alike, np.nan)


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("copies", [1, 3])
def test_rounded_averages_are_those_of_all_conflicts(monkeypatch, whole, copies):
    monkeypatch.setattr(ranks, "LEAST", 100.0)
    monkeypatch.setattr(ranks, "RANKED", 0)
    exact, ranked = [], ranks.Seen.exact
    monkeypatch.setattr(ranks.Seen, "exact", lambda self: exact.append(self.rows) or ranked(self))
    rows = made(12_000, 7, whole).rename(columns={"y": OUTCOME}).drop(columns="key").drop_duplicates()
    rows = rows.assign(**{BLOCK: np.arange(len(rows)) % 2, COPIES: np.arange(len(rows)) % copies + 1}).reset_index(drop=True)
    held = Ordered(SPEC, "equal", None if whole else "z", [rows[i : i + 500] for i in range(0, len(rows), 500)])
    probing = rows[(rows["x"] == 0) & (rows["s"] == "red") & (rows["bits"] == 1)].reset_index(drop=True)
    if whole:
        probing = probing[probing["z"] == 0.5].reset_index(drop=True)
    found = held.averages(probing, 3, each)
    assert found.shape == (len(probing), 2)
    for i in range(0, len(probing), 5):
        degree = conflicts_of(rows, probing.iloc[i])
        for b in (0, 1):
            mine = ~np.isnan(degree) & (rows[BLOCK] == b)
            want = brute.owa(np.repeat(degree[mine], rows[COPIES][mine])) or 0.0
            assert round(want, 3) == round(found[i, b], 3) and abs(want - found[i, b]) < 6e-4
    # Before, every conflict of every row was ranked.
    assert whole or len(exact) < found.size / 4


def test_finer_decimals_are_ranked_more_finely():
    r = np.random.default_rng(3)
    runs = [ranks.Run.of(-np.sqrt(r.random(n)), None, None) for n in (90_000, 60_000, 30_000)]
    shifts = [0.02, -0.01, 0.0]
    seen = ranks.Seen(runs, shifts, [int(run.keys.searchsorted(-s)) for run, s in zip(runs, shifts)], 2)
    whole = seen.exact()
    errors = []
    for share in (3e-2, 1e-2, 3e-3):
        value, error = seen.within(share)
        assert abs(value - whole) <= error
        errors.append(error)
    assert errors[0] > 5 * errors[1] > 25 * errors[2]
    assert abs(ranks._resolved([[seen]], 4, each)[0, 0] - whole) <= errors[0]
    assert seen.within(1e-6) is None, "ranking all takes less"


@pytest.mark.parametrize("kind", ["even", "ends", "equal", "random"])
def test_bounds_of_a_run_of_ranks(kind):
    r = np.random.default_rng(1)
    for n, a in ((2, 300), (9, 700), (400, 2000), (5, 20_000)):
        values = {
            "even": np.arange(n) / n, "ends": np.repeat([0.0, 1.0], [n // 2, n - n // 2]), "equal": np.full(n, 0.3),
            "random": np.sort(r.random(n)),
        }[kind]
        weight = 1.0 / np.arange(a + 1.0, a + n + 1)
        over = values.sum() * weight.mean() - (values * weight).sum()
        spread = np.array([((values - values.mean()) ** 2).sum()])
        least, most = ranks._too_much(np.array([float(a)]), np.array([float(n)]), np.ones(1), spread, np.full(1, 1e-15))
        assert least - 1e-15 <= over <= most + 1e-15


@pytest.mark.parametrize("whole,blocks", [(False, 3), (True, 1)])
def test_jobs_with_decimals_give_the_rounded_results(spark, monkeypatch, whole, blocks):
    """Keys may be repeated or lie below 0, outcomes and numbers may be missing."""
    pdf = made(1300, 11, True) if whole else made(350, 11, copies=2)
    jobs, reduced = [], conflicts._Prepared.reduced

    def seen(self, work, schema):
        jobs.append(self.job)
        return reduced(self, work, schema)

    monkeypatch.setattr(conflicts._Prepared, "reduced", seen)
    settings = ConflictSettings(held_rows=150, probing_rows=64)
    table = spark.createDataFrame(pdf)
    found = {r["id"]: r["quality"] for r in ps.quality_powa(table, SPEC, blocks=blocks, decimals=6, settings=settings).collect()}
    want = brute.powa(pdf, SPEC, blocks)
    assert np.allclose([found[k] for k in pdf["key"]], want, atol=5e-7, rtol=0)
    assert [round(found[k], 6) for k in pdf["key"]] == [round(x, 6) for x in want]
    assert jobs[0].ranked and jobs[0].free == (None if whole else "z")

    odd = pdf.astype({"x": object, "y": object})
    odd.loc[5:30, "x"], odd.loc[40:60, "y"] = None, None
    odd.loc[70:90, "key"] = 7
    odd = spark.createDataFrame(odd.astype(object), "x double, z double, s string, bits long, y double, key long")
    fine, all_ = (
        sorted((r["id"], r["block"], round(r["owa"], 6)) for r in found.collect())
        for found in (
            ps.owa_blocks(odd, SPEC, blocks=blocks, decimals=6, settings=settings),
            ps.owa_blocks(odd, SPEC, blocks=blocks, settings=settings),
        )
    )
    assert fine == all_ and jobs[1].ranked and not jobs[2].ranked
    with pytest.raises(ValueError):
        ps.owa_blocks(table, SPEC, blocks=blocks, decimals=12)


def test_words_of_the_held_table_are_kept_once():
    rows = made(5000, 2).rename(columns={"y": OUTCOME}).assign(**{BLOCK: 0, COPIES: 1})
    held = Ordered(SPEC, "equal", "z", [rows[:2500], rows[2500:]])
    assert held.kinds.size == len(rows[["x", "s", "bits"]].drop_duplicates()) and len(held.kind) == 5000
