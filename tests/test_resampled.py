"""Resampling by counts against NumPy on the same counts."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from drift_atlas.operators import moments as mom
from drift_atlas.operators import resampled, study, weights
from drift_atlas.operators.resampled import Plan

DIMS = {"wide": 12, "narrow": 5}


def plain_frechet(x, y, ridge=mom.RIDGE):
    """The distance by the eigenvalues of the covariances' product."""
    cov = lambda z: np.cov(z, rowvar=False) + ridge * np.eye(z.shape[1])
    a, b = cov(x), cov(y)
    root = np.sqrt(np.clip(np.linalg.eigvals(a @ b).real, 0, None)).sum()
    return ((x.mean(axis=0) - y.mean(axis=0)) ** 2).sum() + max(np.trace(a) + np.trace(b) - 2 * root, 0)


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 3000])
def test_counts_have_exact_sizes_and_do_not_depend_on_the_reader(n):
    reps, rng = 20, np.random.default_rng(n)
    for make in (lambda: weights.Counts("s", n, reps, draws=n), lambda: weights.Counts("s", n, reps, draws=7), lambda: weights.Counts("s", n, reps, dealt=(n // 2, n // 2)), lambda: weights.Counts("s", n, reps, dealt=(n // 3, n - n // 3))):
        whole = make().of(np.arange(n))
        one = make()
        places = np.sort(rng.choice(n, max(1, n // 3), replace=False))
        assert np.array_equal(one.of(places), whole[:, places]) and np.array_equal(make().of(places[-1:]), whole[:, places[-1:]])
        if one.dealt:
            assert ((whole == 1).sum(axis=1) == one.dealt[0]).all() and ((whole == -1).sum(axis=1) == one.dealt[1]).all()
        else:
            assert (whole >= 0).all() and len({*whole.sum(axis=1)}) == 1 and whole[0].sum() in (n, 7)
    with pytest.raises(ValueError):
        weights.Counts("s", 3, 2)
    with pytest.raises(ValueError):
        weights.Counts("s", 3, 2, dealt=(2, 2))


def test_counts_are_spread_evenly():
    n, reps = 700, 4000
    drawn = weights.Counts("s", n, reps, draws=n).of(np.arange(n))
    dealt = weights.Counts("s", n, reps, dealt=(200, 500)).of(np.arange(n))
    assert abs(drawn.mean(axis=0) - 1).max() < 0.08 and abs(drawn.var(axis=0) - 1).mean() < 0.05
    assert abs((dealt == 1).mean(axis=0) - 200 / 700).max() < 0.04
    # Two rows of different leaves are drawn almost independently, and dealt with the small negative tie of a deal.
    assert abs(np.corrcoef(drawn[:, 3], drawn[:, 600])[0, 1]) < 0.06 and abs(np.corrcoef(dealt[:, 3], dealt[:, 4])[0, 1]) < 0.06


@pytest.fixture(scope="module")
def both(spark):
    """Two versions of sets of 60, 40, 7 and 1 rows, so some are smaller than their dimension and some larger than twice it."""
    rng = np.random.default_rng(4)
    sizes = [60, 40, 7, 1]
    rows = [(c, s, k, side, (rng.normal(0.3 * s + 0.4 * side, 1 + 0.2 * s, d)).tolist()) for c, d in DIMS.items() for s in range(4) for side in (0, 1) for k in range(sizes[s] - 3 * side * (s < 3))]
    rows += [("wide", 9, k, 0, [1.0] * 12) for k in range(3)] + [("wide", 0, 99, 0, None)]
    return spark.createDataFrame(rows, "configuration string, set_id long, row_id long, side int, embedding array<double>").repartition(5).persist()


def resamples(rows, plan):
    """(configuration, set_id) to the pairs of row arrays of all repetitions, from the counts."""
    hashed = rows.where("embedding is not null").withColumn("hash", F.xxhash64(F.col("row_id").cast("string"), F.col("side"))).collect()
    out = {}
    for c, s in {(r.configuration, r.set_id) for r in hashed}:
        own = sorted((r for r in hashed if (r.configuration, r.set_id) == (c, s) and (plan.kind != "halves" or r.side == 0)), key=lambda r: (r.hash, str(r.row_id), r.side))
        key = json.dumps({"configuration": c, "set_id": s}, separators=(",", ":"))
        n0, n1 = (sum(r.side == k for r in own) for k in (0, 1))
        if plan.kind != "halves" and not (n0 and n1):
            continue
        pops = [[r for r in own if r.side == k] for k in (0, 1)] if plan.kind == "drawn" else [own]
        sides = []
        for pop, members in enumerate(pops):
            x = np.array([r.embedding for r in members])
            counts = plan.counts(key, pop, n0, n1).of(np.arange(len(members)))
            for signed in [counts] if plan.kind == "drawn" else [np.maximum(counts, 0), np.maximum(-counts, 0)]:
                sides.append([np.repeat(x, w.astype(int), axis=0) for w in signed])
        out[c, s] = list(zip(*sides))
    return out


@pytest.mark.parametrize("plan", [Plan("halves", 9, "t"), Plan("drawn", 7, "t"), Plan("drawn", 7, "t", cap=20), Plan("relabelled", 11, "t")], ids=lambda p: f"{p.kind}-{p.cap}")
def test_distances_of_resamples(both, plan, monkeypatch):
    """Rows that are folded in small steps, partials of few repetitions, and merges in a tree change nothing."""
    settled = resampled.order.settled
    monkeypatch.setattr(resampled.order, "settled", lambda table: settled(table, 3 if plan.cap else 1000))
    want = resamples(both, plan)
    got = {}
    for r in resampled.distances(both, ["configuration", "set_id"], plan).collect():
        got.setdefault((r.configuration, r.set_id), {})[r.rep] = r.fmd
    assert set(got) == set(want)
    for key, pairs in want.items():
        assert sorted(got[key]) == list(range(plan.reps))
        for k, (a, b) in enumerate(pairs):
            if not len(a) or not len(b):
                assert got[key][k] is None
            elif len(a) > 1 and len(b) > 1:
                assert got[key][k] == pytest.approx(plain_frechet(a, b), rel=1e-6, abs=1e-9), (key, k)


def test_blocks_and_folds_of_a_large_set():
    """The fold of a task, in blocks of two repetitions and steps of 50 rows, and merged partials give the moments of all rows."""
    rng = np.random.default_rng(1)
    rows = rng.normal(5, 2, (700, 4))
    counts = weights.Counts("s", 700, 5, draws=700).of(np.arange(700))
    total = None
    for k in range(0, 700, 50):
        part = resampled.Moments.of(counts[:, k : k + 50], rows[k : k + 50])
        part = resampled.Moments.unpack(part.pack())
        total = part if total is None else total.merged(part)
    for r in range(5):
        x = np.repeat(rows, counts[r].astype(int), axis=0)
        assert np.allclose(total.mean[r], x.mean(axis=0)) and np.allclose(total.cov(r), np.cov(x, rowvar=False)) and total.n[r] == 700


def test_sensitivity_on_whole_vectors(spark, both):
    """Interval, floor, p and verdict equal NumPy's from the same counts."""
    keys = ["configuration", "set_id"]
    original = both.where("side = 0 and set_id < 3").drop("side")
    moved = original.withColumn("embedding", F.transform("embedding", lambda x, i: F.when(i == 0, x + 9).otherwise(x))).withColumn("perturbation", F.lit("moved"))
    changed = moved.unionByName(original.withColumn("perturbation", F.lit("none")))
    rows = study.sensitivity(original, changed, 9, 8, 19).collect()
    assert {(r.configuration, r.dataset, r.perturbation) for r in rows} == {(c, s, p) for c in DIMS for s in range(3) for p in ("moved", "none")}
    floors = resamples(original.withColumn("side", F.lit(0)), Plan("halves", 9, "floor"))
    for r in rows:
        own = np.array([plain_frechet(a, b) for a, b in floors[r.configuration, r.dataset]])
        assert r.noise_floor_mean == pytest.approx(own.mean(), rel=1e-6) and r.noise_floor_ci_upper == pytest.approx(np.quantile(own, 0.975), rel=1e-6)
        assert r.snr == pytest.approx(r.fmd_vs_original / own.mean(), rel=1e-6, abs=1e-9) and r.above_floor == (r.fmd_vs_original > r.noise_floor_ci_upper)
        assert r.significant == (r.perm_p_value < 0.05 and r.snr >= 1)
        if r.perturbation == "none":
            assert r.fmd_vs_original == 0 and r.perm_p_value == 1 and not r.significant
        elif r.dataset < 2:
            assert r.fmd_vs_original == pytest.approx(81, rel=1e-2) and r.perm_p_value == pytest.approx(1 / 20) and r.fmd_ci_lower <= r.fmd_boot_mean <= r.fmd_ci_upper
    both_sides = study._two_sides(original, moved, keys)
    drawn = resampled.distances(both_sides, keys, Plan("drawn", 8, "interval")).groupBy(*keys).agg(*study.interval()).collect()
    assert all(r.fmd_boot_mean > 50 for r in drawn if r.set_id < 2)


def test_stability_of_a_pair(both):
    a, b = (both.where(f"side = 0 and set_id = {k}").drop("side") for k in (0, 1))
    got = {r.configuration: r for r in study.bootstrap_stability(a, b, 6, 50).collect()}
    assert {(r.sample_size_a, r.sample_size_b, r.n_resamples) for r in got.values()} == {(50, 40, 6)}
    assert all(r.fmd_ci_lower <= r.fmd_mean <= r.fmd_ci_upper and r.cv == pytest.approx(r.fmd_std / r.fmd_mean) for r in got.values())


def test_no_rows(both):
    for kind in ("halves", "drawn", "relabelled"):
        assert resampled.distances(both.limit(0), ["configuration", "set_id"], Plan(kind, 3, "t")).count() == 0
    with pytest.raises(ValueError):
        Plan("other", 1, "t")
