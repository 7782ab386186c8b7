"""Whole-vector studies, contrasts, relational operators, encoders and block distances against brute force."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from drift_atlas.functions import scalar as sc
from drift_atlas.operators import distance as dist
from drift_atlas.operators import encoders as enc
from drift_atlas.operators import hausdorff
from drift_atlas.operators import hypothesis as hyp
from drift_atlas.operators import moments as mom
from drift_atlas.operators import relations as rel
from drift_atlas.operators import resample as rs
from drift_atlas.operators import study

DIMS = {"wide": 12, "narrow": 5}


def plain_frechet(x, y, ridge=mom.RIDGE):
    """The distance by the eigenvalues of the covariances' product."""
    cov = lambda z: np.cov(z, rowvar=False) + ridge * np.eye(z.shape[1])
    a, b = cov(x), cov(y)
    root = np.sqrt(np.clip(np.linalg.eigvals(a @ b).real, 0, None)).sum()
    return ((x.mean(axis=0) - y.mean(axis=0)) ** 2).sum() + max(np.trace(a) + np.trace(b) - 2 * root, 0)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(c, s, k, (rng.normal(0.3 * s, 1 + 0.2 * s, d)).tolist()) for c, d in DIMS.items() for s in range(4) for k in range(40 if s < 3 else 6)]
    return spark.createDataFrame(rows, "configuration string, set_id long, row_id long, embedding array<double>").repartition(5).persist()


def sets_of(vectors):
    out = {}
    for r in vectors.orderBy("row_id").collect():
        out.setdefault((r.configuration, r.set_id), []).append(r.embedding)
    return {k: np.array(v) for k, v in out.items()}


def test_full_moments_meet_in_a_tree(spark, vectors, monkeypatch):
    monkeypatch.setattr(mom, "FAN_IN", 2)
    want = sets_of(vectors)
    got = mom.full_moments(vectors.repartition(13), ("configuration", "set_id")).collect()
    assert len(got) == len(want)
    for r in got:
        x = want[r.configuration, r.set_id]
        assert r.n == len(x) and np.allclose(r.mean, x.mean(axis=0)) and np.allclose(np.reshape(r.cov, (x.shape[1], -1)), np.cov(x, rowvar=False))


def test_cross_distances_and_agreement_in_full_dimension(vectors):
    x = sets_of(vectors)
    got = {(r.configuration, r.dataset_a, r.dataset_b): r.fmd for r in study.cross_distances(vectors).collect()}
    assert set(got) == {(c, a, b) for c in DIMS for a, b in itertools.combinations(range(4), 2)}
    for (c, a, b), fmd in got.items():
        assert fmd == pytest.approx(plain_frechet(x[c, a], x[c, b]), rel=1e-6)
    row = study.ranking_agreement(study.cross_distances(vectors)).collect()
    ranks = [np.argsort(np.argsort([got[c, a, b] for a, b in itertools.combinations(range(4), 2)])) for c in ("narrow", "wide")]
    assert [(r.config_a, r.config_b, r.n_pairs, r.interpretable) for r in row] == [("narrow", "wide", 6, False)]
    assert row[0].spearman_tau == pytest.approx(np.corrcoef(*ranks)[0, 1])


def test_self_similarity_in_full_dimension(vectors):
    got = {(r.configuration, r.dataset): r for r in study.self_similarity(vectors).collect()}
    assert set(got) == {(c, s) for c in DIMS for s in range(3)}  # the fourth set has too few files
    halves = rs.split_half(vectors, "h", ["configuration", "set_id"]).collect()
    for (c, s), r in got.items():
        x, y = (np.array([v.embedding for v in halves if (v.configuration, v.set_id, v.half) == (c, s, h)]) for h in (0, 1))
        assert r.n_samples_per_half == 20 and r.split_half_fmd == pytest.approx(plain_frechet(x, y), rel=1e-6)


def test_random_order_against_brute_force(spark):
    sizes = {1: 700, 2: 41, 3: 1, None: 6}
    rows = [(g, i, f"r{i}") for g, n in sizes.items() for i in range(n)]
    table = spark.createDataFrame(rows, "set_id long, row_id long, name string").repartition(3)

    def order(group, *rep):
        return sorted(range(sizes[group]), key=lambda i: (hashlib.md5("|".join(["s", *map(str, rep), str(i)]).encode()).hexdigest(), i))

    once = {(r.set_id, r.row_id): (r.half, r.name) for r in rs.split_half(table, "s", ["set_id"]).collect()}
    many = {(r.set_id, r.rep, r.row_id): r.half for r in rs.split_half(table, "s", ["set_id"], reps=3).collect()}
    halves = {g: n // 2 for g, n in sizes.items()}
    assert once == {(g, i): (k // halves[g], f"r{i}") for g in sizes for k, i in enumerate(order(g)) if k < 2 * halves[g]}
    assert many == {(g, p, i): k // halves[g] for g in sizes for p in range(3) for k, i in enumerate(order(g, p)) if k < 2 * halves[g]}
    asked = {(r.set_id, r.rep, r.row_id): r.half for r in rs.split_half(rs.repeated(table, 3), "s", ["set_id", "rep"]).collect()}
    assert asked == many

    first = {1: 200, 2: 41, 3: 0, None: 0}
    pool = table.select(F.col("set_id").alias("pair"), F.col("row_id").alias("pooled_id"))
    count = F.sum(F.expr("int((pair = 1 and pooled_id < 200) or pair = 2)"))
    sides = {(r.pair, r.rep, r.pooled_id): r.side for r in rs.relabel(pool, 2, "s", F.coalesce(count, F.lit(0))).collect()}
    assert sides == {(g, p, i): int(k >= first[g]) for g in sizes for p in range(2) for k, i in enumerate(order(g, p))}
    assert rs.split_half(table.limit(0), "s", ["set_id"], reps=3).count() == 0 and rs.relabel(pool.limit(0), 2, "s", F.count("*")).count() == 0


def test_contrast_families_and_holm_against_brute_force(spark):
    rng = np.random.default_rng(8)
    shifts = {(s, c, d): {k: round(float(rng.gamma(2, 0.1) * (1 + (d == "a") * (c == "x"))), 9) for k in range(14)} for s in (0, 1) for c in ("x", "y") for d in ("__retest__", "a", "b")}
    for k in range(5, 14):
        shifts[1, "y", "a"].pop(k)  # too few files for the control of the second set
    rows = [(c, s, k, d, v) for (s, c, d), m in shifts.items() for k, v in m.items()]
    pairs = study.contrast_pairs(spark.createDataFrame(rows, "configuration string, set_id long, row_id long, condition string, shift double"), "a", "b", ("x", "y"))
    got = {(r.set_id, r.contrast, r.configuration, r.perturbation): r for r in study.contrast_tests(pairs).collect()}
    want = {}
    for s in (0, 1):
        for c in ("x", "y"):
            of = lambda d: shifts[s, c, d]  # noqa: B023, E731
            for d in ("a", "b"):
                want[s, "exceeds_retest_noise", c, d] = [(of(d)[k], of("__retest__")[k]) for k in of(d)]
            want[s, "a_gt_b", c, "a"] = [(of("a")[k], of("b")[k]) for k in of("a")]
    excess = lambda c, k: round(shifts[0, c, "a"][k] - shifts[0, c, "__retest__"][k], 9)
    want[0, "control_x_gt_y_a_excess", "x_vs_y", "a"] = [(excess("x", k), excess("y", k)) for k in range(14)]
    assert set(got) == set(want)
    for key, values in want.items():
        d = np.array([a - b for a, b in values])
        ranks = np.argsort(np.argsort(np.abs(d))) + 1
        stat = ranks[d > 0].sum()
        signs = np.array(list(itertools.product((0, 1), repeat=len(d)))) if len(d) <= 14 else None
        p = (signs @ ranks >= stat).mean()
        assert got[key].n == len(d) and got[key].stat == stat and got[key].p_raw == pytest.approx(p)
        assert got[key].median_shift == pytest.approx(np.median([a for a, _ in values]))
    for s in (0, 1):
        raw = sorted((got[k].p_raw, k) for k in got if k[0] == s)
        worst = 0
        for place, (p, k) in enumerate(raw):
            worst = max(worst, min(1, (len(raw) - place) * p))
            assert got[k].p_holm == pytest.approx(worst)
    assert hyp.normal_sf(0) == 0.5


def test_complete_shifts_need_every_condition_and_enough_files(spark):
    rng = np.random.default_rng(1)
    original = [("x", s, k, rng.normal(size=3).tolist()) for s in (0, 1) for k in range(12 if s == 0 else 9)]
    conditions = [(c, s, k, d, v) for c, s, k, v in original for d in ("__retest__", "a") if not (k == 3 and d == "a")]
    schema = "configuration string, set_id long, row_id long, embedding array<double>"
    got = study.complete_shifts(spark.createDataFrame(original, schema), spark.createDataFrame([(c, s, k, v, d) for c, s, k, d, v in conditions], schema + ", condition string")).collect()
    assert {(r.set_id, r.row_id) for r in got} == {(0, k) for k in range(12) if k != 3} and len(got) == 22
    assert all(abs(r["shift"]) < 1e-9 for r in got)


@pytest.mark.parametrize("rows, most", [(7, 9), (512, 9), (7, 1)])
def test_hausdorff_by_blocks(spark, vectors, rows, most, monkeypatch):
    """Blocks of any size, with pivots and without, against all pairs of rows."""
    monkeypatch.setattr(dist, "BLOCK_ROWS", rows)
    monkeypatch.setattr(hausdorff, "MOST_SETS", most)
    x = {k[1]: v for k, v in sets_of(vectors).items() if k[0] == "wide"}
    got = {(r.a, r.b): r.hausdorff for r in hausdorff.hausdorff_pairs(vectors.where("configuration = 'wide'")).collect()}
    for a, b in itertools.combinations(sorted(x), 2):
        d = np.sqrt(((x[a][:, None] - x[b][None]) ** 2).sum(axis=2))
        assert got[a, b] == pytest.approx(max(d.min(axis=0).max(), d.min(axis=1).max()), rel=1e-12)
    assert len(got) == 6


def test_hausdorff_leaves_out_far_blocks(spark, monkeypatch):
    """Of clustered sets few pairs of blocks are met, and the distance is that of all pairs; equal sets have none."""
    monkeypatch.setattr(dist, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 30, (12, 6))
    sets = {s: np.concatenate([c + rng.normal(0, 0.3, (20, 6)) for c in centres]) for s in (0, 1)}
    sets[0][5] += 4
    sets[2] = sets[1]
    rows = spark.createDataFrame([(s, k, v.tolist()) for s, x in sets.items() for k, v in enumerate(x)] + [(None, 1, [0.0] * 6), (0, 999, None)], "set_id long, row_id long, embedding array<double>")
    packed = hausdorff.blocks(rows).persist()
    pairs = hausdorff.block_pairs(packed).where("a = 0 and b = 1")
    every = pairs.count()
    assert every > 100 and pairs.where("look_a or look_b").count() < every / 5
    got = {(r.a, r.b): r.hausdorff for r in hausdorff.hausdorff_pairs(rows).collect()}
    d = np.sqrt(((sets[0][:, None] - sets[1][None]) ** 2).sum(axis=2))
    assert got[0, 1] == pytest.approx(max(d.min(axis=0).max(), d.min(axis=1).max()), rel=1e-12) and got[1, 2] == 0 and len(got) == 3
    assert hausdorff.hausdorff_pairs(rows.limit(0)).count() == 0


def test_batch_encoding_equals_one_hot_times_projection(spark):
    rng = np.random.default_rng(2)
    items = [(k, [rng.integers(-3, 140, 6).tolist() for _ in range(k % 4)] or None if k % 7 else None) for k in range(300)]
    for name in ("patches-bars", "tokens"):
        model = enc.encoder(name)
        got = {r.file_id: np.array(r.embedding) for r in enc.encode(spark.createDataFrame(items, "file_id long, patches array<array<int>>"), name).collect()}
        for k, patches in items:
            want = np.zeros(model.dim)
            for patch in patches or []:
                for p, code in enumerate(patch):
                    want += model._draw(p)[min(max(code, 0), model.classes - 1)]
            want /= max(len(patches or []), 1)
            size = np.linalg.norm(want)
            want = want / size if model.normalize and size else want
            assert np.allclose(got[k], want, atol=1e-6)


def test_relations(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    rows = frame([(k, "abc"[k % 3], None if k % 4 == 0 else float(k)) for k in range(20)], "k long, g string, v double")
    assert {r.g for r in rel.with_enough(rows, ["g"], 7).collect()} == {"a", "b"}
    keys = lambda *v: frame([(x,) for x in v], "key string")
    assert sorted(r.key for r in rel.admitted(keys("a", "b"), keys("c", "d", "b"), keys("c", "c", "b"), "key").collect()) == ["a", "b", "c"]
    registry = frame([(0, "x"), (1, "y"), (2, "z")], "place int, key string")
    assert [r.key for r in rel.in_registry(keys("z", "x", "q"), registry, "key", "place").collect()] == ["x", "z"]
    assert [r.key for r in rel.in_registry(keys("q"), registry, "key", "place").collect()] == ["x", "y", "z"]
    done = rel.counters(rows, F.col("v") > 9, "k", "g").collect()
    for r in done:
        good = [x for x in range(20) if "abc"[x % 3] == r.g and x % 4 and x > 9]
        assert (r.total, r.successful, r.failed_items) == (len([x for x in range(20) if "abc"[x % 3] == r.g]), len(good), [x for x in range(20) if "abc"[x % 3] == r.g and x not in good])
    looked = rel.with_default(rows, frame([("a", 1.5)], "g string, floor double"), ["g"], "floor").collect()
    assert all(r.floor == 1.5 if r.g == "a" else np.isnan(r.floor) for r in looked)
    counted = rows.groupBy("g").agg(F.count("*").alias("n"))
    assert [(r.g, r.n) for r in rel.reindexed(counted, "g", ["c", "nothing", "a"]).collect()] == [("c", 6), ("nothing", None), ("a", 7)]
    parsed = rel.isolated(keys("1", "x", None), "key", int, "long").collect()
    assert [(r.result, r.problem) for r in parsed] == [(1, None), (None, "ValueError"), (None, "TypeError")]
    assert rel.tag_counts(keys("b", " a", "a ", "", None, " "), "key").collect() == [("a", 2), ("b", 1)]
    assert rel.complete_cases(frame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "k long, c string"), ["k"], "c").select("k").distinct().collect() == [(1,)]
    both = rel.concat_frames([frame([(1,)], "a long"), frame([("x",)], "b string")]).collect()
    assert sorted(map(str, both)) == ["Row(a=1, b=None)", "Row(a=None, b='x')"]
    numbers = frame([(0.5,), (1.5,), (-0.5,), (float("nan"),), (float("inf"),)], "v double")
    assert [r.h for r in numbers.where("v < 2").select(sc.half_even(F.col("v")).alias("h")).collect()] == [0, 2, 0]
    assert [r.f for r in numbers.select(sc.finite_or(F.col("v"), 9.0).alias("f")).collect()] == [0.5, 1.5, -0.5, 9.0, 9.0]
    assert rel.music_messages(frame([("lyrics",), ("note_on",)], "type string")).collect() == [("note_on",)]
