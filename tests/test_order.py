"""Ranks and order statistics of large, tied and skewed groups against NumPy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from drift_atlas.operators import hypothesis as hyp
from drift_atlas.operators import hypothesis as hyp
from drift_atlas.operators import order


def mid_rank(values):
    values = np.asarray(values)
    return np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])


@pytest.fixture(scope="module")
def groups(spark):
    """A hot group with a hot value, a skewed one, a tiny one, one of a single value, and one whose key is null."""
    rng = random.Random(5)
    made = {1: [round(rng.gauss(0, 1), 2) if k % 3 else 0.5 for k in range(1500)], 2: [10.0 ** rng.uniform(-300, 300) for _ in range(400)], 3: [4.0, -1.0], 4: [7.0] * 30, None: [rng.random() for _ in range(25)]}
    rows = [(g, k, v, round(v * (k % 7), 3) if abs(v) < 1e9 else float(k)) for g, vs in made.items() for k, v in enumerate(vs)]
    rng.shuffle(rows)
    return made, spark.createDataFrame(rows, "g long, id long, v double, w double").repartition(6)


@pytest.mark.parametrize("most", [2, 50_000])
def test_mid_ranks_and_numbers(groups, most, monkeypatch):
    """Also where the tables between the passes are too large to be broadcast."""
    settled = order.settled
    monkeypatch.setattr(order, "settled", lambda table: settled(table, most))
    made, rows = groups
    got = {}
    for r in order.mid_ranks(rows, ["g"], {"v": "rv", "w": "rw"}).collect():
        got.setdefault(r.g, {})[r.id] = r
    for g, values in made.items():
        own = got[g]
        assert [own[k].rv for k in range(len(values))] == mid_rank(values).tolist()
        assert [own[k].rw for k in range(len(values))] == mid_rank([own[k].w for k in range(len(values))]).tolist()
    assert all(r.n == r.id for r in order.numbered(rows, ["g"], "id", "n").collect())
    values = {(r.g, r.v): (r.n, r.up) for r in order.ranked_values(rows, ["g"], "v", F.count_if(F.col("w") > 0).alias("up")).collect()}
    assert values[4, 7.0] == (30, sum(k % 7 > 0 for k in range(30))) and values[1, 0.5][0] == made[1].count(0.5)


@pytest.mark.parametrize("passes", [0, 1, 2])
def test_quantiles(groups, passes, monkeypatch):
    monkeypatch.setattr(order, "CELLS", 16)
    made, rows = groups
    broken = rows.unionByName(rows.where("id < 2").withColumn("v", F.lit(float("nan")))).unionByName(rows.where("id = 0").withColumn("v", F.lit(None).cast("double")))
    shares = [0.0, 0.025, 0.5, 0.9, 1.0]
    got = {(r.g, r.q): r.value for r in order.quantiles(order.Rows(broken, ["g"], "v"), shares, passes).collect()}
    assert set(got) == {(g, q) for g in made for q in shares}
    for (g, q), value in got.items():
        assert value == pytest.approx(np.quantile(made[g], q), rel=1e-12, abs=1e-300)


def test_median_of_pair_distances(spark, monkeypatch):
    """Blocks of few rows, sets of one and two rows, equal vectors and a null set."""
    monkeypatch.setattr(order.dist, "BLOCK_ROWS", 4)
    monkeypatch.setattr(order, "CELLS", 8)
    rng = np.random.default_rng(3)
    sets = {0: rng.normal(size=(23, 5)), 1: rng.normal(size=(1, 5)), 2: rng.normal(size=(2, 5)), 3: np.ones((6, 5)), None: rng.normal(size=(7, 5))}
    rows = spark.createDataFrame([(s, k, v.tolist()) for s, x in sets.items() for k, v in enumerate(x)], "set_id long, row_id long, embedding array<double>").repartition(3)
    got = {r.set_id: r.scale for r in order.median(order.PairDistances(rows), "scale").collect()}
    assert set(got) == {0, 2, 3, None}
    for s, value in got.items():
        x = sets[s]
        n = np.sqrt((x * x).sum(axis=1)) + 1e-12
        d = 1 - (x @ x.T) / np.outer(n, n)
        assert value == pytest.approx(np.median(d[np.triu_indices(len(x), 1)]), abs=1e-9)


def test_no_rows(groups):
    empty = groups[1].limit(0)
    assert order.mid_ranks(empty, ["g"], {"v": "r"}).count() == 0 and order.numbered(empty, ["g"], "id", "n").count() == 0
    assert order.quantiles(order.Rows(empty, ["g"], "v"), [0.5]).count() == 0


def test_ranks_of_values_that_differ_when_computed_again(spark):
    """A sum whose last digits depend on the order of its terms is another number each time it is computed."""
    import random

    wavering = F.udf(lambda k: k + random.random() / 1e6, "double").asNondeterministic()
    rows = spark.range(60).select((F.col("id") % 2).alias("g"), wavering("id").alias("x"), wavering(-F.col("id")).alias("y"))
    got = hyp.spearman(rows, ["g"]).collect()
    assert [r.n_pairs for r in got] == [30, 30] and all(abs(r.rho + 1) < 1e-12 for r in got)
