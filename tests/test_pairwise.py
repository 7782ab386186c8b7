"""All rows of one set against all of another, by tiles."""

import functools
import math
import operator
import random

import pytest
from pyspark.sql import functions as F

from drift_atlas.operators import pairwise

SCHEMA = "row_id long, embedding array<double>"


def plain(p, q, metric):
    """As a sum over a list in SQL: terms that are null are left out, and there is no sum of none."""
    def total(x, y, term):
        terms = [term(u, v) for u, v in zip(x or [], y or []) if u is not None and v is not None]
        return functools.reduce(operator.add, terms, 0.0) if terms else None  # the built-in sum compensates

    if metric == "euclidean":
        d = total(p, q, lambda u, v: (u - v) * (u - v))
        return None if d is None else math.sqrt(d)
    dots = [total(x, y, lambda u, v: u * v) for x, y in ((p, q), (p, p), (q, q))]
    return None if None in dots else 1.0 - dots[0] / ((math.sqrt(dots[1]) + 1e-8) * (math.sqrt(dots[2]) + 1e-8))


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_tiles_give_every_pair_once_to_many_tasks(spark, monkeypatch, metric):
    """Sets of one partition each are compared by many tasks; nulls, short, empty and missing vectors as in SQL."""
    monkeypatch.setattr(pairwise, "PART_ROWS", 20)
    rng = random.Random(3)
    vector = lambda k: [rng.uniform(-1, 1) for _ in range(k)]
    odd = [None, [], [0.0] * 5, [None, 1.0, 2.0, 3.0, 4.0], [1.0, 2.0], [None] * 5, vector(7)]
    one, two = [(k, v) for k, v in enumerate([vector(5) for _ in range(150)] + odd)], [(1000 + k, v) for k, v in enumerate([vector(5) for _ in range(60)] + odd)]
    a, b = (spark.createDataFrame(rows, SCHEMA).coalesce(1) for rows in (one, two))
    out = pairwise.pairwise_distances(a, b, metric).withColumn("task", F.spark_partition_id()).collect()
    got = {(r.row_a, r.row_b): r.distance for r in out}
    assert len(out) == len(got) == len(one) * len(two)
    for k, p in one:
        for n, q in two:
            assert got[k, n] == plain(p, q, metric)  # to the last digit
    assert len({r.task for r in out}) > 8


def test_tiles_without_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], SCHEMA)
    assert pairwise.pairwise_distances(rows, rows.limit(0)).count() == 0 and pairwise.pairwise_distances(rows.limit(0), rows).count() == 0
    assert sorted((r.row_a, r.row_b, r.distance) for r in pairwise.pairwise_distances(rows, rows).collect()) == [(1, 1, 0.0), (1, 2, math.sqrt(2)), (2, 1, math.sqrt(2)), (2, 2, 0.0)]
    with pytest.raises(ValueError):
        pairwise.pairwise_distances(rows, rows, "manhattan")
