"""Hausdorff distances whose blocks travel by groups."""

import numpy as np
from pyspark.sql import functions as F

from drift_atlas.operators import distance as dist
from drift_atlas.operators import hausdorff


def test_a_block_is_sent_for_groups_and_not_for_blocks(spark, monkeypatch):
    monkeypatch.setattr(dist, "BLOCK_ROWS", 8)
    monkeypatch.setattr(hausdorff, "GROUP_ROWS", 40)
    sent, real = spark.sparkContext.accumulator(0), hausdorff._nearest

    def counted(kind):
        run = real(kind)

        def counting(left, right):
            sent.add(left.num_rows + right.num_rows)
            return run(left, right)

        return counting

    monkeypatch.setattr(hausdorff, "_nearest", counted)
    x = np.random.default_rng(4).normal(size=(3, 100, 24))  # so many dimensions that no bound rules much out
    rows = spark.createDataFrame([(s, k, x[s, k].tolist()) for s in range(3) for k in range(100)], "set_id long, row_id long, embedding array<double>")
    packed = hausdorff.blocks(rows).persist()
    left = hausdorff.block_pairs(packed).where("look_a or look_b").count()
    parts = hausdorff._grouped(packed).groupBy("set_id").agg(F.max("part").alias("last")).collect()
    assert all(r["last"] >= 2 for r in parts)
    got = {(r.a, r.b): r.hausdorff for r in hausdorff.hausdorff_pairs(rows).collect()}
    for a, b in ((0, 1), (0, 2), (1, 2)):
        d = np.sqrt(((x[a][:, None] - x[b]) ** 2).sum(axis=2))
        assert abs(got[a, b] - max(d.min(axis=1).max(), d.min(axis=0).max())) < 1e-12
    assert 0 < sent.value < left  # before: two for every pair of blocks
    packed.unpersist()
