"""Gaussian moments of vector sets.

``plane_moments`` and ``pooled_mean`` are plain aggregates with map-side combine.
``full_moments`` serves any dimension: every task folds its rows to one partial
(n, mean, centred second moment) per set, and partials are merged in a tree, so a
set of any size costs one row of d*d numbers per task and no process holds them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RIDGE = 1e-4


def plane_moments(points: DataFrame, keys: list[str]) -> DataFrame:
    """n, means and sample covariances of (x, y) by key; the covariance of one row is 0."""
    cov = lambda a, b: F.coalesce(F.covar_samp(a, b), F.lit(0.0))
    return points.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), cov("x", "x").alias("cxx"), cov("x", "y").alias("cxy"), cov("y", "y").alias("cyy"))


def elements(vectors: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """One row per coordinate: set_id, row_id, i, v."""
    part = F.col("embedding") if last is None else F.slice("embedding", first + 1, last - first)
    return vectors.select("set_id", "row_id", F.posexplode(part).alias("i", "v")).withColumn("i", F.col("i").cast("long"))


def mean_vector(vectors: DataFrame) -> DataFrame:
    """Mean of every coordinate of every set, in long form."""
    return elements(vectors).groupBy("set_id", "i").agg(F.avg("v").alias("mean"))


def vector_statistics(vectors: DataFrame) -> DataFrame:
    """Mean, population deviation and count of every coordinate of every set."""
    return elements(vectors).groupBy("set_id", "i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("*").alias("n"))


def covariance(vectors: DataFrame, ridge: float = 0.0) -> DataFrame:
    """Sample covariance of all coordinates of every set in long form (i <= j).

    The upper triangle is read off the moments, of which there is one row a set.
    """
    m = full_moments(vectors).select("set_id", F.size("mean").alias("d"), F.posexplode("cov").alias("at", "cov"))
    i, j = F.floor(F.col("at") / F.col("d")), F.col("at") % F.col("d")
    rows = m.select("set_id", i.cast("long").alias("i"), j.cast("long").alias("j"), "cov").where("i <= j")
    return rows.withColumn("cov", F.col("cov") + F.when(F.col("i") == F.col("j"), F.lit(ridge)).otherwise(F.lit(0.0)))


def pooled_mean(vectors: DataFrame, dims: int, keys: list[str]) -> DataFrame:
    """Mean vector of every group as one row: an aggregate per coordinate, combined before the shuffle."""
    means = vectors.groupBy(*keys).agg(*[F.avg(F.get("embedding", F.lit(k))).alias(f"__{k}") for k in range(dims)])
    return means.select(*keys, F.array(*[f"__{k}" for k in range(dims)]).alias("embedding"))


_PARTIAL = "key string, part long, n long, mean array<double>, m2 array<double>"
#: Partials that one merge takes in a level, and keys whose partials a task holds at once.
FAN_IN, HELD_KEYS = 32, 64


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's partial of each key; where keys are many, a key may have several."""
    task = TaskContext.get().partitionId()
    held: dict[str, tuple[int, np.ndarray, np.ndarray]] = {}

    def send() -> pa.RecordBatch:
        out = list(held.items())
        held.clear()
        lists = [pa.array([v[k].ravel() for _, v in out], pa.list_(pa.float64())) for k in (1, 2)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([task] * len(out), pa.int64()), pa.array([v[0] for _, v in out], pa.int64()), *lists], names=["key", "part", "n", "mean", "m2"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.array(batch.column(0).to_pylist(), object)
        for key in sorted(set(keys)):
            own = batch.column(1).take(pa.array(np.flatnonzero(keys == key)))
            rows = np.array(own.flatten(), float).reshape(len(own), -1)
            mean = rows.mean(axis=0)
            part = (len(rows), mean, (rows - mean).T @ (rows - mean))
            held[key] = part if key not in held else merge_moments(held[key], part)
            if len(held) >= HELD_KEYS:
                yield send()
    yield send()


def merge_moments(a: tuple, b: tuple) -> tuple:
    """Chan's pairwise update of (n, mean, centred second moment)."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    total = None
    for r in group.itertuples():
        d = len(r.mean)
        part = (r.n, np.array(r.mean), np.array(r.m2).reshape(d, d))
        total = part if total is None else merge_moments(total, part)
    n, mean, m2 = total
    return pd.DataFrame({"key": [group["key"].iloc[0]], "part": [group["part"].iloc[0] // FAN_IN], "n": [n], "mean": [mean], "m2": [m2.ravel()]})


def full_moments(vectors: DataFrame, keys: tuple[str, ...] = ("set_id",), levels: int = 3) -> DataFrame:
    """The keys, n, mean and row-major sample covariance of every group, in any dimension.

    Partials meet in a tree: a merge takes those of ``FAN_IN`` neighbouring tasks, so a
    group of any size never stands in one Python process.
    """
    kinds = vectors.select(*keys).schema
    parts = vectors.where(F.col("embedding").isNotNull()).select(F.to_json(F.struct(*keys)).alias("key"), "embedding").mapInArrow(_partials, _PARTIAL)
    for level in range(levels):
        place = F.floor(F.col("part") / F.lit(FAN_IN)) if level < levels - 1 else F.lit(0)
        parts = parts.groupBy("key", place.alias("place")).applyInPandas(_merged, _PARTIAL)
    cov = F.transform("m2", lambda x: F.when(F.col("n") > 1, x / (F.col("n") - 1)).otherwise(F.lit(0.0)))
    return parts.select(F.from_json("key", kinds).alias("k"), "n", "mean", cov.alias("cov")).select(*[F.col("k")[c].alias(c) for c in keys], "n", "mean", "cov")
