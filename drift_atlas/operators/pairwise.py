"""Distances of all rows of one set to all rows of another, a tile of rows by rows at a time.

The result has a row for each pair, so its size is the product of the sets' sizes. Rows are dealt
to parts of bounded size by their hash; every part of one set meets every part of the other in a tile, of
which a task holds one. A tile adds up coordinate after coordinate, for all its pairs at once, in
the order in which a list is summed, so the numbers are those of the expression written out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from drift_atlas.operators.distance import ANALYZER_EPS

#: Rows of a part, rows of a part that are compared at once, and partitions that tiles are dealt to at most.
PART_ROWS, STRIP_ROWS, MOST_PARTITIONS = 1024, 64, 2000


def _dense(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates by rows (rows x longest vector, 0 where there is none) and which of them are there."""
    lists = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    sizes = np.array(pc.fill_null(pc.list_value_length(lists), 0))
    known = np.arange(sizes.max(initial=0)) < sizes[:, None]
    flat, values = lists.flatten(), np.zeros(known.shape)
    values[known] = np.array(pc.fill_null(flat, 0.0))
    known[known] = np.array(flat.is_valid())
    return values, known


def _summed(x: np.ndarray, y: np.ndarray, known_x: np.ndarray, known_y: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the coordinates that both rows have, of squared differences or of products, and how many these are (x rows by y rows)."""
    width, whole = min(x.shape[1], y.shape[1]), bool(known_x.all() and known_y.all())
    total, part = np.zeros((len(x), len(y))), np.empty((len(x), len(y)))
    for i in range(width):
        if metric == "euclidean":
            np.subtract.outer(x[:, i], y[:, i], out=part)
            np.multiply(part, part, out=part)
        else:
            np.multiply.outer(x[:, i], y[:, i], out=part)
        if not whole:
            part[~np.logical_and.outer(known_x[:, i], known_y[:, i])] = 0
        total += part
    n = np.full(total.shape, width) if whole else known_x[:, :width].astype(np.int64) @ known_y[:, :width].astype(np.int64).T
    return total, n


def _lengths(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        total += x[:, i] * x[:, i]
    return np.sqrt(total) + ANALYZER_EPS


def tile(x: np.ndarray, y: np.ndarray, known_x: np.ndarray, known_y: np.ndarray, metric: str) -> pa.Array:
    """Distances of all rows of x to all of y, row by row; null for rows without a coordinate in common."""
    out, n = np.empty((len(x), len(y))), np.empty((len(x), len(y)), np.int64)
    by_coordinate = np.asfortranarray(y)
    for first in range(0, len(x), STRIP_ROWS):
        strip = slice(first, first + STRIP_ROWS)
        out[strip], n[strip] = _summed(x[strip], by_coordinate, known_x[strip], known_y, metric)
    if metric == "euclidean":
        out = np.sqrt(out)
    else:
        out = 1.0 - out / np.multiply.outer(_lengths(x), _lengths(y))
    return pa.array(out.ravel(), mask=n.ravel() == 0)


def pairwise_distances(a: DataFrame, b: DataFrame, metric: str = "euclidean") -> DataFrame:
    """All rows of one set against all rows of another; both hold (row_id, embedding): row_a, row_b, distance.

    Coordinates that are null or beyond the end of the other vector are left out, as a sum over a list
    does; a vector that is null or empty has null distances.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    sides = [df.select("row_id", F.col("embedding").cast("array<double>").alias("embedding")) for df in (a, b)]
    n_a, n_b = (r["n"] for r in sides[0].agg(F.count("*").alias("n")).unionAll(sides[1].agg(F.count("*").alias("n"))).collect())
    parts = [max(1, math.ceil(n / PART_ROWS)) for n in (n_a, n_b)]
    partitions = min(parts[0] * parts[1], MOST_PARTITIONS)

    def dealt(k: int) -> DataFrame:
        own, other = F.pmod(F.xxhash64("row_id"), F.lit(parts[k])).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(parts[1 - k] - 1)))
        placed = sides[k].withColumn("own", own).withColumn("other", other)
        return placed.select(*[F.col(c).alias(t) for c, t in zip(("own", "other") if k == 0 else ("other", "own"), ("tile_a", "tile_b"))], F.col("row_id").alias(f"row_{'ab'[k]}"), F.col("embedding").alias(f"embedding_{'ab'[k]}")).repartition(partitions, "tile_a", "tile_b")

    kinds = [df.schema["row_id"].dataType for df in sides]
    empty = pa.table({"row_a": pa.array([], to_arrow_type(kinds[0])), "row_b": pa.array([], to_arrow_type(kinds[1])), "distance": pa.array([], pa.float64())})
    keys = ["tile_a", "tile_b"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:  # such a side has no columns either
            return empty
        (x, known_x), (y, known_y) = _dense(left["embedding_a"]), _dense(right["embedding_b"])
        at_a, at_b = np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x))
        return pa.table({"row_a": left["row_a"].take(pa.array(at_a)), "row_b": right["row_b"].take(pa.array(at_b)), "distance": tile(x, y, known_x, known_y, metric)})

    return dealt(0).groupBy(*keys).cogroup(dealt(1).groupBy(*keys)).applyInArrow(run, f"row_a {kinds[0].simpleString()}, row_b {kinds[1].simpleString()}, distance double")
