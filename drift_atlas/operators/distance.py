"""Distances between vector sets and between vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drift_atlas.operators.moments import RIDGE

PAIRED_EPS, ANALYZER_EPS = 1e-12, 1e-8


def frechet_terms(a: str, b: str, ridge: float = RIDGE) -> tuple[str, str]:
    """SQL of the mean term and the trace term of two planar Gaussians, given the prefixes of their columns.

    In two dimensions the trace of the root of P is sqrt(tr P + 2 sqrt(det P)).
    """
    e = f"CAST({ridge!r} AS DOUBLE)"
    mean = f"(({a}mx - {b}mx) * ({a}mx - {b}mx) + ({a}my - {b}my) * ({a}my - {b}my))"
    det = lambda s: f"(({s}cxx + {e}) * ({s}cyy + {e}) - {s}cxy * {s}cxy)"
    trace = f"(({a}cxx + {e}) * ({b}cxx + {e}) + CAST(2 AS DOUBLE) * {a}cxy * {b}cxy + ({a}cyy + {e}) * ({b}cyy + {e}))"
    root = f"sqrt(greatest({trace} + CAST(2 AS DOUBLE) * sqrt(greatest({det(a)} * {det(b)}, CAST(0 AS DOUBLE))), CAST(0 AS DOUBLE)))"
    return mean, f"greatest({a}cxx + {a}cyy + {b}cxx + {b}cyy + CAST(4 AS DOUBLE) * {e} - CAST(2 AS DOUBLE) * {root}, CAST(0 AS DOUBLE))"


def frechet_sql(a: str, b: str, ridge: float = RIDGE) -> str:
    """SQL of the planar Fréchet distance; equal moments give exactly 0."""
    mean, trace = frechet_terms(a, b, ridge)
    same = " AND ".join(f"{a}{c} = {b}{c}" for c in ("mx", "my", "cxx", "cxy", "cyy"))
    return f"(CASE WHEN {same} THEN CAST(0 AS DOUBLE) ELSE {mean} + {trace} END)"


MOMENT_COLUMNS = ("n", "mx", "my", "cxx", "cxy", "cyy")


def side(moments: DataFrame, prefix: str, *keys: str) -> DataFrame:
    """Moments with prefixed columns, for one side of a join."""
    return moments.select(*[F.col(c).alias(f"{prefix}{c}") for c in (*keys, *MOMENT_COLUMNS)])


def both_sides(moments: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row a key with the moments where ``by`` is 0 and 1 as a_ and b_; keys that lack a side or have a null go.

    An aggregation of the moments, not a join of them with themselves, so the rows behind them are read once.
    """
    sides = [F.max(F.when(F.col(by) == k, F.col(c))).alias(f"{p}{c}") for k, p in ((0, "a_"), (1, "b_")) for c in MOMENT_COLUMNS]
    met = moments.groupBy(*keys).agg(*sides).where("a_n is not null and b_n is not null")
    return met.dropna(subset=keys)


def plane_pairs(moments: DataFrame, inclusive: bool = False) -> DataFrame:
    """Distance of every pair of sets a < b (a <= b): the moments are one row a set, whatever the sets' sizes."""
    a, b = side(moments, "a_", "set_id"), side(moments, "b_", "set_id")
    test = F.col("a_set_id") <= F.col("b_set_id") if inclusive else F.col("a_set_id") < F.col("b_set_id")
    return a.join(b, test).select(F.col("a_set_id").alias("a"), F.col("b_set_id").alias("b"), F.expr(frechet_sql("a_", "b_")).alias("fmd"))


def frechet(mean_a: np.ndarray, cov_a: np.ndarray, mean_b: np.ndarray, cov_b: np.ndarray, ridge: float = RIDGE) -> float:
    """Fréchet distance of two Gaussians; the trace of the root comes from a symmetric eigenproblem, so it is real."""
    if mean_a.shape != mean_b.shape:
        raise ValueError("the sets differ in dimension")
    if np.array_equal(mean_a, mean_b) and np.array_equal(cov_a, cov_b):
        return 0.0
    return frechet_of_root(mean_a, covariance_root(cov_a, ridge), mean_b, cov_b, ridge)


def covariance_root(cov: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """The symmetric root of a covariance with its ridge."""
    values, vectors = np.linalg.eigh(cov + ridge * np.eye(len(cov)))
    return (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T


def frechet_of_root(mean_a: np.ndarray, root_a: np.ndarray, mean_b: np.ndarray, cov_b: np.ndarray, ridge: float = RIDGE) -> float:
    """The distance, where the root of the first covariance is known."""
    cov_b = cov_b + ridge * np.eye(len(cov_b))
    inner = np.linalg.eigvalsh(root_a @ cov_b @ root_a)
    trace = (root_a * root_a).sum() + np.trace(cov_b) - 2 * np.sqrt(np.maximum(inner, 0)).sum()
    return float(((mean_a - mean_b) ** 2).sum() + max(trace, 0.0))


def frechet_low_rank(a: np.ndarray, b: np.ndarray, ridge: float = RIDGE) -> float:
    """The same distance from the rows, inside the span of both centred sets.

    Outside the span both covariances are the ridge alone, which cancels; so this
    is exact and cheap where there are fewer rows than dimensions.
    """
    mean_a, mean_b = a.mean(axis=0), b.mean(axis=0)
    rows = np.vstack((a - mean_a, b - mean_b))
    values, vectors = np.linalg.eigh(rows @ rows.T)
    keep = values > max(values.max(initial=0), 1e-300) * 1e-12
    coordinates = vectors[:, keep] * np.sqrt(values[keep])
    cov = lambda x: x.T @ x / (len(x) - 1) if len(x) > 1 else np.zeros((x.shape[1], x.shape[1]))
    zero = np.zeros(int(keep.sum()))
    spread = frechet(zero, cov(coordinates[: len(a)]), zero, cov(coordinates[len(a) :]), ridge)
    return float(((mean_a - mean_b) ** 2).sum() + spread)


def _square(x) -> np.ndarray:
    return np.asarray(x).reshape(int(len(x) ** 0.5), -1)


def root_traces(moments: DataFrame) -> DataFrame:
    """Trace of the root of the product of two sets' covariances, for all pairs a < b.

    The product has the eigenvalues of the symmetric root-a * cov-b * root-a; a root is
    taken once a set. What is not finite counts as 0.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def roots(cov: pd.Series) -> pd.Series:
        return pd.Series([covariance_root(np.nan_to_num(_square(c)), 0.0).ravel() for c in cov])

    @F.pandas_udf(T.DoubleType())
    def traces(root: pd.Series, cov: pd.Series) -> pd.Series:
        return pd.Series([float(np.sqrt(np.maximum(np.linalg.eigvalsh(_square(r) @ np.nan_to_num(_square(c)) @ _square(r)), 0)).sum()) for r, c in zip(root, cov, strict=True)])

    a = moments.select(F.col("set_id").alias("a"), roots("cov").alias("root"))
    b = moments.select(F.col("set_id").alias("b"), "cov")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", traces("root", "cov").alias("root_trace"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _roots(cov: pd.Series) -> pd.Series:
    return pd.Series([covariance_root(_square(c)).ravel() for c in cov])


@F.pandas_udf(T.DoubleType())
def _distances(ma: pd.Series, ca: pd.Series, ra: pd.Series, mb: pd.Series, cb: pd.Series) -> pd.Series:
    out = []
    for mean_a, cov_a, root_a, mean_b, cov_b in zip(ma, ca, ra, mb, cb, strict=True):
        same = np.array_equal(mean_a, mean_b) and np.array_equal(cov_a, cov_b)
        out.append(0.0 if same else frechet_of_root(np.asarray(mean_a), _square(root_a), np.asarray(mean_b), _square(cov_b)))
    return pd.Series(out)


def full_distances(a: DataFrame, b: DataFrame, test, keys_a: dict[str, str], keys_b: dict[str, str]) -> DataFrame:
    """Distance of the moments that meet; the keys are named anew. The root of a set is taken once, before the join."""
    x = a.select(*[F.col(c).alias(f"a_{c}") for c in dict.fromkeys([*keys_a, "mean", "cov"])], _roots("cov").alias("a_root"), F.col("n").alias("a_n"))
    y = b.select(*[F.col(c).alias(f"b_{c}") for c in dict.fromkeys([*keys_b, "mean", "cov"])], F.col("n").alias("b_n"))
    fmd = _distances("a_mean", "a_cov", "a_root", "b_mean", "b_cov").alias("fmd")
    return x.join(y, test).select(*[F.col(f"a_{c}").alias(n) for c, n in keys_a.items()], *[F.col(f"b_{c}").alias(n) for c, n in keys_b.items()], "a_n", "b_n", fmd)


def full_pairs(moments: DataFrame) -> DataFrame:
    """Distance of every pair of sets a < b in full dimension, from their moments."""
    return full_distances(moments, moments, F.col("a_set_id") < F.col("b_set_id"), {"set_id": "a"}, {"set_id": "b"}).drop("a_n", "b_n")


def diagonal_pairs(vectors: DataFrame) -> DataFrame:
    """Fréchet distance of sets under diagonal covariances, in any dimension, with aggregates only."""
    from drift_atlas.operators.moments import elements

    stats = elements(vectors).groupBy("set_id", "i").agg(F.avg("v").alias("m"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("s"))
    a, b = stats.alias("a"), stats.alias("b")
    met = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.set_id") < F.col("b.set_id")))
    gap = lambda c: F.pow(F.col(f"a.{c}") - F.col(f"b.{c}"), 2)
    return met.groupBy(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b")).agg(F.sum(gap("m") + gap("s")).alias("fmd"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column, eps: float) -> Column:
    """1 - cosine, each norm with eps added."""
    return F.lit(1.0) - dot(a, b) / ((F.sqrt(dot(a, a)) + F.lit(eps)) * (F.sqrt(dot(b, b)) + F.lit(eps)))


#: Rows of a block, of which one task compares two at a time.
BLOCK_ROWS = 512


def blocks(vectors: DataFrame, rows: int | None = None) -> DataFrame:
    """Vectors packed by set into blocks of about so many: set_id, block, flat (all numbers), n."""
    sizes = vectors.groupBy(F.col("set_id").alias("__set")).agg(F.ceil(F.count("*") / F.lit(rows or BLOCK_ROWS)).alias("parts"))
    dealt = vectors.join(sizes, F.col("set_id").eqNullSafe(F.col("__set"))).withColumn("block", F.pmod(F.xxhash64("row_id"), F.col("parts")))
    return dealt.groupBy("set_id", "block").agg(F.flatten(F.collect_list("embedding")).alias("flat"), F.count("*").alias("n"))


def placed(rows: DataFrame, value: str, tie: str) -> DataFrame:
    """Rows of a report, largest value first, with their places; a report is few rows."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc(value), tie)).cast("long"))


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair."""
    other = pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "fmd")
    return pairs.select("a", "b", "fmd").unionByName(other)


def rank_by_distance(pairs: DataFrame) -> DataFrame:
    """Every set's ranking of the others, nearest first; ties by set."""
    order = Window.partitionBy("a").orderBy("fmd", "b")
    return mirrored(pairs).select(F.col("a").alias("ref"), F.col("b").alias("set_id"), F.row_number().over(order).cast("long").alias("place"), "fmd")


def ranking_stability(rankings: DataFrame) -> DataFrame:
    """Mean concordant share over pairs of rankings (ranking, item, place); 1 for fewer than two.

    A pair of items is discordant if only one of the rankings puts the first strictly before the second.
    """
    a, b = rankings.alias("a"), rankings.alias("b")
    items = a.join(b, (F.col("a.ranking") == F.col("b.ranking")) & (F.col("a.item") < F.col("b.item")))
    order = items.select(F.col("a.ranking").alias("ranking"), F.col("a.item").alias("i"), F.col("b.item").alias("j"), (F.col("a.place") < F.col("b.place")).alias("less"))
    x, y = order.alias("x"), order.alias("y")
    met = x.join(y, (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & (F.col("x.ranking") < F.col("y.ranking")))
    scores = met.groupBy(F.col("x.ranking").alias("r"), F.col("y.ranking").alias("s")).agg(F.avg((F.col("x.less") == F.col("y.less")).cast("double")).alias("score"))
    return scores.agg(F.coalesce(F.avg("score"), F.lit(1.0)).alias("stability"))


def batch_summary(pairs: DataFrame) -> DataFrame:
    """Mean, median, population deviation, maximum and minimum of distances, NaN left out."""
    kept = pairs.where(~F.isnan("fmd"))
    return kept.agg(F.avg("fmd").alias("mean"), F.median("fmd").alias("median"), F.stddev_pop("fmd").alias("std"), F.max("fmd").alias("max"), F.min("fmd").alias("min"))
