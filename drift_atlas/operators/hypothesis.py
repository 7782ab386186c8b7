"""Rank tests and multiple-testing correction."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drift_atlas.operators import order


def signed_rank(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """One-sided signed-rank statistic of a > b: n, n_nonzero, ties, stat and z by key.

    Zero differences are left out; z has no continuity correction and is null where no
    difference is left. All of it is summed over distinct differences and their ranks.
    """
    marked = pairs.withColumn("__d", F.col(a) - F.col(b))
    sizes = marked.groupBy(*keys).agg(F.count("*").alias("n"))
    nonzero = marked.where("__d <> 0").withColumn("__abs", F.abs("__d"))
    ranked = order.ranked_values(nonzero.select(*keys, "__d", "__abs"), keys, "__abs", F.count_if(F.col("__d") > 0).alias("__up"))
    t = F.col("n").cast("double")
    stats = ranked.groupBy(*keys).agg(F.sum("n").alias("n_nonzero"), F.sum(F.col("__up") * F.col("rank")).alias("stat"), F.sum(t * (t * t - 1)).alias("__tie"), (F.max("n") > 1).alias("ties"))
    m = F.col("n_nonzero").cast("double")
    spread = m * (m + 1) * (2 * m + 1) / 24 - F.col("__tie") / 48
    out = sizes.join(stats, keys, "left").withColumn("z", F.when(spread > 0, (F.col("stat") - m * (m + 1) / 4) / F.sqrt(spread)))
    return out.select(*keys, "n", F.coalesce("n_nonzero", F.lit(0).cast("long")).alias("n_nonzero"), F.coalesce("ties", F.lit(False)).alias("ties"), F.coalesce("stat", F.lit(0.0)).alias("stat"), "z")


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def exact_signed_rank_sf(stat: float, n: int) -> float:
    """P(W >= stat) under the null, without zeros or ties, from the counts of rank sums."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1
    for r in range(1, n + 1):
        counts[r:] += counts[:-r].copy()
    return float(counts[int(math.ceil(stat)) :].sum() / counts.sum())


@F.pandas_udf(T.DoubleType())
def signed_rank_p(n: pd.Series, nonzero: pd.Series, ties: pd.Series, stat: pd.Series, z: pd.Series) -> pd.Series:
    """p of the one-sided test: exact up to 50 rows without zeros and ties, else normal; null without differences."""
    out = []
    for total, m, tied, w, score in zip(n, nonzero, ties, stat, z, strict=True):
        if not m:
            out.append(None)
        elif total <= 50 and m == total and not tied:
            out.append(exact_signed_rank_sf(w, int(m)))
        else:
            out.append(normal_sf(score) if score is not None and score == score else None)
    return pd.Series(out, dtype="float64")


def holm(tests: DataFrame, p: str, family: list[str], tie_break: list[str]) -> DataFrame:
    """Step-down adjusted p-values within each family; null and NaN come last, become 1, and count as tests."""
    known = F.when(~F.isnan(p), F.col(p))
    order = Window.partitionBy(*family).orderBy(known.asc_nulls_last(), *tie_break)
    m, k = F.count("*").over(Window.partitionBy(*family)), F.row_number().over(order)
    step = F.when(known.isNotNull(), F.least(F.lit(1.0), (m - k + 1) * known)).otherwise(F.lit(1.0))
    staged = tests.withColumn("__step", step).withColumn("__known", known)
    running = Window.partitionBy(*family).orderBy(F.col("__known").asc_nulls_last(), *tie_break).rowsBetween(Window.unboundedPreceding, 0)
    return staged.withColumn("p_holm", F.max("__step").over(running)).drop("__step", "__known")


def spearman(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Pearson correlation of mid-ranks and the number of pairs, by key."""
    ranked = order.mid_ranks(pairs.select(*keys, x, y), keys, {x: "__rx", y: "__ry"})
    return ranked.groupBy(*keys).agg(F.corr("__rx", "__ry").alias("rho"), F.count("*").alias("n_pairs"))


def student_sf(t: float, df: float) -> float:
    """P(T >= t) of Student's distribution, from the incomplete beta function."""
    half = 0.5 * _incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    # Modified Lentz evaluation of the continued fraction.
    tiny = 1e-300
    c, d, value = 1.0, 0.0, 1.0
    for k in range(400):
        m = k // 2
        if k == 0:
            term = 1.0
        elif k % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d if abs(1 + term * d) > tiny else tiny)
        c = 1 + term / c if abs(1 + term / c) > tiny else tiny
        value *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (value - 1)


@F.pandas_udf(T.DoubleType())
def spearman_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a rank correlation; null below ten pairs."""
    out = []
    for r, k in zip(rho, n, strict=True):
        if r is None or r != r or k < 10:
            out.append(None)
        else:
            out.append(2 * student_sf(abs(r) * math.sqrt((k - 2) / max(1 - r * r, 1e-300)), k - 2))
    return pd.Series(out, dtype="float64")
