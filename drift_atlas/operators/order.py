"""Ranks and order statistics of groups of any size, with no group sorted in one task.

Ranks: the distinct values of a group are counted first, with map-side combine, so a
value that a third of the rows share is one row. Splitters from a mergeable sketch cut
the values into ranges; a running count within a range and the counts of the ranges before it
give every value's rank. Equal values are one row, so ties never straddle ranges.

Order statistics: the interval that holds the k-th value is cut into cells, rows
are counted by cell, and the cell that holds the k-th becomes the interval; after two
passes few distinct values are left, which a window reads off. What is kept between
passes is one row for each group and value asked for. Distances of all pairs of a set
go through the same passes straight from blocks of vectors, so pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drift_atlas.operators import distance as dist
from drift_atlas.sources.staging import staged

#: Ranges of a group's values, cells of an interval, passes before the rest is put in order, rows of a table that is broadcast.
RANGES, CELLS, PASSES, BROADCAST_ROWS = 64, 4096, 2, 50_000


def settled(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A table that is computed once: with at most ``most`` rows, which is checked, it is broadcast; a larger one is written and joined by shuffles."""
    few = table.limit(most + 1).collect()
    if len(few) <= most:
        return F.broadcast(table.sparkSession.createDataFrame(few, table.schema))
    return staged(table, "settled")


def met(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beside the table's rows of their keys; null meets null."""
    other = table.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(other, same).drop(*[f"__{k}" for k in keys])


# Ranks ----------------------------------------------------------------------


def _ranged(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with ``__range``: how many of their group's splitters their value reaches."""
    at = [(k + 1) / RANGES for k in range(RANGES - 1)]
    splits = rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx(value, at, 1000))).alias("__splits"))
    found = met(rows, settled(splits), keys)
    return found.withColumn("__range", F.size(F.filter("__splits", lambda s: s <= F.col(value)))).drop("__splits")


def running_count(rows: DataFrame, keys: list[str], value: str, n: Column, out: str) -> DataFrame:
    """Rows of distinct values with the sum of ``n`` over the group's values up to theirs."""
    ranged = _ranged(rows, keys, value).withColumn("__n", n)
    sums = ranged.groupBy(*keys, "__range").agg(F.sum("__n").alias("__all"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "__range", F.coalesce(F.sum("__all").over(earlier), F.lit(0)).alias("__before"))
    within = F.sum("__n").over(Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return met(ranged.withColumn(out, within), before, [*keys, "__range"]).withColumn(out, F.col(out) + F.col("__before")).drop("__range", "__n", "__before")


def ranked_values(rows: DataFrame, keys: list[str], value: str, *more: Column) -> DataFrame:
    """Every distinct value of a group with ``n`` rows, its mid-rank ``rank``, and further aggregates over its rows."""
    values = staged(rows.groupBy(*keys, value).agg(F.count("*").alias("n"), *more), "values")
    upto = running_count(values, keys, value, F.col("n"), "__upto")
    return upto.withColumn("rank", (F.col("__upto") - F.col("n") + 1).cast("double") + (F.col("n") - 1).cast("double") / F.lit(2.0)).drop("__upto")


def mid_ranks(rows: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """Rows with the mid-rank of each value among those of their group, under new names.

    Ranks meet the rows by value, so the rows are staged: computed again, sums of doubles that
    came in another order would differ in their last digits and meet nothing.
    """
    rows = staged(rows, "ranked-rows")
    for value, out in values.items():
        ranks = ranked_values(rows, keys, value).select(*keys, value, F.col("rank").alias(out))
        rows = met(rows, ranks, [*keys, value])
    return rows


def numbered(rows: DataFrame, keys: list[str], by: str, out: str) -> DataFrame:
    """Rows numbered from 0 within their group in the order of ``by``, which is unique there."""
    return running_count(rows, keys, by, F.lit(1), out).withColumn(out, (F.col(out) - 1).cast("long"))


# Order statistics -----------------------------------------------------------


class Rows:
    """Values that are a column."""

    def __init__(self, rows: DataFrame, keys: list[str], value: str):
        self.keys, self.table = keys, rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("__v"))

    def bounds(self) -> DataFrame:
        return self.table.groupBy(*self.keys).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))

    def _inside(self, asked: DataFrame) -> DataFrame:
        return met(self.table, asked, self.keys).where(F.col("__v").between(F.col("lo"), F.col("hi")))

    def cells(self, asked: DataFrame) -> DataFrame:
        cell = F.least(F.floor((F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS), F.lit(CELLS - 1))
        rows = self._inside(asked).withColumn("cell", F.when(F.col("hi") > F.col("lo"), cell).otherwise(0))
        return rows.groupBy(*self.keys, "k", "before", "cell").agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))

    def values(self, asked: DataFrame) -> DataFrame:
        return self._inside(asked).groupBy(*self.keys, "k", "before", "__v").agg(F.count("*").alias("n"))


class PairDistances:
    """Cosine distances of all pairs of distinct rows of a set, block by block."""

    keys = ["set_id"]

    def __init__(self, vectors: DataFrame):
        packed = staged(dist.blocks(vectors), "blocks")
        a, b = (packed.select("set_id", F.col("block").alias(f"block_{s}"), F.col("flat").alias(f"flat_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
        self.pairs = met(a, b, ["set_id"]).where("block_a <= block_b")
        self.kind = vectors.schema["set_id"].dataType.simpleString()

    def _fold(self, pairs: DataFrame, of_pair, schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    at = {c: batch.column(c)[row] for c in batch.schema.names}
                    found = of_pair(_cosines(at), at)
                    size = len(next(iter(found.values())))
                    yield pa.RecordBatch.from_arrays([pa.array([at["set_id"].as_py()] * size, batch.schema.field("set_id").type), *map(pa.array, found.values())], names=["set_id", *found])

        return pairs.mapInArrow(run, f"set_id {self.kind}, {schema}")

    def bounds(self) -> DataFrame:
        def of_pair(d, _):
            return {"n": np.array([len(d)], np.int64), "lo": np.array([d.min() if len(d) else np.inf]), "hi": np.array([d.max() if len(d) else -np.inf])}

        return self._fold(self.pairs, of_pair, "n long, lo double, hi double").groupBy("set_id").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("n > 0")

    def _asked(self, asked: DataFrame) -> DataFrame:
        every = asked.groupBy("set_id").agg(F.collect_list(F.struct("k", "before", "lo", "hi")).alias("asked"))
        return met(self.pairs, every, ["set_id"])

    def cells(self, asked: DataFrame) -> DataFrame:
        def of_pair(d, at):
            out = {c: [] for c in ("k", "before", "cell", "n", "lo", "hi")}
            for k, before, lo, hi in _wanted(at):
                own = d[(d >= lo) & (d <= hi)]
                cell = np.minimum(np.floor((own - lo) / (hi - lo) * CELLS), CELLS - 1).astype(np.int64) if hi > lo else np.zeros(len(own), np.int64)
                order = np.argsort(cell, kind="stable")
                found, first = np.unique(cell[order], return_index=True)
                groups = np.split(own[order], first[1:]) if len(found) else []
                for c, g in zip(found, groups):
                    for name, v in zip(out, (k, before, int(c), len(g), float(g.min()), float(g.max()))):
                        out[name].append(v)
            return {c: np.array(v, np.float64 if c in ("lo", "hi") else np.int64) for c, v in out.items()}

        cells = self._fold(self._asked(asked), of_pair, "k long, before long, cell long, n long, lo double, hi double")
        return cells.groupBy("set_id", "k", "before", "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def values(self, asked: DataFrame) -> DataFrame:
        def of_pair(d, at):
            out = {"k": [], "before": [], "__v": []}
            for k, before, lo, hi in _wanted(at):
                own = d[(d >= lo) & (d <= hi)]
                for name, v in zip(out, (np.full(len(own), k, np.int64), np.full(len(own), before, np.int64), own)):
                    out[name].append(v)
            return {c: np.concatenate(v) for c, v in out.items()}

        return self._fold(self._asked(asked), of_pair, "k long, before long, __v double").groupBy("set_id", "k", "before", "__v").agg(F.count("*").alias("n"))


def _cosines(at: dict) -> np.ndarray:
    """The distances of a pair of blocks; of a block with itself, each pair of rows once."""
    x, y = (np.array(at[f"flat_{s}"].values, float).reshape(at[f"n_{s}"].as_py(), -1) for s in "ab")
    norms = [np.sqrt((z * z).sum(axis=1)) + dist.PAIRED_EPS for z in (x, y)]
    d = 1 - (x @ y.T) / (norms[0][:, None] * norms[1])
    return d[np.triu_indices(len(x), 1)] if at["block_a"].as_py() == at["block_b"].as_py() else d.ravel()


def _wanted(at: dict) -> list[tuple]:
    return [(w["k"], w["before"], w["lo"], w["hi"]) for w in at["asked"].as_py()]


def quantiles(source: Rows | PairDistances, shares: list[float], passes: int = PASSES) -> DataFrame:
    """The keys, ``q`` and the ``value`` at each share of a group's values, between two of them in proportion.

    Nulls and NaN are no values; a group without any has no row.
    """
    keys = source.keys
    bounds = settled(source.bounds())
    place = (F.col("n") - 1) * F.col("q")
    wanted = bounds.select("*", F.explode(F.array(*map(F.lit, shares))).alias("q")).select(*keys, "q", "lo", "hi", F.floor(place).alias("k0"), F.ceil(place).alias("k1"), (place - F.floor(place)).alias("part"))
    asked = wanted.select(*keys, "lo", "hi", F.explode(F.array_distinct(F.array("k0", "k1"))).alias("k")).distinct().withColumn("before", F.lit(0).cast("long"))
    for _ in range(passes):
        upto = F.sum("n").over(Window.partitionBy(*keys, "k").orderBy("cell"))
        cells = source.cells(settled(asked)).withColumn("__upto", F.col("before") + upto)
        asked = cells.where((F.col("__upto") > F.col("k")) & (F.col("__upto") - F.col("n") <= F.col("k"))).select(*keys, "lo", "hi", "k", (F.col("__upto") - F.col("n")).alias("before"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "k").orderBy("__v"))
    last = source.values(settled(asked)).withColumn("__upto", F.col("before") + upto)
    found = settled(last.where((F.col("__upto") > F.col("k")) & (F.col("__upto") - F.col("n") <= F.col("k"))).select(*keys, "k", "__v"))
    low, high = (found.select(*keys, F.col("k").alias(f"k{s}"), F.col("__v").alias(f"v{s}")) for s in "01")
    out = met(met(wanted, low, [*keys, "k0"]), high, [*keys, "k1"])
    return out.select(*keys, "q", (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("part")).alias("value"))


def median(source: Rows | PairDistances, out: str) -> DataFrame:
    """The keys and the median of each group."""
    return quantiles(source, [0.5]).withColumnRenamed("value", out).drop("q")
