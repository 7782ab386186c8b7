"""Deterministic resampling: random order and random draws come from md5 keys.

Any engine computes the same order, so every resampled statistic can be checked
elsewhere. Repetitions are rows of the plan, not a loop of the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drift_atlas.operators.order import met, numbered

#: Hex digits of a key by which a group's rows are counted before any are put in order.
CUT_DIGITS = 2


def key(seed: str, *parts: str) -> Column:
    """md5 of the seed and the parts, as hex; equal strings order alike everywhere."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(p).cast("string") for p in parts]).cast("binary"))


def draw(seed: str, *parts: str) -> Column:
    """A nonnegative long from the first eight hex digits of the key."""
    return F.conv(F.substring(key(seed, *parts), 1, 8), 16, 10).cast("long")


def repeated(df: DataFrame, reps: int) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))))


def sample(df: DataFrame, k: int, seed: str, by: list[str], id_col: str) -> DataFrame:
    """k rows of each group without replacement."""
    order = Window.partitionBy(*by).orderBy(key(seed, id_col), id_col)
    return df.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= k).drop("__place")


def with_cuts(df: DataFrame, keys: list[str], seed: str, id_col: str, places: list[Column], reps: int | None = None) -> DataFrame:
    """Rows with ``__order``, where they stand in their group's random order, and ``__at0``, ``__at1``, ..., what stands at the places.

    ``places`` are aggregates over a group, counted from 1; at a place of 0 stands null.
    With ``reps`` every row comes once for each ``rep``, with an order of its own. Ids are
    unique within a group.

    No group is sorted. Rows are counted by the first digits of their keys with map-side
    combine, which tells where a place lies; only the rows that share those digits, one
    in ``16 ** CUT_DIGITS``, are put in order. What stands at the places, one row a group
    with an array of ``reps``, is joined to the rows before they are repeated, so
    repeated rows are never shuffled.
    """
    group = [*keys, "rep"] if reps else keys
    name = key(seed, *[k for k in group if k == "rep"], id_col)
    digits = F.substring(name, 1, CUT_DIGITS)
    order = F.struct(name.alias("key"), F.col(id_col).alias("id"))
    thin = df.select(*keys, id_col)
    asked = df.groupBy(*keys).agg(F.array(*[p.cast("long") for p in places]).alias("__places"))

    counted = (repeated(thin, reps) if reps else thin).groupBy(*group, digits.alias("__digits")).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*group).orderBy("__digits"))
    coarse = met(counted.withColumn("__upto", upto), asked, keys).select(*group, "__digits", "__n", "__upto", F.posexplode("__places").alias("__which", "__place"))
    coarse = coarse.withColumn("__rest", F.col("__place") - F.col("__upto") + F.col("__n")).where("__rest between 1 and __n")
    wanted = coarse.groupBy(*keys).agg(F.collect_list(F.struct(*group[len(keys) :], "__which", "__digits", "__rest")).alias("__wanted"))

    close = met(thin, wanted, keys).select(*keys, id_col, F.inline("__wanted")).where(digits == F.col("__digits")).withColumn("__order", order)
    place = F.row_number().over(Window.partitionBy(*group, "__which").orderBy("__order"))
    found = close.withColumn("__place", place).where("__place = __rest").select(*group, "__which", "__order")
    every = asked.select(*keys)
    found = found.unionByName(repeated(every, reps) if reps else every, allowMissingColumns=True)
    at = [F.max(F.when(F.col("__which") == k, F.col("__order"))).alias(f"__at{k}") for k in range(len(places))]
    cuts = found.groupBy(*group).agg(*at)
    if reps:
        cuts = cuts.groupBy(*keys).agg(F.collect_list(F.struct("rep", *[f"__at{k}" for k in range(len(places))])).alias("__cuts"))
        return met(df, cuts, keys).select(*df.columns, F.inline("__cuts")).withColumn("__order", order)
    return met(df, cuts, keys).withColumn("__order", order)


def split_half(df: DataFrame, seed: str, keys: list[str], id_col: str = "row_id", reps: int | None = None) -> DataFrame:
    """Two random halves of each group, so many times over; of an odd number, the last row is dropped."""
    size = F.floor(F.count("*") / 2)
    placed = with_cuts(df, keys, seed, id_col, [size, 2 * size], reps)
    half = F.when(F.col("__order") <= F.col("__at0"), F.lit(0)).when(F.col("__order") <= F.col("__at1"), F.lit(1))
    return placed.withColumn("half", half.cast("long")).where("half is not null").drop("__order", "__at0", "__at1")


def indexed(df: DataFrame, keys: list[str], id_col: str = "row_id") -> DataFrame:
    """Rows numbered from 0 within their group."""
    return numbered(df, keys, id_col, "idx")


def bootstrap(df: DataFrame, reps: int, seed: str, cap: int | None = None) -> DataFrame:
    """Resamples with replacement of every set: set_id, rep, x, y; of the set's size or the cap, if that is less."""
    rows = indexed(df, ["set_id"])
    sizes = rows.groupBy("set_id").agg(F.count("*").alias("n"))
    size = F.col("n") if cap is None else F.least("n", F.lit(cap))
    drawn = sizes.select("set_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))).alias("rep"), size.cast("long").alias("size"))
    drawn = drawn.select("set_id", "rep", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("j"))
    drawn = drawn.select("set_id", "rep", (draw(seed, "set_id", "rep", "j") % F.col("n")).alias("idx"))
    # Uncapped draws are many times the rows and must not be what is broadcast.
    return drawn.join(rows.hint("shuffle_hash") if cap is None else rows, ["set_id", "idx"]).drop("idx")


def relabel(df: DataFrame, reps: int, seed: str, first_size: Column) -> DataFrame:
    """Pooled rows in random order for every repetition; the first ``first_size``, an aggregate over the pair, are side 0, the others 1."""
    placed = with_cuts(df, ["pair"], seed, "pooled_id", [first_size], reps)
    side = F.when(F.col("__order") <= F.col("__at0"), F.lit(0)).otherwise(F.lit(1))
    return placed.withColumn("side", side.cast("long")).drop("__order", "__at0")
