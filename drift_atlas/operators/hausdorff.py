"""Hausdorff distances of sets by blocks that bounds have not ruled out.

Rows go to the nearest of a few pivots of their set, and each pivot's rows to blocks of
bounded size with a centre and a radius. By the triangle inequality the rows of two
blocks are at least (centres' distance less both radii) and at most (with both radii added)
apart. So of a block X only those blocks can hold the nearest row whose lower bound
is at most X's least upper bound; and X matters for the maximum only if that bound reaches the
largest of all blocks' least lower bounds. Only centres are compared for this; vectors move for
the pairs of blocks that are left, by groups of blocks, and one product of matrices serves both directions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from drift_atlas.operators import distance as dist
from drift_atlas.operators.order import settled
from drift_atlas.sources.staging import staged

#: Pivots of a set, sets whose pivots are sent to all tasks (with more, rows go to blocks by their hash), and what rounding may shift a bound by.
PIVOTS, MOST_SETS, SLACK = 32, 2000, 1e-9
#: Rows of a group of blocks, of which one task compares two at a time.
GROUP_ROWS = 16384


def _by_pivot(vectors: DataFrame) -> DataFrame:
    """Rows with the number of their set's nearest pivot, of which a set has about two a block: set_id, row_id, embedding, pivot."""
    first = Window.partitionBy("set_id").orderBy(F.xxhash64("row_id"), "row_id")
    chosen = vectors.withColumn("k", F.row_number().over(first)).where(F.col("k") <= PIVOTS).groupBy("set_id").agg(F.collect_list("embedding").alias("pivots"))
    rows = vectors.select("set_id", "row_id", "embedding")
    chosen = chosen.join(vectors.groupBy("set_id").agg(F.when(F.count("*") > dist.BLOCK_ROWS, 2 * F.ceil(F.count("*") / F.lit(dist.BLOCK_ROWS))).otherwise(1).alias("enough")), "set_id")
    sent = chosen.limit(MOST_SETS + 1).collect()
    if len(sent) > MOST_SETS or all(r["enough"] == 1 for r in sent):
        return rows.withColumn("pivot", F.lit(0))
    known = vectors.sparkSession.sparkContext.broadcast({r["set_id"]: np.array(r["pivots"][: r["enough"]]) for r in sent})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, flat = batch.column(0).to_pylist(), batch.column(2)
            pivot = np.zeros(batch.num_rows, np.int32)
            for s in set(sets):
                own = np.flatnonzero([x == s for x in sets])
                x, p = np.array(flat.take(pa.array(own)).flatten(), float).reshape(len(own), -1), known.value[s]
                pivot[own] = ((p * p).sum(axis=1) - 2 * (x @ p.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot)], names=[*batch.schema.names, "pivot"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    return rows.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", pivot int")


def _circled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed blocks with the centre of their rows and the largest distance from it."""
    for batch in batches:
        centres, radii = [], []
        for k in range(batch.num_rows):
            x = np.array(batch.column("flat")[k].values, float).reshape(batch.column("n")[k].as_py(), -1)
            centre = x.mean(axis=0)
            centres.append(centre)
            radii.append(float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(centres, pa.list_(pa.float64())), pa.array(radii, pa.float64())], names=[*batch.schema.names, "centre", "radius"])


def blocks(vectors: DataFrame) -> DataFrame:
    """set_id, block, flat, n, centre, radius of blocks of near rows; vectors that are null are left out."""
    rows = _by_pivot(vectors.where(F.col("set_id").isNotNull() & F.col("embedding").isNotNull()))
    sizes = rows.groupBy("set_id", "pivot").agg(F.ceil(F.count("*") / F.lit(dist.BLOCK_ROWS)).alias("parts"))
    dealt = rows.join(settled(sizes), ["set_id", "pivot"]).withColumn("block", F.concat_ws("|", "pivot", F.pmod(F.xxhash64("row_id"), F.col("parts"))))
    packed = dealt.groupBy("set_id", "block").agg(F.flatten(F.collect_list("embedding")).alias("flat"), F.count("*").alias("n"))
    kind = packed.schema["set_id"].dataType.simpleString()
    return packed.mapInArrow(_circled, f"set_id {kind}, block string, flat array<double>, n long, centre array<double>, radius double")


def block_pairs(packed: DataFrame) -> DataFrame:
    """All pairs of blocks of sets a < b: a, b, block_a, block_b, and whether each side has to look in the other block."""
    circles = packed.select("set_id", "block", "centre", "radius")
    sets = circles.select("set_id").distinct()
    pairs = sets.select(F.col("set_id").alias("a")).join(sets.select(F.col("set_id").alias("b")), F.col("a") < F.col("b"))
    side = lambda s: circles.select(F.col("set_id").alias(s), F.col("block").alias(f"block_{s}"), F.col("centre").alias(f"centre_{s}"), F.col("radius").alias(f"radius_{s}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    gap, spread = dist.euclidean(F.col("centre_a"), F.col("centre_b")), F.col("radius_a") + F.col("radius_b")
    slack = F.lit(SLACK) * (1 + F.col("gap") + spread)
    met = met.withColumn("gap", gap).select("a", "b", "block_a", "block_b", F.greatest(F.col("gap") - spread - slack, F.lit(0.0)).alias("lower"), (F.col("gap") + spread + slack).alias("upper"))
    for s in "ab":
        own = Window.partitionBy("a", "b", f"block_{s}")
        met = met.withColumns({f"upper_{s}": F.min("upper").over(own), f"lower_{s}": F.min("lower").over(own)})
    whole = met.groupBy("a", "b").agg(F.max("lower_a").alias("least_a"), F.max("lower_b").alias("least_b"))
    met = met.join(settled(whole), ["a", "b"])
    look = {f"look_{s}": (F.col("lower") <= F.col(f"upper_{s}")) & (F.col(f"upper_{s}") >= F.col(f"least_{s}")) for s in "ab"}
    return met.select("a", "b", "block_a", "block_b", *[test.alias(name) for name, test in look.items()])


def _grouped(packed: DataFrame) -> DataFrame:
    """Blocks with the number of their group, neighbouring blocks of a set with about so many rows in all: set_id, block, part."""
    before = F.sum("n").over(Window.partitionBy("set_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return packed.select("set_id", "block", F.floor(F.coalesce(before, F.lit(0)) / F.lit(GROUP_ROWS)).alias("part"))


def _nearest(kind: pa.DataType):
    """For two groups of blocks each row's distance to its nearest row in the blocks of the other group that are left, block by block."""
    schema = pa.schema([("a", kind), ("b", kind), ("side", pa.string()), ("block", pa.string()), ("near", pa.list_(pa.float64()))])

    def held(table: pa.Table, s: str) -> dict[str, np.ndarray]:
        flat = table[f"flat_{s}"].combine_chunks()
        return {name: np.array(flat[k].values, float).reshape(n, -1) for k, (name, n) in enumerate(zip(table[f"block_{s}"].to_pylist(), table[f"n_{s}"].to_pylist()))}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        rows, found = {"a": held(left, "a"), "b": held(right, "b")}, {}
        squares = {s: {name: (x * x).sum(axis=1) for name, x in rows[s].items()} for s in "ab"}
        for block_a, others in zip(left["block_a"].to_pylist(), left["others"].to_pylist()):
            x = rows["a"][block_a]
            for other in others:
                y = rows["b"][other["block_b"]]
                near = squares["a"][block_a][:, None] + squares["b"][other["block_b"]] - 2 * (x @ y.T)
                # The product finds the nearest row; its distance is then taken from the difference.
                for s, block, own, theirs, axis in (("a", block_a, x, y, 1), ("b", other["block_b"], y, x, 0)):
                    if other[f"look_{s}"]:
                        d = np.sqrt(((own - theirs[near.argmin(axis=axis)]) ** 2).sum(axis=1))
                        found[s, block] = np.minimum(found[s, block], d) if (s, block) in found else d
        sets = [pa.array([table[name][0].as_py()] * len(found), kind) for table, name in ((left, "a"), (left, "b"))]
        return pa.Table.from_arrays([*sets, pa.array([s for s, _ in found], pa.string()), pa.array([block for _, block in found], pa.string()), pa.array(list(found.values()), pa.list_(pa.float64()))], schema=schema)

    return run


def hausdorff_pairs(vectors: DataFrame) -> DataFrame:
    """Hausdorff distance of all pairs of sets a < b.

    Blocks travel by groups: two groups that have a pair of blocks left meet in one task, which holds
    these two, whatever the sets' sizes. So a block is sent once for each group that it meets, not for each block.
    """
    packed = staged(blocks(vectors), "blocks")
    parts = settled(_grouped(packed))
    part = lambda s: parts.select(F.col("set_id").alias(s), F.col("block").alias(f"block_{s}"), F.col("part").alias(f"part_{s}"))
    left = staged(block_pairs(packed).where("look_a or look_b").join(part("a"), ["a", "block_a"]).join(part("b"), ["b", "block_b"]), "block-pairs")
    meet = ["a", "part_a", "b", "part_b"]
    pairs = {
        "a": left.groupBy(*meet, "block_a").agg(F.collect_list(F.struct("block_b", "look_a", "look_b")).alias("others")),
        "b": left.select(*meet, "block_b").distinct(),
    }

    def sent(s: str, more: list[str]) -> DataFrame:
        side = packed.select(F.col("set_id").alias(s), F.col("block").alias(f"block_{s}"), F.col("flat").alias(f"flat_{s}"), F.col("n").alias(f"n_{s}"))
        met = pairs[s].join(side, [s, f"block_{s}"])
        # Columns of both sides of a cogroup need names of their own.
        return met.select(*[F.col(c).alias(c if s == "a" else f"their_{c}") for c in meet], f"block_{s}", f"flat_{s}", f"n_{s}", *more)

    kind = packed.schema["set_id"].dataType
    met = sent("a", ["others"]).groupBy(*meet).cogroup(sent("b", []).groupBy(*[f"their_{c}" for c in meet]))
    near = met.applyInArrow(_nearest(to_arrow_type(kind)), f"a {kind.simpleString()}, b {kind.simpleString()}, side string, block string, near array<double>")
    minima = near.select("a", "b", "side", "block", F.posexplode("near").alias("place", "d"))
    minima = minima.groupBy("a", "b", "side", "block", "place").agg(F.min("d").alias("d"))
    return minima.groupBy("a", "b").agg(F.max("d").alias("hausdorff"))
