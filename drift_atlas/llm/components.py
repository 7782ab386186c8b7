"""Connected components by alternating large-star and small-star rounds.

Each round is one aggregation with map-side combine and one equi-join of two
written tables, so a hub with very many links is split by the adaptive skew
join, and no link, label or component ever reaches the driver. Rounds grow with
the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drift_atlas.llm import common


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hook neighbours to the smallest of a vertex's neighbourhood; links are (u, v) with u > v."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    least = common.materialize(least, "star-least")
    hooked = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if large:
        hooked = hooked.where("u > v")
        # The vertex itself keeps its link to the smallest, so it stays in its component.
        own = least.where("u > m").select("u", F.col("m").alias("v"))
        hooked = hooked.unionByName(own)
    else:
        own = least.where("u > m").select("u", F.col("m").alias("v"))
        hooked = hooked.where("u > v").unionByName(own)
    out = common.materialize(hooked.distinct(), "star-links")
    common.discard(least, links)
    return out


def _all_stars(links: DataFrame) -> bool:
    """Whether every vertex either has one link, to a smaller one, or is the smallest of its links."""
    ends = links.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    degree = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return degree.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest vertex reachable from every vertex that has a link to another.

    ``links`` are undirected pairs of longs; repeats, loops and pairs with a null
    are allowed and add nothing. Columns: ``id``, ``component``.
    """
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    current = common.materialize(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while not _all_stars(current):
        current = _star(_star(current, large=True), large=False)
    # Stars: every vertex but a component's smallest has one link, to that smallest.
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
