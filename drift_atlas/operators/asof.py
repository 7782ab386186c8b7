"""As-of join: every row with the last mark at or before its time.

Rows and marks are brought together by key and cell of time, so the largest group is what one
cell of one key holds, however long a key's history is. Within a cell a running last
finds the mark; what the cells before it end with is one row a cell, carried on by a window over
a key's cells and joined back. The cost is linear in rows and marks, and no row
carries the marks of its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a cell.
CELL = 60.0


def last_mark(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, mark_at: str, tie: str, out: str = "mark", cell: float = CELL) -> DataFrame:
    """``rows`` with the struct ``out`` of the last mark whose ``mark_at`` is at most ``at``; null where there is none.

    Of marks at one time the one with the largest ``tie`` counts. A null key has marks of
    its own; a row with a null time has none, nor does a null ``mark_at`` mark anything. A
    ``mark_at`` of minus infinity comes before all times.
    """
    own = F.struct(*[F.col(c) for c in rows.columns])
    held = marks.where(F.col(mark_at).isNotNull())
    both = rows.select(*keys, F.col(at).cast("double").alias("__t"), F.lit(1).alias("__kind"), own.alias("__row")).unionByName(
        held.select(*keys, F.col(mark_at).cast("double").alias("__t"), F.lit(0).alias("__kind"), F.col(tie).alias("__tie"), F.struct(*[F.col(c) for c in marks.columns]).alias("__mark")), allowMissingColumns=True)
    both = both.withColumn("__cell", F.floor(F.col("__t") / F.lit(cell)))
    order = Window.partitionBy(*keys, "__cell").orderBy("__t", "__kind", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__seen", F.last("__mark", True).over(order)).where("__kind = 1").drop("__kind", "__mark", "__tie")

    # Rows only say which cells there are: an aggregate of structs sorts what it gets, so they come as distinct cells.
    cells = both.where("__kind = 1").select(*keys, "__cell").distinct()
    known = cells.unionByName(both.where("__kind = 0").select(*keys, "__cell", "__t", "__tie", "__mark"), allowMissingColumns=True)
    ends = known.groupBy(*keys, "__cell").agg(F.max_by("__mark", F.when(F.col("__mark").isNotNull(), F.struct("__t", "__tie"))).alias("__end"))
    earlier = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__carry", F.last("__end", True).over(earlier)).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__cell").alias("__c"), "__carry")
    same = F.col("__cell").eqNullSafe(F.col("__c"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    mark = F.when(F.col("__t").isNotNull(), F.coalesce("__seen", "__carry"))
    return found.join(carried, same).select("__row.*", mark.alias(out))
