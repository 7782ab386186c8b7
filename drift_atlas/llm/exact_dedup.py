"""Exact duplicates by content sort, with DataFrame operations only.

Sampled splitters deal the normalised texts into ranges, an external sort puts
equal texts next to each other, and a window whose group boundaries are full
comparisons of neighbouring texts names the survivor of each group.

Skew. The range key is a short prefix of the normalised text followed by a
64-bit hash of a coarser form of it, so texts that merely begin alike are still
spread, and splitters stay a few bytes long. A text with very many copies would
still fill one range. Such hot texts are found first by a count with map-side
combine, and their rows are spread over salts of ``slice_rows`` rows each, by their
place in the input, so rows that share an id are spread too; one row of every salted
slice carries the text on to a second full comparison.

Bounds. ``slice_rows`` grows with rows / partitions, so there are at most
``4 * partitions`` hot texts and, with ``rows / slice_rows + hot`` slices, at
most ``8 * partitions`` slice rows. Those two tables are the only ones that are
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drift_atlas.llm import common

#: Leading characters of a text that order the ranges.
PREFIX_CHARS = 32
#: Copies below which a text is never worth splitting.
LEAST_SLICE_ROWS = 64


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: bool = True) -> DataFrame:
    """One row per input row: its id, the id that survives, the group's size and whether it survives.

    Equality is that of texts after lower-casing A-Z; null counts as empty.
    ``keep`` is ``smallest`` or ``largest``, in the order of the ids' type, which may
    be any that sorts. Null ids sort behind all others. Of
    rows that repeat an id and its text exactly one survives, and each counts in
    ``group_size``. An empty table gives an empty result; columns other than the
    two named are ignored, so clashing names do no harm.

    Columns: the id, ``keep_id``, ``group_size`` long, ``kept`` boolean,
    ``text_sha256`` string.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    spark = docs.sparkSession
    width = common.partitions(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Lower-casing everything is coarser than lower-casing A-Z, so equal texts share this hash.
    rows = rows.withColumn("h", F.xxhash64(F.lower("text")))
    counts = rows.groupBy("h").agg(F.count("*").alias("n"))
    total = rows.select(F.count("*")).first()[0]
    slice_rows = max(LEAST_SLICE_ROWS, -(-total // (4 * width)))
    hot = counts.where(F.col("n") > slice_rows).select("h", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices"))
    hot = common.materialize(hot, "hot-texts")

    head = common.fold_case(F.substring("text", 1, PREFIX_CHARS)).alias("head")
    salt = F.when(F.col("slices").isNotNull(), F.pmod(F.xxhash64("place"), F.col("slices"))).otherwise(F.lit(-1)).cast("int").alias("salt")
    dealt = rows.withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(hot), "h", "left").select("id", head, "h", salt, "text")
    dealt = dealt.repartitionByRange(width, "head", "h", "salt")
    content = dealt.select("id", "head", "h", "salt", common.fold_case(F.col("text")).alias("norm"))

    order = _id_order(F.col("id"), keep)
    equal = Window.partitionBy("head", "h", "salt", "norm")
    ranked = equal.orderBy(order)
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    grouped = content.select(
        "id", "salt",
        F.row_number().over(ranked).alias("place"),
        F.first("id").over(whole).alias("best"),
        F.count("*").over(whole).alias("n"),
        "norm",
    )
    slices = grouped.select(
        "id", "salt", "place", "best", "n",
        F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
        F.when((F.col("salt") >= 0) & (F.col("place") == 1), F.col("norm")).alias("norm"),
    )
    slices = common.materialize(slices, "content-slices")

    heads = slices.where("norm is not null")
    best = F.min_by("best", F.struct(F.col("best").isNull(), "best")) if keep == "smallest" else F.max("best")
    groups = heads.groupBy("norm").agg(best.alias("group_best"), F.sum("n").alias("group_n"), F.first("sha").alias("sha"), _best_salt(keep).alias("best_salt"))
    groups = common.materialize(groups.select("sha", "group_best", "group_n", "best_salt"), "hot-groups")
    joined = slices.drop("norm").join(F.broadcast(groups), "sha", "left")
    cold = F.col("salt") < 0
    out = joined.select(
        F.col("id").alias(id_col),
        F.when(cold, F.col("best")).otherwise(F.col("group_best")).alias("keep_id"),
        F.when(cold, F.col("n")).otherwise(F.col("group_n")).cast("long").alias("group_size"),
        ((F.col("place") == 1) & (cold | (F.col("salt") == F.col("best_salt")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return out if digest else out.drop("text_sha256")


def _id_order(column: Column, keep: str) -> Column:
    return column.asc_nulls_last() if keep == "smallest" else column.desc_nulls_last()


def _best_salt(keep: str) -> Column:
    """The slice with the surviving id; of equal ids, the smallest salt."""
    best = F.col("best")
    return F.min_by("salt", F.struct(best.isNull(), best, "salt")) if keep == "smallest" else F.max_by("salt", F.struct(best.isNotNull(), best, -F.col("salt")))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that survive, with all their columns.

    Rows that repeat an id, its text included, survive together here only if
    their id survives; give each row an id of its own to have them dropped.
    """
    verdict = exact_duplicates(docs, id_col, text_col, keep, digest=False)
    stays = verdict.where("kept").select(F.col(id_col).alias("kept_id")).distinct()
    return common.rows_with_ids(docs, id_col, common.materialize(stays, "kept-ids"))
