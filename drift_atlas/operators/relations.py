"""Relational steps of a study: pairing, alignment, guards, counters and report order.

All are joins and aggregates over keys, so Catalyst picks their strategy; only
``isolated`` runs Python, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Files below which a dataset, or a configuration of it, is left out of a study.
LEAST_FILES = 10
#: Meta messages that carry text and no music.
TEXT_META = ("text", "copyright", "track_name", "instrument_name", "lyrics", "marker", "cue_marker", "device_name")


def with_enough(rows: DataFrame, keys: list[str], least: int = LEAST_FILES) -> DataFrame:
    """Rows of the groups that have at least so many; the groups' sizes are counted with map-side combine."""
    fit = rows.groupBy(*keys).count().where(F.col("count") >= least).select(*keys)
    return rows.join(fit, keys, "left_semi")


def admitted(required: DataFrame, optional: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """All required datasets and those optional ones that have files."""
    return required.select(key).union(optional.join(files, key, "left_semi").select(key)).distinct()


def ordered_pairs(items: DataFrame, order: str, *columns: str, within: str | None = None) -> DataFrame:
    """Every two items, the one that comes first as a; items are few, one row each."""
    a, b = (items.select(*[F.col(c).alias(f"{c}_{s}") for c in dict.fromkeys((order, *columns, *([within] if within else [])))]) for s in "ab")
    test = F.col(f"{order}_a") < F.col(f"{order}_b")
    if within:
        test = test & (F.col(f"{within}_a") == F.col(f"{within}_b"))
    return a.join(b, test).select(*[f"{c}_{s}" for c in columns for s in "ab"])


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The values of both sides by key, for keys that both sides have."""
    return a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys)


def aligned_rankings(distances: DataFrame, config_a: str, config_b: str) -> DataFrame:
    """Distances of the same pair of datasets under two configurations."""
    of = lambda c: distances.where(F.col("configuration") == c)
    return paired(of(config_a), of(config_b), ["pair"], "fmd")


def complete_cases(rows: DataFrame, item: list[str], condition: str) -> DataFrame:
    """Rows of the items that have every condition there is (relational division)."""
    wanted = rows.select(condition).distinct().agg(F.count("*").alias("wanted"))
    have = rows.groupBy(*item).agg(F.count_distinct(condition).alias("have"))
    whole = have.join(F.broadcast(wanted), F.col("have") == F.col("wanted")).select(*item)  # one row is broadcast
    return rows.join(whole, item, "left_semi")


def with_default(rows: DataFrame, lookup: DataFrame, keys: list[str], value: str, default: float = float("nan")) -> DataFrame:
    """Left lookup of a value; keys that are not found get the default."""
    return rows.join(lookup.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def in_registry(wanted: DataFrame, registry: DataFrame, key: str, order: str) -> DataFrame:
    """The registry's entries that are wanted, in its order; all of them if none is."""
    hit = registry.join(wanted.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    any_hit = hit.agg(F.coalesce(F.bool_or("__hit"), F.lit(False)).alias("__any"))
    kept = hit.join(F.broadcast(any_hit), F.col("__hit").isNotNull() | ~F.col("__any"))  # one row is broadcast
    return kept.select(*registry.columns).orderBy(order)


def counters(rows: DataFrame, ok: Column, name: str, *keys: str) -> DataFrame:
    """Totals, successes, failures and the sorted names of failed items, by key."""
    failed = F.array_sort(F.collect_list(F.when(~F.coalesce(ok, F.lit(False)), F.col(name))))
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(ok).alias("successful"), (F.count("*") - F.count_if(ok)).alias("failed"), failed.alias("failed_items"))


def tag_counts(rows: DataFrame, tag: str) -> DataFrame:
    """How many rows have each tag, sorted by tag; blank and null tags count for none."""
    return rows.where(F.trim(tag) != "").groupBy(F.trim(tag).alias("tag")).agg(F.count("*").alias("n")).orderBy("tag")


def reindexed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows in a fixed order of their keys; a key without a row gives a row of nulls, other keys go."""
    places = rows.sparkSession.createDataFrame(list(enumerate(order)), f"__place int, {key} string")
    return places.join(rows, key, "left").orderBy("__place").select(*rows.columns)


def concat_frames(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def pooled(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of two sets with the side they came from."""
    return a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def members(pairs: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """What occurs on either side of the pairs, once."""
    return pairs.select(F.col(first).alias(name)).union(pairs.select(F.col(second).alias(name))).distinct()


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the other table does not have."""
    return rows.join(gone, keys, "left_anti")


def without_nan(rows: DataFrame, value: str) -> DataFrame:
    return rows.where(F.col(value).isNotNull() & ~F.isnan(value))


def music_messages(messages: DataFrame, kind: str = "type") -> DataFrame:
    """MIDI messages without the meta messages that carry text only."""
    return messages.where(~F.col(kind).isin(*TEXT_META))


def isolated(rows: DataFrame, value: str, function: Callable, kind: str) -> DataFrame:
    """Apply a Python function to each value; where it fails, ``result`` is null and ``problem`` names the exception."""

    @F.pandas_udf(f"result {kind}, problem string")
    def run(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            try:
                out.append((function(v), None))
            except Exception as problem:  # one item's failure must not end the others
                out.append((None, type(problem).__name__))
        made = pd.DataFrame(out, columns=["result", "problem"])
        return made.astype({"result": "Int64"}) if kind in ("long", "bigint") else made

    return rows.withColumn("__made", run(value)).select(*rows.columns, "__made.result", "__made.problem")
