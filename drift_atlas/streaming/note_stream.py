"""Incremental forms of the note operators: the row-wise filters and a windowed event summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drift_atlas.operators import notes


def clean_stream(stream: DataFrame) -> DataFrame:
    """Range filter and flat velocity on a stream of notes; both look at one row only."""
    return notes.remove_velocity(notes.filter_note_range(stream))


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events and their value by type and tumbling window; rows later than the watermark are dropped."""
    timed = events.withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
