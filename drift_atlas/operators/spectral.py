"""Embeddings of how notes sound: band energies of the first seconds, without audio.

A note is a few harmonics of its pitch, the h-th with amplitude velocity / 127 / h. Time
is cut into frames; a harmonic adds the square of its amplitude, times the share of the frame that the
note sounds, to the frame's energy in its band. A file's embedding is the mean over its
frames of log(1 + energy) of every band. Notes meet as sums by (file, frame, band):
notes that lie by file are not shuffled again, and of others sums are combined before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds that count, frames of a second, harmonics of a note, bands of an octave, the lowest frequency and the number of bands.
SECONDS, FRAMES_A_SECOND, HARMONICS, BANDS_AN_OCTAVE, LOWEST_HZ, BANDS = 10, 50, 6, 3, 27.5, 30
#: Concert pitch and its MIDI number.
CONCERT_HZ, CONCERT_PITCH = 440.0, 69


def band_energies(notes: DataFrame) -> DataFrame:
    """file_id, frame, band, energy of all frames and bands that sound; pitches are whole, and notes that last no time are silent."""
    frame = 1 / FRAMES_A_SECOND
    end = F.least("end_s", F.lit(float(SECONDS)))
    first, last = F.floor(F.col("start_s") * FRAMES_A_SECOND), F.ceil(end * FRAMES_A_SECOND) - 1
    rows = notes.where((F.col("start_s") >= 0) & (F.col("start_s") < end)).select("file_id", "pitch", "velocity", "start_s", end.alias("end_s"), F.explode(F.sequence(first, F.greatest(first, last))).alias("frame"))
    share = F.greatest(F.lit(0.0), F.least(F.col("end_s"), (F.col("frame") + 1) * frame) - F.greatest(F.col("start_s"), F.col("frame") * frame)) * FRAMES_A_SECOND
    # The h-th harmonic lies a whole pitch plus an interval that depends on h only above the lowest frequency.
    lift = [BANDS_AN_OCTAVE * math.log2(h * CONCERT_HZ / LOWEST_HZ) for h in range(1, HARMONICS + 1)]
    band = lambda h: F.floor((F.col("pitch") - CONCERT_PITCH) * (BANDS_AN_OCTAVE / 12) + lift[h - 1] + 1e-9)
    parts = F.array(*[F.struct(band(h).alias("band"), F.pow(F.col("velocity") / 127.0 / h, F.lit(2.0)).alias("power")) for h in range(1, HARMONICS + 1)])
    sounding = rows.select("file_id", "frame", share.alias("share"), F.inline(parts)).where(F.col("band").between(0, BANDS - 1))
    return sounding.groupBy("file_id", "frame", "band").agg(F.sum(F.col("share") * F.col("power")).alias("energy"))


def embed(notes: DataFrame) -> DataFrame:
    """file_id and the embedding of every file with a note: one number a band, 0 where nothing sounds."""
    ends = notes.groupBy("file_id").agg(F.greatest(F.lit(1), F.ceil(F.least(F.max("end_s"), F.lit(float(SECONDS))) * FRAMES_A_SECOND)).alias("frames"))
    bands = band_energies(notes).groupBy("file_id", "band").agg(F.sum(F.log1p("energy")).alias("total"))
    by_band = bands.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("band", "total"))).alias("totals"))
    value = lambda k: F.coalesce(F.try_element_at("totals", k.cast("long")), F.lit(0.0)) / F.col("frames")
    return ends.join(by_band, "file_id", "left").select("file_id", F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), value).alias("embedding"))
