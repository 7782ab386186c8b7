"""Note-table operators: filters, perturbations and their composition.

A note table has file_id, note_id, track, is_drum, pitch, velocity, start_s and
end_s. All operators are row-wise or windowed within a file, so a file's notes
meet in one task at most once, keyed by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drift_atlas.operators.asof import last_mark

MIN_NOTE, MAX_NOTE = 21, 108
FLAT_VELOCITY = 64
STEPS_PER_QUARTER = 8
TARGET_BPM = 120.0
DEFAULT_TEMPO = 120.0
#: The least beat intervals and the duration given to a note that a warp turned around.
LEAST_LAST_INTERVAL, LEAST_INTERVAL, LEAST_DURATION = 0.001, 1e-6, 0.01


def filter_note_range(notes: DataFrame, low: int = MIN_NOTE, high: int = MAX_NOTE) -> DataFrame:
    """Keep drums, and other notes whose pitch is in the range."""
    return notes.where(F.col("is_drum") | F.col("pitch").between(low, high))


def flat_velocity(velocity: Column, is_drum: Column, value: int = FLAT_VELOCITY) -> Column:
    return F.when(~is_drum, F.lit(value).cast("long")).otherwise(velocity)


def remove_velocity(notes: DataFrame, value: int = FLAT_VELOCITY) -> DataFrame:
    """Give all notes but drums one velocity."""
    return notes.withColumn("velocity", flat_velocity(F.col("velocity"), F.col("is_drum"), value))


def grid_step(tempo: Column, steps: int = STEPS_PER_QUARTER) -> Column:
    return F.lit(60.0) / F.coalesce(tempo, F.lit(DEFAULT_TEMPO)) / F.lit(float(steps))


def quantize_time(notes: DataFrame, tempos: DataFrame, hard: bool = True, steps: int = STEPS_PER_QUARTER) -> DataFrame:
    """Snap starts and ends to the grid of the file's first tempo, half to even; a note lasts one step at least."""
    if not hard:
        return notes
    step = grid_step(F.col("tempo_bpm"), steps)
    snapped = notes.join(tempos, "file_id", "left").withColumn("__step", step)
    snap = lambda c: F.rint(F.col(c) / F.col("__step")) * F.col("__step")
    snapped = snapped.withColumns({"start_s": snap("start_s"), "end_s": snap("end_s")})
    end = F.when(F.col("end_s") <= F.col("start_s"), F.col("start_s") + F.col("__step")).otherwise(F.col("end_s"))
    return snapped.withColumn("end_s", end).select(*notes.columns)


def beat_marks(beats: DataFrame) -> DataFrame:
    """Every beat as a mark of the as-of join: its place from 0, its successor, and what is the same for all beats of the file.

    Times rise with ``k``. A mark at minus infinity, place -1, stands before the first
    beat of every file, so notes before it know the file's beats too. All comes from windows over one
    sort: a join of the beats with what is the same for a file would be taken for a small one, since their
    number only shows after they are exploded, and the beats of all files would go through the driver.
    """
    order, whole = Window.partitionBy("file_id").orderBy("k"), Window.partitionBy("file_id")
    placed = beats.select("file_id", "t", (F.row_number().over(order) - 1).cast("long").alias("place"), F.lead("t").over(order).alias("next_t"))
    inner = F.col("next_t").isNotNull()
    same = {"n": F.count("*"), "first": F.min_by("t", "place"), "last": F.max_by("t", "place"), "before_last": F.max_by(F.when(inner, F.col("t")), F.when(inner, F.col("place")))}
    placed = placed.withColumns({c: f.over(whole) for c, f in same.items()})
    mark = lambda t, place, next_t: F.struct(t.alias("t"), place.alias("place"), next_t.alias("next_t"), *same)
    own = mark(F.col("t"), F.col("place"), F.col("next_t"))
    before = mark(F.lit(float("-inf")), F.lit(-1).cast("long"), F.lit(None).cast("double"))
    held = F.array(F.when(F.col("place") == 0, before), F.when(F.col("file_id").isNotNull(), own))
    return placed.select("file_id", F.inline(F.filter(held, lambda m: m.isNotNull())))


def _marked(rows: DataFrame, marks: DataFrame, at: str) -> DataFrame:
    return last_mark(rows, marks, ["file_id"], at, "t", "place", "__beat")


def _warped(t: Column, target: float) -> Column:
    """Time on the even grid, from the beat at or before it; unchanged where the file has fewer than two beats."""
    beat = F.col("__beat")
    inside = (beat["place"] + (t - beat["t"]) / F.greatest(beat["next_t"] - beat["t"], F.lit(LEAST_INTERVAL))) * F.lit(target)
    beyond = (beat["n"] - 1) * F.lit(target) + (t - beat["last"]) * (F.lit(target) / F.greatest(beat["last"] - beat["before_last"], F.lit(LEAST_LAST_INTERVAL)))
    even = F.when(t <= beat["first"], F.lit(0.0)).when(t >= beat["last"], beyond).otherwise(inside)
    return F.when(beat["n"] >= 2, even).otherwise(t)


def warp_times(rows: DataFrame, beats: DataFrame, columns: list[str], target_bpm: float = TARGET_BPM) -> DataFrame:
    """Any table of file_id and times, such as control changes and pitch bends, with its times on the even grid."""
    marks, out = beat_marks(beats), rows
    for c in columns:
        out = _marked(out, marks, c).withColumn(c, _warped(F.col(c), 60.0 / target_bpm)).select(*rows.columns)
    return out


def normalize_tempo(notes: DataFrame, beats: DataFrame, target_bpm: float = TARGET_BPM) -> DataFrame:
    """Warp times so that the beats are evenly spaced; files with fewer than two beats stay as they are."""
    marks, target = beat_marks(beats), 60.0 / target_bpm
    out = _marked(notes, marks, "start_s").withColumn("start_s", _warped(F.col("start_s"), target)).drop("__beat")
    out = _marked(out, marks, "end_s").withColumn("end_s", _warped(F.col("end_s"), target))
    turned = (F.col("__beat")["n"] >= 2) & (F.col("end_s") <= F.col("start_s"))
    return out.withColumn("end_s", F.when(turned, F.col("start_s") + F.lit(LEAST_DURATION)).otherwise(F.col("end_s"))).select(*notes.columns)


def time_to_beat(notes: DataFrame, beats: DataFrame) -> DataFrame:
    """The index of the last beat at or before each note, clamped to the last interval; -1 before the first beat."""
    found = _marked(notes.select("file_id", "note_id", "start_s"), beat_marks(beats), "start_s").where("__beat is not null")
    return found.select("file_id", "note_id", F.least(F.col("__beat.place"), F.col("__beat.n") - 2).cast("long").alias("beat"))


def normalize_instruments(notes: DataFrame) -> DataFrame:
    """Merge all tracks but drums into one piano, its notes numbered by start; drums follow as they are."""
    order = Window.partitionBy("file_id", "is_drum").orderBy("start_s", "track", "note_id")
    place = F.when(~F.col("is_drum"), F.row_number().over(order).cast("long"))
    return notes.withColumns({"place": place, "track": F.when(F.col("is_drum"), F.col("track")).otherwise(F.lit("Piano")), "program": F.when(~F.col("is_drum"), F.lit(0).cast("long"))})


def preprocess(notes: DataFrame, tempos: DataFrame, drop_velocity: bool = False, hard_quantize: bool = False) -> DataFrame:
    """Range filter, merge of the instruments, then velocity and grid as asked."""
    out = normalize_instruments(filter_note_range(notes))
    if drop_velocity:
        out = remove_velocity(out)
    return quantize_time(out, tempos, hard_quantize)


#: The study's perturbations: (name, velocity removed, snapped to the grid, tempo evened).
PERTURBATIONS = [
    ("original", False, False, False),
    ("no_velocity", True, False, False),
    ("quantized_time", False, True, False),
    ("constant_tempo", False, False, True),
    ("all_combined", True, True, True),
]


def perturb(notes: DataFrame, tempos: DataFrame, beats: DataFrame) -> DataFrame:
    """All perturbations of every note in one plan: velocity, then grid, then tempo.

    Each note is multiplied by the five constant perturbations inside its row; those
    that even the tempo meet the beats.
    """
    flags = F.array(*[F.struct(F.lit(n).alias("perturbation"), F.lit(v).alias("v"), F.lit(q).alias("q"), F.lit(t).alias("t")) for n, v, q, t in PERTURBATIONS])
    base = normalize_instruments(filter_note_range(notes)).join(tempos, "file_id", "left")
    rows = base.select("*", F.inline(flags))
    rows = rows.withColumn("velocity", F.when(F.col("v"), flat_velocity(F.col("velocity"), F.col("is_drum"))).otherwise(F.col("velocity")))
    step = grid_step(F.col("tempo_bpm"))
    snap = lambda c: F.when(F.col("q"), F.rint(F.col(c) / step) * step).otherwise(F.col(c))
    rows = rows.withColumns({"start_s": snap("start_s"), "end_s": snap("end_s")})
    rows = rows.withColumn("end_s", F.when(F.col("q") & (F.col("end_s") <= F.col("start_s")), F.col("start_s") + step).otherwise(F.col("end_s")))
    rows = rows.select("perturbation", "file_id", "note_id", "track", "is_drum", "pitch", "velocity", "start_s", "end_s", "t")
    return rows.where(~F.col("t")).unionByName(normalize_tempo(rows.where("t"), beats)).drop("t")


def melodic(notes: DataFrame) -> DataFrame:
    """Start, pitch and end of all notes but drums."""
    return notes.where(~F.col("is_drum")).select("file_id", "start_s", "pitch", "end_s")


def batch_report(files: DataFrame) -> DataFrame:
    """Counters over a table of (file_id, ok): total, successful, failed and the failed ones."""
    return files.agg(
        F.count("*").alias("total"), F.count_if("ok").alias("successful"), F.count_if(~F.col("ok")).alias("failed"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("file_id").cast("string")))), ",").alias("failed_files"),
    )
