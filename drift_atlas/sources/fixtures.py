"""Stand-ins for the domain tables over the shared test tables, and loading helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Notes of a task, about: what a task holds follows from this, not from the size of the tables.
NOTES_OF_A_TASK = 25_000


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note table derived from events: one file per user, one track per event type.

    Events are few bytes and their notes, messages and frames many, so adaptive execution would leave them to
    few tasks. They are dealt by file to a number of tasks that grows with their count; what is
    grouped or joined by file after that needs no other shuffle.
    """
    events = load(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("file_id"), "event_type")
    tasks = max(spark.sparkContext.defaultParallelism, -(-events.count() // NOTES_OF_A_TASK))
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("ts", "event_id"))
    placed = events.repartition(tasks, "file_id").withColumn("place", place)
    start = (F.col("place") - 1) * F.lit(0.25) + (F.col("event_id") % 97) / F.lit(1000.0)
    rows = placed.select(
        "file_id", F.col("event_id").alias("note_id"), F.col("event_type").alias("track"),
        (F.col("event_type") == "error").alias("is_drum"), (F.lit(15) + F.col("event_id") % 100).alias("pitch"),
        (F.lit(1) + F.col("event_id") % 127).alias("velocity"), start.alias("start_s"),
    )
    return rows.withColumn("end_s", F.col("start_s") + F.lit(0.05) + (F.col("note_id") % 40) / F.lit(100.0))


def tempo_of(file_id: Column) -> Column:
    """Beats per minute of a derived file."""
    return (F.lit(60) + file_id % 120).cast("double")


def tempos(notes_df: DataFrame) -> DataFrame:
    return notes_df.select("file_id").distinct().withColumn("tempo_bpm", tempo_of(F.col("file_id")))


BEATS = 64


def beats(notes_df: DataFrame) -> DataFrame:
    """Unevenly spaced beats of every derived file: file_id, k, t.

    The files are dealt anew to a fixed number of tasks: ids alone are few bytes, which adaptive execution
    leaves to one task, and that task would hold the beats of all files. The number is not that of
    other shuffles, or Spark would take this one for the same and leave it out.
    """
    wide = 2 * int(notes_df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = tempos(notes_df).repartition(wide, "file_id").select("file_id", "tempo_bpm", F.explode(F.sequence(F.lit(0), F.lit(BEATS - 1))).alias("k"))
    jitter = F.lit(0.01) * ((F.col("k") * 7) % 5)
    return grid.select("file_id", F.col("k").cast("long").alias("k"), (F.col("k") * F.lit(60.0) / F.col("tempo_bpm") + jitter).alias("t"))


def messages(notes_df: DataFrame) -> DataFrame:
    """The message table of the derived files: their notes, and pedals, bends, lyrics and program changes at some of them."""
    from drift_atlas.operators import messages as ms

    channel, note = F.when(F.col("is_drum"), ms.DRUM_CHANNEL).otherwise(0), F.col("note_id")
    some = lambda test, time, m: F.when(test, F.struct(F.col(time).alias("time_s"), m.alias("message")))
    extra = F.array(
        some(note % 16 == 0, "start_s", ms.message("control_change", channel=channel, control=64, value=note % 128)),
        some(note % 24 == 5, "end_s", ms.message("pitchwheel", channel=channel, pitch=note % 4096 - 2048)),
        some(note % 10 == 3, "start_s", ms.message("lyrics", text=F.concat(F.lit("la"), note))),
        some(note % 50 == 7, "start_s", ms.message("program_change", channel=channel, program=note % 128)),
    )
    rows = notes_df.select("file_id", "track", note.alias("tie"), F.explode(F.filter(extra, lambda x: x.isNotNull())).alias("x")).select("file_id", "track", "tie", "x.*")
    return ms.of_notes(notes_df, tempos(notes_df), rows)


def embedding_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the set they belong to: set_id, row_id, embedding (doubles)."""
    rows = load(spark, sf_dir, "embeddings")
    return rows.select(F.col("label").cast("long").alias("set_id"), F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def plane(vectors: DataFrame, first: int = 0) -> DataFrame:
    """Two neighbouring coordinates of every vector as x and y."""
    return vectors.select("set_id", "row_id", F.get("embedding", F.lit(first)).alias("x"), F.get("embedding", F.lit(first + 1)).alias("y"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file listing from the pages: path and size in characters, null as 0."""
    return load(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.col("url").alias("path"), F.coalesce(F.length("html"), F.lit(0)).cast("long").alias("size_bytes"))


#: DuckDB definitions of the same tables, as common table expressions.
NOTES_CTE = """
notes AS (
  SELECT user_id AS file_id, event_id AS note_id, event_type AS track, event_type = 'error' AS is_drum,
         15 + event_id % 100 AS pitch, 1 + event_id % 127 AS velocity,
         (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * CAST(0.25 AS DOUBLE)
           + (event_id % 97) / CAST(1000 AS DOUBLE) AS start_s
  FROM events),
n AS (SELECT *, start_s + CAST(0.05 AS DOUBLE) + (note_id % 40) / CAST(100 AS DOUBLE) AS end_s,
             CAST(60 + file_id % 120 AS DOUBLE) AS tempo_bpm FROM notes)"""

BEATS_CTE = """
beats AS (
  SELECT file_id, k, k * CAST(60 AS DOUBLE) / tempo_bpm + CAST(0.01 AS DOUBLE) * ((k * 7) % 5) AS t
  FROM (SELECT DISTINCT file_id, tempo_bpm FROM n) f, (SELECT unnest(range(64)) AS k) r)"""

_TICK = lambda t: f"CAST(round_even({t} / (CAST(60 AS DOUBLE) / tempo_bpm / CAST(480 AS DOUBLE)), 0) AS BIGINT)"

MESSAGES_CTE = f"""
nc AS (SELECT *, CASE WHEN is_drum THEN 9 ELSE 0 END AS ch, {_TICK('start_s')} AS on_tick, {_TICK('end_s')} AS off_tick FROM n),
mr AS (
  SELECT file_id, track, on_tick AS tick, 8 AS o, note_id AS tie, 'note_on' AS type, false AS is_meta, ch || ' ' || pitch || ' ' || velocity AS vals FROM nc
  UNION ALL SELECT file_id, track, off_tick, 7, note_id, 'note_on', false, ch || ' ' || pitch || ' 0' FROM nc
  UNION ALL SELECT DISTINCT file_id, track, 0, 0, 0, 'track_name', true, track FROM nc
  UNION ALL SELECT DISTINCT file_id, track, 0, 4, 0, 'program_change', false, ch || ' 0' FROM nc
  UNION ALL SELECT DISTINCT file_id, NULL, 0, 1, 0, 'set_tempo', true, CAST(CAST(round_even(CAST(60000000 AS DOUBLE) / tempo_bpm, 0) AS BIGINT) AS VARCHAR) FROM nc
  UNION ALL SELECT DISTINCT file_id, NULL, 0, 2, 0, 'time_signature', true, '4 4 24 8' FROM nc
  UNION ALL SELECT file_id, track, on_tick, 6, note_id, 'control_change', false, ch || ' 64 ' || (note_id % 128) FROM nc WHERE note_id % 16 = 0
  UNION ALL SELECT file_id, track, off_tick, 5, note_id, 'pitchwheel', false, ch || ' ' || (note_id % 4096 - 2048) FROM nc WHERE note_id % 24 = 5
  UNION ALL SELECT file_id, track, on_tick, 3, note_id, 'lyrics', true, 'la' || note_id FROM nc WHERE note_id % 10 = 3
  UNION ALL SELECT file_id, track, on_tick, 4, note_id, 'program_change', false, ch || ' ' || (note_id % 128) FROM nc WHERE note_id % 50 = 7),
mt AS (SELECT * FROM mr UNION ALL SELECT file_id, track, max(tick), 9, 0, 'end_of_track', true, '' FROM mr GROUP BY file_id, track),
ms AS (SELECT *, dense_rank() OVER (PARTITION BY file_id ORDER BY track NULLS FIRST) - 1 AS track_idx, row_number() OVER (PARTITION BY file_id, track ORDER BY tick, o, tie) - 1 AS seq FROM mt),
mg AS (SELECT *, tick - coalesce(lag(tick) OVER (PARTITION BY file_id ORDER BY tick, track_idx, seq), 0) AS delta FROM (
  SELECT file_id, track_idx, seq, tick, type, is_meta, vals FROM ms WHERE type <> 'end_of_track'
  UNION ALL SELECT file_id, 1 << 30, 0, max(tick), 'end_of_track', true, '' FROM ms GROUP BY file_id))"""

SETS_CTE = """
e AS (SELECT CAST(label AS BIGINT) AS set_id, vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS v,
             CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
             CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS w FROM embeddings)"""

FILES_CTE = """
files AS (SELECT page_id AS file_id, url AS path, CAST(coalesce(length(html), 0) AS BIGINT) AS size_bytes FROM pages)"""
