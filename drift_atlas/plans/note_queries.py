"""Queries of the note-table family, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drift_atlas.operators import notes as ops
from drift_atlas.sources import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _times(df: DataFrame) -> DataFrame:
    return df.withColumns({"start_s": F.round("start_s", 6), "end_s": F.round("end_s", 6)})


_NOTE = "file_id, note_id, track, is_drum, pitch, velocity, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s"
_STEP = "(CAST(60 AS DOUBLE) / tempo_bpm / CAST(8 AS DOUBLE))"


@query("p01_filter_note_range", f"WITH {fx.NOTES_CTE} SELECT {_NOTE} FROM n WHERE is_drum OR pitch BETWEEN 21 AND 108")
def p01(spark: SparkSession, sf: str) -> DataFrame:
    return _times(ops.filter_note_range(fx.notes(spark, sf)))


@query("p02_remove_velocity", f"WITH {fx.NOTES_CTE} SELECT {_NOTE.replace('velocity', 'CASE WHEN is_drum THEN velocity ELSE 64 END AS velocity')} FROM n")
def p02(spark: SparkSession, sf: str) -> DataFrame:
    return _times(ops.remove_velocity(fx.notes(spark, sf)))


_SNAP = f"""q AS (SELECT * REPLACE (round_even(start_s / {_STEP}, 0) * {_STEP} AS start_s, round_even(end_s / {_STEP}, 0) * {_STEP} AS end_s) FROM n),
s AS (SELECT * REPLACE (CASE WHEN end_s <= start_s THEN start_s + {_STEP} ELSE end_s END AS end_s) FROM q)"""


@query("p03_quantize_time", f"WITH {fx.NOTES_CTE}, {_SNAP} SELECT {_NOTE} FROM s")
def p03(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.notes(spark, sf)
    return _times(ops.quantize_time(rows, fx.tempos(rows)))


def _warp_sql(source: str, name: str, target: str = "CAST(0.5 AS DOUBLE)") -> str:
    """DuckDB form of the tempo warp over a relation with file_id, start_s and end_s."""
    def w(c: str) -> str:
        i = f"least(len(list_filter(bs, lambda b: b <= {c})) - 1, len(bs) - 2)"
        return f"""CASE WHEN {c} <= bs[1] THEN CAST(0 AS DOUBLE)
          WHEN {c} >= bs[len(bs)] THEN (len(bs) - 1) * {target} + ({c} - bs[len(bs)]) * ({target} / greatest(bs[len(bs)] - bs[len(bs) - 1], CAST(0.001 AS DOUBLE)))
          ELSE ({i} + ({c} - bs[{i} + 1]) / greatest(bs[{i} + 2] - bs[{i} + 1], CAST(0.000001 AS DOUBLE))) * {target} END"""

    return f"""bm AS (SELECT file_id AS fid, list(t ORDER BY k) AS bs FROM beats GROUP BY file_id),
{name}0 AS (SELECT * REPLACE ({w('start_s')} AS start_s, {w('end_s')} AS end_s) FROM {source} JOIN bm ON fid = file_id),
{name} AS (SELECT * REPLACE (CASE WHEN end_s <= start_s THEN start_s + CAST(0.01 AS DOUBLE) ELSE end_s END AS end_s) FROM {name}0)"""


@query("p04_normalize_tempo", f"WITH {fx.NOTES_CTE}, {fx.BEATS_CTE}, {_warp_sql('n', 'wn')} SELECT {_NOTE} FROM wn")
def p04(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.notes(spark, sf)
    return _times(ops.normalize_tempo(rows, fx.beats(rows)))


_MERGED = """m AS (SELECT file_id, note_id, CASE WHEN is_drum THEN track ELSE 'Piano' END AS track, is_drum, pitch, velocity, start_s, end_s, tempo_bpm,
  CASE WHEN NOT is_drum THEN row_number() OVER (PARTITION BY file_id, is_drum ORDER BY start_s, track, note_id) END AS place,
  CASE WHEN NOT is_drum THEN CAST(0 AS BIGINT) END AS program FROM {source})"""


@query("p05_normalize_instruments", f"WITH {fx.NOTES_CTE}, {_MERGED.format(source='n')} SELECT {_NOTE}, place, program FROM m")
def p05(spark: SparkSession, sf: str) -> DataFrame:
    return _times(ops.normalize_instruments(fx.notes(spark, sf)))


_RANGED = "r AS (SELECT * FROM n WHERE is_drum OR pitch BETWEEN 21 AND 108)"
_PRE = f"""{_RANGED}, {_MERGED.format(source='r')},
v AS (SELECT * REPLACE (CASE WHEN is_drum THEN velocity ELSE 64 END AS velocity) FROM m),
{_SNAP.replace('FROM n)', 'FROM v)')}"""


@query("p06_preprocess", f"WITH {fx.NOTES_CTE}, {_PRE} SELECT {_NOTE}, place, program FROM s")
def p06(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.notes(spark, sf)
    return _times(ops.preprocess(rows, fx.tempos(rows), drop_velocity=True, hard_quantize=True))


@query("p07_process_dataset", f"""WITH {fx.NOTES_CTE}, o AS (SELECT file_id, count(*) FILTER (WHERE NOT is_drum AND pitch BETWEEN 21 AND 108) > 50 AS ok FROM n GROUP BY file_id)
SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS successful, count(*) FILTER (WHERE NOT ok) AS failed,
       coalesce(string_agg(CAST(file_id AS VARCHAR), ',' ORDER BY CAST(file_id AS VARCHAR)) FILTER (WHERE NOT ok), '') AS failed_files FROM o""")
def p07(spark: SparkSession, sf: str) -> DataFrame:
    """Batch cleaning with its counters; a file fails with fewer than 51 melodic notes left."""
    rows = fx.notes(spark, sf)
    kept = ops.preprocess(rows, fx.tempos(rows))
    melodic = kept.groupBy("file_id").agg(F.count_if(~F.col("is_drum")).alias("melodic"))
    status = rows.select("file_id").distinct().join(melodic, "file_id", "left").select("file_id", (F.coalesce("melodic", F.lit(0)) > 50).alias("ok"))
    return ops.batch_report(status)


@query("p08_process_single_file", f"WITH {fx.NOTES_CTE}, {_PRE} SELECT {_NOTE}, place, program FROM s WHERE file_id = (SELECT min(file_id) FROM n)")
def p08(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.notes(spark, sf)
    one = rows.join(rows.agg(F.min("file_id").alias("file_id")), "file_id", "left_semi")
    return _times(ops.preprocess(one, fx.tempos(one), drop_velocity=True, hard_quantize=True))


_PERT = f"""{_RANGED}, {_MERGED.format(source='r')},
f(perturbation, v, q, t) AS (VALUES ('original', false, false, false), ('no_velocity', true, false, false), ('quantized_time', false, true, false),
  ('constant_tempo', false, false, true), ('all_combined', true, true, true)),
a AS (SELECT * REPLACE (CASE WHEN v AND NOT is_drum THEN 64 ELSE velocity END AS velocity,
   CASE WHEN q THEN round_even(start_s / {_STEP}, 0) * {_STEP} ELSE start_s END AS start_s,
   CASE WHEN q THEN round_even(end_s / {_STEP}, 0) * {_STEP} ELSE end_s END AS end_s) FROM m, f),
b AS (SELECT * REPLACE (CASE WHEN q AND end_s <= start_s THEN start_s + {_STEP} ELSE end_s END AS end_s) FROM a),
{_warp_sql('(SELECT * FROM b WHERE t)', 'wp')},
pert AS (SELECT perturbation, file_id, note_id, track, is_drum, pitch, velocity, start_s, end_s FROM wp
  UNION ALL SELECT perturbation, file_id, note_id, track, is_drum, pitch, velocity, start_s, end_s FROM b WHERE NOT t)"""


@query("p09_perturbations", f"WITH {fx.NOTES_CTE}, {fx.BEATS_CTE}, {_PERT} SELECT perturbation, {_NOTE} FROM pert")
def p09(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.notes(spark, sf)
    return _times(ops.perturb(rows, fx.tempos(rows), fx.beats(rows)))


@query("p14_empty_token_drop", f"WITH {fx.NOTES_CTE}, c AS (SELECT file_id, count(*) FILTER (WHERE is_drum) AS k FROM n GROUP BY file_id) SELECT count(*) FILTER (WHERE k > 13) AS kept, count(*) FILTER (WHERE k <= 13) AS failed FROM c")
def p14(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose token list would be empty are counted as failed: here, lists of the drums past the 13th."""
    tokens = fx.notes(spark, sf).groupBy("file_id").agg(F.filter(F.collect_list("is_drum"), lambda d: d).alias("drums"))
    tokens = tokens.select(F.slice("drums", 14, 1 << 30).alias("tokens"))
    return tokens.agg(F.count_if(F.size("tokens") > 0).alias("kept"), F.count_if(F.size("tokens") == 0).alias("failed"))


@query("p21_melodic_projection", f"WITH {fx.NOTES_CTE} SELECT file_id, round(start_s, 6) AS start_s, pitch, round(end_s, 6) AS end_s FROM n WHERE NOT is_drum")
def p21(spark: SparkSession, sf: str) -> DataFrame:
    return _times(ops.melodic(fx.notes(spark, sf)))


@query("j11_time_to_beat", f"""WITH {fx.NOTES_CTE}, {fx.BEATS_CTE}, bm AS (SELECT file_id AS fid, list(t ORDER BY k) AS bs FROM beats GROUP BY file_id)
SELECT file_id, note_id, CAST(least(len(list_filter(bs, lambda b: b <= start_s)) - 1, len(bs) - 2) AS BIGINT) AS beat FROM n JOIN bm ON fid = file_id""")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.notes(spark, sf)
    return ops.time_to_beat(rows, fx.beats(rows))


@query("o03_note_order", f"WITH {fx.NOTES_CTE} SELECT file_id, note_id, row_number() OVER (PARTITION BY file_id ORDER BY start_s, pitch, end_s, note_id) AS place FROM n WHERE NOT is_drum")
def o03(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("file_id").orderBy("start_s", "pitch", "end_s", "note_id")
    return fx.notes(spark, sf).where(~F.col("is_drum")).select("file_id", "note_id", F.row_number().over(order).cast("long").alias("place"))
