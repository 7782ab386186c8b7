"""Queries over message tables, with their DuckDB equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from drift_atlas.operators import messages as ms
from drift_atlas.operators import rendering as rd
from drift_atlas.operators.relations import TEXT_META, music_messages
from drift_atlas.plans.note_queries import _warp_sql
from drift_atlas.sources import committed, midi
from drift_atlas.sources import fixtures as fx
from drift_atlas.sources.staging import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_MS = f"WITH {fx.NOTES_CTE}, {fx.MESSAGES_CTE}"
_TEXTS = ", ".join(f"'{k}'" for k in TEXT_META)
_NUMBERS = "list_sum(list_transform(string_split(vals, ' '), lambda x: CAST(x AS BIGINT)))"
#: Columns of what a file's messages sum up to.
_SUMS = {"file_id": pa.int64(), "type": pa.string(), "n": pa.int64(), "ticks": pa.int64(), "numbers": pa.int64()}


def _messages(spark, sf):
    return fx.messages(fx.notes(spark, sf))


@query("s07_message_table", f"{_MS} SELECT file_id, track_idx, seq, tick, type, is_meta, vals AS field_values FROM ms")
def s07(spark, sf):
    """Every message of every file."""
    rows = _messages(spark, sf)
    return rows.select("file_id", F.col("track_idx").cast("long").alias("track_idx"), F.col("seq").cast("long").alias("seq"), "tick", "type", "is_meta", F.array_join(F.transform("fields", lambda f: f["value"]), " ").alias("field_values"))


@query("s07_message_round_trip", f"{_MS} SELECT file_id, type, count(*) AS n, CAST(sum(tick) AS BIGINT) AS ticks, CAST(coalesce(sum(CASE WHEN type IN ({_TEXTS}, 'end_of_track') THEN 0 ELSE {_NUMBERS} END), 0) AS BIGINT) AS numbers FROM ms GROUP BY file_id, type")
def s07_round_trip(spark, sf):
    """The messages of a file written as a MIDI file and parsed again: none is lost, all keep their ticks and numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file_id, content in zip(*(batch.column(c).to_pylist() for c in ("file_id", "content"))):
                sums: dict[str, list[int]] = {}
                for m in midi.messages(content):
                    own = sums.setdefault(m["type"], [0, 0, 0])
                    own[0] += 1
                    own[1] += m["tick"]
                    own[2] += 0 if m["type"] in TEXT_META else sum(int(f["value"]) for f in m["fields"])
                out += [(file_id, kind, *own) for kind, own in sums.items()]
            columns = list(zip(*out)) or [()] * len(_SUMS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SUMS.values())], names=list(_SUMS))

    return midi.files_of_messages(_messages(spark, sf)).mapInArrow(run, "file_id long, type string, n long, ticks long, numbers long")


@query("s08_midi_sink", f"{_MS} SELECT file_id, type, count(*) AS n, CAST(sum(tick) AS BIGINT) AS ticks FROM ms GROUP BY file_id, type")
def s08(spark, sf):
    """Every file written as a MIDI file through the committing sink, found again by Spark and parsed."""

    folder = f"{shared_folder(spark)}/midi-{uuid.uuid4().hex}"
    name = F.concat((F.col("file_id") % 10).cast("string"), F.lit("/"), F.col("file_id").cast("string"), F.lit(".mid"))
    committed.save_files(midi.files_of_messages(_messages(spark, sf)).select(name.alias("name"), "content"), folder)
    parsed = midi.load_messages(spark, folder).withColumn("file_id", F.regexp_extract("path", r"/(\d+)\.mid$", 1).cast("long"))
    return parsed.groupBy("file_id", "type").agg(F.count("*").alias("n"), F.sum("tick").alias("ticks"))


@query("s07_programs_of_notes", f"""{_MS}, pn AS (SELECT *, CAST(string_split(vals, ' ')[1] AS BIGINT) AS c, CAST(string_split(vals, ' ')[2] AS BIGINT) AS v FROM ms WHERE type IN ('note_on', 'program_change')),
pl AS (SELECT *, last_value(CASE WHEN type = 'program_change' THEN v END IGNORE NULLS) OVER (PARTITION BY file_id, track_idx, c ORDER BY tick, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM pn)
SELECT file_id, track_idx, seq, CAST(v AS INTEGER) AS note, CAST(coalesce(p, 0) AS INTEGER) AS program FROM pl WHERE type = 'note_on' AND string_split(vals, ' ')[3] <> '0'""")
def s07_programs(spark, sf):
    out = ms.programs_of_notes(_messages(spark, sf))
    return out.select("file_id", F.col("track_idx").cast("long").alias("track_idx"), F.col("seq").cast("long").alias("seq"), "note", "program")


@query("p20_meta_filter", f"{_MS} SELECT file_id, track_idx, seq, type FROM ms WHERE type NOT IN ({_TEXTS})")
def p20(spark, sf):
    """Messages but those of text."""
    rows = music_messages(_messages(spark, sf))
    return rows.select("file_id", F.col("track_idx").cast("long").alias("track_idx"), F.col("seq").cast("long").alias("seq"), "type")


@query("p04_normalize_controls", f"""WITH {fx.NOTES_CTE}, {fx.BEATS_CTE}, {fx.MESSAGES_CTE}, tp AS (SELECT DISTINCT file_id, tempo_bpm FROM n),
cc AS (SELECT ms.file_id, track_idx, seq, type, tick * (CAST(60 AS DOUBLE) / tempo_bpm / CAST(480 AS DOUBLE)) AS start_s, CAST(1e12 AS DOUBLE) AS end_s FROM ms JOIN tp ON tp.file_id = ms.file_id WHERE type IN ('control_change', 'pitchwheel')),
{_warp_sql('cc', 'wc')} SELECT file_id, track_idx, seq, type, round(start_s, 6) AS even_s FROM wc""")
def p04_controls(spark, sf):
    """Control changes and pitch bends at their times on the even grid."""
    notes = fx.notes(spark, sf)
    out = ms.even_tempo(fx.messages(notes), fx.tempos(notes), fx.beats(notes))
    return out.select("file_id", F.col("track_idx").cast("long").alias("track_idx"), F.col("seq").cast("long").alias("seq"), "type", F.round("even_s", 6).alias("even_s"))


_LINES = f"""{_MS}, ln AS (SELECT *, type || ' ' || type || CASE WHEN is_meta THEN CASE WHEN vals = '' THEN '' ELSE ' ' || vals END || ' ' || delta ELSE ' ' || delta || ' ' || vals END AS line FROM mg WHERE type NOT IN ({_TEXTS})),
tx AS (SELECT file_id, 'ticks_per_beat 480' || chr(10) || string_agg(line, chr(10) ORDER BY tick, track_idx, seq) AS text FROM ln GROUP BY file_id)"""


@query("t18_message_text", f"{_LINES} SELECT file_id, text FROM tx")
def t18(spark, sf):
    """Every message of a file as a line, in the order of the merged tracks."""
    return ms.text(_messages(spark, sf))


# The greedy packing, line by line: a patch is what the last of its lines has made of it.
_PACKED = f"""{_LINES.replace('WITH ', 'WITH RECURSIVE ', 1)},
li AS (SELECT file_id, unnest(ls) || CASE WHEN unnest(range(len(ls))) < len(ls) - 1 THEN chr(10) ELSE '' END AS line, unnest(range(len(ls))) AS k FROM (SELECT file_id, string_split(text, chr(10)) AS ls FROM tx)),
lk AS (SELECT *, string_split(line, ' ')[1] AS kind, substr(line, length(string_split(line, ' ')[1]) + 2) AS payload FROM li),
pk(file_id, k, cur, fresh) AS (
  SELECT file_id, k, line, 1 FROM lk WHERE k = 0
  UNION ALL
  SELECT l.file_id, l.k, CASE WHEN joins THEN substr(cur, 1, length(cur) - 1) || chr(9) || payload ELSE line END, CASE WHEN joins THEN 0 ELSE 1 END
  FROM (SELECT l.file_id, l.k, l.line, l.payload, cur, starts_with(cur, kind) AND length(cur) + length(payload) <= {rd.PATCH - 2} AS joins FROM pk JOIN lk l ON l.file_id = pk.file_id AND l.k = pk.k + 1) l),
pn AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY k) - 1 AS patch_idx FROM pk)
SELECT file_id, CAST(patch_idx AS BIGINT) AS patch_idx, max_by(cur, k) AS patch FROM pn WHERE patch_idx < {rd.MAX_PATCHES} GROUP BY file_id, patch_idx"""


@query("t23_message_patches", _PACKED)
def t23(spark, sf):
    """Messages packed into patches."""
    return rd.message_patches(ms.text(_messages(spark, sf)), rd.PATCH)
