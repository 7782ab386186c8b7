"""Message tables: what a MIDI file holds, one row a message.

A message table has file_id, track_idx, seq (the place in its track), tick, type,
is_meta and fields (name, value) in the order of the format. Values are text, as
messages of one file differ in their fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drift_atlas.operators import notes as note_ops
from drift_atlas.operators.relations import TEXT_META, music_messages

#: Fixed value: what ends a track.
END = "end_of_track"
TICKS, DRUM_CHANNEL = 480, 9

#: Order of messages at one tick of a track, as writers save them: what sets a state comes before notes, ends of notes before starts.
_ORDER = {"track_name": 0, "set_tempo": 1, "time_signature": 2, "lyrics": 3, "program_change": 4, "pitchwheel": 5, "control_change": 6, "note_off": 7, "note_on": 8, END: 9}


def field(name: str) -> Column:
    """A field of a message as text; null if it has none of this name."""
    return F.get(F.filter("fields", lambda f: f["name"] == name), F.lit(0))["value"]


def message(kind: str, **values: Column | int | str) -> Column:
    """The columns of a message from its type and its fields, in order."""
    meta = kind in TEXT_META or kind in ("set_tempo", "time_signature", "key_signature", END)
    text = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("string")
    made = [F.struct(F.lit(k).alias("name"), text(v).alias("value")) for k, v in values.items()]
    fields = F.array(*made) if made else F.array().cast("array<struct<name:string,value:string>>")
    return F.struct(F.lit(kind).alias("type"), F.lit(meta).alias("is_meta"), fields.alias("fields"), F.lit(_ORDER[kind]).alias("order"))


def of_notes(notes: DataFrame, tempos: DataFrame, extra: DataFrame | None = None, ticks: int = TICKS) -> DataFrame:
    """The messages of a file written from notes: a track of tempo and meter, then a track for every track name.

    A track begins with its name and, unless notes have ``program``, program 0; the end of a note is a note_on without velocity, as
    writers save it. ``extra`` has further messages of tracks: file_id, track, time_s and
    the struct ``message`` of ``message()``.
    """
    tick = lambda t: F.rint(t / (F.lit(60.0) / F.col("tempo_bpm") / F.lit(float(ticks)))).cast("long")
    channel = F.when(F.col("is_drum"), DRUM_CHANNEL).otherwise(0)
    program = F.col("program") if "program" in notes.columns else F.lit(0)
    timed = notes.join(tempos, "file_id")
    # Starts and ends of notes stay numbers until they are placed, as messages are several times larger.
    of_note = F.array(*[F.struct(tick(F.col(t)).alias("tick"), F.lit(_ORDER[kind]).alias("order")) for t, kind in (("start_s", "note_on"), ("end_s", "note_off"))])
    rows = timed.select("file_id", "track", F.col("note_id").alias("tie"), channel.alias("channel"), "pitch", "velocity", F.lit(True).alias("of_note"), F.inline(of_note))
    tracks = timed.groupBy("file_id", "track").agg(F.max("is_drum").alias("is_drum"), F.max(program).alias("program"))
    begins = F.array(message("track_name", name=F.col("track")), message("program_change", channel=channel, program=F.col("program")))
    zero = F.lit(0).cast("long")
    others = [tracks.select("file_id", "track", zero.alias("tie"), zero.alias("tick"), F.explode(begins).alias("m"))]
    us = F.rint(F.lit(60e6) / F.col("tempo_bpm")).cast("long")
    meter = message("time_signature", numerator=4, denominator=4, clocks_per_click=24, notated_32nd_notes_per_beat=8)
    others += [tempos.where(F.col("file_id").isNotNull()).select("file_id", F.lit(None).cast("string").alias("track"), zero.alias("tie"), zero.alias("tick"), F.explode(F.array(message("set_tempo", tempo=us), meter)).alias("m"))]
    if extra is not None:
        others += [extra.join(tempos, "file_id").select("file_id", "track", F.col("tie"), tick(F.col("time_s")).alias("tick"), F.col("message").alias("m"))]
    for other in others:
        rows = rows.unionByName(other.withColumns({"order": F.col("m.order"), "of_note": F.lit(False)}), allowMissingColumns=True)
    # Both windows go by one sort. An end_of_track comes after all else, so it is made beside the last message.
    order = Window.partitionBy("file_id", "track").orderBy("tick", "order", "tie")
    placed = rows.withColumns({"seq": F.row_number().over(order) - 1, "is_last": F.lead(F.lit(True)).over(order).isNull()})
    placed = placed.withColumn("track_idx", F.dense_rank().over(Window.partitionBy("file_id").orderBy(F.col("track").asc_nulls_first())) - 1)
    velocity = F.when(F.col("order") == _ORDER["note_off"], "0").otherwise(F.col("velocity").cast("string"))
    own = F.when(F.col("of_note"), message("note_on", channel=F.col("channel"), note=F.col("pitch"), velocity=velocity)).otherwise(F.col("m"))
    with_end = F.when(F.col("is_last"), F.array(F.struct("seq", own.alias("m")), F.struct((F.col("seq") + 1).alias("seq"), message(END).alias("m")))).otherwise(F.array(F.struct("seq", own.alias("m"))))
    return placed.select("file_id", "track_idx", "tick", F.inline(with_end)).select("file_id", "track_idx", "seq", "tick", "m.type", "m.is_meta", "m.fields")


def merged(messages: DataFrame) -> DataFrame:
    """One stream a file: tracks merged by tick, stable by track and place, with ``place`` and the gap to the message before as ``delta``.

    The ends of the tracks go; one end closes the stream at the last tick of all.
    """
    order = Window.partitionBy("file_id").orderBy("tick", "track_idx", "seq")
    body = messages.where(F.col("type") != END)
    ends = messages.groupBy("file_id").agg(F.max("tick").alias("tick")).select("file_id", F.lit(1 << 30).alias("track_idx"), F.lit(0).alias("seq"), "tick", F.lit(END).alias("type"), F.lit(True).alias("is_meta"), F.array().cast("array<struct<name:string,value:string>>").alias("fields"))
    rows = body.select("file_id", "track_idx", "seq", "tick", "type", "is_meta", "fields").unionByName(ends)
    return rows.withColumns({"place": F.row_number().over(order), "delta": F.col("tick") - F.lag("tick", 1, 0).over(order)})


def lines(stream: DataFrame) -> DataFrame:
    """A merged stream's messages as lines: the type, then every field that the message's own listing has.

    That listing begins with the type again; the gap follows it in channel messages and ends the line of meta messages.
    """
    values = F.transform("fields", lambda f: f["value"])
    gap = F.array(F.col("delta").cast("string"))
    kind = F.array(F.col("type"), F.col("type"))
    parts = F.when(F.col("is_meta"), F.concat(kind, values, gap)).otherwise(F.concat(kind, gap, values))
    return stream.withColumn("line", F.array_join(parts, " "))


def text(messages: DataFrame, ticks: int = TICKS, music: bool = True) -> DataFrame:
    """The message text of every file: file_id, text. Gaps are those of the whole stream, also where text messages are left out."""
    stream = merged(messages)
    rows = lines(music_messages(stream) if music else stream)
    body = rows.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda r: r["line"]), "\n").alias("body"))
    return body.select("file_id", F.concat(F.lit(f"ticks_per_beat {ticks}\n"), "body").alias("text"))


def even_tempo(messages: DataFrame, tempos: DataFrame, beats: DataFrame, ticks: int = TICKS, kinds: tuple[str, ...] = ("control_change", "pitchwheel")) -> DataFrame:
    """Controls and bends in seconds with their times on the even grid: file_id, track_idx, seq, type, fields, time_s, even_s."""
    rows = messages.where(F.col("type").isin(*kinds)).join(tempos, "file_id")
    timed = rows.select("file_id", "track_idx", "seq", "type", "fields", (F.col("tick") * (F.lit(60.0) / F.col("tempo_bpm") / F.lit(float(ticks)))).alias("time_s"))
    return note_ops.warp_times(timed.withColumn("even_s", F.col("time_s")), beats, ["even_s"])


def programs_of_notes(messages: DataFrame) -> DataFrame:
    """Every start of a note with the program that its channel has in its track at that place: file_id, track_idx, seq, note, program.

    The program is that of the last change before it, 0 if there is none.
    """
    order = Window.partitionBy("file_id", "track_idx", "channel").orderBy("tick", "seq").rowsBetween(Window.unboundedPreceding, 0)
    # Only what the window needs is sorted.
    rows = messages.select("file_id", "track_idx", "seq", "tick", field("channel").alias("channel"), field("program").alias("change"), F.when((F.col("type") == "note_on") & (field("velocity") != "0"), F.struct(field("note").cast("int").alias("note"))).alias("start"))
    rows = rows.where(F.col("start").isNotNull() | F.col("change").isNotNull()).withColumn("program", F.last("change", True).over(order))
    return rows.where(F.col("start").isNotNull()).select("file_id", "track_idx", "seq", "start.note", F.coalesce(F.col("program").cast("int"), F.lit(0)).alias("program"))
