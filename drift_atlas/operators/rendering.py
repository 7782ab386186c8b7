"""Notes to text, text to patches, notes to tokens: windows and array expressions, all inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drift_atlas.functions.transliterate import to_ascii

#: Fixed values of the formats.
PITCH_CLASSES = ["C", "^C", "D", "^D", "E", "F", "^F", "G", "^G", "A", "^A", "B"]
BAR_DELIMITERS = r"(\|:|::|:\||\[\||\|\||\|\]|\|)"
DELIMITER_LIST = ["|:", "::", ":|", "[|", "||", "|]", "|"]
PAD, BOS, EOS, MASK = 0, 1, 2, 3
MAX_GROUPS, MAX_PATCHES, PATCH = 4096, 512, 64
#: Message texts that a worker unpacks at once.
TEXTS_AT_ONCE = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it many times, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def abc_pitch(pitch: Column) -> Column:
    """ABC name of a MIDI pitch; 60 is C."""
    octave = F.floor(pitch / 12).cast("int") - 1
    name = F.get(F.array(*[F.lit(c) for c in PITCH_CLASSES]), (pitch % 12).cast("int"))
    return F.when(octave >= 5, F.concat(F.lower(name), F.repeat(F.lit("'"), octave - 5))).otherwise(F.concat(name, F.repeat(F.lit(","), F.lit(4) - octave)))


def chord_groups(notes: DataFrame, tempos: DataFrame) -> DataFrame:
    """Notes but drums on the sixteenth grid, grouped by onset: file_id, onset, pitches, duration."""
    unit = F.lit(60.0) / F.col("tempo_bpm") / F.lit(4.0)
    melodic = notes.where(~F.col("is_drum")).join(tempos, "file_id").select(
        "file_id", F.rint(F.col("start_s") / unit).cast("long").alias("onset"), "pitch",
        F.greatest(F.lit(1), F.rint((F.col("end_s") - F.col("start_s")) / unit).cast("long")).cast("long").alias("dur"), abc_pitch(F.col("pitch")).alias("name"),
    )
    grouped = melodic.groupBy("file_id", "onset").agg(F.array_sort(F.collect_set(F.struct("pitch", "name"))).alias("chord"), F.max("dur").alias("duration"))
    return grouped.select("file_id", "onset", "duration", F.transform("chord", lambda c: c["pitch"]).alias("pitches"), F.array_join(F.transform("chord", lambda c: c["name"]), "").alias("names"))


def abc_text(notes: DataFrame, tempos: DataFrame, num: int = 4, den: int = 4, max_groups: int = MAX_GROUPS) -> DataFrame:
    """ABC text of every file. It depends on pitches and times only, never on velocities."""
    per_bar = max(1, num * 16 // den)
    order = Window.partitionBy("file_id").orderBy("onset")
    rows = chord_groups(notes, tempos).withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_groups)
    bar = F.floor(F.col("onset") / per_bar)
    rows = rows.withColumn("bar", bar).withColumns({"gap": F.col("onset") - F.lag(F.col("onset") + F.col("duration"), 1, 0).over(order), "prior": F.lag("bar", 1, 0).over(order)})
    length = F.when(F.col("duration") == 1, "").otherwise(F.col("duration").cast("string"))
    rest = F.when(F.col("gap") > 1, F.concat(F.lit("z"), F.col("gap").cast("string"))).when(F.col("gap") == 1, "z")
    turn = F.col("bar") > F.col("prior")
    chord = F.when(F.size("pitches") == 1, F.concat("names", length)).otherwise(F.concat(F.lit("["), "names", F.lit("]"), length))
    part = F.concat_ws(" ", rest, F.when(turn, "|"), F.when(turn & (F.col("bar") % 4 == 0), "\n"), chord)
    bodies = rows.select("file_id", "onset", part.alias("part")).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("onset", "part"))), lambda p: p["part"]), " ").alias("body"))
    header = F.concat(F.lit(f"X:1\nM:{num}/{den}\nL:1/16\nQ:"), F.rint("tempo_bpm").cast("long").cast("string"), F.lit("\nK:C\n"))
    out = tempos.join(bodies, "file_id", "left")
    return out.select("file_id", F.concat(header, F.coalesce(F.concat("body", F.lit(" |\n")), F.lit("z16 |\n"))).alias("abc"))


def split_bars(line: Column) -> Column:
    """Bars of a line, each with the delimiter that ends it; a leading delimiter joins the first bar, an odd tail goes."""
    pieces = F.filter(F.split(F.regexp_replace(line, BAR_DELIMITERS, "\u0001$1\u0001"), "\u0001"), lambda p: p != "")

    def merged(b: Column) -> Column:
        first = F.get(b, F.lit(0))
        return F.when(first.isin(DELIMITER_LIST), F.when(F.size(b) > 1, F.concat(F.array(F.concat(first, F.get(b, F.lit(1)))), F.slice(b, 3, 1 << 20))).otherwise(F.array().cast("array<string>"))).otherwise(b)

    def paired(b: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(b) / 2).cast("int") - 1), lambda i: F.concat(F.get(b, i * 2), F.get(b, i * 2 + 1)))
        return F.when(F.size(b) < 2, b).otherwise(pairs)

    return let(let(pieces, merged), paired)


def bar_patch(bar: Column, size: int) -> Column:
    """Code points between begin and end marks, cut and padded to the size."""
    codes = F.when(bar == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(bar, ""), lambda c: F.ascii(c)))
    full = F.concat(F.array(F.lit(BOS)), codes, F.array(F.lit(EOS)))
    return F.slice(F.concat(full, F.array_repeat(F.lit(PAD), size)), 1, size)


def abc_patches(texts: DataFrame, size: int, special: bool = False, truncate: bool = True) -> DataFrame:
    """Patches of ABC text, in ASCII: header lines whole, other lines by bars; file_id, patch_idx, codes."""
    lines = F.filter(F.regexp_extract_all(to_ascii(F.col("abc")), F.lit(r"[^\n]*\n|[^\n]+$"), 0), lambda x: x != "")

    def of_line(x: Column) -> Column:
        header = ((F.length(x) > 1) & x.rlike(r"^\p{L}:")) | x.startswith("%%")
        bars = split_bars(x)
        ended = let(bars, lambda b: F.when(F.size(b) == 0, b).otherwise(F.concat(F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0))), F.array(F.concat(F.get(b, F.size(b) - 1), F.lit("\n"))))))
        return F.when(header, F.array(x)).otherwise(ended)

    patches = F.flatten(F.transform(lines, of_line))
    if special:
        patches = F.concat(F.array(F.lit(chr(BOS) * size)), patches, F.array(F.lit(chr(EOS) * size)))
    if truncate:
        patches = F.slice(patches, 1, MAX_PATCHES)
    patches = let(patches, lambda p: F.when(F.size(p) == 0, F.array(F.lit(""))).otherwise(p))
    rows = texts.select("file_id", F.posexplode(patches).alias("patch_idx", "patch"))
    return rows.select("file_id", F.col("patch_idx").cast("long").alias("patch_idx"), bar_patch(F.col("patch"), size).alias("codes"))


def pack_messages(text: str, size: int) -> list[str]:
    """Greedy packing of message lines: a line joins the patch that begins with its type while there is room."""
    packed: list[str] = []
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        kind, _, payload = line.partition(" ")
        if packed and packed[-1].startswith(kind) and len(packed[-1]) + len(payload) <= size - 2:
            packed[-1] = packed[-1][:-1] + "\t" + payload
        else:
            packed.append(line)
    return packed[:MAX_PATCHES] or [""]


def message_patches(texts: DataFrame, size: int) -> DataFrame:
    """Patches of message text, in ASCII: file_id, patch_idx, patch. The fold has state, so it runs in Arrow batches.

    Texts are unpacked a few at a time, so a worker holds the patches of these and not those of a batch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(first, TEXTS_AT_ONCE)
                packed = [pack_messages(t or "", size) for t in part.column(1).to_pylist()]
                owner = np.repeat(np.arange(len(packed)), [len(p) for p in packed])
                places = pa.array([k for p in packed for k in range(len(p))], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), places, pa.array([x for p in packed for x in p], pa.string())], names=["file_id", "patch_idx", "patch"])

    return texts.select(F.col("file_id").cast("long").alias("file_id"), to_ascii(F.col("text")).alias("text")).mapInArrow(run, "file_id long, patch_idx long, patch string")


# Event tokenizers -----------------------------------------------------------

#: Grid, ranges and bins, and the first id of every event kind of the vocabulary.
STEPS, BEATS_PER_BAR, LOW, HIGH, VELOCITIES, DURATIONS, SHIFTS = 8, 4, 21, 108, 32, 64, 256
BAR_STEPS = STEPS * BEATS_PER_BAR
FIRST = {"Bar": 4, "Position": 5, "Pitch": 37, "Velocity": 125, "Duration": 157, "TimeShift": 221, "NoteOff": 477}
VOCABULARY = FIRST["NoteOff"] + HIGH - LOW + 1
KINDS = ("REMI", "TSD", "Octuple", "MIDILike")


def token_name(token: Column) -> Column:
    """Name of an id: its kind and value; ids outside the vocabulary are UNK_<id>."""
    name = F.concat(F.lit("UNK_"), token.cast("string"))
    out = F.when(token < 4, F.get(F.array(F.lit("PAD"), F.lit("BOS"), F.lit("EOS"), F.lit("MASK")), token.cast("int")))
    for kind, first, last in (("Bar", 4, 4), ("Position", 5, 36), ("Pitch", 37, 124), ("Velocity", 125, 156), ("Duration", 157, 220), ("TimeShift", 221, 476), ("NoteOff", 477, VOCABULARY - 1)):
        base = LOW if kind in ("Pitch", "NoteOff") else 0
        out = out.when((token >= first) & (token <= last), F.concat(F.lit(f"{kind}_"), (token - first + base).cast("string")))
    return out.otherwise(name)


def _grid(notes: DataFrame, tempos: DataFrame) -> DataFrame:
    step = F.lit(60.0) / F.col("tempo_bpm") / F.lit(float(STEPS))
    rows = notes.where(F.col("pitch").between(LOW, HIGH)).join(tempos, "file_id")
    dur = F.greatest(F.lit(1), F.least(F.lit(DURATIONS), F.rint((F.col("end_s") - F.col("start_s")) / step).cast("long")))
    return rows.select("file_id", "note_id", "pitch", F.rint(F.col("start_s") / step).cast("long").alias("onset"), dur.cast("long").alias("dur"), F.floor(F.col("velocity") * VELOCITIES / 128).alias("vel"))


def tokenize(notes: DataFrame, tempos: DataFrame, kind: str) -> DataFrame:
    """Token ids of every file: file_id, tokens."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")
    rows = _grid(notes, tempos)
    pitch, vel, dur = F.col("pitch") - LOW + FIRST["Pitch"], F.col("vel") + FIRST["Velocity"], F.col("dur") - 1 + FIRST["Duration"]
    some = lambda test, x: F.when(test, F.array(x)).otherwise(F.array().cast("array<bigint>"))
    order = Window.partitionBy("file_id").orderBy("onset", "pitch", "note_id")
    if kind == "MIDILike":
        on = F.struct(F.col("onset").alias("at"), F.lit(1).alias("o"), "pitch", "note_id", F.array(pitch, vel).alias("ids"))
        off = F.struct((F.col("onset") + F.col("dur")).alias("at"), F.lit(0).alias("o"), "pitch", "note_id", F.array(F.col("pitch") - LOW + FIRST["NoteOff"]).alias("ids"))
        events = rows.select("file_id", F.inline(F.array(on, off)))
        turn = Window.partitionBy("file_id").orderBy("at", "o", "pitch", "note_id")
        gap = F.col("at") - F.lag("at", 1, 0).over(turn)
        part = events.select("file_id", F.struct("at", "o", "pitch", "note_id", F.concat(some(gap > 0, F.least(gap, F.lit(SHIFTS)) - 1 + FIRST["TimeShift"]), "ids").alias("ids")).alias("e"))
    else:
        if kind == "REMI":
            bar, prior = F.floor(F.col("onset") / BAR_STEPS), F.lag("onset", 1).over(order)
            bars = bar - F.coalesce(F.floor(prior / BAR_STEPS), F.lit(-1))
            new = F.coalesce(F.col("onset") != prior, F.lit(True))
            ids = F.concat(F.array_repeat(F.lit(FIRST["Bar"]).cast("long"), bars.cast("int")), some(new, F.col("onset") % BAR_STEPS + FIRST["Position"]), F.array(pitch, vel, dur))
        elif kind == "TSD":
            gap = F.col("onset") - F.lag("onset", 1, 0).over(order)
            ids = F.concat(some(gap > 0, F.least(gap, F.lit(SHIFTS)) - 1 + FIRST["TimeShift"]), F.array(pitch, vel, dur))
        else:
            ids = F.array(pitch, vel, dur, F.col("onset") % BAR_STEPS + FIRST["Position"], F.least(F.floor(F.col("onset") / BAR_STEPS), F.lit(SHIFTS - 1)) + FIRST["TimeShift"])
        part = rows.select("file_id", F.struct("onset", "pitch", "note_id", ids.alias("ids")).alias("e"))
    return part.groupBy("file_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["ids"])).alias("tokens"))


def detokenize(tokens: DataFrame) -> DataFrame:
    """Notes of REMI tokens: file_id, onset, pitch, vel, dur. Bars and positions are running values."""
    rows = tokens.select("file_id", F.posexplode("tokens").alias("at", "t"))
    order = Window.partitionBy("file_id").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumns({
        "bar": F.sum((F.col("t") == FIRST["Bar"]).cast("long")).over(so_far) - 1,
        "pos": F.last(F.when(F.col("t").between(5, 36), F.col("t") - 5), True).over(so_far),
        "vel": F.lead("t", 1).over(order) - FIRST["Velocity"], "dur": F.lead("t", 2).over(order) - FIRST["Duration"] + 1,
    })
    return placed.where(F.col("t").between(37, 124)).select("file_id", (F.col("bar") * BAR_STEPS + F.col("pos")).alias("onset"), (F.col("t") - FIRST["Pitch"] + LOW).alias("pitch"), "vel", "dur")
