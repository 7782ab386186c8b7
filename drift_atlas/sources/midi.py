"""Standard MIDI files: a parser, a writer and a Python data source for note tables."""

from __future__ import annotations

import bisect
import itertools
import struct
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NOTE_SCHEMA = "path string, track_idx int, program int, is_drum boolean, note_idx int, pitch int, velocity int, start_s double, end_s double"
DEFAULT_TEMPO_US = 500_000
DRUM_CHANNEL = 9


def _varlen(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    while True:
        byte = data[at]
        at += 1
        value = value << 7 | byte & 0x7F
        if byte < 0x80:
            return value, at


def _events(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tick, status, data) of one track; meta events have status 0xFF and their type as first byte."""
    at = tick = status = 0
    while at < len(data):
        gap, at = _varlen(data, at)
        tick += gap
        if data[at] >= 0x80:
            status = data[at]
            at += 1
        elif status < 0x80:
            raise ValueError("a running status without a status")
        if status == 0xFF:
            kind, at = data[at], at + 1
            size, at = _varlen(data, at)
            yield tick, 0xFF, bytes([kind]) + data[at : at + size]
            at += size
        elif status in (0xF0, 0xF7):
            size, at = _varlen(data, at)
            at += size
        else:
            size = 1 if status & 0xF0 in (0xC0, 0xD0) else 2
            yield tick, status, data[at : at + size]
            at += size


def _tracks(data: bytes) -> tuple[int, list[list[tuple[int, int, bytes]]]]:
    """Ticks of a quarter note, and the events of every track. ValueError for what is no MIDI file."""
    if data[:4] != b"MThd" or len(data) < 14:
        raise ValueError("not a MIDI file")
    size, _, tracks, division = struct.unpack(">IHHH", data[4:14])
    if division & 0x8000 or not division:
        raise ValueError("only ticks per quarter are supported")
    at, parsed = 8 + size, []
    for _ in range(tracks):
        if data[at : at + 4] != b"MTrk":
            raise ValueError("a track is missing")
        length = struct.unpack(">I", data[at + 4 : at + 8])[0]
        parsed.append(list(_events(data[at + 8 : at + 8 + length])))
        at += 8 + length
    return division, parsed


def parse(data: bytes) -> list[dict]:
    """Notes of a file in seconds, by track and start; a note has the program that its channel has when the note ends."""
    division, parsed = _tracks(data)
    tempos = sorted((t, int.from_bytes(d[1:4], "big")) for events in parsed for t, s, d in events if s == 0xFF and d[:1] == b"\x51")
    changes, seconds, last, us = [(0, 0.0, DEFAULT_TEMPO_US)], 0.0, 0, DEFAULT_TEMPO_US
    for tick, tempo in tempos:
        seconds += (tick - last) * us / 1e6 / division
        last, us = tick, tempo
        changes.append((tick, seconds, us))
    ticks = [c[0] for c in changes]

    def when(tick: int) -> float:
        base = changes[bisect.bisect_right(ticks, tick) - 1]
        return base[1] + (tick - base[0]) * base[2] / 1e6 / division

    out = []
    for k, events in enumerate(parsed):
        program: dict[int, int] = {}
        sounding: dict[tuple[int, int], list[tuple[int, int]]] = {}
        notes = []
        for tick, status, d in events:
            kind, channel = status & 0xF0, status & 0x0F
            if kind == 0xC0:
                program[channel] = d[0]
            elif kind == 0x90 and d[1]:
                sounding.setdefault((channel, d[0]), []).append((tick, d[1]))
            elif kind in (0x80, 0x90):
                for start, velocity in sounding.pop((channel, d[0]), []):
                    notes.append((start, d[0], tick, velocity, channel, program.get(channel, 0)))
        for n, (start, pitch, end, velocity, channel, held) in enumerate(sorted(notes)):
            out.append({"track_idx": k, "program": held, "is_drum": channel == DRUM_CHANNEL, "note_idx": n, "pitch": pitch, "velocity": velocity, "start_s": when(start), "end_s": when(end)})
    return out


MESSAGE_SCHEMA = "path string, track_idx int, seq int, tick long, type string, is_meta boolean, fields array<struct<name:string,value:string>>, ticks_per_beat int"

#: Fixed values of the format: channel messages by the upper half of their status, and meta messages by their type, each with its fields.
CHANNEL_MESSAGES = {
    0x80: ("note_off", ["note", "velocity"]), 0x90: ("note_on", ["note", "velocity"]), 0xA0: ("polytouch", ["note", "value"]),
    0xB0: ("control_change", ["control", "value"]), 0xC0: ("program_change", ["program"]), 0xD0: ("aftertouch", ["value"]), 0xE0: ("pitchwheel", ["pitch"]),
}
META_MESSAGES = {
    0x00: ("sequence_number", ["number"]), 0x01: ("text", ["text"]), 0x02: ("copyright", ["text"]), 0x03: ("track_name", ["name"]), 0x04: ("instrument_name", ["name"]),
    0x05: ("lyrics", ["text"]), 0x06: ("marker", ["text"]), 0x07: ("cue_marker", ["text"]), 0x09: ("device_name", ["name"]), 0x20: ("channel_prefix", ["channel"]), 0x21: ("midi_port", ["port"]),
    0x2F: ("end_of_track", []), 0x51: ("set_tempo", ["tempo"]), 0x58: ("time_signature", ["numerator", "denominator", "clocks_per_click", "notated_32nd_notes_per_beat"]), 0x59: ("key_signature", ["key"]), 0x7F: ("sequencer_specific", ["data"]),
}
_TEXTS = {"text", "copyright", "track_name", "instrument_name", "lyrics", "marker", "cue_marker", "device_name"}


def _key_name(sharps: int, minor: int) -> str:
    """The key with so many sharps (flats, if negative), by the circle of fifths."""
    octave, letter = divmod(sharps + (4 if minor else 1), 7)
    return "FCGDAEB"[letter] + "#" * octave + "b" * -octave + "m" * minor


def _meta_values(kind: str, data: bytes) -> list[str]:
    if kind in _TEXTS:
        return [data.decode("latin-1")]
    if kind == "time_signature":
        return [str(data[0]), str(1 << data[1]), str(data[2]), str(data[3])]
    if kind == "key_signature":
        return [_key_name(struct.unpack("b", data[:1])[0], data[1])]
    if kind == "sequencer_specific":
        return [str(tuple(data))]
    return [str(int.from_bytes(data, "big"))]


def messages(data: bytes) -> list[dict]:
    """All messages of a file but system exclusive ones: track, place in it, tick, type and fields in the order of the format."""
    division, parsed = _tracks(data)
    out = []
    for k, events in enumerate(parsed):
        for n, (tick, status, d) in enumerate(events):
            if status == 0xFF:
                kind, names = META_MESSAGES.get(d[0], ("unknown_meta", ["type_byte", "data"]))
                values = [str(d[0]), str(tuple(d[1:]))] if kind == "unknown_meta" else _meta_values(kind, d[1:]) if names else []
            else:
                kind, names = CHANNEL_MESSAGES[status & 0xF0]
                names = ["channel", *names]
                values = [str(status & 0x0F), *([str((d[1] << 7 | d[0]) - 8192)] if kind == "pitchwheel" else map(str, d))]
            out.append({"track_idx": k, "seq": n, "tick": tick, "type": kind, "is_meta": status == 0xFF, "fields": [{"name": a, "value": b} for a, b in zip(names, values)], "ticks_per_beat": division})
    return out


def load_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of all MIDI files of a folder; files that are not MIDI are left out."""
    return _parsed(spark, folder, messages, MESSAGE_SCHEMA)


#: Files whose messages are Python objects at one time.
_FILES_AT_A_TIME = 64

_STATUS = {name: status for status, (name, _) in CHANNEL_MESSAGES.items()}
_META_TYPE = {name: kind for kind, (name, _) in META_MESSAGES.items()}
_SHORT = [bytes([k]) for k in range(0x80)]


def _message_bytes(kind: str, values: list[str]) -> bytes:
    """One message, without its gap. Key signatures and data of unknown form can't be written."""
    if kind in _STATUS:
        channel, *rest = map(int, values)
        body = [(rest[0] + 8192) & 0x7F, (rest[0] + 8192) >> 7] if kind == "pitchwheel" else rest
        return bytes([_STATUS[kind] | channel, *body])
    if kind in _TEXTS:
        body = values[0].encode("latin-1", "replace")
    elif kind == "time_signature":
        body = bytes([int(values[0]), int(values[1]).bit_length() - 1, int(values[2]), int(values[3])])
    elif kind == "end_of_track":
        body = b""
    else:
        width = {"set_tempo": 3, "sequence_number": 2}.get(kind, 1)
        body = int(values[0]).to_bytes(width, "big")
    return bytes([0xFF, _META_TYPE[kind]]) + _as_varlen(len(body)) + body


def write_messages(rows: list[dict], division: int = 480) -> bytes:
    """A file of messages (track_idx, seq, tick, type, fields); every track ends with an end_of_track, made if there is none."""
    return _file(((r["track_idx"], r["tick"], r["seq"], r["type"], [f["value"] for f in r["fields"]]) for r in rows), division)


def _file(rows: Iterable[tuple[int, int, int, str, list[str]]], division: int = 480) -> bytes:
    """A file of messages as (track_idx, tick, seq, type, values)."""
    tracks: dict[int, bytearray] = {}
    last, ends = {}, {}
    for k, tick, _, kind, values in sorted(rows, key=lambda r: r[:3]):
        body = tracks.setdefault(k, bytearray())
        body += _as_varlen(tick - last.get(k, 0)) + _message_bytes(kind, values)
        last[k], ends[k] = tick, kind == "end_of_track"
    for k, body in tracks.items():
        if not ends[k]:
            body += b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 1, len(tracks), division) + b"".join(b"MTrk" + struct.pack(">I", len(t)) + t for t in tracks.values())


def files_of_messages(messages: DataFrame) -> DataFrame:
    """file_id, content: every file of a message table as the bytes of a MIDI file.

    Messages come to Python as the columns of a batch of files, not as a table or a dict for each message.
    """
    names = ["track_idx", "tick", "seq", "type", "values"]
    rows = messages.withColumn("values", F.transform("fields", lambda f: f["value"]))
    rows = rows.groupBy("file_id").agg(F.collect_list(F.struct(*names)).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _FILES_AT_A_TIME):
                part = batch.slice(at, _FILES_AT_A_TIME)
                lists = part.column("rows")
                flat = lists.flatten()
                cells = zip(*(flat.field(n).to_pylist() for n in names))
                content = [_file(itertools.islice(cells, size)) for size in pc.list_value_length(lists).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("file_id"), pa.array(content, pa.binary())], names=["file_id", "content"])

    return rows.mapInArrow(run, f"file_id {dict(messages.dtypes)['file_id']}, content binary")


def _as_varlen(value: int) -> bytes:
    if 0 <= value < 0x80:
        return _SHORT[value]
    out = bytearray([value & 0x7F])
    while value := value >> 7:
        out.insert(0, value & 0x7F | 0x80)
    return bytes(out)


def write(notes: list[dict], division: int = 480, tempo_bpm: float = 120.0) -> bytes:
    """A file of one tempo with a track for every track_idx; times are rounded to ticks."""
    us = round(60e6 / tempo_bpm)
    tick = lambda s: round(s * 1e6 / us * division)
    tracks = [b"\x00\xff\x51\x03" + us.to_bytes(3, "big") + b"\x00\xff\x2f\x00"]
    for k in sorted({n["track_idx"] for n in notes}):
        own = [n for n in notes if n["track_idx"] == k]
        channel = DRUM_CHANNEL if own[0]["is_drum"] else 0
        events = [(0, 0, bytes([0xC0 | channel, own[0]["program"]]))]
        for n in own:
            events.append((tick(n["start_s"]), 2, bytes([0x90 | channel, n["pitch"], n["velocity"]])))
            events.append((tick(n["end_s"]), 1, bytes([0x80 | channel, n["pitch"], 0])))
        body, last = b"", 0
        for at, _, data in sorted(events):
            body += _as_varlen(at - last) + data
            last = at
        tracks.append(body + b"\x00\xff\x2f\x00")
    head = b"MThd" + struct.pack(">IHHH", 6, 1, len(tracks), division)
    return head + b"".join(b"MTrk" + struct.pack(">I", len(t)) + t for t in tracks)


def _parsed(spark: SparkSession, folder: str, parser, schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mid*").load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in schema.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [{"path": path, **n} for n in parser(bytes(content))]
                except (ValueError, IndexError, KeyError, struct.error):
                    continue
                yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, schema)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of all MIDI files of a folder, read by Spark; files that are not MIDI are left out."""
    return _parsed(spark, folder, parse, NOTE_SCHEMA)


def save(notes: DataFrame, folder: str) -> DataFrame:
    """Write one MIDI file a ``name`` below a folder that all workers share: name, bytes, problem.

    ``notes`` has the columns of the readers and ``name``, relative to the folder, and may
    have tempo_bpm. Folders are made, a file that fails is reported and does not stop the
    others, and a task that runs again writes the same bytes.
    """
    kept = notes.select("name", "track_idx", "program", "is_drum", "note_idx", "pitch", "velocity", "start_s", "end_s", (F.col("tempo_bpm") if "tempo_bpm" in notes.columns else F.lit(120.0)).alias("tempo_bpm"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        import pyarrow.fs as pafs

        name, size, problem = group["name"].iloc[0], 0, None
        try:
            data = write(group.sort_values(["track_idx", "note_idx"]).to_dict("records"), tempo_bpm=float(group["tempo_bpm"].iloc[0]))
            fs, base = pafs.FileSystem.from_uri(folder)
            fs.create_dir(f"{base}/{name}".rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(data)
            size = len(data)
        except Exception as error:  # one file's failure must not end the others
            problem = type(error).__name__
        return pd.DataFrame({"name": [name], "bytes": [size], "problem": [problem]})

    return kept.groupBy("name").applyInPandas(run, "name string, bytes long, problem string")


class _Partition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[_Partition]:
        return [_Partition(p) for p in self.paths]

    def read(self, partition: _Partition) -> Iterator[tuple]:
        import pyarrow.fs as pafs

        fs, path = pafs.FileSystem.from_uri(partition.path)
        with fs.open_input_file(path) as f:
            data = f.read()
        try:
            notes = parse(data)
        except (ValueError, IndexError, struct.error):
            return
        for n in notes:
            yield (partition.path, n["track_idx"], n["program"], n["is_drum"], n["note_idx"], n["pitch"], n["velocity"], n["start_s"], n["end_s"])


class MidiSource(DataSource):
    """spark.read.format("midi").option("paths", "a,b"): notes of the named files, a task a file."""

    @classmethod
    def name(cls) -> str:
        return "midi"

    def schema(self) -> str:
        return NOTE_SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader([p for p in self.options.get("paths", "").split(",") if p])
