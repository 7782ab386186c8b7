"""MIDI messages, and the as-of join that serves note times."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from drift_atlas.operators import asof
from drift_atlas.operators import messages as ms
from drift_atlas.operators import notes as note_ops
from drift_atlas.sources import midi


@pytest.mark.parametrize("cell", [0.5, 60.0])
def test_last_mark_against_plain_search(spark, cell):
    """A hot key, keys without marks, null keys and times, marks at one time, and times on the bounds of cells."""
    rng = random.Random(2)
    keys = [1] * 400 + [2] * 20 + [3] * 5 + [None] * 20
    rows = [(k, i, rng.choice([rng.uniform(-3, 30), float(rng.randint(0, 30)), None])) for i, k in enumerate(keys)]
    marks = [(k, n, rng.choice([rng.uniform(0, 30), float(rng.randint(0, 30))])) for k in (1, 2, None) for n in range(40)] + [(1, 99, None), (2, 98, 5.0), (2, 97, 5.0)]
    left = spark.createDataFrame(rows, "key long, id long, t double").repartition(3)
    right = spark.createDataFrame(marks, "key long, n long, at double").repartition(2)
    got = {r.id: r.mark.n if r.mark else None for r in asof.last_mark(left, right, ["key"], "t", "at", "n", cell=cell).collect()}
    assert len(got) == len(rows)
    for key, i, t in rows:
        before = [(at, n) for k, n, at in marks if k == key and at is not None and t is not None and at <= t]
        assert got[i] == (max(before)[1] if before else None)
    assert asof.last_mark(left, right.limit(0), ["key"], "t", "at", "n").where("mark is not null").count() == 0
    assert asof.last_mark(left.limit(0), right, ["key"], "t", "at", "n").count() == 0


def test_tempo_of_files_with_few_beats(spark):
    """No beats and one beat leave times as they are; one table of any times is warped like notes."""
    beats = spark.createDataFrame([(1, k, 0.5 + k * 0.4 + 0.01 * (k % 3)) for k in range(9)] + [(2, 0, 0.3)], "file_id long, k long, t double")
    rows = spark.createDataFrame([(f, n, t) for f in (1, 2, 3) for n, t in enumerate([0.0, 0.5, 1.0, 2.2, 9.0])], "file_id long, n long, time_s double")
    got = {(r.file_id, r.n): r.time_s for r in note_ops.warp_times(rows, beats, ["time_s"]).collect()}
    grid = [0.5 + k * 0.4 + 0.01 * (k % 3) for k in range(9)]
    for (f, n), t in got.items():
        was = [0.0, 0.5, 1.0, 2.2, 9.0][n]
        if f != 1:
            assert t == was
        elif was <= grid[0]:
            assert t == 0
        elif was >= grid[-1]:
            assert t == pytest.approx(8 * 0.5 + (was - grid[-1]) * 0.5 / (grid[-1] - grid[-2]))
        else:
            k = max(k for k in range(9) if grid[k] <= was)
            assert t == pytest.approx((k + (was - grid[k]) / (grid[k + 1] - grid[k])) * 0.5)


def track(*events):
    body = b"".join(midi._as_varlen(gap) + data for gap, data in events)
    return b"MTrk" + struct.pack(">I", len(body)) + body


def test_a_note_has_the_program_of_its_time_and_many_tempos_are_followed():
    tempos = [(0 if k == 0 else 48, b"\xff\x51\x03" + (300_000 + 1000 * k).to_bytes(3, "big")) for k in range(200)]
    notes = [(0, b"\xc0\x05"), (0, b"\x90\x3c\x40"), (480, b"\x80\x3c\x00"), (0, b"\xc0\x07"), (0, b"\x90\x3e\x41"), (480, b"\x90\x3e\x00"), (9000, b"\x91\x40\x10"), (10, b"\x81\x40\x00")]
    end = (0, b"\xff\x2f\x00")
    data = b"MThd" + struct.pack(">IHHH", 6, 1, 2, 480) + track(*tempos, end) + track(*notes, end)
    got = midi.parse(data)
    assert [(n["pitch"], n["program"]) for n in got] == [(60, 5), (62, 7), (64, 0)]

    def when(tick):
        return sum(min(max(tick - 48 * k, 0), 48 if k < 199 else 1 << 40) * (300_000 + 1000 * k) for k in range(200)) / 1e6 / 480

    assert [(n["start_s"], n["end_s"]) for n in got] == [pytest.approx((when(a), when(b))) for a, b in ((0, 480), (480, 960), (9960, 9970))]


def test_messages_of_a_file_and_back():
    events = [
        (0, b"\xff\x03\x02ab"), (0, b"\xff\x51\x03\x07\xa1\x20"), (0, b"\xff\x58\x04\x03\x03\x18\x08"), (0, b"\xff\x59\x02\xfd\x01"), (5, b"\xb1\x07\x64"), (0, b"\xe1\x00\x40"),
        (0, b"\xd1\x09"), (0, b"\xa1\x10\x11"), (3, b"\xf0\x02\x01\xf7"), (0, b"\xc1\x20"), (0, b"\x91\x3c\x40"), (2, b"\x3d\x41"), (10, b"\x81\x3c\x40"), (0, b"\xff\x0a\x01\x05"), (0, b"\xff\x7f\x01\x09"), (1, b"\xff\x2f\x00"),
    ]
    data = b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + track(*events)
    got = midi.messages(data)
    named = lambda m: (m["tick"], m["type"], [(f["name"], f["value"]) for f in m["fields"]])
    assert [named(m) for m in got] == [
        (0, "track_name", [("name", "ab")]), (0, "set_tempo", [("tempo", "500000")]),
        (0, "time_signature", [("numerator", "3"), ("denominator", "8"), ("clocks_per_click", "24"), ("notated_32nd_notes_per_beat", "8")]), (0, "key_signature", [("key", "Cm")]),
        (5, "control_change", [("channel", "1"), ("control", "7"), ("value", "100")]), (5, "pitchwheel", [("channel", "1"), ("pitch", "0")]), (5, "aftertouch", [("channel", "1"), ("value", "9")]),
        (5, "polytouch", [("channel", "1"), ("note", "16"), ("value", "17")]), (8, "program_change", [("channel", "1"), ("program", "32")]), (8, "note_on", [("channel", "1"), ("note", "60"), ("velocity", "64")]),
        (10, "note_on", [("channel", "1"), ("note", "61"), ("velocity", "65")]), (20, "note_off", [("channel", "1"), ("note", "60"), ("velocity", "64")]),
        (20, "unknown_meta", [("type_byte", "10"), ("data", "(5,)")]), (20, "sequencer_specific", [("data", "(9,)")]), (21, "end_of_track", []),
    ]
    known = [m for m in got if m["type"] not in ("unknown_meta", "sequencer_specific", "key_signature")]
    again = midi.messages(midi.write_messages(known, 96))
    assert [named(m) for m in again] == [named(m) for m in known]
    assert [midi._key_name(k, 0) for k in (-7, -1, 0, 1, 7)] == ["Cb", "F", "C", "G", "C#"] and [midi._key_name(k, 1) for k in (-7, 0, 3, 7)] == ["Abm", "Am", "F#m", "A#m"]
    with pytest.raises(ValueError):
        midi.messages(b"MThd")


def test_load_messages_skips_what_is_no_midi(spark, tmp_path):
    (tmp_path / "a.mid").write_bytes(b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + track((0, b"\x90\x3c\x40"), (4, b"\xff\x2f\x00")))
    (tmp_path / "b.mid").write_bytes(b"nothing of the kind")
    (tmp_path / "c.mid").write_bytes(b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + track((0, b"\x3c\x40")))
    got = midi.load_messages(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.type, r.tick, r.ticks_per_beat) for r in got] == [("note_on", 0, 96), ("end_of_track", 4, 96)]


def test_merged_text_of_two_tracks(spark):
    """Ties in the order of tracks, gaps over left-out texts, one end at the last tick of all."""
    field = lambda **v: [(k, str(x)) for k, x in v.items()]
    rows = [
        (1, 0, 0, 0, "set_tempo", True, field(tempo=500000)), (1, 0, 1, 900, "end_of_track", True, []), (1, 1, 0, 0, "track_name", True, field(name="x")),
        (1, 1, 1, 10, "note_on", False, field(channel=0, note=60, velocity=64)), (1, 1, 2, 20, "lyrics", True, field(text="la")), (1, 1, 3, 50, "note_on", False, field(channel=0, note=60, velocity=0)),
        (1, 1, 4, 50, "end_of_track", True, []), (1, 0, 2, 10, "marker", True, field(text="m")), (2, 0, 0, 7, "end_of_track", True, []),
    ]
    frame = spark.createDataFrame(rows, "file_id long, track_idx int, seq int, tick long, type string, is_meta boolean, fields array<struct<name:string,value:string>>")
    got = {r.file_id: r.text for r in ms.text(frame, 96).collect()}
    assert got == {
        1: "ticks_per_beat 96\nset_tempo set_tempo 500000 0\nnote_on note_on 0 0 60 64\nnote_on note_on 30 0 60 0\nend_of_track end_of_track 850",
        2: "ticks_per_beat 96\nend_of_track end_of_track 7",
    }
    whole = {r.file_id: r.text for r in ms.text(frame, 96, music=False).collect()}
    assert "marker marker m 10\nnote_on note_on 0 0 60 64\nlyrics lyrics la 10" in whole[1]
    assert ms.text(frame.limit(0)).count() == 0


def test_beats_are_made_by_many_tasks(spark):
    """Ids are few bytes, but their beats are not: adaptive execution must not leave all files to one task."""
    from drift_atlas.sources import fixtures

    files = spark.range(500).select(F.col("id").alias("file_id"))
    made = fixtures.beats(files).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in made) == 500 * fixtures.BEATS and max(r["count"] for r in made) < 500 * fixtures.BEATS / 3


def test_tasks_of_notes_grow_with_their_count_and_messages_stay_there(spark, monkeypatch):
    """Few bytes of events are many notes: more of them make more tasks, and messages of a file are made where its notes are."""
    from drift_atlas.sources import fixtures

    monkeypatch.setattr(fixtures, "NOTES_OF_A_TASK", 50)
    made = fixtures.notes(spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() == -(-made.count() // 50) > spark.sparkContext.defaultParallelism
    plan = fixtures.messages(made)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_files_of_messages_in_batches(spark, monkeypatch):
    """More files than are taken at a time, rows in any order, a track without an end, and a text that is no Latin-1."""
    monkeypatch.setattr(midi, "_FILES_AT_A_TIME", 3)
    field = lambda **v: [(k, str(x)) for k, x in v.items()]
    rows = [(f, k, n, 200 * n, "note_on", False, field(channel=0, note=60 + f, velocity=n)) for f in range(8) for k in (1, 2) for n in range(1, 5 + f)]
    rows += [(f, 0, 0, 0, "track_name", True, field(name=f"\u00e9 {f} \u0416")) for f in range(8)] + [(f, 1, 99, 9000, "end_of_track", True, []) for f in range(4)]
    random.Random(3).shuffle(rows)
    names = ["file_id", "track_idx", "seq", "tick", "type", "is_meta", "fields"]
    frame = spark.createDataFrame(rows, "file_id long, track_idx int, seq int, tick long, type string, is_meta boolean, fields array<struct<name:string,value:string>>").repartition(2)
    got = {r.file_id: bytes(r.content) for r in midi.files_of_messages(frame).collect()}
    assert len(got) == 8
    for f, content in got.items():
        own = [dict(zip(names, r)) | {"fields": [{"name": a, "value": b} for a, b in r[-1]]} for r in rows if r[0] == f]
        assert content == midi.write_messages(own)
        back = midi.messages(content)
        assert [m["tick"] for m in back if m["track_idx"] == 2 and m["type"] == "note_on"] == [200 * n for n in range(1, 5 + f)]
        assert back[0]["fields"][0]["value"] == f"\u00e9 {f} ?" and sum(m["type"] == "end_of_track" for m in back) == 3
    assert midi.files_of_messages(frame.limit(0)).count() == 0


def test_placed_messages_of_notes_by_hand(spark):
    """Every track ends after its last message, also the track of tempos, one of extra messages alone and one that ends with ties."""
    notes = spark.createDataFrame([(1, 7, "b", False, 60, 9, 0.0, 1.0), (1, 8, "b", False, 62, 9, 0.5, 1.0), (2, 9, None, True, 40, 5, 0.25, 0.5)], "file_id long, note_id long, track string, is_drum boolean, pitch long, velocity long, start_s double, end_s double")
    tempos = spark.createDataFrame([(1, 60.0), (2, 120.0), (3, 60.0)], "file_id long, tempo_bpm double")
    extra = spark.createDataFrame([(1, "a", 5, 2.0)], "file_id long, track string, tie long, time_s double").withColumn("message", ms.message("lyrics", text="x"))
    got = [(r.file_id, r.track_idx, r.seq, r.tick, r.type, " ".join(f["value"] or "" for f in r.fields)) for r in ms.of_notes(notes, tempos, extra).orderBy("file_id", "track_idx", "seq").collect()]
    assert got == [
        (1, 0, 0, 0, "set_tempo", "1000000"), (1, 0, 1, 0, "time_signature", "4 4 24 8"), (1, 0, 2, 0, "end_of_track", ""),
        (1, 1, 0, 960, "lyrics", "x"), (1, 1, 1, 960, "end_of_track", ""),
        (1, 2, 0, 0, "track_name", "b"), (1, 2, 1, 0, "program_change", "0 0"), (1, 2, 2, 0, "note_on", "0 60 9"), (1, 2, 3, 240, "note_on", "0 62 9"),
        (1, 2, 4, 480, "note_on", "0 60 0"), (1, 2, 5, 480, "note_on", "0 62 0"), (1, 2, 6, 480, "end_of_track", ""),
        (2, 0, 0, 0, "track_name", ""), (2, 0, 1, 0, "set_tempo", "500000"), (2, 0, 2, 0, "time_signature", "4 4 24 8"), (2, 0, 3, 0, "program_change", "9 0"),
        (2, 0, 4, 240, "note_on", "9 40 5"), (2, 0, 5, 480, "note_on", "9 40 0"), (2, 0, 6, 480, "end_of_track", ""),
        (3, 0, 0, 0, "set_tempo", "1000000"), (3, 0, 1, 0, "time_signature", "4 4 24 8"), (3, 0, 2, 0, "end_of_track", ""),
    ]


def test_programs_of_notes_sort_only_what_they_need(spark):
    """Channels of a track have their own programs; ends of notes have none; neither fields nor other messages reach the window."""
    from drift_atlas.sources import fixtures

    field = lambda **v: [(k, str(x)) for k, x in v.items()]
    rows = [
        (1, 0, 0, 0, "note_on", False, field(channel=0, note=50, velocity=9)), (1, 0, 1, 5, "program_change", False, field(channel=0, program=7)), (1, 0, 2, 5, "note_on", False, field(channel=1, note=51, velocity=9)),
        (1, 0, 3, 5, "control_change", False, field(channel=0, control=64, value=1)), (1, 0, 4, 6, "note_on", False, field(channel=0, note=50, velocity=0)), (1, 0, 5, 9, "note_on", False, field(channel=0, note=52, velocity=9)),
        (1, 1, 0, 9, "note_on", False, field(channel=0, note=53, velocity=9)), (1, 1, 1, 9, "end_of_track", True, []),
    ]
    frame = spark.createDataFrame(rows, "file_id long, track_idx int, seq int, tick long, type string, is_meta boolean, fields array<struct<name:string,value:string>>")
    out = ms.programs_of_notes(frame)
    assert sorted((r.track_idx, r.seq, r.note, r.program) for r in out.collect()) == [(0, 0, 50, 0), (0, 2, 51, 0), (0, 5, 52, 7), (1, 0, 53, 0)]
    plan = ms.programs_of_notes(fixtures.messages(fixtures.notes(spark, "/root/testdata/sf0.001")))._jdf.queryExecution().optimizedPlan()
    while not plan.toString().startswith("Window [last("):
        plan = plan.children().apply(0)
    below = plan.children().apply(0).output().toString()
    assert "change" in below and "fields" not in below and "type" not in below
