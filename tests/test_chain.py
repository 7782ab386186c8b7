"""From MIDI files to a study and back, and the sinks' readers."""

import random

from pyspark.sql import functions as F

from drift_atlas.operators import chain
from drift_atlas.operators import notes as note_ops
from drift_atlas.sources.staging import staged
from drift_atlas.sources import metadata, midi


def test_files_to_study(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"d{d}/f{k}.mid", t, 0, False, i, 48 + 6 * d + rng.randint(0, 24), rng.randint(20, 120), 0.37 * i + 0.01 * t + rng.random() / 9, 0.37 * i + 0.3 + rng.random() / 5) for d in (0, 1) for k in range(12) for t in (1, 2) for i in range(14)]
    notes = spark.createDataFrame(rows, "name string, track_idx int, program int, is_drum boolean, note_idx int, pitch int, velocity int, start_s double, end_s double")
    broken = notes.limit(1).withColumns({"name": F.lit("bad.mid"), "pitch": F.lit(400)})
    report = {r.name: r for r in midi.save(notes.unionByName(broken), f"file://{tmp_path}/m").collect()}
    assert len(report) == 25 and [n for n, r in report.items() if r.problem] == ["bad.mid"]
    parsed = midi.load(spark, str(tmp_path / "m"))
    assert parsed.count() == len(rows)
    table = chain.from_midi(parsed)
    files = table.select("file_id").distinct()
    tempos = files.withColumn("tempo_bpm", F.lit(100.0))
    beats = files.select("file_id", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k")).select("file_id", F.col("k").cast("long").alias("k"), (F.col("k") * 0.6 + 0.02 * (F.col("k") % 3)).alias("t"))
    embedded = chain.perturbed_embeddings(table, tempos, beats, {"bars": ("patches-bars", None), "remi": ("tokens", "REMI")})
    embedded = staged(embedded, "embedded")
    names = {r.perturbation for r in embedded.select("perturbation").distinct().collect()}
    assert embedded.count() == 24 * 2 * len(names)
    sets = files.select("file_id", F.regexp_extract("file_id", r"/d(\d)/", 1).cast("long").alias("set_id"), F.regexp_extract("file_id", r"f(\d+)\.mid", 1).cast("long").alias("row_id"))
    out = {(r.dataset, r.configuration, r.perturbation): r for r in chain.perturbation_study(embedded, sets, "original", 5, 5, 9).collect()}
    assert set(out) == {(d, c, p) for d in (0, 1) for c in ("bars", "remi") for p in names - {"original"}}
    for d in (0, 1):
        # ABC text has no velocities: equal vectors, summed in another order.
        assert out[d, "bars", "no_velocity"].fmd_vs_original < 1e-12 < out[d, "remi", "no_velocity"].fmd_vs_original
        assert out[d, "bars", "constant_tempo"].fmd_vs_original > 0
    assert all(r.noise_floor_mean > 0 for r in out.values())


def test_written_tables_are_read_back(spark, tmp_path):
    tokens = spark.createDataFrame([(1, [1, 2, 2]), (2, []), (3, [7])], "file_id long, tokens array<int>")
    metadata.write_tokens(tokens, str(tmp_path / "t"))
    assert sorted((r.file, r.tokens) for r in metadata.load_tokens(spark, str(tmp_path / "t")).collect()) == [("1", [1, 2, 2]), ("2", []), ("3", [7])]
    stats = metadata.token_statistics(tokens)
    metadata.write_statistics(stats, str(tmp_path / "s"))
    row = spark.read.json(str(tmp_path / "s")).first()
    assert (row.n_files, row.n_tokens, row.n_distinct, row.least, row.most) == (3, 4, 3, 0, 3)
    results = spark.createDataFrame([("c1", "0_vs_1", 1.5), ("c2", "0_vs_1", 2.0)], "configuration string, pair string, fmd double")
    metadata.write_results(results, str(tmp_path / "r"))
    assert sorted(map(tuple, metadata.read_results(spark, str(tmp_path / "r")).select("configuration", "pair", "fmd").collect())) == [("c1", "0_vs_1", 1.5), ("c2", "0_vs_1", 2.0)]
    listing = spark.createDataFrame([("a.mid",)], "path string")
    (tmp_path / "m.csv").write_text("filename,genre\na.mid,Rock\nb.mid,Jazz\n")
    assert [tuple(r) for r in metadata.read_csv_tags(spark, str(tmp_path / "m.csv"), listing).collect()] == [("Rock", "a.mid")]


def test_perturbed_notes_are_made_once(spark):
    """All configurations read the staged notes, and neither the beats nor the perturbed notes are collected to be broadcast."""
    notes = spark.createDataFrame([(f, i, "a", False, 50 + i, 64, 0.3 * i, 0.3 * i + 0.2) for f in range(3) for i in range(8)], "file_id long, note_id long, track string, is_drum boolean, pitch long, velocity long, start_s double, end_s double")
    tempos = notes.select("file_id").distinct().withColumn("tempo_bpm", F.lit(100.0))
    beats = tempos.select("file_id", F.explode(F.array(*[F.lit(k).cast("long") for k in range(6)])).alias("k")).withColumn("t", F.col("k") * 0.5)
    out = chain.perturbed_embeddings(notes, tempos, beats, {"bars": ("patches-bars", None), "remi": ("tokens", "REMI")})
    assert out.count() == 3 * 5 * 2
    read = out.inputFiles()
    assert read and all("/versions-" in p for p in read)


def test_beat_marks_are_not_broadcast(spark):
    rows = [(1, k, 0.5 * k) for k in range(4)] + [(2, 0, 1.0), (None, 0, 0.1), (None, 1, 0.2), (3, 0, None), (3, 1, 2.0), (3, 2, None)]
    marks = note_ops.beat_marks(spark.createDataFrame(rows, "file_id long, k long, t double"))
    plan = marks._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("LocalTableScan") + plan.count("Scan ExistingRDD") == 1
    none, low = None, float("-inf")
    same = {1: (4, 0.0, 1.5, 1.0), 2: (1, 1.0, 1.0, None), 3: (3, None, None, None), None: (2, 0.1, 0.2, 0.1)}
    want = [(f, low, -1, none, *same[f]) for f in same] + [(1, 0.5 * k, k, 0.5 * k + 0.5 if k < 3 else none, *same[1]) for k in range(4)]
    want += [(2, 1.0, 0, none, *same[2]), (3, none, 0, 2.0, *same[3]), (3, 2.0, 1, none, *same[3]), (3, none, 2, none, *same[3])]
    assert sorted(map(tuple, marks.collect()), key=repr) == sorted(want, key=repr)
