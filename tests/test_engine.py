"""Closed forms, metamorphic properties and readers of the analytics engine."""

import json
import math
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from drift_atlas.operators import distance, encoders, hypothesis, moments, notes, rendering
from drift_atlas.plans import distance_queries
from drift_atlas.sources import fixtures, listing, metadata, midi

RNG = np.random.Generator(np.random.PCG64(42))


def gaussian(rows):
    return rows.mean(axis=0), np.cov(rows, rowvar=False)


def test_frechet_closed_forms():
    a, b = RNG.normal(0, 1, (80, 1)), RNG.normal(1, 2, (90, 1))
    (ma, ca), (mb, cb) = (a.mean(axis=0), a.var(axis=0, ddof=1).reshape(1, 1)), (b.mean(axis=0), b.var(axis=0, ddof=1).reshape(1, 1))
    want = (ma[0] - mb[0]) ** 2 + (math.sqrt(ca[0, 0]) - math.sqrt(cb[0, 0])) ** 2
    assert distance.frechet(ma, ca, mb, cb, ridge=0) == pytest.approx(want)
    assert distance.frechet(ma, ca, ma, ca) == 0.0
    with pytest.raises(ValueError):
        distance.frechet(np.zeros(2), np.eye(2), np.zeros(3), np.eye(3))


def test_frechet_properties():
    a, b = RNG.normal(size=(100, 8)), RNG.normal(0.3, 1.5, (100, 8))
    d = distance.frechet(*gaussian(a), *gaussian(b), ridge=0)
    assert d == pytest.approx(distance.frechet(*gaussian(b), *gaussian(a), ridge=0))
    assert distance.frechet(*gaussian(3 * a), *gaussian(3 * b), ridge=0) == pytest.approx(9 * d)
    assert distance.frechet(*gaussian(a), *gaussian(a + 2), ridge=0) == pytest.approx(4 * 8)
    assert distance.frechet_low_rank(a[:6], b[:5]) == pytest.approx(distance.frechet(*gaussian(a[:6]), *gaussian(b[:5])), rel=1e-6)


def test_full_moments_merge(spark):
    rows = RNG.normal(size=(90, 5))
    df = spark.createDataFrame([(int(k % 2), k, r.tolist()) for k, r in enumerate(rows)], "set_id long, row_id long, embedding array<double>").repartition(4)
    got = {r.set_id: r for r in moments.full_moments(df).collect()}
    for s in (0, 1):
        mean, cov = gaussian(rows[s::2])
        assert np.allclose(got[s]["mean"], mean) and np.allclose(np.array(got[s]["cov"]).reshape(5, 5), cov)
    single = moments.full_moments(df.where("row_id = 0")).first()
    assert not np.any(single["cov"])


def test_wilcoxon_goldens():
    n, w = 80, 3240.0
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    assert hypothesis.normal_sf(z) == pytest.approx(3.924763274e-15, rel=1e-8)
    z = (10 - 4 * 5 / 4) / math.sqrt(4 * 5 * 9 / 24)
    assert hypothesis.normal_sf(z) == pytest.approx(0.033944577, rel=1e-6)
    assert hypothesis.exact_signed_rank_sf(15, 5) == pytest.approx(1 / 32)


def test_spearman_p_goldens():
    for rho, p in ((0.825, 1.532e-4), (0.435714, 0.1045), (0.907143, 3.063e-6)):
        assert 2 * hypothesis.student_sf(rho * math.sqrt(13 / (1 - rho * rho)), 13) == pytest.approx(p, rel=1e-3)


def test_holm_with_missing(spark):
    rows = [(0, 0, 0.01), (0, 1, 0.04), (0, 2, None), (0, 3, 0.03)]
    got = {r.k: r.p_holm for r in hypothesis.holm(spark.createDataFrame(rows, "f long, k long, p double"), "p", ["f"], ["k"]).collect()}
    assert got == pytest.approx({0: 0.04, 3: 0.09, 1: 0.09, 2: 1.0})


def test_signed_rank_of_equal_columns(spark):
    rows = spark.createDataFrame([(0, 1.0, 1.0)] * 12, "k long, a double, b double")
    tested = hypothesis.signed_rank(rows, ["k"]).withColumn("p", hypothesis.signed_rank_p("n", "n_nonzero", "ties", "stat", "z")).first()
    assert tested["stat"] == 0 and tested["p"] is None and tested["n"] == 12


def test_ranking_stability_by_hand(spark):
    ranks = [[0, 1, 2, 3], [0, 1, 2, 3], [0, 1, 3, 2]]
    df = spark.createDataFrame([(k, i, r.index(i)) for k, r in enumerate(ranks) for i in range(4)], "ranking long, item long, place long")
    assert distance.ranking_stability(df).first()["stability"] == pytest.approx(8 / 9)
    assert distance.ranking_stability(df.where("ranking = 0")).first()["stability"] == 1.0
    ends = [[0, 1], [1, 0]]
    df = spark.createDataFrame([(k, i, r.index(i)) for k, r in enumerate(ends) for i in range(2)], "ranking long, item long, place long")
    assert distance.ranking_stability(df).first()["stability"] == 0.0


def note_table(spark, rows):
    return spark.createDataFrame(rows, "file_id long, note_id long, track string, is_drum boolean, pitch long, velocity long, start_s double, end_s double")


def test_note_operators(spark):
    rows = note_table(spark, [(1, 0, "a", False, 20, 90, 0.0, 0.5), (1, 1, "b", False, 60, 90, 1.0, 1.0), (1, 2, "d", True, 110, 90, 2.0, 2.5), (1, 3, "a", False, 110, 80, 2.0, 3.0)])
    assert {r.note_id for r in notes.filter_note_range(rows).collect()} == {1, 2}
    assert {r.note_id: r.velocity for r in notes.remove_velocity(rows).collect()} == {0: 64, 1: 64, 2: 90, 3: 64}
    tempo = spark.createDataFrame([(1, 120.0)], "file_id long, tempo_bpm double")
    snapped = {r.note_id: (r.start_s, r.end_s) for r in notes.quantize_time(rows, tempo).collect()}
    assert snapped[1] == (1.0, 1.0625)
    assert notes.quantize_time(rows, tempo, hard=False) is rows
    few = spark.createDataFrame([(1, 0, 0.0)], "file_id long, k long, t double")
    assert sorted(map(tuple, notes.normalize_tempo(rows, few).collect())) == sorted(map(tuple, rows.collect()))
    merged = notes.normalize_instruments(rows).where("not is_drum").orderBy("place").collect()
    assert [r.note_id for r in merged] == [0, 1, 3] and {r.track for r in merged} == {"Piano"}


def test_grid_ties_are_half_even(spark):
    rows = note_table(spark, [(1, k, "a", False, 60, 64, (k + 0.5) * 0.0625, 9.0) for k in range(4)])
    tempo = spark.createDataFrame([(1, 120.0)], "file_id long, tempo_bpm double")
    assert [round(r.start_s / 0.0625) for r in notes.quantize_time(rows, tempo).orderBy("note_id").collect()] == [0, 2, 2, 4]


def test_abc_of_an_empty_file_and_names(spark):
    rows = note_table(spark, [(1, 0, "d", True, 60, 90, 0.0, 0.5)])
    tempo = spark.createDataFrame([(1, 120.0)], "file_id long, tempo_bpm double")
    assert rendering.abc_text(rows, tempo).first()["abc"].endswith("K:C\nz16 |\n")
    got = spark.createDataFrame([(p,) for p in (60, 61, 48, 72, 84)], "p long").select(rendering.abc_pitch(F.col("p"))).collect()
    assert [r[0] for r in got] == ["C", "^C", "C,", "c", "c'"]


def brute_bars(line):
    """Scan for marks, longest meaning first; then join what belongs together."""
    pieces, word, at = [], "", 0
    while at < len(line):
        mark = next((m for m in rendering.DELIMITER_LIST if line.startswith(m, at)), None)
        if mark is None:
            word, at = word + line[at], at + 1
            continue
        pieces += [word, mark] if word else [mark]
        word, at = "", at + len(mark)
    pieces += [word] if word else []
    if pieces and pieces[0] in rendering.DELIMITER_LIST:
        head = pieces.pop(0)
        if pieces:
            pieces[0] = head + pieces[0]
    if len(pieces) < 2:
        return pieces
    halves = iter(pieces)
    return [content + mark for content, mark in zip(halves, halves, strict=False)]


def test_split_bars(spark):
    texts = ["", "|", "||", "C D |", "|:C|D:|E", "C|D||E|]", "a b c", "|C", "[|C D|E"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(rendering.split_bars(F.col("t"))).collect()
    assert [r[0] for r in got] == [brute_bars(t) for t in texts]


def test_message_packing_never_exceeds_the_patch(spark):
    text = "ticks_per_beat 480\n" + "".join(f"note_on 0 {60 + k} 64 {k}\n" for k in range(9)) + "note_off 0 60 0 1\n"
    packed = rendering.pack_messages(text, 64)
    assert packed[0] == "ticks_per_beat 480\n" and all(len(p) <= 64 for p in packed)
    assert sum(p.count("\t") + 1 for p in packed) == 11
    assert rendering.pack_messages("", 64) == [""]


def test_tokenizers_differ_and_have_known_ids(spark):
    rows = note_table(spark, [(1, k, "a", False, 60 + k, 80, 0.5 * k, 0.5 * k + 0.2) for k in range(5)])
    tempo = spark.createDataFrame([(1, 120.0)], "file_id long, tempo_bpm double")
    made = {k: rendering.tokenize(rows, tempo, k).first()["tokens"] for k in rendering.KINDS}
    assert len({tuple(t) for t in made.values()}) == 4 and 100 < rendering.VOCABULARY < 10_000
    assert all(0 <= t < rendering.VOCABULARY for ts in made.values() for t in ts)
    with pytest.raises(ValueError):
        rendering.tokenize(rows, tempo, "other")


def test_encoders_and_rules():
    unit = encoders.encoder("patches-bars").encode(np.array([[1, 70, 2]]))
    assert np.linalg.norm(unit) == pytest.approx(1)
    assert not encoders.encoder("tokens").encode(np.zeros((0, 0), int)).any()
    with pytest.raises(ValueError):
        encoders.encoder("none")
    assert encoders.validate("tokens", "REMI", None, ("REMI",)) == ("tokens", "MIDITOK", "REMI")
    for bad in (("patches-bars", "MTF", None), ("tokens", "MIDITOK", None), ("text", "TEXT", "REMI"), ("none", "ABC", None)):
        with pytest.raises(ValueError):
            encoders.validate(*bad, ("REMI",))


def test_midi_round_trip_and_source(spark, tmp_path):
    made = [{"track_idx": 1, "program": 5, "is_drum": False, "note_idx": k, "pitch": 60 + k, "velocity": 80, "start_s": 0.5 * k, "end_s": 0.5 * k + 0.25} for k in range(5)]
    made += [{"track_idx": 2, "program": 0, "is_drum": True, "note_idx": 0, "pitch": 36, "velocity": 99, "start_s": 0.0, "end_s": 0.1}]
    data = midi.write(made)
    assert [n | {"end_s": round(n["end_s"], 6)} for n in midi.parse(data)] == made
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.mid").write_bytes(data)
    (tmp_path / "d" / "bad.midi").write_bytes(b"nothing")
    assert midi.load(spark, str(tmp_path)).count() == 6
    spark.dataSource.register(midi.MidiSource)
    assert spark.read.format("midi").option("paths", str(tmp_path / "d" / "a.mid")).load().count() == 6
    files = listing.list_files(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in listing.ordered_listing(files).collect()] == ["a.mid", "bad.midi"]
    assert listing.list_files(spark, str(tmp_path / "absent")).count() == 0
    with pytest.raises(ValueError):
        midi.parse(b"MThd")


def test_metadata_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("filename,genre\n" + "".join(f"r{k}.mid,Rock\n" for k in range(5)) + "".join(f"j{k}.mid,Jazz; Blues\n" for k in range(3)))
    tags = {r.tag: r.n for r in metadata.read_csv_tags(spark, str(tmp_path / "m.csv")).groupBy("tag").agg(F.count("*").alias("n")).collect()}
    assert tags == {"Rock": 5, "Jazz": 3, "Blues": 3}
    (tmp_path / "items.json").write_text(json.dumps({"items": [{"genre": "a", "path": "x"}, {"genre": "b", "path": "y"}]}))
    assert metadata.read_json_items(spark, str(tmp_path / "items.json")).count() == 2
    lines = spark.createDataFrame([("1 2 3",), ("[10, 20]",), ('{"tokens": [5, 6]}',), ("x y",), (None,), ("",)], "t string")
    assert [r[0] for r in lines.select(metadata.parse_tokens(F.col("t"))).collect()] == [[1, 2, 3], [10, 20], [5, 6], [], [], []]
    empty = spark.createDataFrame([], "tag string, location string")
    assert metadata.first_source(empty, metadata.read_csv_tags(spark, str(tmp_path / "m.csv"))).count() == 11


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("c1", 1.0), ("c2", 2.0)], "configuration string, fmd double")
    metadata.write_results(rows, str(tmp_path / "r"))
    metadata.write_results(rows.where("configuration = 'c1'").withColumn("fmd", F.lit(9.0)), str(tmp_path / "r"))
    got = {r.configuration: r.fmd for r in spark.read.option("header", "true").schema("fmd double, configuration string").csv(str(tmp_path / "r")).collect()}
    assert got == {"c1": 9.0, "c2": 2.0}
    metadata.write_tokens(spark.createDataFrame([(1, [1, 2])], "file_id long, tokens array<int>"), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).first()["tokens"] == [1, 2]


def test_streams(spark, tmp_path):
    from drift_atlas.streaming import note_stream

    events = spark.createDataFrame([(k, f"2024-01-01 00:{k:02d}:00", "click", 1.0) for k in range(60)], "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "e"))
    stream = note_stream.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windowed").agg(F.sum("n")).first()[0] == 60


def test_entry_and_oracle_names(spark):
    import __spark_entry__

    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries)
    assert __spark_entry__.entry(spark).count() == 90


def test_resamples_are_as_many_as_the_references(spark):
    run = lambda name: distance_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert [run(name).agg({"rep": "max"}).first()[0] + 1 for name in ("r03_noise_floor", "r04_perturbation_bootstrap", "r06_pair_bootstrap")] == [100, 100, 50]
    assert run("q05_bootstrap_stability").first().n_resamples == 50
    assert all(abs(r.perm_p_value * 201 - round(r.perm_p_value * 201)) < 1e-3 for r in run("r05_permutation_pvalue").collect())


def test_first_groups_end_at_the_renderers_cap(spark):
    from drift_atlas.plans import render_queries

    files = render_queries.QUERIES["o04_first_groups"](spark, "/root/testdata/sf0.001").groupBy("file_id").count()
    assert 16 < files.agg({"count": "max"}).first()[0] <= render_queries.rd.MAX_GROUPS


def test_retest_shift_is_zero(spark):
    rows = spark.createDataFrame([(0, k, RNG.normal(size=8).tolist()) for k in range(12)], "set_id long, row_id long, embedding array<double>")
    shifts = distance_queries.paired_shifts(rows).where("condition = '__retest__'").collect()
    assert len(shifts) == 12 and all(abs(r.shift) < 1e-9 for r in shifts)
    assert fixtures.plane(rows).columns == ["set_id", "row_id", "x", "y"]


def test_the_rest_works_without_the_corpus_subpackage(tmp_path):
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/drift_atlas", tmp_path / "drift_atlas", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = """if True:
        import __spark_entry__ as e
        from pyspark.sql import SparkSession
        q = e.queries()
        assert len(q) > 100 and not any(n.startswith('op1_') for n in q) and set(e.oracle_sql()) <= set(q)
        spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
        assert q['m07_rank_by_distance'](spark, '/root/testdata/sf0.001').count() == 90
        assert q['p13_optional_admission'](spark, '/root/testdata/sf0.001').count() > 0
    """
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_copy_plan_of_equal_paths_and_nulls(spark, tmp_path):
    """Of equal paths the smallest id has the name, in both windows of the plan; what SQL's NOT leaves unknown is not planned."""
    from drift_atlas.plans import relational_queries

    pages = [(6, "b/y", "q" * 9), (3, "b/y", "q"), (4, "a/x", "z" * 9), (1, "a/x", "z"), (9, None, "q"), (2, None, "r"), (None, "b/y", "1"), (None, "c/y", "2"), (None, None, "3")]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in relational_queries.s15(spark, str(tmp_path)).collect()}
    assert got == {(None, "a53b8593_y", "c/y", 1), ("d0", "3704db02_y", "b/y", 9), ("d1", "x", "a/x", 1), ("d1", "e2d645f7_x", "a/x", 9), ("d2", None, None, 1)}


def test_copy_plan_of_repeated_ids(spark, tmp_path):
    """Of rows that share path and id the smallest file has the name, wherever it stands: an id alone leaves the order open."""
    from drift_atlas.plans import relational_queries

    pages = [(f, f"{f}/x", "q" * n) for f in range(3, 30) for n in (9, 1, 5)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.path, r.size_bytes) for r in relational_queries.s15(spark, str(tmp_path)).collect() if "_" not in r.target]
    assert sorted(got) == [("10/x", 1), ("11/x", 1)]
