"""The committing file sink: all or nothing, alone in its failures."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drift_atlas.sources import committed


def visible(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs if not f.startswith(".") and "/_" not in f"/{os.path.relpath(d, folder)}")


def test_files_and_their_report(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    rows = [(f"d{k % 3}/f{k}.bin", bytes([k]) * (k + 1)) for k in range(40)] + [("d0/f0.bin", b"again"), ("../up", b"x"), ("/abs", b"x"), ("_own", b"x"), (None, b"x"), ("none", None), ("a//b", b"x")]
    report = committed.save_files(spark.createDataFrame(rows, "name string, content binary").repartition(5), folder)
    assert (report["files"], report["failed"]) == (40, 7) and {f["name"] for f in report["failed_files"]} == {"d0/f0.bin", "../up", "/abs", "_own", "None", "none", "a//b"}
    got = {r.name: bytes(r.content) for r in committed.read_files(spark, folder).collect()}
    assert set(got) == {n for n, _ in rows[:40]} and all(got[n] == c for n, c in rows[1:40]) and got["d0/f0.bin"] in (b"\0", b"again")
    assert report["bytes"] == sum(map(len, got.values())) and not [d for d in os.listdir(tmp_path / "out") if d.startswith("_staging")]
    assert committed.save_files(spark.createDataFrame([("d0/f0.bin", b"new")], "name string, content binary"), folder)["files"] == 1
    assert (tmp_path / "out/d0/f0.bin").read_bytes() == b"new"
    assert committed.save_files(spark.createDataFrame([], "name string, content binary"), folder)["files"] == 0


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "out"
    committed.save_files(spark.createDataFrame([("old", b"1")], "name string, content binary"), f"file://{folder}")

    @F.udf(T.BinaryType())
    def broken(k):
        if k == 77:
            raise RuntimeError("lost")
        return bytes([k])

    rows = spark.range(200).select(F.concat(F.lit("new"), "id").alias("name"), broken("id").alias("content"))
    with pytest.raises(Exception):
        committed.save_files(rows, f"file://{folder}")
    assert visible(folder) == ["old"] and not [d for d in os.listdir(folder) if d.startswith("_staging")]


def test_copies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(6):
        (tmp_path / f"in/{k}.txt").write_bytes(b"x" * (k * 1_000_000))
    plan = [(f"file://{tmp_path}/in/{k}.txt", f"by/{k % 2}/{k}.txt") for k in range(6)] + [(f"file://{tmp_path}/in/missing.txt", "m.txt")]
    report = committed.copy_files(spark.createDataFrame(plan, "source string, name string"), f"file://{tmp_path}/out")
    assert (report["files"], report["bytes"], report["failed"], report["failed_files"][0]["name"]) == (6, 15_000_000, 1, "m.txt")
    assert sorted(len(r.content) for r in committed.read_files(spark, f"file://{tmp_path}/out").collect()) == [k * 1_000_000 for k in range(1, 6)]
