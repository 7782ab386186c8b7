"""Studies compiled from configurations: checks, units, resumption, isolation and results."""

import json

import numpy as np
import pytest

from drift_atlas import cli
from drift_atlas.operators import compiled, study

CONFIG = {
    "datasets": [{"name": n} for n in ("a", "b", "c")],
    "configurations": [{"name": "remi", "model": "tokens", "input_format": "MIDITOK", "tokenizer": "REMI"}, {"name": "bars", "model": "patches-bars", "input_format": "ABC"}],
    "perturbations": [{"name": "original"}, {"name": "x"}, {"name": "y"}],
    "noise_floor": {"n_resamples": 3}, "interval": {"n_resamples": 3}, "permutation": {"n_permutations": 39},
    "stability": {"dataset_pair": ["a", "b"], "n_resamples": 3, "sample_size": 10}, "sensitivity": {"datasets": ["b"]},
}
TOML = """
steps = ["self_similarity", "ranking"]
[[datasets]]
name = "a"
[[datasets]]
name = "b"
[[configurations]]
name = "bars"
model = "patches-bars"
input_format = "ABC"
[[perturbations]]
name = "original"
"""


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    rows = []
    for d, dataset in enumerate("abc"):
        for c in ("remi", "bars"):
            base = rng.normal(0.5 * d, 1, (14, 4))
            for p, moved in (("original", base), ("x", base + 5), ("y", base * 1.01)):
                rows += [(c, dataset, p, f"f{k}", v.tolist()) for k, v in enumerate(moved)]
    return spark.createDataFrame(rows, "configuration string, dataset string, perturbation string, file_id string, embedding array<double>").persist()


def test_configurations_are_checked():
    assert compiled.problems(CONFIG) == []
    wrong = {"datasets": [{"name": "a"}, {"name": "a"}], "configurations": [{"name": "z", "model": "tokens", "input_format": "ABC"}], "perturbations": [{"name": "x"}],
             "stability": {"dataset_pair": ["a"], "n_resamples": 0}, "sensitivity": {"datasets": ["q"]}, "steps": ["dance"], "paired": {"contrast": ["x"]}}
    found = "\n".join(compiled.problems(wrong))
    for part in ("datasets: a name", "configuration z", "'original' is missing", "dataset_pair", "sensitivity: datasets", "n_resamples", "steps: known", "two perturbations"):
        assert part in found
    with pytest.raises(ValueError):
        compiled.units(wrong)
    assert compiled.problems({}) and compiled.units(CONFIG)[:2] == [compiled.Unit("self_similarity", "", "remi"), compiled.Unit("self_similarity", "", "bars")]
    assert [u for u in compiled.units(CONFIG) if u.step == "sensitivity"] == [compiled.Unit("sensitivity", d, c) for d in "b" for c in ("remi", "bars")]


def test_an_interrupted_study_resumes_and_failures_stay_alone(spark, vectors, tmp_path, monkeypatch):
    made = compiled.Study(CONFIG, vectors, f"file://{tmp_path}/out")
    real = study.cross_distances
    monkeypatch.setattr(study, "cross_distances", lambda rows: 1 / 0)
    first = {(r["step"], r["dataset"], r["configuration"]): r for r in made.run(["self_similarity", "ranking", "agreement"])}
    assert {k[0]: r["status"] for k, r in first.items()} == {"self_similarity": "done", "ranking": "failed", "agreement": "blocked"}
    assert "ZeroDivisionError" in first["ranking", "", "remi"]["problem"] and "ranking" in first["agreement", "", ""]["problem"]
    monkeypatch.setattr(study, "cross_distances", real)
    second = compiled.Study(CONFIG, vectors, f"file://{tmp_path}/out").run()
    status = {(r["step"], r["dataset"], r["configuration"]): r["status"] for r in second}
    assert {k: s for k, s in status.items() if k[0] == "self_similarity"} == {k: "complete" for k in status if k[0] == "self_similarity"}
    assert {s for k, s in status.items() if k[0] != "self_similarity"} == {"done"} and len(status) == 12
    assert {r["status"] for r in made.run()} == {"complete"}
    other = compiled.Study(CONFIG | {"noise_floor": {"n_resamples": 2}}, vectors, f"file://{tmp_path}/out")
    assert not any(other.complete(u) for u in other.units)

    rows = {(r.dataset, r.configuration, r.perturbation): r for r in made.table("sensitivity").collect()}
    assert set(rows) == {("b", c, p) for c in ("remi", "bars") for p in "xy"} and all(rows[k].significant == (k[2] == "x") for k in rows)
    frames = {(r.dataset, r.configuration, r.perturbation): r for r in made.table("frames").collect()}
    assert all(frames[k].label == ("*" if k[2] == "x" else "ns") and frames[k].snr == rows[k].snr for k in rows)
    summary = {r.step: r.results for r in made.table("summary").collect()}
    assert summary["self_similarity"] == 6 and summary["ranking"] == 6 and summary["sensitivity"] == 4 and summary["stability"] == 2
    assert {r.contrast for r in made.table("paired").collect()} == {"exceeds_retest_noise", "x_gt_y", "control_remi_gt_bars_x_excess"}


def test_command_line(spark, vectors, tmp_path, capsys):
    (tmp_path / "c.toml").write_text(TOML)
    (tmp_path / "c.json").write_text(json.dumps(CONFIG))
    assert compiled.load(str(tmp_path / "c.json")) == CONFIG
    vectors.write.parquet(str(tmp_path / "v"))
    args = ["run", "ranking", "--config", str(tmp_path / "c.toml"), "--data", str(tmp_path / "v"), "--out", str(tmp_path / "o")]
    assert cli.main(args) == 0 and "ranking" in capsys.readouterr().out
    assert spark.read.parquet(compiled.Study(compiled.load(str(tmp_path / "c.toml")), vectors, str(tmp_path / "o")).path(compiled.Unit("ranking", "", "bars"))).count() == 1
