"""A study compiled from a configuration into units of work that resume.

The configuration is a TOML or JSON file: datasets, configurations (encoder and input),
perturbations, and the counts of each step. It is checked as a whole, then expanded into
units, each known by its step, dataset and configuration. A unit writes one
table below the output folder, under a fingerprint of what it depends on, and counts as
complete when Spark's success marker stands there; a second run skips it. A unit that fails does
not stop the others; those that read its table are blocked and named so.
"""

from __future__ import annotations

import hashlib
import json
import tomllib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drift_atlas.operators import encoders as enc
from drift_atlas.operators import rendering as rd
from drift_atlas.operators import study

ORIGINAL = "original"
#: Counts where the configuration has none of its own.
DEFAULTS = {"noise_floor": {"n_resamples": 100}, "interval": {"n_resamples": 100}, "permutation": {"n_permutations": 200}, "stability": {"n_resamples": 50, "sample_size": 100}}
#: Steps in the order in which they run, the keys that they are expanded by, and the steps whose tables they read.
STEPS = {
    "self_similarity": (("configuration",), ()), "ranking": (("configuration",), ()), "agreement": ((), ("ranking",)), "sensitivity": (("dataset", "configuration"), ()),
    "stability": (("configuration",), ()), "paired": (("dataset",), ()), "frames": ((), ("sensitivity",)), "summary": ((), ("self_similarity", "ranking", "agreement", "sensitivity", "stability", "paired")),
}


def load(path: str) -> dict:
    """A configuration file's content, by its ending."""
    with open(path, "rb") as file:
        return json.load(file) if path.endswith(".json") else tomllib.load(file)


def problems(config: dict) -> list[str]:
    """What is wrong with a configuration; nothing if it can be compiled."""
    found = []
    for part in ("datasets", "configurations", "perturbations"):
        names = [x.get("name") for x in config.get(part, []) if isinstance(x, dict)]
        if not names:
            found.append(f"{part}: none")
        if None in names or len(set(names)) < len(names):
            found.append(f"{part}: a name is missing or stands twice")
    for c in config.get("configurations", []):
        try:
            enc.validate(c.get("model"), c.get("input_format"), c.get("tokenizer"), rd.KINDS)
        except ValueError as problem:
            found.append(f"configuration {c.get('name')}: {problem}")
    if ORIGINAL not in [p.get("name") for p in config.get("perturbations", [])]:
        found.append(f"perturbations: {ORIGINAL!r} is missing")
    known = {d.get("name") for d in config.get("datasets", [])}
    for part, key in (("stability", "dataset_pair"), ("sensitivity", "datasets"), ("paired", "datasets")):
        asked = config.get(part, {}).get(key, [])
        if set(asked) - known or (key == "dataset_pair" and len(asked) not in (0, 2)):
            found.append(f"{part}: {key} names datasets that are not there, or not two")
    for part, values in DEFAULTS.items():
        for key in values:
            n = config.get(part, {}).get(key, 1)
            if not isinstance(n, int) or isinstance(n, bool) or n < 1:
                found.append(f"{part}: {key} is no positive number")
    if set(config.get("steps", [])) - set(STEPS):
        found.append(f"steps: known are {', '.join(STEPS)}")
    if config.get("paired", {}).get("contrast") and len(config["paired"]["contrast"]) != 2:
        found.append("paired: a contrast names two perturbations")
    return found


@dataclass(frozen=True)
class Unit:
    step: str
    dataset: str = ""
    configuration: str = ""


def units(config: dict) -> list[Unit]:
    """The units of a checked configuration, in the order in which they run. ValueError with all problems of another."""
    if found := problems(config):
        raise ValueError("; ".join(found))
    datasets = [d["name"] for d in config["datasets"]]
    values = {"configuration": [c["name"] for c in config["configurations"]]}
    out = []
    for step in config.get("steps", STEPS):
        if step == "stability" and not config.get("stability", {}).get("dataset_pair"):
            continue
        # The first dataset is studied, and any that the step names besides as its replications.
        own = config.get(step, {}).get("datasets", datasets[:1])
        by = STEPS[step][0]
        out += [Unit(step, d, c) for d in (own if "dataset" in by else [""]) for c in (values["configuration"] if "configuration" in by else [""])]
    return out


class Study:
    """The units of a configuration over one table of vectors: configuration, dataset, perturbation, file_id, embedding."""

    def __init__(self, config: dict, vectors: DataFrame, out: str):
        self.config, self.out, self.units = config, out.rstrip("/"), units(config)
        self.spark = vectors.sparkSession
        names = [d["name"] for d in config["datasets"]]
        self.vectors = vectors.where(F.col("dataset").isin(names)).select("configuration", F.col("dataset").alias("set_id"), "perturbation", F.col("file_id").alias("row_id"), "embedding")

    def count(self, part: str, key: str) -> int:
        return self.config.get(part, {}).get(key, DEFAULTS[part][key])

    def path(self, unit: Unit) -> str:
        """Where a unit's table stands; another configuration has another place."""
        asked = {k: self.config.get(k) for k in ("datasets", "configurations", "perturbations", "steps", *DEFAULTS, "sensitivity", "paired")}
        mark = hashlib.sha256(json.dumps([unit.step, asked], sort_keys=True).encode()).hexdigest()[:12]
        return f"{self.out}/{unit.step}/dataset={unit.dataset or '-'}/configuration={unit.configuration or '-'}/{mark}"

    def complete(self, unit: Unit) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(unit)}/_SUCCESS")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def table(self, step: str) -> DataFrame:
        """The tables of all units of a step as one."""
        out = None
        for unit in (u for u in self.units if u.step == step):
            rows = self.spark.read.parquet(self.path(unit))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise ValueError(f"the configuration has no {step}")
        return out

    def run(self, only: list[str] | None = None) -> list[dict]:
        """Run what is not complete: step, dataset, configuration, status (done, complete, failed, blocked) and problem of every unit."""
        report, broken = [], set()
        for unit in self.units:
            if only and unit.step not in only:
                continue
            status, problem = "complete", None
            if not self.complete(unit):
                lacking = sorted(broken & set(STEPS[unit.step][1]))
                if lacking:
                    status, problem = "blocked", f"no table of {', '.join(lacking)}"
                else:
                    try:
                        self._rows(unit).write.mode("overwrite").parquet(self.path(unit))
                        status = "done"
                    except Exception as error:  # one unit must not stop the others
                        status, problem = "failed", f"{type(error).__name__}: {str(error)[:300]}"
            if status in ("failed", "blocked"):
                broken.add(unit.step)
            report.append({"step": unit.step, "dataset": unit.dataset, "configuration": unit.configuration, "status": status, "problem": problem})
        return report

    def _rows(self, unit: Unit) -> DataFrame:
        makers: dict[str, Callable[[Unit], DataFrame]] = {
            "self_similarity": lambda u: study.self_similarity(self._originals(u)), "ranking": lambda u: study.cross_distances(self._originals(u)),
            "agreement": lambda u: study.ranking_agreement(self.table("ranking")), "sensitivity": self._sensitivity, "stability": self._stability, "paired": self._paired, "frames": self._frames, "summary": self._summary,
        }
        return makers[unit.step](unit)

    def _of(self, unit: Unit) -> DataFrame:
        rows = self.vectors.where(F.col("configuration") == unit.configuration) if unit.configuration else self.vectors
        return rows.where(F.col("set_id") == unit.dataset) if unit.dataset else rows

    def _originals(self, unit: Unit) -> DataFrame:
        return self._of(unit).where(F.col("perturbation") == ORIGINAL).drop("perturbation")

    def _changed(self, unit: Unit) -> DataFrame:
        names = [p["name"] for p in self.config["perturbations"] if p["name"] != ORIGINAL]
        return self._of(unit).where(F.col("perturbation").isin(names))

    def _sensitivity(self, unit: Unit) -> DataFrame:
        reps = self.count("noise_floor", "n_resamples"), self.count("interval", "n_resamples"), self.count("permutation", "n_permutations")
        return study.sensitivity(self._originals(unit), self._changed(unit), *reps)

    def _stability(self, unit: Unit) -> DataFrame:
        rows, pair = self._originals(unit), self.config["stability"]["dataset_pair"]
        a, b = (rows.where(F.col("set_id") == name) for name in pair)
        out = study.bootstrap_stability(a, b, self.count("stability", "n_resamples"), self.count("stability", "sample_size"))
        return out.withColumns({"dataset_a": F.lit(pair[0]), "dataset_b": F.lit(pair[1])})

    def _paired(self, unit: Unit) -> DataFrame:
        """Contrasts of all perturbations; the retest is the original encoded again, which here gives the same vectors."""
        original = self._originals(unit)
        changed = self._changed(unit).withColumnRenamed("perturbation", "condition")
        conditions = changed.unionByName(original.withColumn("condition", F.lit(study.RETEST)))
        names = [p["name"] for p in self.config["perturbations"] if p["name"] != ORIGINAL]
        first, second = self.config.get("paired", {}).get("contrast", (names * 2)[:2])
        configurations = ([c["name"] for c in self.config["configurations"]] * 2)[:2]
        shifts = study.complete_shifts(original, conditions)
        return study.contrast_tests(study.contrast_pairs(shifts, first, second, tuple(configurations)))

    def _frames(self, unit: Unit) -> DataFrame:
        """What the figures show: ratio and its interval, with the label of each bar, and the heat map's cells."""
        rows = self.table("sensitivity")
        ratio = lambda c: F.when(F.col("noise_floor_mean") > 1e-12, F.col(c) / F.col("noise_floor_mean"))
        label = F.when(F.col("significant"), "*").otherwise("ns")
        return rows.select("dataset", "configuration", "perturbation", "snr", ratio("fmd_ci_lower").alias("snr_lower"), ratio("fmd_ci_upper").alias("snr_upper"), label.alias("label"), F.format_string("%.2f", "fmd_vs_original").alias("cell"))

    def _summary(self, unit: Unit) -> DataFrame:
        """One row a step: how many results it has, and its mean distance where it has distances."""
        out = None
        for step, value in (("self_similarity", "split_half_fmd"), ("ranking", "fmd"), ("agreement", "spearman_tau"), ("sensitivity", "fmd_vs_original"), ("stability", "fmd_mean"), ("paired", "p_holm")):
            if any(u.step == step for u in self.units):
                rows = self.table(step).agg(F.count("*").alias("results"), F.avg(value).alias("mean")).select(F.lit(step).alias("step"), F.lit(value).alias("measure"), "results", "mean")
                out = rows if out is None else out.unionByName(rows)
        return out
