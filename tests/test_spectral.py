"""Band energies in closed form and against a plain sum."""

import math
import random

import pytest

from drift_atlas.operators import spectral as sp

SCHEMA = "file_id long, note_id long, pitch long, velocity long, start_s double, end_s double"


def brute(notes):
    frames = max(1, math.ceil(min(max(n[5] for n in notes), sp.SECONDS) * sp.FRAMES_A_SECOND))
    energy = {}
    for _, _, pitch, velocity, start, end in notes:
        end = min(end, sp.SECONDS)
        for f in range(frames):
            share = max(0.0, min(end, (f + 1) / sp.FRAMES_A_SECOND) - max(start, f / sp.FRAMES_A_SECOND)) * sp.FRAMES_A_SECOND
            for h in range(1, sp.HARMONICS + 1):
                hz = 440 * 2 ** ((pitch - 69) / 12) * h
                band = math.floor(sp.BANDS_AN_OCTAVE * math.log2(hz / sp.LOWEST_HZ) + 1e-9)
                if share and start < sp.SECONDS and 0 <= band < sp.BANDS:
                    energy[f, band] = energy.get((f, band), 0) + share * (velocity / 127 / h) ** 2
    return [sum(math.log1p(e) for (f, b), e in energy.items() if b == k) / frames for k in range(sp.BANDS)]


def test_one_note(spark):
    """Concert pitch at full strength for one second: its band has log 2 in every frame, its octave the log of 1 + 1/4, and the fourth and fifth harmonic share a band."""
    out = sp.embed(spark.createDataFrame([(1, 1, 69, 127, 0.0, 1.0)], SCHEMA)).first().embedding
    assert len(out) == sp.BANDS and out[12] == pytest.approx(math.log(2)) and out[15] == pytest.approx(math.log1p(1 / 4)) and out[18] == pytest.approx(math.log1p(1 / 16 + 1 / 25))
    assert sum(v > 0 for v in out) == 5 and out[0] == 0


def test_many_notes(spark):
    rng = random.Random(5)
    rows = [(f, k, rng.randint(10, 127), rng.randint(1, 127), s := rng.uniform(0, 12), s + rng.choice([0.0, 0.003, 0.5, 4.0])) for f in range(4) for k in range(40)]
    rows += [(9, 1, 60, 64, 11.0, 12.0)]  # nothing of it sounds in time
    got = {r.file_id: r.embedding for r in sp.embed(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {0, 1, 2, 3, 9} and got[9] == [0.0] * sp.BANDS
    for f in range(4):
        assert got[f] == pytest.approx(brute([r for r in rows if r[0] == f]), rel=1e-9, abs=1e-12)
    assert sp.embed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_frames_and_bands_are_not_shuffled(spark):
    """Notes lie by file already; their frames and bands, many times as many rows, stay there."""
    from drift_atlas.sources import fixtures

    notes = fixtures.notes(spark, "/root/testdata/sf0.001")
    for out in (sp.band_energies(notes), sp.embed(notes)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
