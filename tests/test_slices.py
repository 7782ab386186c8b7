"""Workers hold the codes and patches of few items at a time, whatever a batch holds."""

import numpy as np
from pyspark.sql import functions as F

from drift_atlas.operators import encoders as enc
from drift_atlas.operators import rendering as rd


def test_items_are_encoded_a_few_at_a_time(spark, monkeypatch):
    class Counted:
        dim = 1

        def encode_batch(self, codes, ends):
            return np.full((len(ends) - 1, 1), len(ends) - 1.0)

    monkeypatch.setitem(enc.REGISTRY, "counted", Counted())
    items = spark.range(0, 300, 1, 1).select(F.col("id").alias("file_id"), F.array(F.array(F.lit(1), F.lit(2))).alias("patches"))
    got = enc.encode(items, "counted").collect()
    assert sorted(r.file_id for r in got) == list(range(300)) and max(r.embedding[0] for r in got) <= enc.ITEMS_AT_ONCE


def test_patches_of_many_texts(spark):
    """More texts than are unpacked at once, null and empty ones among them."""
    texts = {k: None if k % 50 == 1 else "" if k % 50 == 2 else f"ticks_per_beat 480\nnote_on note_on {k} 0 60 64\nnote_on note_on 5 0 60 0\nend_of_track end_of_track {k}" for k in range(rd.TEXTS_AT_ONCE * 2 + 9)}
    frame = spark.createDataFrame(list(texts.items()), "file_id long, text string").coalesce(1)
    got = {(r.file_id, r.patch_idx): r.patch for r in rd.message_patches(frame, 64).collect()}
    assert got == {(k, i): p for k, t in texts.items() for i, p in enumerate(rd.pack_messages(t or "", 64))}
