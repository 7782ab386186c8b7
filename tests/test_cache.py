"""The embedding store: misses only, whole parts, two writers, compaction."""

import pytest
from pyspark.sql import functions as F

from drift_atlas.operators import encoders as enc
from drift_atlas.operators.cache import EmbeddingStore, encode_through
from drift_atlas.plans.render_queries import _share


@pytest.fixture
def items(spark):
    rows = [(k, [[k % 5, 1], [7, k % 3]]) for k in range(40)] + [(40, []), (41, None)]
    return spark.createDataFrame(rows, "file_id long, patches array<array<int>>").repartition(4)


def vectors(frame):
    return {r.file_id: tuple(r.embedding) for r in frame.collect()}


def test_only_what_is_new_is_encoded(spark, items, tmp_path, monkeypatch):
    store = EmbeddingStore(spark, f"file://{tmp_path}/store")
    first, n = encode_through(items.where("file_id % 2 = 0 and file_id < 40"), store, "histogram")
    assert n == 15 and first.count() == 20
    every, n = encode_through(items, store, "histogram")
    want = vectors(enc.encode(items, "histogram"))
    assert n == 2 and vectors(every) == want  # an empty and a null item
    parts = store.parts()
    again, n = encode_through(items, store, "histogram")
    assert n == 0 and vectors(again) == want and store.parts() == parts
    assert encode_through(items, store, "tokens")[1] == 17 and store.read("tokens").count() == 17
    assert encode_through(items.limit(0), store, "tokens")[1] == 0
    # Another session's store of the same folder sees the same.
    assert EmbeddingStore(spark, f"file://{tmp_path}/store").read("histogram").count() == 17


def test_two_writers_and_compaction(spark, items, tmp_path):
    store = EmbeddingStore(spark, f"file://{tmp_path}/store")
    rows = enc.encode(enc.content_key(items, "histogram").dropDuplicates(["content_hash"]), "histogram", "content_hash").select(F.lit("histogram").alias("model"), "content_hash", "embedding")
    assert store.add(rows) == store.add(rows) == 17  # both began before the other had ended
    assert store.read().count() == 17 and len(store.parts()) == 2
    before, old = store.read(), store.parts()
    store.compact()
    assert len(store.parts()) == 1 and store.read().count() == 17 and before.count() == 17
    assert store.clear() == [] and before.count() == 17
    assert sorted(store.clear(kept_s=-1)) == sorted(old) and store.read().count() == 17


def test_a_failed_addition_is_invisible(spark, items, tmp_path):
    store = EmbeddingStore(spark, f"file://{tmp_path}/store")
    uneven = spark.createDataFrame([(1, [[1], [1, 2]])], "file_id long, patches array<array<int>>")
    with pytest.raises(Exception):
        encode_through(uneven, store, "histogram")
    assert store.parts() == [] and store.read().count() == 0
    assert encode_through(items, store, "histogram")[1] == 17


def test_shares_that_are_kept_as_floats_round_as_they_were(spark):
    """Every share of up to 512 tokens rounds to the fourth place like the quotient itself, halves included."""
    rows = [(c, k) for k in range(1, 513) for c in range(1, k + 1)]
    frame = spark.createDataFrame(rows, "c int, k int").select("c", "k", F.expr("round(cast(10000 * c as double) / k)").alias("want"), (F.col("c") / F.col("k")).cast("float").alias("v"))
    off = frame.where((F.round(_share(F.col("v")), 4) * 10000 + 0.5).cast("long") != F.col("want"))
    assert off.count() == 0 and frame.where(F.round(F.col("v").cast("double") * 10000) != F.col("want")).count() > 0
