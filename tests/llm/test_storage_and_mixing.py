"""Shards, archives, mixing and the pipeline."""

import base64
import hashlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from drift_atlas.llm import common, mixing, sharding, textkit, warc

from . import helpers as H


def test_shards_keep_every_row_and_versions(spark):
    rows = H.awkward_rows()
    docs = H.documents(spark, rows)
    store = sharding.ShardStore(spark, common.new_folder(spark, "t"), target=1 << 20, fanout=3)
    for part in sharding.arrivals(docs, "doc_id", 4):
        store.append(part.repartition(2))
    before = store.manifest()
    assert Counter(map(tuple, store.read().collect())) == Counter(map(tuple, docs.collect()))
    after = store.compact()
    assert len(after.shards) < len(before.shards) and sum(s.rows for s in after.shards) == len(rows)
    assert not sharding.merge_plan(after.shards, store.target, store.fanout, store.least) or len(after.shards) < 3
    assert store.read(before.version).count() == len(rows) == store.read().count()
    with pytest.raises(sharding.CommitConflict):
        store.commit(before, before.schema, before.shards)
    assert store.vacuum() >= len(before.shards) and store.versions() == [after.version]
    assert Counter(map(tuple, store.read().collect())) == Counter(map(tuple, docs.collect()))
    with pytest.raises(ValueError):
        store.append(docs.select("doc_id"))


def test_shards_of_target_size(spark):
    rows = spark.range(0, 40_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).repartition(12)
    store = sharding.ShardStore(spark, common.new_folder(spark, "t"), target=1 << 19, fanout=2, least=1 << 16)
    store.append(rows)
    made = store.compact().shards
    assert all(s.bytes < 1.6 * store.target for s in made) and len(made) <= 8
    assert store.read().select("doc_id").distinct().count() == 40_000


def test_shards_of_any_id_and_of_clashing_columns(spark):
    rows = [(None if r[0] is None else f"id{r[0]}", *r[1:]) for r in H.awkward_rows()]
    docs = spark.createDataFrame(rows, H.SCHEMA.replace("doc_id long", "doc_id string")).withColumns({c: F.lit(c) for c in H.CLASHES})
    back = sharding.shard_table(docs).read()
    assert back.columns == docs.columns and Counter(map(tuple, back.collect())) == Counter(map(tuple, docs.collect()))


def test_one_of_many_writers_at_once_gets_the_version(spark):
    store = sharding.ShardStore(spark, common.new_folder(spark, "t"))
    base = store.append(spark.range(3))

    def attempt(k):
        try:
            return store.commit(base, base.schema, (*base.shards, sharding.Shard(f"data/{k}", k, k)))
        except sharding.CommitConflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        made = [m for m in pool.map(attempt, range(16)) if m]
    assert len(made) == 1 and store.manifest() == made[0] and store.versions() == [0, 1]


def test_empty_shards(spark):
    store = sharding.shard_table(H.documents(spark, []))
    assert store.read().count() == 0 and store.manifest().shards == ()
    with pytest.raises(ValueError):
        sharding.ShardStore(spark, common.new_folder(spark, "t")).read()


PAGES = [(1, "http://a/x y\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 300_000), (5, "u", "x" * 300_000), (6, "u", "x" * 300_000), (None, "u", "<p>é</p>"), (None, None, "alone"), (7, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 10])
def test_warc_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'c' as digest", "'c' as file")
    folder = common.new_folder(spark, "w")
    index = warc.write_archives(pages, folder, min_revisit_bytes=least, archive_bytes=200)
    assert index.select("file").distinct().count() > 1
    got = warc.read_records(index, folder, stretch_bytes=1 << 10).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = Counter()
    for i, _, h in PAGES:
        data = (h or "").encode()
        again = len(data) >= least and h is not None and (h in first) and i != first[h] if h else len(data) >= least and i != first[""]
        want[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None)] += 1
    assert Counter(tuple(g)[:5] for g in got) == want
    assert all((g.payload is None) == (g.record_type == "revisit") for g in got)


def test_warc_selected_records_and_errors(spark):
    pages = spark.createDataFrame(PAGES[:6], "page_id long, url string, html string")
    folder = common.new_folder(spark, "w")
    index = warc.write_archives(pages, folder)
    assert [r.page_id for r in warc.read_records(index.where("page_id = 3"), folder).collect()] == [3]
    assert warc.read_records(index.where("false"), folder).count() == 0
    assert warc.write_archives(pages.where("false"), common.new_folder(spark, "w")).count() == 0
    record = warc.build_record(1, "u", b"abc", "X" * 32, None, False)
    with pytest.raises(ValueError):
        warc.parse_record(record)
    with pytest.raises(ValueError):
        warc.parse_record(record[:-1])


def test_coalesced_ranges():
    ranges = [(0, 10, "a"), (500, 5, "c"), (10, 20, "b")]
    assert [(s, e, len(m)) for s, e, m in warc.coalesce_ranges(ranges, gap=100)] == [(0, 30, 2), (500, 505, 1)]


def domain_rows(n=300):
    import random

    rng = random.Random(7)
    rows, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        text = H.prose(rng, 60) + (" awful awful stuff" if toxic else "")
        rows.append((k, text, None, None, None))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_mixing_meets_its_targets(spark):
    rows, labels = domain_rows()
    table, report = mixing.mix(H.documents(spark, rows), H.labels(spark, labels[::2]), F.expr(mixing.LABEL_DOMAIN), {"clean": 0.9, "toxic": 0.1})
    out = table.toPandas()
    assert (out["rate"] >= 0).all() and len(out) == len(rows)
    for k, d in enumerate(report["domains"]):
        reached = (out["n_tokens"] * out["rate"] * out[f"p_{d}"]).sum()
        assert abs(reached - report["target"][k]) < 0.03 * report["supply"].sum()
    clean = out[out["doc_id"] % 4 != 0]
    assert (clean["copies"] == 1).mean() > 0.97
    assert (out[out["doc_id"] % 4 == 0]["copies"] == 0).mean() > 0.4
    # Brute force: plain projected gradient in numpy, run long, comes no nearer to the targets.
    p, t = out[["p_clean", "p_toxic"]].to_numpy(), out["n_tokens"].to_numpy()
    total, target = t.sum(), report["target"]
    rate = np.ones(len(t))
    for _ in range(5_000):
        rate = np.clip(rate - p @ ((t * rate) @ p - target) / total, 0, 1)
    plain = (((t * rate) @ p - target) ** 2).sum()
    mine = (((t * out["rate"].to_numpy()) @ p - target) ** 2).sum()
    assert report["matched"] or mine <= 1.001 * plain + (mixing.TOLERANCE * total) ** 2
    assert np.allclose((t * out["rate"].to_numpy()) @ p, report["reached"])


def test_mixing_settles_or_says_so(spark):
    """Random soft memberships: the totals match where rates are free, and one step only is an error."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.4, 0.2, 0.2], 500)
    rows = [(k, int(rng.integers(0, 400)), *map(float, x)) for k, x in enumerate(p)]
    members = common.materialize(spark.createDataFrame(rows, "id long, n_tokens long, p0 double, p1 double, p2 double"), "m")
    for weights in ([0.96, 0.02, 0.02], [0.3, 0.6, 0.1], [1.0, 0.0, 0.0]):
        for bound in (1.0, float("inf")):
            rated, report = mixing.fit_rates(members, weights, bound)
            got = rated.toPandas()
            total = got["n_tokens"].sum()
            t, q, r = got["n_tokens"].to_numpy(), got[["p0", "p1", "p2"]].to_numpy(), got["rate"].to_numpy()
            assert (r >= 0).all() and (r <= bound).all()
            error = (t * r) @ q - report["target"]
            if report["matched"]:
                assert np.abs(error).max() <= 1.01 * mixing.TOLERANCE * total
                continue
            rate = np.ones(len(t))
            for _ in range(5_000):
                rate = np.clip(rate - q @ ((t * rate) @ q - report["target"]) / total, 0, bound)
            plain = (((t * rate) @ q - report["target"]) ** 2).sum()
            assert (error**2).sum() <= 1.02 * plain + (mixing.TOLERANCE * total) ** 2
    with pytest.raises(RuntimeError):
        mixing.fit_rates(members, [0.3, 0.6, 0.1], 1.0, most_sums=1)


def test_posteriors_are_the_softmax_of_the_features(spark):
    """Posteriors by a second computation, text by text, and ids that are strings."""
    rows, labels = domain_rows(80)
    docs = H.documents(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    known = H.labels(spark, labels).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    model = mixing.learn_domains(docs, known, F.expr(mixing.LABEL_DOMAIN))
    got = {r["id"]: r for r in mixing.posteriors(docs, model).collect()}
    assert set(got) == {f"d{k}" for k in range(80)}
    for k, text, *_ in rows:
        data, said = text.encode(), H.words(text)
        shares = [data.count(bytes([b])) / len(data) for b in range(256)]
        hashes, _ = textkit.word_hashes(*textkit.buffers(pa.array([text])))
        buckets = sorted({int(h) % mixing.BUCKETS for h in hashes})
        dense = np.array([*shares, len(buckets) / len(said), sum(a == b for a, b in zip(said, said[1:], strict=False)) / len(said)])
        z = (np.clip((dense - model.mean) / model.scale, -8, 8) / 4) @ model.weights[: mixing.DENSE] + model.weights[-1]
        for b in buckets:
            if model.slot[b] >= 0:
                z = z + model.weights[mixing.DENSE + model.slot[b]]
        p = np.exp(z - z.max())
        p /= p.sum()
        assert np.allclose([got[f"d{k}"]["p0"], got[f"d{k}"]["p1"]], p, atol=1e-9)
        assert got[f"d{k}"]["n_tokens"] == len(said)
    table, _ = mixing.mix(docs, known, F.expr(mixing.LABEL_DOMAIN), {"clean": 0.5, "toxic": 0.5}, max_rate=float("inf"))
    assert table.where("copies <> floor(rate) and copies <> floor(rate) + 1").count() == 0


def test_scarce_domains_are_repeated_where_rates_are_free(spark):
    rows, labels = domain_rows()
    weights = {"clean": 0.5, "toxic": 0.5}
    for bound in (1.0, float("inf")):
        table, report = mixing.mix(H.documents(spark, rows), H.labels(spark, labels[::2]), F.expr(mixing.LABEL_DOMAIN), weights, max_rate=bound)
        toxic = report["domains"].index("toxic")
        assert report["asked"][toxic] > 2 * report["supply"][toxic]
        short = report["asked"][toxic] - report["target"][toxic]
        assert short == 0 if bound > 1 else short > 0
    assert report["matched"] and abs(report["reached"] - report["asked"]).max() < 1e-4 * report["supply"].sum()
    assert table.agg(F.max("copies")).first()[0] > 1


def test_mixing_awkward_rows(spark):
    rows = H.awkward_rows()
    table, _ = mixing.mix(H.documents(spark, rows), H.labels(spark), F.expr(mixing.LABEL_DOMAIN), mixing.LABEL_TARGETS)
    got = table.collect()
    assert len(got) == len(rows)
    assert Counter((g.doc_id, g.n_tokens) for g in got) == Counter((r[0], len(H.words(r[1]))) for r in rows)
    plain, report = mixing.mix(H.documents(spark, rows), H.labels(spark, []), F.expr(mixing.LABEL_DOMAIN), mixing.LABEL_TARGETS)
    assert report == {} and {(r.rate, r.copies) for r in plain.collect()} == {(1.0, 1)}
    assert mixing.mix(H.documents(spark, []), H.labels(spark), F.expr(mixing.LABEL_DOMAIN), mixing.LABEL_TARGETS)[0].count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows, labels = domain_rows(120)
    rows += [(500 + k, rows[1][1], None, None, None) for k in range(4)]
    rows += [(None if r[0] is None else r[0] + 1000, *r[1:]) for r in H.awkward_rows()]
    H.documents(spark, rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    H.labels(spark, labels).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.materialize(stage(spark, docs, str(tmp_path)), "stage")
        kept = [r[0] for r in docs.select("doc_id").collect()]
        if name != "bpe":
            assert docs.columns == before.columns
            assert docs.join(before, "doc_id", "left_semi").count() == docs.where("doc_id is not null").count()
        if name == "exact_dedup":
            texts = [(r[0] or "").translate(H.LOWER) for r in docs.where("doc_id is not null").select("text").collect()]
            assert len(texts) == len(set(texts)) and 503 in kept and 1 not in kept
        if name == "near_dedup":
            comps = H.near_components([tuple(r) for r in docs.collect()])
            assert all(i == c for i, c in comps.items())
            assert set(comps) == set(H.near_components([tuple(r) for r in before.collect()]).values())
        if name == "mixing":
            assert {i for i in kept if i is not None and i < 120 and i % 4} == {i for (i,) in before.select("doc_id").where("doc_id < 120 and doc_id % 4 <> 0").collect()}
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() == len(kept)
    empty = H.documents(spark, [], clash=False)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
