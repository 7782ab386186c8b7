"""Near-duplicate documents: MinHash bands, odd sketches and exact confirmation.

Plan
 1. One pass over the texts hashes every 5-word shingle, and gives each document
    a 128-bit digest of its shingle set, band keys of its MinHash samples, and an
    odd sketch: a parity bitmap into which all samples are folded.
 2. Documents with equal sets are one class, represented by its smallest id. Only
    representatives go on, so exact copies, however many, cost one row each.
 3. In each band bucket every member is paired with the bucket's smallest id. The
    population count of the XOR of two odd sketches estimates the similarity;
    pairs far below the threshold go, the rest are confirmed on full sets.
    Confirmed links are contracted to components.
 4. What is left to compare in a bucket are members of different components: all
    such pairs are met in a join whose condition holds the size bound, the
    estimate of a longer odd sketch, made for these members only, and at last the
    comparison of the full sets, and that yields
    a link in the first of its common buckets only. So every pair that shares a bucket is
    either already in one component or has been compared; a bucket has no cap.
 5. Components over all confirmed links give each class its component.

A large group of near copies therefore costs one pair per member and band, not
all pairs. Two sets of similarity 0.75 share no bucket with probability
(1 - 0.75**5)**40, about 2e-5, and sets of 0.8 with 1e-7.

Every stage reads written tables, so hot join keys are split by the adaptive skew
join, and a lost executor costs one stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drift_atlas.llm import common, components, textkit
from drift_atlas.llm.textkit import U64

SHINGLE_WORDS = 5
#: Links need 100 * intersection >= THRESHOLD_PERCENT * union.
THRESHOLD_PERCENT = 75
BANDS, BAND_ROWS = 40, 5
SAMPLES = BANDS * BAND_ROWS
SKETCH_BITS = 1024
#: Samples and bits of the longer sketch.
FINE_SAMPLES, FINE_BITS = 1024, 4096
#: Shingle hashes that a task keeps of texts it may meet again.
HELD_HASHES = 500_000
#: The estimates' standard deviations at the threshold are about 0.033 and 0.0145; these are over four of them.
ESTIMATE_MARGIN, FINE_MARGIN = 0.14, 0.063

_rng = np.random.Generator(np.random.PCG64(5_000_011))
_XOR = _rng.integers(0, 1 << 32, FINE_SAMPLES, dtype=np.uint64).astype(np.uint32)
_MUL = _rng.integers(0, 1 << 31, FINE_SAMPLES, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_BAND_MUL = _rng.integers(1, 1 << 63, (BANDS, BAND_ROWS), dtype=np.uint64) * U64(2) + U64(1)
_BAND_ADD = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)
_SKETCH_ADD = _rng.integers(1, 1 << 63, FINE_SAMPLES, dtype=np.uint64)
_DIGEST_MUL = _rng.integers(1, 1 << 63, 2, dtype=np.uint64) * U64(2) + U64(1)


def minhash(shingle_set: np.ndarray, samples: int = SAMPLES, cells: int = 25_600) -> np.ndarray:
    """The smallest value of the set under each sample's hash, in blocks that stay in the cache."""
    low = shingle_set.astype(np.uint32)
    best = np.full(samples, 0xFFFFFFFF, np.uint32)
    rows = max(1, cells // samples)
    for k in range(0, len(low), rows):
        block = (low[k : k + rows, None] ^ _XOR[:samples]) * _MUL[:samples]
        np.minimum(best, block.min(axis=0), out=best)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, with the band's number mixed in."""
    grouped = samples.reshape(BANDS, BAND_ROWS).astype(U64)
    return textkit.mix((grouped * _BAND_MUL).sum(axis=1, dtype=U64) + _BAND_ADD)


def odd_sketch(samples: np.ndarray, size: int = SKETCH_BITS) -> np.ndarray:
    """Parity of the samples that fall on each bit, as 64-bit words."""
    bits = textkit.mix(samples.astype(U64) + _SKETCH_ADD[: len(samples)]) % U64(size)
    parity = (np.bincount(bits.astype(np.int64), minlength=size) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def sketch_limit(threshold: float, margin: float, samples: int = SAMPLES, size: int = SKETCH_BITS) -> int:
    """Differing bits up to which a pair's estimated similarity reaches the threshold less the margin."""
    apart = 2 * samples * (1 - (threshold - margin))
    return int(np.ceil(size * (1 - (1 - 2 / size) ** apart) / 2))


def _sets(raw: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    for first, last in textkit.slices(at):
        words, word_at = textkit.word_hashes(raw, at[first : last + 1])
        runs, run_at = textkit.shingles(words, word_at, SHINGLE_WORDS)
        for k in range(last - first):
            yield np.unique(runs[run_at[k] : run_at[k + 1]])


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashed shingles of one text."""
    return next(_sets(*textkit.buffers(pa.array([text], pa.string()))))


_SIGNATURE = "id long, n_shingles long, set_hi long, set_lo long, bands array<long>, sketch array<long>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One output batch for each slice of texts; blank texts have a size of 0 and nulls."""
    for batch in batches:
        raw, at = textkit.buffers(batch.column(1))
        ids = batch.column(0).cast(pa.int64())
        for first, last in textkit.slices(at):
            n = last - first
            count, digest = np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
            bands, sketches = np.zeros((n, BANDS), np.int64), np.zeros((n, SKETCH_BITS // 64), np.int64)
            for k, own in enumerate(_sets(raw, at[first : last + 1])):
                count[k] = len(own)
                if len(own):
                    digest[k] = np.array([textkit.mix(own ^ m).sum(dtype=U64) for m in _DIGEST_MUL]).view(np.int64)
                    samples = minhash(own)
                    bands[k], sketches[k] = band_keys(samples).view(np.int64), odd_sketch(samples)
            blank = count == 0
            columns = [pa.array(count), *(pa.array(digest[:, k], mask=blank) for k in (0, 1)), _lists(bands, blank), _lists(sketches, blank)]
            yield pa.RecordBatch.from_arrays([ids.slice(first, n), *columns], names=["id", "n_shingles", "set_hi", "set_lo", "bands", "sketch"])


def _lists(rows: np.ndarray, blank: np.ndarray) -> pa.Array:
    """A list column of equally long rows, null where blank."""
    ends = np.concatenate(([0], np.cumsum(~blank))).astype(np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows[~blank].ravel()), mask=pa.array(blank))


def _fine_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The longer sketch and the whole shingle set of every text."""
    for batch in batches:
        made = np.zeros((batch.num_rows, FINE_BITS // 64), np.int64)
        sets = list(_sets(*textkit.buffers(batch.column(1))))
        for k, own in enumerate(sets):
            made[k] = odd_sketch(minhash(own, FINE_SAMPLES), FINE_BITS)
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        whole = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, U64), *sets]).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(made, np.zeros(batch.num_rows, bool)), whole], names=["id", "fine", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the threshold. A text met again in the batch is hashed once."""
    for batch in batches:
        known: dict[int, np.ndarray] = {}
        held = 0
        keep = []
        ids = [batch.column(0).to_pylist(), batch.column(1).to_pylist()]
        for k in range(batch.num_rows):
            sets = []
            for side in (0, 1):
                key = ids[side][k]
                if key not in known:
                    if held > HELD_HASHES:
                        known.clear()
                        held = 0
                    known[key] = shingle_set(batch.column(2 + side)[k].as_py())
                    held += len(known[key])
                sets.append(known[key])
            both = len(np.intersect1d(*sets, assume_unique=True))
            keep.append(100 * both >= THRESHOLD_PERCENT * (len(sets[0]) + len(sets[1]) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _apart(a: str, b: str) -> Column:
    """Differing bits of two short sketches, as straight-line code."""
    total = F.lit(0)
    for k in range(SKETCH_BITS // 64):
        total = total + F.bit_count(F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k))))
    return total


def _apart_long(a: str, b: str) -> Column:
    """Differing bits of two long sketches, as a loop: unrolled, the method would be too long to be compiled."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)


def _sizes_fit(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= THRESHOLD_PERCENT * F.greatest(a, b)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its set's size, its component and whether it stays.

    Documents are linked when their sets of distinct 5-word shingles have a
    Jaccard similarity of 0.75 or more; words are runs of characters other than
    U+0020 and U+0009-U+000D with A-Z lowered; a text of fewer words is one shingle;
    null and blank texts have no shingles and no link. Ids are longs; rows that
    repeat an id are each returned, with one component if their texts are equal; of
    different texts under one id, one decides what the id links to. Rows with a
    null id take the component of the rows with an equal set, null if none of them
    has an id; they link nothing and are not kept. Further columns are ignored.

    Columns: the id, ``n_shingles`` long, ``component_id`` (the smallest id
    reachable), ``kept`` boolean (the id is its component's).
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = common.materialize(texts.mapInArrow(_signatures, _SIGNATURE), "signatures")
    classes = signed.where("n_shingles > 0").groupBy("set_hi", "set_lo").agg(F.min("id").alias("rep"))
    classes = common.materialize(classes, "set-classes")
    chosen = classes.withColumnRenamed("rep", "id")
    reps = signed.join(chosen, ["set_hi", "set_lo", "id"], "left_semi").dropDuplicates(["id"]).select("id", "n_shingles", "bands", "sketch")
    reps = common.materialize(reps, "representatives")

    # The buckets with more than one member; most have one and end here.
    entries = reps.select("id", F.explode("bands").alias("bucket"))
    hubs = entries.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("members")).where("members > 1").drop("members")
    hubs = common.materialize(hubs, "bucket-hubs")
    shared = common.materialize(entries.join(hubs, "bucket"), "bucket-members")
    common.discard(hubs)

    pairs = shared.where("id > hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    links = _confirmed(_estimated(pairs, reps), texts)
    joined = common.materialize(components.connected_components(links), "components")

    # Members of one bucket in different components have not been compared yet.
    open_members = _open_members(shared, joined)
    common.discard(shared)
    open_texts = _texts_of(open_members.select("id"), texts)
    fine = open_texts.mapInArrow(_fine_sketches, "id long, fine array<long>, shingles array<long>")
    fine = common.materialize(fine.join(reps.select("id", "n_shingles", "bands", "sketch"), "id"), "fine-sketches")
    common.discard(open_texts, reps)
    members = common.materialize(open_members.join(fine, "id"), "cross-members")
    common.discard(open_members, fine)
    x, y = (members.select("bucket", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "component", "n_shingles", "bands", "sketch", "fine", "shingles")]) for s in "xy")
    likely = _apart("sketch_x", "sketch_y") <= sketch_limit(THRESHOLD_PERCENT / 100, ESTIMATE_MARGIN)
    near = (F.col("component_x") < F.col("component_y")) & _sizes_fit("n_shingles_x", "n_shingles_y") & likely
    near = near & (_apart_long("fine_x", "fine_y") <= sketch_limit(THRESHOLD_PERCENT / 100, FINE_MARGIN, FINE_SAMPLES, FINE_BITS))
    near = near & (F.col("bucket") == F.array_min(F.array_intersect("bands_x", "bands_y")))
    # Many pairs of a large group may lie just below the threshold, so whole sets decide before a pair becomes a row.
    both = F.size(F.array_intersect("shingles_x", "shingles_y"))
    near = near & ((100 + THRESHOLD_PERCENT) * both >= THRESHOLD_PERCENT * (F.col("n_shingles_x") + F.col("n_shingles_y")))
    links = x.join(y, "bucket").where(near).select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))
    links = common.materialize(links, "cross-links")
    common.discard(members)
    joined = _contracted(joined, links)

    labelled = classes.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("set_hi", "set_lo", F.coalesce("component", "rep").alias("component"))
    labelled = common.materialize(labelled, "class-components")
    out = signed.select("id", "n_shingles", "set_hi", "set_lo").join(labelled, ["set_hi", "set_lo"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _open_members(shared: DataFrame, joined: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, with their components."""
    placed = shared.join(joined, "id", "left").select("bucket", "hub", "id", F.coalesce("component", "id").alias("component"))
    placed = common.materialize(placed, "placed-members")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("bucket")
    mixed = common.materialize(mixed, "mixed-buckets")
    out = common.materialize(placed.join(mixed, "bucket", "left_semi").select("bucket", "id", "component"), "open-members")
    common.discard(placed, mixed)
    return out


def _contracted(joined: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links."""
    if links.isEmpty():
        return joined
    stars = joined.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    return common.materialize(components.connected_components(stars.unionByName(links)), "components")


def _estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Distinct pairs whose sizes and sketches allow the threshold, written."""
    pairs = common.materialize(pairs.distinct(), "candidate-pairs")
    side = lambda s: reps.select(F.col("id").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a")
    near = _sizes_fit("n_a", "n_b") & (_apart("sketch_a", "sketch_b") <= sketch_limit(THRESHOLD_PERCENT / 100, ESTIMATE_MARGIN))
    out = common.materialize(met.where(near).select("a", "b"), "estimated-pairs")
    common.discard(pairs)
    return out


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of written pairs (a, b) those whose full shingle sets are linked, written."""
    needed = _texts_of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), texts)
    with_b = pairs.join(needed.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(needed.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    links = common.materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long"), "links")
    common.discard(needed, pairs)
    return links


def _texts_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per id with its text, written."""
    ids = common.materialize(ids.distinct(), "chosen-ids")
    out = common.materialize(texts.join(ids, "id", "left_semi").dropDuplicates(["id"]), "chosen-texts")
    common.discard(ids)
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is its component's smallest, with all their columns."""
    verdict = near_duplicates(docs, id_col, text_col)
    stays = verdict.where("kept").select(F.col(id_col).alias("kept_id")).distinct()
    return common.rows_with_ids(docs, id_col, common.materialize(stays, "kept-ids"))
