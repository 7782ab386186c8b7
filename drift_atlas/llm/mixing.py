"""Soft-membership mixing: document rates that bring domain token totals to target weights.

A classifier learned from a labelled table gives every document a posterior over
the domains; its tokens count towards each domain in that proportion. Nonnegative
rates, one per document, are fitted so that the expected token totals match the
targets: least squares by projected gradient from the rate 1.

The gradient of a document's rate is its posterior times the domains' errors. The
projection is lazy: gradients are accumulated in one number per domain, and a rate
is 1 less the posterior times those numbers, projected to its bounds. A step scales
the gradient by the inverse Gram matrix of the rates that no bound holds, and is
shortened while the objective does not fall. So an iteration is one distributed sum
of a few numbers, and nothing per document ever reaches the driver or is written.
The fit ends at the optimum, whether the totals can match or not; not to reach it is
an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drift_atlas.llm import common, textkit

#: Hashed word features, how many of them the classifier keeps, and the labelled rows it sees.
BUCKETS, KEPT_WORDS, SAMPLE_ROWS = 1 << 16, 256, 6_000
#: Dense features: shares of the 256 bytes, of distinct words, and of words equal to the one before.
DENSE = 258
#: Totals match within this share of all tokens.
TOLERANCE = 1e-5
#: Weights of the squared distance of the rates from 1, tried in turn until the totals match; the last makes no matter.
RIDGES = (1e-2, 1e-4, 1e-6)
#: Shares of a step that are tried in one distributed sum, and sums beyond which the fit is given up as an error.
STEP_SIZES, MOST_SUMS = np.array([1.0, 1 / 3, 1 / 9, 1 / 27]), 200
SEED = 17


def _features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: first text, word counts, dense features, and (text, bucket) of distinct words."""
    raw, at = textkit.buffers(column)
    for first, last in textkit.slices(at):
        n = last - first
        words, word_at = textkit.word_hashes(raw, at[first : last + 1])
        owner = np.repeat(np.arange(n), np.diff(word_at))
        counts = np.diff(word_at)
        own = raw[at[first] : at[last]]
        byte_owner = np.repeat(np.arange(n), np.diff(at[first : last + 1]))
        dense = np.zeros((n, DENSE))
        dense[:, :256] = np.bincount(byte_owner * 256 + own, minlength=n * 256).reshape(n, 256)
        dense[:, :256] /= np.maximum(dense[:, :256].sum(axis=1, keepdims=True), 1)
        pairs = np.unique(owner.astype(np.int64) * BUCKETS + (words & textkit.U64(BUCKETS - 1)).astype(np.int64))
        who, bucket = pairs // BUCKETS, pairs % BUCKETS
        dense[:, 256] = np.bincount(who, minlength=n) / np.maximum(counts, 1)
        again = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        dense[:, 257] = np.bincount(owner[1:][again], minlength=n) / np.maximum(counts, 1)
        yield first, counts, dense, who, bucket


@dataclass(frozen=True)
class DomainModel:
    domains: tuple[str, ...]
    slot: np.ndarray  # bucket to kept word feature, -1 for the others
    weights: np.ndarray  # (dense + kept words + 1) x domains
    mean: np.ndarray
    scale: np.ndarray


def fit_classifier(dense: np.ndarray, buckets: list[np.ndarray], labels: list[str], rounds: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> DomainModel:
    """Multinomial logistic regression on dense features and the words that tell the domains apart best."""
    domains = tuple(sorted(set(labels)))
    kinds = np.array([domains.index(x) for x in labels], np.int64)
    n, c = len(kinds), len(domains)
    seen = np.zeros((c, BUCKETS))
    for k, own in zip(kinds, buckets, strict=True):
        seen[k, own] += 1
    size = np.maximum(np.bincount(kinds, minlength=c), 1)[:, None]
    expected = seen.sum(axis=0) * size / max(n, 1)
    tells = ((seen - expected) ** 2 / np.maximum(expected, 1)).max(axis=0, initial=0)
    kept = np.sort(np.argsort(-tells, kind="stable")[:KEPT_WORDS])
    slot = np.full(BUCKETS, -1, np.int64)
    slot[kept] = np.arange(len(kept))
    x = np.zeros((n, DENSE + len(kept) + 1))
    mean, scale = dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-3)
    x[:, :DENSE] = np.clip((dense - mean) / scale, -8, 8) / 4
    for k, own in enumerate(buckets):
        own = slot[own]
        x[k, DENSE + own[own >= 0]] = 1
    x[:, -1] = 1
    w, pace = np.zeros((x.shape[1], c)), np.zeros((x.shape[1], c))
    truth = np.eye(c)[kinds]
    for _ in range(rounds):  # Nesterov's gradient on the full sample
        ahead = w + 0.9 * pace
        z = x @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        pace = 0.9 * pace - rate * (x.T @ (p - truth) / n + ridge * ahead)
        w = w + pace
    return DomainModel(domains, slot, w, mean, scale)


def learn_domains(docs: DataFrame, labelled: DataFrame, domain: Column, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DomainModel | None:
    """Fit on a bounded sample of the labelled table: the rows of smallest id hash. None without labels."""
    known = labelled.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), domain.alias("__domain")).where("__domain is not null")
    known = known.groupBy("__id").agg(F.min("__domain").alias("__domain")).orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    met = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(known), "__id").select("__id", "__domain", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, counts, dense, who, bucket in _features(batch.column(2)):
                cuts = np.searchsorted(who, np.arange(len(counts) + 1))
                words = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(bucket.astype(np.int32)))
                shares = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * DENSE, pa.int32()), pa.array(dense.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), batch.column(1).slice(first, len(counts)), words, shares], names=["id", "domain", "words", "dense"])

    rows = met.mapInArrow(run, f"id {met.schema[0].dataType.simpleString()}, domain string, words array<int>, dense array<float>").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["id"], r["domain"]))
    return fit_classifier(np.array([r["dense"] for r in rows], np.float64), [np.array(r["words"], np.int64) for r in rows], [r["domain"] for r in rows])


def posteriors(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_tokens`` (words) and the posterior of each domain as columns p0, p1, ... of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"p{k}" for k in range(len(model.domains))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        kept = m.weights.shape[0] - DENSE - 1
        for batch in batches:
            for first, counts, dense, who, bucket in _features(batch.column(1)):
                z = np.clip((dense - m.mean) / m.scale, -8, 8) / 4 @ m.weights[:DENSE] + m.weights[-1]
                slot = m.slot[bucket]
                hit = slot >= 0
                if kept and hit.any():
                    np.add.at(z, who[hit], m.weights[DENSE + slot[hit]])
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), pa.array(counts.astype(np.int64)), *[pa.array(np.ascontiguousarray(p[:, k])) for k in range(p.shape[1])]], names=["id", "n_tokens", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = ", ".join(f"{n} double" for n in names)
    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, n_tokens long, {kinds}")


def _rate(slopes: np.ndarray, max_rate: float) -> Column:
    """The rates of accumulated gradients."""
    free = F.lit(1.0)
    for k, x in enumerate(slopes):
        free = free - F.col(f"p{k}") * F.lit(float(x))
    return F.least(F.lit(float(max_rate)), F.greatest(F.lit(0.0), free))


@dataclass(frozen=True)
class _State:
    """At the rates of ``slopes``: tokens of each domain, Gram matrix of the rates within their bounds, and the sum whose gradient those tokens are."""

    slopes: np.ndarray
    reached: np.ndarray
    gram: np.ndarray
    level: float

    def worth(self, target: np.ndarray, ridge: float) -> float:
        return ridge / 2 * float(self.slopes @ self.slopes) + float(target @ self.slopes) + self.level


def _measure(members: DataFrame, tried: np.ndarray, max_rate: float) -> list[_State]:
    """One distributed sum for all rows of ``tried``; a task sends a row of numbers for each batch, and Spark adds them up."""
    m, c = tried.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, *p = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(c + 1))
            p = np.stack(p, axis=1)
            free = 1 - p @ tried.T
            rate = np.clip(free, 0, max_rate)
            inside = (free > 0) & (free < max_rate)
            grams = [(p * (n * inside[:, k])[:, None]).T @ p for k in range(m)]
            # Half the squared rate, continued as a line beyond an upper bound.
            sums = np.concatenate(((p * n[:, None]).T @ rate, np.stack(grams, axis=-1).reshape(c * c, m), (n @ (rate * free - rate * rate / 2))[None, :])).T
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(m)), *(pa.array(np.ascontiguousarray(sums[:, k])) for k in range(sums.shape[1]))], names=names)

    names = ["k", *(f"v{k}" for k in range(c + c * c + 1))]
    parts = members.select("n_tokens", *(f"p{k}" for k in range(c))).mapInArrow(run, "k long, " + ", ".join(f"{v} double" for v in names[1:]))
    rows = {r["k"]: np.array(r[1:], float) for r in parts.groupBy("k").agg(*(F.sum(v) for v in names[1:])).collect()}
    found = [rows.get(k, np.zeros(len(names) - 1)) for k in range(m)]
    return [_State(at, v[:c], v[c:-1].reshape(c, c), float(v[-1])) for at, v in zip(tried, found, strict=True)]


def fit_rates(members: DataFrame, weights: list[float], max_rate: float, most_sums: int = MOST_SUMS) -> tuple[DataFrame, dict]:
    """Add ``rate`` to a table of n_tokens and p0, p1, ...; also what was aimed at and reached.

    The budget is such that the domain of the largest weight is used once in full.
    A domain's target is its weight of the budget, or, where rates are bounded,
    ``max_rate`` times what there is of it, if that is less; ``asked`` has the weights
    of the budget without that bound. ``matched`` tells whether the targets are met
    within the tolerance; if not, no rates within the bounds come notably nearer.
    """
    c = len(weights)
    share = np.array(weights, float) / sum(weights)
    now = _measure(members, np.zeros((1, c)), max_rate)[0]
    supply, sums = now.reached, 1
    total = supply.sum()
    if not total:
        return members.withColumn("rate", F.lit(1.0)), {"supply": supply, "asked": supply, "target": supply, "reached": supply, "sums": 1, "matched": True}
    anchor = int(share.argmax())
    asked = share * (supply[anchor] / share[anchor])
    target = np.minimum(asked, supply * max_rate) if np.isfinite(max_rate) else np.where(supply > 0, asked, 0.0)
    for ridge in (r * total for r in RIDGES):
        while np.abs(gradient := ridge * now.slopes + target - now.reached).max() > TOLERANCE / 10 * total:
            move = np.linalg.solve(now.gram + ridge * np.eye(c), gradient)
            before, length = now.worth(target, ridge), 1.0
            while True:
                if sums == most_sums:
                    raise RuntimeError(f"the rates did not settle in {most_sums} sums")
                sums += 1
                sizes = length * STEP_SIZES
                tried = _measure(members, now.slopes - sizes[:, None] * move, max_rate)
                better = [t for t, size in zip(tried, sizes, strict=True) if t.worth(target, ridge) <= before - 1e-4 * size * float(gradient @ move) + 1e-12 * abs(before)]
                if better:
                    now = min(better, key=lambda t: t.worth(target, ridge))  # noqa: B023
                    break
                length *= STEP_SIZES[-1] / 3
        matched = bool(np.abs(now.reached - target).max() <= TOLERANCE * total)
        if matched:
            break
    report = {"supply": supply, "asked": asked, "target": target, "reached": now.reached, "sums": sums, "matched": matched}
    return members.withColumn("rate", _rate(now.slopes, max_rate)), report


def mix(docs: DataFrame, labelled: DataFrame, domain: Column, targets: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text", max_rate: float = 1.0, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, dict]:
    """Rates of all documents that bring the domains' expected token totals to the target weights.

    Returns the table (the id, ``n_tokens``, ``p_<domain>`` for each domain, ``rate``,
    ``copies``) and a report. ``copies`` is the rate rounded up or down by a hash of
    the id, so that its expectation is the rate; rows of one id agree. Domains
    without a target weight get weight 0. Null and empty texts have no tokens, and
    a rate all the same. Without labels, or where no label has a positive weight,
    every rate is 1. Ids may be of any type that Arrow carries; further columns are
    ignored.
    """
    model = learn_domains(docs, labelled, domain, id_col, text_col, sample_rows)
    weights = [float(targets.get(d, 0.0)) for d in model.domains] if model else []
    if model is None or sum(weights) <= 0:
        plain = docs.select(F.col(id_col).alias(id_col), F.size(F.array_remove(F.split(F.coalesce(text_col, F.lit("")), common.SPACE_CLASS + "+"), "")).cast("long").alias("n_tokens"))
        return plain.withColumns({"rate": F.lit(1.0), "copies": F.lit(1).cast("long")}), {}
    members = common.materialize(posteriors(docs, model, id_col, text_col), "domain-members")
    rated, report = fit_rates(members, weights, max_rate)
    draw = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    out = rated.select(F.col("id").alias(id_col), "n_tokens", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(model.domains)], "rate", copies.alias("copies"))
    return out, report | {"domains": model.domains}


#: The domains of the labels table and the mixture that training wants.
LABEL_DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' WHEN quality = 1 THEN 'clean' END"
LABEL_TARGETS = {"clean": 0.96, "poor": 0.02, "toxic": 0.02}
