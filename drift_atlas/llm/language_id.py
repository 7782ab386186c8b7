"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed character n-grams (words with
boundary marks, letters lower-cased), and a softmax over a linear layer gives the
languages. Both layers are trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows. As both are linear, embedding and layer are
multiplied out once after training: a prediction is a mean of table rows.

A temperature fitted on rows that were not trained on calibrates the scores; a
prediction below ``reject_below`` is rejected as ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drift_atlas.llm import textkit

#: N-grams and hashed embeddings.
GRAMS = (1, 2, 3)
BUCKETS, WIDTH = 1 << 14, 16
#: Labelled rows that are learned from, chosen by the smallest hash of their id, and the bytes of each that are read.
SAMPLE_ROWS = 4_000
EPOCHS, RATE = 12, 0.5
UNDETERMINED = "und"

#: Hashes of ids are taken modulo this.
_HASHES = 1 << 52
#: Ranges of hashes whose rows are counted before the sample is taken.
HASH_RANGES = 1 << 12
#: Code points hashed at once.
_PIECE = 1 << 19
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _letters(codes: np.ndarray) -> np.ndarray:
    """Lower-cased letters as code points, everything else as 0."""
    table = _letter_table()
    return table[np.minimum(codes, len(table) - 1)]


_table: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code point to the lower-case letter, or 0; built once from Python's character database."""
    if not _table:
        size = 0x32000
        out = np.zeros(size + 1, np.uint32)
        for k in range(size):
            c = chr(k)
            if c.isalpha() or 0x300 <= k < 0x370:
                low = c.lower()
                out[k] = ord(low) if len(low) == 1 else k
        out[size] = size
        _table.append(out)
    return _table[0]


def _gram_buckets(letters: np.ndarray) -> np.ndarray:
    """Buckets of all n-grams of consecutive symbols that hold a letter; non-letters are one boundary symbol."""
    if not len(letters):
        return np.zeros(0, np.int64)
    edged = np.concatenate((np.zeros(1, np.uint32), letters, np.zeros(1, np.uint32)))
    keep = np.ones(len(edged), bool)
    keep[1:] = (edged[1:] != 0) | (edged[:-1] != 0)
    edged = edged[keep]
    out = []
    for n in GRAMS:
        m = len(edged) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        solid, inner = np.zeros(m, bool), np.ones(m, bool)
        for k in range(n):
            part = edged[k : k + m]
            h = (h ^ part) * _MUL[k]
            h ^= h >> np.uint32(15)
            solid |= part != 0
            if 0 < k < n - 1:
                inner &= part != 0  # a gram crosses no boundary
        out.append((h[solid & inner] & np.uint32(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Bounded pieces of UTF-8 bytes, none of which ends inside a character."""
    at = 0
    while at < len(raw):
        end = min(at + _PIECE, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        yield raw[at:end]
        at = end


def _codes(raw: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes; a character cut off at an end is dropped."""
    return np.frombuffer(raw.tobytes().decode("utf-8", "ignore").encode("utf-32-le"), np.uint32)


def gram_counts(text: str | bytes | None) -> np.ndarray:
    """How often each bucket occurs in a whole text."""
    data = text.encode() if isinstance(text, str) else text or b""
    counts = np.zeros(BUCKETS, np.float64)
    raw = np.frombuffer(data, np.uint8)
    for piece in _pieces(raw):
        counts += np.bincount(_gram_buckets(_letters(_codes(piece))), minlength=BUCKETS)
    return counts


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # buckets x languages: embeddings times the linear layer
    bias: np.ndarray
    temperature: float

    def scores(self, grams: np.ndarray) -> np.ndarray:
        logits = (grams @ self.table / max(grams.sum(), 1.0) + self.bias) / self.temperature
        e = np.exp(logits - logits.max())
        return e / e.sum()


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Train on labelled texts as (buckets that occur, how often); every eighth calibrates the temperature instead."""
    languages = tuple(sorted(set(labels)))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    rng = np.random.Generator(np.random.PCG64(seed))
    kinds = np.array([languages.index(x) for x in labels])
    grams = [(at, counts / max(counts.sum(), 1.0)) for at, counts in rows]
    embed = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    layer, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    held = np.arange(len(rows)) % 8 == 7 if len(rows) >= 64 else np.zeros(len(rows), bool)
    trained = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(trained):
            at, share = grams[k]
            mean = share @ embed[at]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[kinds[k]] -= 1
            back = layer @ p
            layer -= step * np.outer(mean, p)
            bias -= step * p
            # Shares are tiny; scaling them by the number of grams gives each the rate of one gram among few.
            embed[at] -= step * np.outer(np.minimum(share * len(at), 1.0), back)
    table = embed @ layer
    check = np.flatnonzero(held)
    z = np.array([grams[k][1] @ table[grams[k][0]] + bias for k in check]) if len(check) else np.zeros((0, len(languages)))
    temperature = _temperature(z, kinds[check])
    return Model(languages, table.astype(np.float32), bias, temperature)


def _temperature(logits: np.ndarray, kinds: np.ndarray) -> float:
    """The divisor of the logits with the best likelihood on held-out rows."""
    if not len(kinds):
        return 1.0

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(kinds)), kinds]).mean())

    return min((float(t) for t in np.geomspace(0.25, 4, 33)), key=loss)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample: the ``sample_rows`` rows of smallest id hash, whole texts.

    The hash is that of the id and the text, so rows that share an id are sampled like
    others, and rows that share both stand or fall together. The rows are counted by
    hash range first, and only those of the ranges that hold the sample are sorted and
    sent as the counts of their buckets; ties come in the order of id, language and
    counts. Texts without a letter teach nothing, as they have no bucket.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    place = F.pmod(F.xxhash64(id_col, text_col), F.lit(_HASHES))
    ranges = known.groupBy(F.floor(place / (_HASHES / HASH_RANGES)).cast("int").alias("k")).count().orderBy("k").collect()
    held = 0
    for r in ranges:
        held += r["count"]
        if held >= sample_rows:
            known = known.where(place < (r["k"] + 1) * (_HASHES // HASH_RANGES))
            break
    chosen = known.select(F.xxhash64(id_col, text_col).alias("h"), F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, often = [], []
            for k in range(batch.num_rows):
                counts = gram_counts(batch.column(3)[k].as_py())
                at = np.flatnonzero(counts)
                found.append(at.astype("<u2").tobytes()), often.append(counts[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary()), pa.array(often, pa.binary())], names=["h", "id", "lang", "buckets", "counts"])

    counted = chosen.mapInArrow(run, f"h long, id {chosen.schema[1].dataType.simpleString()}, lang string, buckets binary, counts binary")
    rows = counted.orderBy(F.pmod("h", F.lit(_HASHES)), "id", "lang", "buckets", "counts").limit(sample_rows).collect()
    grams = [(np.frombuffer(r["buckets"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<f4").astype(np.float64)) for r in rows]
    return fit(grams, [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject_below: float = 0.5) -> DataFrame:
    """Language and calibrated score of every whole text: the id, ``lang_pred``, ``score``.

    Null texts and texts without a letter are ``und`` with score 0, as is all with a
    model that knows no language; a score below ``reject_below`` makes ``und`` too.
    The model (its size is fixed by the buckets) is sent out once. Each row stands
    alone; further columns are dropped.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            raw, at = textkit.buffers(batch.column(1))
            langs, scores = [], []
            for k in range(batch.num_rows):
                total, seen = np.zeros(len(known.languages)), 0
                own = raw[at[k] : at[k + 1]]
                for piece in _pieces(own):
                    grams = _gram_buckets(_letters(_codes(piece)))
                    counts = np.bincount(grams, minlength=BUCKETS)
                    total += counts @ known.table
                    seen += len(grams)
                if not seen or not known.languages:
                    langs.append(UNDETERMINED), scores.append(0.0)
                    continue
                z = (total / seen + known.bias) / known.temperature
                p = np.exp(z - z.max())
                p /= p.sum()
                best = int(p.argmax())
                langs.append(known.languages[best] if p[best] >= reject_below else UNDETERMINED)
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, lang_pred string, score double")
