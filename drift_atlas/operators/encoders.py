"""Pluggable encoders: Arrow batches of code sequences in, vectors out.

Pretrained weights are not part of this engine. ``ProjectionEncoder`` is a
deterministic stand-in with the same contract: clamp codes, one-hot by position,
project with a fixed random matrix, average, and normalise if asked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    dim: int

    def encode(self, codes: np.ndarray) -> np.ndarray: ...

    def encode_batch(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray: ...


#: Items whose codes are counted in one table.
ITEMS_AT_ONCE = 128
#: Projections drawn so far in this process, by encoder and position.
_MATRICES: dict[tuple, np.ndarray] = {}


@dataclass(frozen=True)
class ProjectionEncoder:
    """Mean over patches of a fixed projection of the one-hot codes."""

    name: str
    dim: int = 64
    classes: int = 128
    normalize: bool = False

    def matrix(self, position: int) -> np.ndarray:
        """The projection of one position, drawn once for a worker."""
        key = (self.name, self.dim, self.classes, position)
        if key not in _MATRICES:
            _MATRICES[key] = self._draw(position)
        return _MATRICES[key]

    def _draw(self, position: int) -> np.ndarray:
        seed = int(hashlib.md5(f"{self.name}|{position}".encode()).hexdigest()[:8], 16)
        return np.random.Generator(np.random.PCG64(seed)).normal(0, 1 / np.sqrt(self.dim), (self.classes, self.dim))

    def encode(self, codes: np.ndarray) -> np.ndarray:
        """codes: patches x positions. An item without patches is the zero vector."""
        return self.encode_batch(codes, np.array([0, len(codes)]))[0]

    def encode_batch(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Vectors of many items at once: their patches one below the other, and the n + 1 bounds of the items.

        Each position counts every item's codes and multiplies the counts once.
        """
        total = np.zeros((len(ends) - 1, self.dim))
        for first in range(0, len(total), ITEMS_AT_ONCE):
            last = min(first + ITEMS_AT_ONCE, len(total))
            owner = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1])) * self.classes
            own = codes[ends[first] : ends[last]]
            for p in range(codes.shape[1] if len(own) else 0):
                counts = np.bincount(owner + np.clip(own[:, p], 0, self.classes - 1), minlength=(last - first) * self.classes)
                total[first:last] += counts.reshape(last - first, self.classes) @ self.matrix(p)
        out = total / np.maximum(np.diff(ends), 1)[:, None]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1) if self.normalize else out


@dataclass(frozen=True)
class HistogramEncoder:
    """Shares of the codes that fall on each remainder by the dimension: an embedding that any engine can compute."""

    name: str
    dim: int = 64

    def encode(self, codes: np.ndarray) -> np.ndarray:
        """codes: patches x positions. An item without patches is the zero vector."""
        return self.encode_batch(codes, np.array([0, len(codes)]))[0]

    def encode_batch(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(ends) - 1
        owner = np.repeat(np.arange(n), np.diff(ends))[:, None] * self.dim
        counts = np.bincount((owner + codes % self.dim).ravel(), minlength=n * self.dim).reshape(n, self.dim) if codes.size else np.zeros((n, self.dim))
        return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


#: Name to encoder: the token-like ones keep the scale, the patch-like ones are on the unit sphere.
REGISTRY: dict[str, Encoder] = {
    "histogram": HistogramEncoder("histogram"),
    "tokens": ProjectionEncoder("tokens", classes=1024),
    "tokens-large": ProjectionEncoder("tokens-large", dim=96, classes=1024),
    "text": ProjectionEncoder("text"),
    "patches-bars": ProjectionEncoder("patches-bars", normalize=True),
    "patches-messages": ProjectionEncoder("patches-messages", normalize=True),
}


def encoder(name: str) -> Encoder:
    if name not in REGISTRY:
        raise ValueError(f"unknown encoder {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name]


#: Formats that each encoder takes, and whether a tokenizer goes with them.
RULES = {"tokens": ("MIDITOK",), "tokens-large": ("MIDITOK",), "text": ("TEXT",), "patches-bars": ("ABC",), "patches-messages": ("MTF", "ABC")}


#: Formats that ask for the notes themselves and not for tokens.
NOTE_FORMATS = ("MTF", "ABC")


def default_format(model: Column) -> Column:
    """The format a model takes if none is named; null for a model that is not known."""
    named = F.create_map(*[F.lit(x) for name, formats in RULES.items() for x in (name, formats[0])])
    return F.try_element_at(named, model)


def requires_notes(input_format: Column) -> Column:
    return F.coalesce(input_format.isin(*NOTE_FORMATS), F.lit(False))


def validate(model: str, input_format: str, tokenizer: str | None, tokenizers: tuple[str, ...]) -> tuple[str, str, str | None]:
    """Check a configuration; a format that names a tokenizer is rewritten. Raises ValueError."""
    if model not in RULES:
        raise ValueError(f"unknown model {model!r}")
    if input_format in tokenizers:
        input_format, tokenizer = "MIDITOK", input_format
    if input_format not in RULES[model]:
        raise ValueError(f"{model} does not take {input_format}")
    if (input_format == "MIDITOK") != (tokenizer is not None):
        raise ValueError("a tokenizer goes with token input, and with that only")
    if tokenizer is not None and tokenizer not in tokenizers:
        raise ValueError(f"unknown tokenizer {tokenizer!r}")
    return model, input_format, tokenizer


def encode(items: DataFrame, name: str, id_col: str = "file_id", codes_col: str = "patches") -> DataFrame:
    """Embed items given as arrays of equally long code arrays: the id and ``embedding``."""
    model = encoder(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ITEMS_AT_ONCE):  # codes of few items at a time become wide integers
                part = batch.slice(first, ITEMS_AT_ONCE)
                column = part.column(1)
                sizes = np.array(pc.fill_null(pc.list_value_length(column), 0))
                patches = column.flatten()  # null items have none
                widths = np.unique(np.array(pc.list_value_length(patches)))
                if len(widths) > 1:
                    raise ValueError("code arrays must be equally long")
                codes = np.array(patches.flatten(), np.int64).reshape(len(patches), -1) if len(patches) else np.zeros((0, 0), np.int64)
                out = model.encode_batch(codes, np.concatenate(([0], np.cumsum(sizes)))).astype(np.float32)
                ends = np.arange(len(out) + 1, dtype=np.int32) * model.dim
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))], names=[id_col, "embedding"])

    rows = items.select(F.col(id_col).alias(id_col), F.col(codes_col).cast("array<array<int>>").alias("codes"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, embedding array<float>")


def content_key(items: DataFrame, model: str, codes_col: str = "patches") -> DataFrame:
    """Add the cache key of every item: the model and a hash of what is really encoded."""
    text = F.to_json(F.col(codes_col))
    return items.withColumns({"model": F.lit(model), "content_hash": F.md5(F.coalesce(text, F.lit("")).cast("binary"))})
