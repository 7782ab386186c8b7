"""A store of embeddings by content, which outlives plans and sessions.

A key is a model and a hash of what is encoded. The store is a folder of parts; a
part is written aside and becomes visible by one rename of its folder, so a reader
sees a part whole or not at all. Only what no visible part holds is encoded and
added. Two writers that meet the same new content each add it: a key has one value, so readers
take either. ``compact`` writes all parts as one that names those it replaces; readers pass over what a visible
part replaces, and its files go only after a time.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drift_atlas.operators import encoders as enc

_SCHEMA = "model string, content_hash string, embedding array<float>"
#: Seconds that a reader of an older state may go on reading.
KEPT_S = 24 * 3600


class EmbeddingStore:
    """The store below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        place = self._path(f"{self.folder}/{kind}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(place)) if self.fs.exists(place) else []

    def _replaced(self, names: list[str]) -> set[str]:
        gone: set[str] = set()
        for name in names:
            listing = self._path(f"{self.folder}/parts/{name}/_replaces.json")
            if self.fs.exists(listing):
                stream = self.fs.open(listing)
                gone |= set(json.loads(bytes(stream.readAllBytes()).decode()))
                stream.close()
        return gone

    def parts(self) -> list[str]:
        """The parts that count now."""
        names = self._names("parts")
        gone = self._replaced(names)
        return [n for n in names if n not in gone]

    def read(self, model: str | None = None) -> DataFrame:
        """model, content_hash, embedding of every key, once, as the store is when this is called."""
        paths = [f"{self.folder}/parts/{n}" for n in self.parts()]
        rows = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        rows = rows if model is None else rows.where(F.col("model") == model)
        return rows.dropDuplicates(["model", "content_hash"]) if len(paths) > 1 else rows

    def add(self, rows: DataFrame, replaces: list[str] | None = None) -> int:
        """Add rows of the store's columns as one part, or nothing if there are none: how many."""
        aside = f"{self.folder}/aside/{uuid.uuid4().hex}"
        rows.select("model", "content_hash", F.col("embedding").cast(T.ArrayType(T.FloatType())).alias("embedding")).write.option("parquet.bloom.filter.enabled#content_hash", "true").parquet(aside)
        n = self.spark.read.schema(_SCHEMA).parquet(aside).count()
        if n:
            if replaces:
                stream = self.fs.create(self._path(f"{aside}/_replaces.json"), False)
                stream.write(bytearray(json.dumps(replaces).encode()))
                stream.close()
            self.fs.mkdirs(self._path(f"{self.folder}/parts"))
            final = f"{self.folder}/parts/{int(time.time() * 1000):015d}-{uuid.uuid4().hex}"
            if not self.fs.rename(self._path(aside), self._path(final)):
                raise OSError(f"could not publish {final}")
        else:
            self.fs.delete(self._path(aside), True)
        return n

    def compact(self) -> None:
        """One part for all: what readers of the old parts use stays until ``clear``."""
        parts = self.parts()
        if len(parts) > 1:
            self.add(self.read(), parts)

    def clear(self, kept_s: float = KEPT_S) -> list[str]:
        """Delete parts that have been replaced, and what was left aside, for longer than ``kept_s``: what went."""
        now, gone = time.time() * 1000, []
        names = self._names("parts")
        for kind, candidates in (("parts", sorted(self._replaced(names) & set(names))), ("aside", self._names("aside"))):
            newest = max((int(n.split("-")[0]) for n in names), default=0)
            for name in candidates:
                place = self._path(f"{self.folder}/{kind}/{name}")
                since = newest if kind == "parts" else self.fs.getFileStatus(place).getModificationTime()
                if now - since > kept_s * 1000:
                    self.fs.delete(place, True)
                    gone.append(name)
        return gone


def encode_through(items: DataFrame, store: EmbeddingStore, model: str, id_col: str = "file_id", codes_col: str = "patches") -> tuple[DataFrame, int]:
    """The embeddings of all items, and how many contents had to be encoded for them; those are in the store now.

    Items of equal content are encoded once. Only keys of the store are read to find what
    it lacks. A null item has the key of an empty text and an embedding of its own.
    """
    keyed = enc.content_key(items, model, codes_col)
    misses = keyed.join(store.read(model).select("content_hash"), "content_hash", "left_anti").groupBy("content_hash").agg(F.first(codes_col).alias(codes_col))
    made = enc.encode(misses, model, "content_hash", codes_col).select(F.lit(model).alias("model"), "content_hash", "embedding")
    n = store.add(made)
    return keyed.select(id_col, "content_hash").join(store.read(model).select("content_hash", "embedding"), "content_hash").select(id_col, "embedding"), n
