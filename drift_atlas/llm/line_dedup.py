"""Line deduplication on levelled sorted runs of line hashes.

The state is a set of runs: tables of (128-bit line hash, number of documents,
largest document), bucketed and sorted by hash. A batch of documents is brought into
that order once; then it merge-anti-joins every run, and the lines that no run holds
become a run of level 0, so each hash stands in one run only. Lines that a run holds
already go to a table of repeats with the batch's counts. When a level holds
``fanout`` runs they are merged into one run of the next level. A hash is thus
rewritten once per level, and a batch meets a logarithmic number of runs; neither
joins nor merges move the runs, as all tables share buckets and order.

A line's documents are its run's count and its repeats. A document's lines are hashed
in one pass, and what follows moves hashes only: counts are combined before they are
shuffled, so a line that stands in a third of all documents costs one row per task.
The texts are shuffled once, to meet the lines they lose.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drift_atlas.llm import common

MIN_CHARS = 20
MIN_DOCS = 3
#: Arrivals into which a table is dealt by a hash of its ids, and runs of a level that trigger a merge.
BATCHES, FANOUT = 4, 2

_STRIP = common.SPACE_CHARS.encode()
_FOLD = bytes.maketrans(common.UPPER.encode(), common.LOWER.encode())
_RUN = "h1 long, h2 long, docs long, last long"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The stripped, case-folded line, or None if it has too few code points to count."""
    key = line.strip(_STRIP)
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return key.translate(_FOLD)


def line_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _postings(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            owners, hashes, held = [], [], 0
            for k, text in enumerate(batch.column(1)):
                own = {line_hash(key) for line in (text.as_py() or "").encode().split(b"\n") if (key := line_key(line, min_chars)) is not None}
                if own:
                    owners.append((ids[k], len(own)))
                    hashes.extend(own)
                    held += len(own)
                if held >= 50_000:
                    yield _posting_batch(owners, hashes)
                    owners, hashes, held = [], [], 0
            if owners:
                yield _posting_batch(owners, hashes)

    return run


def _posting_batch(owners: list[tuple[int, int]], hashes: list[bytes]) -> pa.RecordBatch:
    pairs = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
    ids = np.repeat(np.array([i for i, _ in owners], np.int64), [n for _, n in owners])
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["id", "h1", "h2"])


def line_postings(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """Each document's distinct line hashes: (id, h1, h2). Rows without an id have none."""
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return known.mapInArrow(_postings(min_chars), "id long, h1 long, h2 long")


class LineRuns:
    """Levelled sorted runs of line statistics below one folder of the shared storage.

    Runs are tables of the session's catalog, because only those keep their buckets; ``drop`` ends them.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout, self.buckets = spark, fanout, common.partitions(spark)
        self.folder = folder or common.new_folder(spark, "line-runs")
        self.levels: list[list[str]] = []
        self.repeats: list[str] = []
        self._name = f"line_run_{uuid.uuid4().hex}"
        self._made = 0

    def _write(self, stats: DataFrame) -> str:
        """Write a run. Its rows come in the partitions of the buckets, so a bucket is one file."""
        name = f"{self._name}_{self._made}"
        self._made += 1
        stats.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            common.remove_folder(self.spark, f"{self.folder}/{name}")

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _new(self, batch: DataFrame) -> DataFrame:
        """Rows of a batch whose hash no run holds: a merge anti-join with run after run."""
        for run in self.runs():
            batch = batch.join(self.spark.table(run).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def add(self, postings: DataFrame) -> DataFrame:
        """Admit a batch: its lines that no run holds become a run and are returned, with their counts in the batch."""
        made = self._write(postings.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("id").alias("last")))
        if self.runs():
            batch, made = made, self._write(self._new(self.spark.table(made)))
            seen = self.spark.table(batch).join(self.spark.table(made).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
            self.repeats.append(self._write(seen))
            self._drop([batch])
        admitted = common.materialize(self.spark.table(made), "fresh-lines")
        self._level(0).append(made)
        self._compact()
        return admitted

    def _level(self, k: int) -> list[str]:
        while len(self.levels) <= k:
            self.levels.append([])
        return self.levels[k]

    def _compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                full, self.levels[k] = self.levels[k], []
                self._level(k + 1).append(self._merge(full))
        if len(self.repeats) >= self.fanout:
            self.repeats = [self._merge(self.repeats)]

    def _merge(self, names: list[str]) -> str:
        """Merge tables into one, two at a time, and drop them."""
        while len(names) > 1:
            made = self._write(_both(self.spark.table(names[0]), self.spark.table(names[1])))
            self._drop(names[:2])
            names = [*names[2:], made]
        return names[0]

    def totals(self) -> DataFrame:
        """All hashes with the number of documents and the largest that holds each: every run with its repeats."""
        out = None
        for run in self.runs():
            stats = self.spark.table(run)
            for name in self.repeats:
                again = self.spark.table(name).select("h1", "h2", F.col("docs").alias("more"), F.col("last").alias("later"))
                stats = stats.join(again.hint("merge"), ["h1", "h2"], "left")
                stats = stats.select("h1", "h2", (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"), F.greatest("last", "later").alias("last"))
            out = stats if out is None else out.unionAll(stats)
        return self.spark.createDataFrame([], _RUN) if out is None else out

    def drop(self) -> None:
        """End all tables."""
        self._drop(self.runs() + self.repeats)
        self.levels, self.repeats = [], []


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of line statistics as one, by a merge of their sorted buckets."""
    b = b.select("h1", "h2", F.col("docs").alias("more"), F.col("last").alias("later"))
    nothing = F.lit(0)
    met = a.join(b.hint("merge"), ["h1", "h2"], "full")
    return met.select("h1", "h2", (F.coalesce("docs", nothing) + F.coalesce("more", nothing)).alias("docs"), F.greatest("last", "later").alias("last"))


def _rewrite(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, gone in zip(batch.column(1), batch.column(2), strict=True):
                text, gone = text.as_py() or "", gone.as_py()
                lines = text.count("\n") + 1
                n_lines.append(lines)
                if gone:
                    lost = {np.array([g["h1"], g["h2"]], np.int64).tobytes() for g in gone}
                    stay = [line for line in text.encode().split(b"\n") if (key := line_key(line, min_chars)) is None or line_hash(key) not in lost]
                    kept.append(b"\n".join(stay).decode())
                    n_dropped.append(lines - len(stay))
                else:
                    kept.append(text)
                    n_dropped.append(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_lines", "n_dropped", "kept_text"])

    return run


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """Every document without the lines that later documents repeat.

    A line's key is the line without white space (U+0020, U+0009-U+000D) at its
    ends, A-Z lowered. Keys of at least ``min_chars`` code points in at least
    ``min_docs`` documents lose all their lines except in the document with the
    largest id that holds them. Null and empty texts are one empty line. Each row
    counts as a document, also where ids repeat; rows with a null id keep all
    their lines and count for none. Further columns are ignored.

    Columns: the id, ``n_lines`` (before), ``n_dropped``, ``kept_text``.
    """
    spark = docs.sparkSession
    folder = common.new_folder(spark, "line-postings")
    postings = line_postings(docs, id_col, text_col, min_chars).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
    postings.write.partitionBy("batch").parquet(folder)
    postings = spark.read.schema("id long, h1 long, h2 long, batch int").parquet(folder)
    runs = LineRuns(spark)
    for batch in range(batches):
        common.discard(runs.add(postings.where(F.col("batch") == batch)))
    frequent = common.materialize(runs.totals().where(F.col("docs") >= min_docs).select("h1", "h2", "last"), "frequent-lines")
    runs.drop()
    lost = postings.join(frequent, ["h1", "h2"]).where("id < last").select("id", "h1", "h2")
    lost = common.materialize(lost, "lost-lines").groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    met = texts.join(lost, "id", "left").select("id", "text", "gone")
    out = met.mapInArrow(_rewrite(min_chars), "id long, n_lines long, n_dropped long, kept_text string")
    return out.withColumnRenamed("id", id_col)

