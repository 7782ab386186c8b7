"""Size-tiered compaction of immutable Parquet shards under versioned manifests.

Arrivals are written as they come, as small shards, without a shuffle. When a
size tier holds ``fanout`` shards, they are merged into files of about the target
size, again without a shuffle: the scan packs the small shards' bytes into tasks
and each task writes its own file. A file is rewritten about once per tier.

A version is a manifest: a JSON file that lists the shards with their bytes and
rows. It is written aside and then given its number in one step that fails if the
number is taken (a hard link on a local file system, elsewhere Hadoop's rename
without overwriting), so of two writers one wins and the other commits on top of the
winner's version. Object stores whose rename is a copy need a committer of their own.
Readers see a version whole or not at all, and files that a
failed job left behind are in no manifest. All data passes through Spark's own
readers and writers.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drift_atlas.llm import common

TARGET_BYTES = 64 << 20
#: Shards of a tier that trigger a merge, and the bytes below which all shards share the lowest tier.
FANOUT, LEAST_BYTES = 4, 1 << 20
#: Shards of this share of the target or more are finished.
FULL_SHARE = 0.7


class CommitConflict(RuntimeError):
    """Another writer took the version."""


@dataclass(frozen=True)
class Shard:
    path: str  # relative to the store's folder
    bytes: int
    rows: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str  # JSON of the rows' type
    shards: tuple[Shard, ...]


def tier_of(size: int, fanout: int = FANOUT, least: int = LEAST_BYTES) -> int:
    """Shards of one tier differ in size by less than the fanout."""
    return 0 if size < least else 1 + int(math.log(size / least, fanout))


def merge_plan(shards: tuple[Shard, ...], target: int = TARGET_BYTES, fanout: int = FANOUT, least: int = LEAST_BYTES) -> list[list[Shard]]:
    """The groups of similarly sized, unfinished shards that are due."""
    tiers: dict[int, list[Shard]] = {}
    for shard in sorted(shards, key=lambda s: s.path):
        if shard.bytes < FULL_SHARE * target:
            tiers.setdefault(tier_of(shard.bytes, fanout, least), []).append(shard)
    return [group for _, group in sorted(tiers.items()) if len(group) >= fanout]


class ShardStore:
    """A table of immutable shards below one folder of the shared storage."""

    def __init__(self, spark: SparkSession, folder: str, target: int = TARGET_BYTES, fanout: int = FANOUT, least: int = LEAST_BYTES):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.target, self.fanout, self.least = target, fanout, least
        self.fs, _ = common.hadoop_fs(spark, self.folder)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _list(self, name: str) -> list[tuple[str, int]]:
        where = self._path(name)
        if not self.fs.exists(where):
            return []
        return sorted((s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(where) if s.isFile())

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n, _ in self._list("manifests") if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest | None:
        """A version's manifest, by default the newest; None for an empty store."""
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = max(known)
        stream = self.fs.open(self._path(f"manifests/v{version:012d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        data = json.loads(text)
        return Manifest(data["version"], data["schema"], tuple(Shard(**s) for s in data["shards"]))

    def commit(self, base: Manifest | None, schema: str, shards: tuple[Shard, ...]) -> Manifest:
        """Publish the version after ``base``, or raise CommitConflict if it exists."""
        made = Manifest(base.version + 1 if base else 0, schema, shards)
        body = json.dumps({"version": made.version, "schema": schema, "shards": [asdict(s) for s in shards]})
        aside, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/v{made.version:012d}.json")
        stream = self.fs.create(aside, False)
        try:
            stream.write(bytearray(body.encode()))
        finally:
            stream.close()
        try:
            self._publish(aside, final)
        except Py4JJavaError as problem:
            if self.fs.exists(final):
                raise CommitConflict(f"version {made.version} exists") from None
            raise problem
        finally:
            self.fs.delete(aside, False)
        return made

    def _publish(self, aside, final) -> None:
        """Give a finished file its name; an error if the name is taken, also by a writer at the same time."""
        jvm = self.spark._jvm
        if self.fs.getUri().getScheme() == "file":
            local = lambda p: jvm.java.io.File(self.fs.makeQualified(p).toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(final), local(aside))
        else:
            options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri()).rename(aside, final, options)

    def _write(self, rows: DataFrame, **options: int) -> tuple[Shard, ...]:
        """Write rows as new files; they belong to no version yet."""
        name = f"data/{uuid.uuid4().hex}"
        rows.write.options(**options).parquet(f"{self.folder}/{name}")
        files = [(f, size) for f, size in self._list(name) if f.endswith(".parquet")]
        written = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")
        counted = written.groupBy(F.col("_metadata.file_name").alias("f")).count().collect()  # one row a file
        count = {r["f"]: r["count"] for r in counted}
        return tuple(Shard(f"{name}/{f}", size, count.get(f, 0)) for f, size in files if count.get(f, 0))

    def append(self, rows: DataFrame) -> Manifest:
        """Add an arrival as small shards. An empty one makes a version without new shards."""
        shards = self._write(rows)
        schema = rows.schema.json()
        while True:
            base = self.manifest()
            if base is not None and _names(base.schema) != _names(schema):
                raise ValueError("the arrival's columns differ from the store's")
            try:
                return self.commit(base, base.schema if base else schema, (base.shards if base else ()) + shards)
            except CommitConflict:
                continue

    def compact(self) -> Manifest | None:
        """Merge the tiers that are due, all in one job and one version, until none is due."""
        current = self.manifest()
        while current is not None and (plan := merge_plan(current.shards, self.target, self.fanout, self.least)):
            group = [s for tier in plan for s in tier]
            rows = sum(s.rows for s in group)
            source, per_file = None, 1
            for tier in plan:
                tier_rows, tier_size = sum(s.rows for s in tier), sum(s.bytes for s in tier)
                files = max(1, round(tier_size / self.target))
                part = self._scan(current, tier).coalesce(files)
                source = part if source is None else source.unionAll(part)
                per_file = max(per_file, math.ceil(tier_rows / max(files, tier_size / self.target)))
            merged = self._write(source, maxRecordsPerFile=per_file)
            if sum(s.rows for s in merged) != rows:
                raise RuntimeError("a merge must keep every row")
            gone = {s.path for s in group}
            while True:
                if not gone <= {s.path for s in current.shards}:
                    break  # another writer merged some of them; our files stay in no version
                try:
                    current = self.commit(current, current.schema, tuple(s for s in current.shards if s.path not in gone) + merged)
                    break
                except CommitConflict:
                    current = self.manifest()
            if len(merged) >= len(group):
                break  # the rows do not fit into fewer files
        return current

    def _scan(self, manifest: Manifest, shards) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        paths = [f"{self.folder}/{s.path}" for s in shards]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        manifest = self.manifest(version)
        if manifest is None:
            raise ValueError("the store has no version")
        return self._scan(manifest, manifest.shards)

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the newest ``keep`` versions, and the files that only those listed."""
        known = sorted(self.versions())
        live = {s.path for v in known[-keep:] for s in self.manifest(v).shards}
        dead: set[str] = set()
        for v in known[:-keep]:
            dead |= {s.path for s in self.manifest(v).shards} - live
            self.fs.delete(self._path(f"manifests/v{v:012d}.json"), False)
        for path in dead:
            self.fs.delete(self._path(path), False)
        return len(dead)


def _names(schema: str) -> list[tuple[str, str]]:
    return [(f["name"], str(f["type"])) for f in json.loads(schema)["fields"]]


def arrivals(rows: DataFrame, id_col: str, parts: int) -> list[DataFrame]:
    """Deal a table into ranges of its ids, as if it came in order, null ids first; ids that are no integers are dealt by hash."""
    if not isinstance(rows.select(id_col).schema[0].dataType, T.IntegralType):
        place = F.pmod(F.xxhash64(id_col), F.lit(parts))
        return [rows.where(place == k) for k in range(parts)]
    ends = rows.select(F.min(id_col), F.max(id_col)).first()
    if ends[0] is None:
        return [rows]
    width = max(1, -(-(ends[1] - ends[0] + 1) // parts))
    cuts = [ends[0] + width * k for k in range(1, parts)]
    out = []
    for k in range(parts):
        test = F.lit(True)
        if k:
            test = test & (F.col(id_col) >= cuts[k - 1])
        if k < parts - 1:
            test = test & (F.col(id_col) < cuts[k])
        out.append(rows.where(test | F.col(id_col).isNull() if k == 0 else test))
    return out


def shard_table(rows: DataFrame, id_col: str = "doc_id", parts: int = 4, target: int = TARGET_BYTES) -> ShardStore:
    """Append a table in ``parts`` arrivals, compact after each, and drop what no reader needs.

    Rows are kept as they are: nulls, empty and long values, repeats and further
    columns included. An empty table gives a version without shards.
    """
    store = ShardStore(rows.sparkSession, common.new_folder(rows.sparkSession, "shards"), target)
    for arrival in arrivals(rows, id_col, parts):
        store.append(arrival)
        store.compact()
        store.vacuum()
    return store
