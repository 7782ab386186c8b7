"""A sink for files of any kind that shows all of a job's files or none.

``write.format("committed-files")`` takes rows of (name, content), or of (name, source)
to copy files. Each attempt of a task stages its files in a folder of its own below
the target; what a commit message names is moved to its place when all tasks are
done, and the staging folder goes. If the job fails, the staging folder goes and the
target is as it was; an attempt that was lost or ran twice leaves nothing. A
file that fails does not stop the others: it is counted and named.

Commit messages hold the counters and the names of a task's files, which the driver
moves one by one, as a file's name is its identity here; a table of very many small
files should be a Parquet table instead.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Names of failed files that a report lists.
LISTED = 1000
_REPORTS, _CHUNK = "_reports", 4 << 20


def _fs(uri: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri)


@dataclass
class _Message(WriterCommitMessage):
    folder: str = ""
    names: list[str] = field(default_factory=list)
    size: int = 0
    failed: list[tuple[str, str]] = field(default_factory=list)


def _checked(name: str | None) -> str:
    """A name that stays below the target and out of the sink's own folders."""
    if not name or name.startswith(("/", "_")) or posixpath.normpath(name) != name or name.startswith(".."):
        raise ValueError("not a name below the target")
    return name


class _Writer(DataSourceWriter):
    def __init__(self, path: str, run: str, columns: list[str]):
        self.path, self.run, self.columns = path.rstrip("/"), run, columns

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        fs, base = _fs(self.path)
        out = _Message(folder=f"_staging-{self.run}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}")
        seen: set[str] = set()
        for row in iterator:
            name = row["name"]
            try:
                if name in seen:
                    raise ValueError("a second file of this name")
                place = f"{base}/{out.folder}/{_checked(name)}"
                fs.create_dir(posixpath.dirname(place), recursive=True)
                with fs.open_output_stream(place) as sink:
                    out.size += self._fill(sink, row)
                out.names.append(name)
                seen.add(name)
            except (OSError, ValueError, TypeError) as problem:
                out.failed.append((str(name), type(problem).__name__))
        return out

    def _fill(self, sink, row) -> int:
        if "content" in self.columns:
            if row["content"] is None:
                raise ValueError("no content")
            data = bytes(row["content"])
            sink.write(data)
            return len(data)
        fs, source = _fs(row["source"])
        size = 0
        with fs.open_input_stream(source) as file:
            while piece := file.read(_CHUNK):
                sink.write(piece)
                size += len(piece)
        return size

    def commit(self, messages: list) -> None:
        fs, base = _fs(self.path)
        done = [m for m in messages if m is not None]
        for m in done:
            for name in m.names:
                fs.create_dir(posixpath.dirname(f"{base}/{name}"), recursive=True)
                fs.move(f"{base}/{m.folder}/{name}", f"{base}/{name}")
        failed = sorted(f for m in done for f in m.failed)
        report = {"run": self.run, "files": sum(len(m.names) for m in done), "bytes": sum(m.size for m in done), "failed": len(failed), "failed_files": [{"name": n, "problem": p} for n, p in failed[:LISTED]]}
        fs.create_dir(f"{base}/{_REPORTS}", recursive=True)
        with fs.open_output_stream(f"{base}/{_REPORTS}/{self.run}.json") as sink:
            sink.write(json.dumps(report).encode())
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        import pyarrow.fs as pafs

        fs, base = _fs(self.path)
        if fs.get_file_info(f"{base}/_staging-{self.run}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{base}/_staging-{self.run}")


class CommittedFiles(DataSource):
    """The sink's registration; options ``path`` and ``run``, a name that no other job uses."""

    @classmethod
    def name(cls) -> str:
        return "committed-files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options["run"], schema.fieldNames())


def _save(rows: DataFrame, folder: str) -> dict:
    spark, run = rows.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(CommittedFiles)
    rows.repartition("name").write.format("committed-files").mode("append").option("path", folder).option("run", run).save()
    fs, base = _fs(folder)
    with fs.open_input_stream(f"{base.rstrip('/')}/{_REPORTS}/{run}.json") as file:
        return json.loads(file.read())


def save_files(rows: DataFrame, folder: str) -> dict:
    """Write (name, content) rows below a folder that all workers share: the report with files, bytes, failed, failed_files.

    Names are relative to the folder. Files of equal names replace those of earlier jobs; of two
    in one job the second fails, as do null names and contents and names that lead elsewhere.
    """
    return _save(rows.select("name", "content"), folder)


def copy_files(plan: DataFrame, folder: str) -> dict:
    """Copy files by a plan of (source, name), piece by piece, with the same report; a source that can't be read fails alone."""
    return _save(plan.select("name", "source"), folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The visible files below a folder: name, content. Spark's reader passes over empty files, and over the sink's own folders, whose names begin with an underscore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    prefix = folder.split("://", 1)[-1].rstrip("/") + "/"
    return files.select(F.substring_index("path", prefix, -1).alias("name"), "content")
