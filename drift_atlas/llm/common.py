"""Shared folders, materialised tables and native text normalisation.

Everything that must outlive an executor is written below the folder that the
session names in ``spark.checkpoint.dir``. Only a session without that setting
whose executors are threads of the driver (a test, a notebook) gets a local one.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contracts: the white space that separates words, and ASCII letter case.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


#: Bytes of an Arrow batch that is sent to a Python worker while a table is written.
BATCH_BYTES = 8 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; an error on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="drift-atlas-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call uses."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    This cuts the lineage, so a lost executor costs one stage at most, and it
    gives later joins plain scans as inputs, whose shuffles Spark can split when
    a key is hot.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Python workers get batches of few bytes for as long as this lasts, so long texts do not add up in them."""
    before = spark.conf.get(_BATCH_BYTES, None)
    spark.conf.set(_BATCH_BYTES, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_BYTES) if before is None else spark.conf.set(_BATCH_BYTES, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for table in tables:
        remove_folder(table.sparkSession, table._written_to)


def hadoop_fs(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as Hadoop sees it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, jpath = hadoop_fs(spark, path)
    fs.delete(jpath, True)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, which is what a deployment sizes to its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_case(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def rows_with_ids(rows: DataFrame, id_col: str, ids: DataFrame, among: bool = True) -> DataFrame:
    """Rows whose id is (or is not) in the one column of a written table; null equals null.

    The condition names both sides' own columns, so any column name of ``rows`` is harmless.
    Ids grow with the rows, so they are met by a shuffle at every size and never broadcast.
    """
    ids = ids.hint("merge")
    same = rows[id_col].eqNullSafe(ids[ids.columns[0]])
    return rows.join(ids, same, "left_semi" if among else "left_anti")
