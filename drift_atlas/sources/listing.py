"""File listings and what follows from them: validation, sampling, copying plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MIDI_PATTERN = r"(?i)\.midi?$"


def list_files(spark: SparkSession, folder: str, pattern: str = "*.mid*") -> DataFrame:
    """path and size of a folder's files at any depth; an absent folder has none. Contents are not read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string, size_bytes long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("size_bytes"))


def ordered_listing(files: DataFrame, limit: int | None = None, by_suffix: bool = False) -> DataFrame:
    """By path, or by suffix and then path (.mid before .midi); the first ``limit`` if given."""
    suffix = F.when(F.lower("path").endswith(".midi"), 1).otherwise(0)
    out = files.orderBy(*([suffix] if by_suffix else []), "path")
    return out if limit is None else out.limit(limit)


def is_valid(path: Column, size: Column, pattern: str = MIDI_PATTERN) -> Column:
    return F.coalesce(path.rlike(pattern) & (size > 0), F.lit(False))


def file_statistics(files: DataFrame, pattern: str = MIDI_PATTERN) -> DataFrame:
    """path, size_bytes and validity of every listed file."""
    return files.select("path", "size_bytes", is_valid(F.col("path"), F.col("size_bytes"), pattern).alias("valid"))


def dataset_path(root: str, name: str, processed: bool = False) -> str:
    return f"{root.rstrip('/')}/{'processed' if processed else 'raw'}/{name}"


def dataset_info(datasets: DataFrame, name: str) -> DataFrame:
    """The row of a dataset, by its name in any case; ValueError if there is none."""
    found = datasets.where(F.lower("name") == name.lower())
    if found.isEmpty():
        raise ValueError(f"unknown dataset {name!r}")
    return found


def copy_plan(files: DataFrame, present: DataFrame, tie: str = "size_bytes") -> DataFrame:
    """Files to copy: those whose name and size are not there yet; a name taken twice gets a hash of its path in front.

    Of files with one path, the one with the smallest ``tie`` comes first, and of equal ones the smallest file.
    """
    name = F.element_at(F.split("path", "/"), -1)
    named = files.withColumn("name", name)
    twin = F.row_number().over(Window.partitionBy("dataset", "name").orderBy("path", tie, "size_bytes")) > 1
    target = F.when(twin, F.concat(F.substring(F.md5(F.col("path").cast("binary")), 1, 8), F.lit("_"), F.col("name"))).otherwise(F.col("name"))
    planned = named.withColumn("target", target)
    return planned.join(present.select("dataset", F.col("name").alias("target"), "size_bytes"), ["dataset", "target", "size_bytes"], "left_anti")


def datasets_named(datasets: DataFrame, asked: DataFrame) -> DataFrame:
    """Information on the datasets whose names are asked for, whatever their case. Asked names are few."""
    wanted = asked.select(F.lower("name").alias("__asked")).distinct()
    return datasets.join(F.broadcast(wanted), F.lower("name") == F.col("__asked")).drop("__asked")
