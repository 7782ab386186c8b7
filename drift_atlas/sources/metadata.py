"""Readers of genre metadata and token files, as transforms of text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Column names that a metadata table may use.
GENRE_COLUMNS = ("genre", "genres", "genre_tag", "genre_tags", "tag", "tags")
FILE_COLUMNS = ("file", "filename", "file_name", "path", "midi_path", "midi_filename", "location", "fname")


def track_genres(lines: DataFrame) -> DataFrame:
    """Tab-separated (track, genre) lines: comments and short lines skipped, the first genre of a track wins.

    ``lines`` has line_no and value.
    """
    rows = lines.select("line_no", F.trim("value").alias("v")).where((F.col("v") != "") & ~F.col("v").startswith("#"))
    parts = F.split("v", "\t")
    rows = rows.where(F.size(parts) >= 2).select("line_no", F.trim(F.get(parts, F.lit(0))).alias("track_id"), F.trim(F.get(parts, F.lit(1))).alias("genre"))
    return rows.where("track_id <> '' and genre <> ''").groupBy("track_id").agg(F.min_by("genre", "line_no").alias("genre"))


def track_folder(track: Column) -> Column:
    """Folder of a track: its third, fourth and fifth characters, then itself; null for short ids."""
    return F.when(F.length(track) >= 5, F.concat_ws("/", F.substring(track, 3, 1), F.substring(track, 4, 1), F.substring(track, 5, 1), track))


def track_files(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """The first file of every track's folder, .mid before .midi; tracks without a file are left out."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    listed = files.withColumn("folder", folder)
    met = tracks.withColumn("folder", track_folder(F.col("track_id"))).join(listed, "folder")
    order = F.struct(F.when(F.lower("path").endswith(".midi"), 1).otherwise(0), "path")
    return met.groupBy("track_id").agg(F.first("genre").alias("genre"), F.min_by("path", order).alias("path"))


def sample_by_genre(rows: DataFrame, k: int, genres: list[str], seed: str = "g") -> DataFrame:
    """At most k files of every wanted genre, in hash order."""
    wanted = rows.where(F.lower("genre").isin(genres))
    order = Window.partitionBy("genre").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "path").cast("binary")), "path")
    return wanted.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= k).drop("__k")


def json_tags(lines: DataFrame) -> DataFrame:
    """JSON lines to (tag, location): one row per tag; bad lines, empty tags and lines without a location are skipped."""
    get = lambda name: F.get_json_object("value", f"$.{name}")
    raw = F.coalesce(F.nullif(get("genre"), F.lit("")), F.nullif(get("genres"), F.lit("")))
    location = F.coalesce(*[F.nullif(get(n), F.lit("")) for n in ("location", "path", "filename")])
    tags = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    rows = lines.select(F.explode(tags).alias("tag"), location.alias("location")).select(F.trim("tag").alias("tag"), "location")
    return rows.where("tag <> '' and location is not null")


def resolve_paths(locations: DataFrame, files: DataFrame, roots: tuple[str, ...] = ("lmd_full", "midicaps", "midi")) -> DataFrame:
    """The first existing candidate of every location: as given, its base name, its last two parts below a root.

    ``files`` holds paths relative to the data folder.
    """
    parts = F.split("location", "/")
    two = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")
    candidates = F.array(F.col("location"), F.element_at(parts, -1), *[F.when(F.size(parts) >= 2, F.concat(F.lit(f"{r}/"), two)) for r in roots])
    tried = locations.select("location", F.posexplode(candidates).alias("priority", "path")).where("path is not null").distinct()
    return tried.join(files.select("path").distinct(), "path").groupBy("location").agg(F.min_by("path", "priority").alias("path"))


def read_csv_tags(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """CSV with a genre and a file column under any of their usual names: (tag, location); none without a genre column.

    With a listing (``path``) only rows whose file exists stay.
    """
    rows = spark.read.csv(path, header=True)
    pick = lambda names: next((c for c in reversed(rows.columns) if c.lower().strip() in names), None)
    genre, file = pick(GENRE_COLUMNS), pick(FILE_COLUMNS)
    if genre is None or file is None:
        return spark.createDataFrame([], "tag string, location string")
    tags = split_tags(rows.select(F.col(f"`{genre}`").alias("genre"), F.trim(F.col(f"`{file}`")).alias("location")).where("location <> ''"))
    return tags if files is None else existing(tags, files)


def existing(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose location is in the listing."""
    return rows.join(files.select(F.col("path").alias("location")), "location", "left_semi").select(*rows.columns)


def split_tags(rows: DataFrame) -> DataFrame:
    """Tags separated by comma or semicolon, one row each."""
    tags = F.filter(F.transform(F.split(F.replace("genre", F.lit(";"), F.lit(",")), ","), lambda t: F.trim(t)), lambda t: t != "")
    return rows.select(F.explode(tags).alias("tag"), "location")


def read_json_items(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file that is a list of objects, or an object with such a list under data or items."""
    rows = spark.read.option("multiLine", "true").json(path)
    for name in ("data", "items"):
        if name in rows.columns:
            return rows.select(F.inline(name))
    return rows


def folder_genre(path: Column) -> Column:
    """The lower-cased name of the folder a file is in."""
    return F.lower(F.element_at(F.split(path, "/"), -2))


def first_source(*sources: DataFrame) -> DataFrame:
    """The first of several metadata tables that has rows; the last if none has."""
    for rows in sources[:-1]:
        if not rows.isEmpty():
            return rows
    return sources[-1]


def canonical_tags(tags: DataFrame, mapping: DataFrame, genres: list[str]) -> DataFrame:
    """Tags with their canonical genre, where it is wanted. The mapping is a dimension of known size, joined by hash."""
    known = mapping.select(F.col("tag").alias("__tag"), "canonical")
    met = tags.join(known, F.lower(F.trim("tag")) == F.col("__tag")).drop("__tag")
    return met.where(F.col("canonical").isin(genres))


def merge_mapping(base: DataFrame, override: DataFrame) -> DataFrame:
    """A mapping with some entries replaced or added."""
    new = override.select("tag", F.col("canonical").alias("__new"))
    return base.join(new, "tag", "full_outer").select("tag", F.coalesce("__new", "canonical").alias("canonical"))


def parse_tokens(text: Column) -> Column:
    """Token files: a JSON list, a JSON object with a list under tokens, or numbers between blanks or commas; else none."""
    body = F.trim(text)
    plain = F.transform(F.filter(F.split(body, r"[\s,]+"), lambda t: t != ""), lambda t: t.try_cast("int"))
    listed = F.when(body.startswith("["), F.from_json(body, "array<int>")).when(body.startswith("{"), F.from_json(F.get_json_object(body, "$.tokens"), "array<int>")).otherwise(plain)
    return F.when(F.exists(listed, lambda t: t.isNull()), F.array().cast("array<int>")).otherwise(F.coalesce(listed, F.array().cast("array<int>")))


def write_tokens(tokens: DataFrame, path: str) -> None:
    """One JSON object per file: its tokens and its name."""
    tokens.select("tokens", F.col("file_id").cast("string").alias("file")).write.mode("overwrite").json(path)


def load_tokens(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_tokens`` wrote: the file's name and its tokens; a line that is no token list gives none."""
    lines = spark.read.text(path)
    return lines.select(F.get_json_object("value", "$.file").alias("file"), parse_tokens(F.col("value")).alias("tokens"))


def token_statistics(tokens: DataFrame) -> DataFrame:
    """Files, tokens, distinct ids, and the mean, least and greatest length of token lists."""
    sizes = tokens.select(F.size("tokens").cast("long").alias("n"), "tokens")
    ids = tokens.select(F.explode("tokens").alias("t")).agg(F.count_distinct("t").alias("n_distinct"))
    counts = sizes.agg(F.count("*").alias("n_files"), F.sum("n").alias("n_tokens"), F.avg("n").alias("mean_length"), F.min("n").alias("least"), F.max("n").alias("most"))
    return counts.join(F.broadcast(ids))  # one row each


def write_statistics(stats: DataFrame, path: str) -> None:
    """A small table of statistics as one JSON file."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_results`` wrote, with its types found anew and its partition as a column."""
    return spark.read.option("header", "true").option("inferSchema", "true").csv(path)


def write_results(rows: DataFrame, path: str, partition: str = "configuration") -> None:
    """CSV by partition; only the partitions at hand are replaced, so each finished one is a checkpoint."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", "true").partitionBy(partition).csv(path)
