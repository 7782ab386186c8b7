"""From note tables to the embeddings of every perturbation, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drift_atlas.operators import encoders as enc
from drift_atlas.operators import notes as note_ops
from drift_atlas.operators import rendering as rd
from drift_atlas.operators import study
from drift_atlas.sources.staging import staged

#: Perturbed notes of a task, about.
NOTES_OF_A_TASK = 100_000


def from_midi(parsed: DataFrame) -> DataFrame:
    """Notes as the MIDI readers give them, as a note table; a file is known by its path."""
    note = F.col("track_idx").cast("long") * F.lit(1 << 32) + F.col("note_idx")
    return parsed.select(F.col("path").alias("file_id"), note.alias("note_id"), F.col("track_idx").cast("string").alias("track"), "is_drum", F.col("pitch").cast("long").alias("pitch"), F.col("velocity").cast("long").alias("velocity"), "start_s", "end_s")


def patch_items(texts: DataFrame, size: int) -> DataFrame:
    """The bar patches of every text as one array, ready for an encoder; a text has a bounded number of them."""
    rows = rd.abc_patches(texts, size)
    return rows.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("patch_idx", "codes"))), lambda p: p["codes"]).alias("patches"))


def token_items(notes: DataFrame, tempos: DataFrame, kind: str, longest: int = 512) -> DataFrame:
    rows = rd.tokenize(notes, tempos, kind)
    return rows.select("file_id", F.transform(F.slice("tokens", 1, longest), lambda t: F.array(t)).alias("patches"))


def perturbed_embeddings(notes: DataFrame, tempos: DataFrame, beats: DataFrame, configurations: dict[str, tuple[str, str | None]], size: int = 64) -> DataFrame:
    """Embeddings of every file under every perturbation and configuration: configuration, perturbation, file_id, embedding.

    A configuration is an encoder and, for one that takes tokens, a tokenizer; without
    a tokenizer its input are the patches of the ABC text. All perturbations of a note
    are made in the same pass, and staged: every configuration reads them several times, and a plan
    that repeats what makes them is too large for a driver. They are dealt by file
    and perturbation to tasks that grow with their count, and rendered there.
    """
    versions = staged(note_ops.perturb(notes, tempos, beats), "versions")
    tasks = max(notes.sparkSession.sparkContext.defaultParallelism, -(-versions.count() // NOTES_OF_A_TASK))
    names = versions.select("perturbation", "file_id").distinct()
    key = F.to_json(F.struct("perturbation", "file_id"))
    keyed = versions.withColumn("file_id", key).drop("perturbation").repartition(tasks, "file_id")
    speeds = names.join(tempos, "file_id").select(key.alias("file_id"), "tempo_bpm")
    kind = notes.schema["file_id"].dataType.simpleString()
    out = None
    for configuration, (model, tokenizer) in configurations.items():
        items = token_items(keyed, speeds, tokenizer) if tokenizer else patch_items(rd.abc_text(keyed, speeds), size)
        made = enc.encode(items, model).select(F.lit(configuration).alias("configuration"), F.from_json("file_id", f"perturbation string, file_id {kind}").alias("k"), F.col("embedding").cast("array<double>").alias("embedding"))
        out = made if out is None else out.unionByName(made)
    return out.select("configuration", "k.perturbation", "k.file_id", "embedding")


def perturbation_study(embeddings: DataFrame, datasets: DataFrame, original: str, floor_reps: int, boot_reps: int, perm_reps: int) -> DataFrame:
    """The study of ``study.sensitivity`` for every perturbation of every dataset under every configuration.

    ``datasets`` has file_id, set_id and a long row_id. The embeddings are staged, since the study reads them often.
    """
    rows = staged(embeddings.join(datasets, "file_id").select("configuration", "perturbation", "set_id", "row_id", "embedding"), "embeddings")
    before = rows.where(F.col("perturbation") == original).drop("perturbation")
    return study.sensitivity(before, rows.where(F.col("perturbation") != original), floor_reps, boot_reps, perm_reps)
