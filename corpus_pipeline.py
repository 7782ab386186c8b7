"""From raw documents to training tokens: five stages, each written as Parquet and read again.

quality_rules      documents that the base check or the learned rules reject go
exact_dedup        of equal texts, the row with the largest doc_id stays
near_dedup         of each near-duplicate component, the smallest doc_id stays
mixing             documents are thinned to the target weights of the labels' domains
bpe                texts become token ids; one row per document with its digests
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drift_atlas.llm import common, exact_dedup, mixing, near_dedup, quality_rules, registry


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is among ``ids``; rows that share an id, or have none, share one fate."""
    chosen = common.materialize(ids.select(F.col("doc_id").alias("kept_id")).distinct(), "stage-ids")
    return common.rows_with_ids(docs, "doc_id", chosen)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good_rows(docs, _labels(spark, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Also of rows that repeat an id and its text one stays; such rows are rare, so only they are compared once more."""
    verdict = common.materialize(exact_dedup.exact_duplicates(docs, keep="largest", digest=False), "exact-verdict")
    kept = _keep(docs, verdict.where("kept"))
    again = verdict.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("repeated_id"))
    again = common.materialize(again, "repeated-ids")
    if again.isEmpty():
        return kept
    once = common.rows_with_ids(kept, "doc_id", again).dropDuplicates(["doc_id", "text"])
    return common.rows_with_ids(kept, "doc_id", again, among=False).unionByName(once)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, near_dedup.near_duplicates(docs).where("kept"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    table, _ = mixing.mix(docs, _labels(spark, sf_dir), F.expr(mixing.LABEL_DOMAIN), mixing.LABEL_TARGETS)
    return _keep(docs, table.where("copies > 0"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return registry.bpe_digests(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: The rules of the first stage and the domains of the fourth are learned, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
