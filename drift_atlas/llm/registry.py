"""The corpus queries, each over its whole table with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drift_atlas.llm import band_join, bpe, common, conversation_repair, exact_dedup, html_extract, language_id, license_scan, line_dedup, mixing, near_dedup, quality_rules, sharding, statements, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from the compacted, committed shards."""
    rows = sharding.shard_table(_table(spark, sf_dir, "documents")).read()
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "lang", "source", "n_chars", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract_text(_table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from three quarters of the documents."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    train = docs.where(~held_out & F.col("lang").isNotNull())
    model = language_id.train(train)
    out = language_id.predict(docs, model, reject_below=0.0)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back through the index."""
    folder = common.new_folder(spark, "warc")
    index = warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc.read_records(index, folder).drop("payload")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of whole texts; the smallest doc_id of each stays."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that occur in three documents or more stay in the largest doc_id only."""
    out = line_dedup.deduplicate_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of whole texts; the largest doc_id of a group stays."""
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"), keep="largest")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base check and learned verdict of every document."""
    return quality_rules.apply_quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents, above 1 where a domain is scarce, that bring the labels' domains to their target weights."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return mixing.mix(docs, labels, F.expr(mixing.LABEL_DOMAIN), mixing.LABEL_TARGETS, max_rate=float("inf"))[0]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again, as digests."""
    return bpe_digests(_table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    path = tokenizer_path()
    out = bpe.decode(bpe.encode(docs, path), path)
    return out.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by a hash of its keys, with its faults, cheapest edits and repaired text."""
    out = conversation_repair.repair_conversations(conversation_repair.damage(_table(spark, sf_dir, "conversations")))
    text = F.concat_ws("\n", F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])))
    return out.withColumn("repaired_sha256", F.sha2(text, 256)).drop("repaired")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of licence phrases and licences of every whole text."""
    return license_scan.scan_licences(_table(spark, sf_dir, "documents")).drop("spans")


def op13_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's nearest ten sale lines of other items, with sums over all lines near its price."""
    return band_join.near_prices(_table(spark, sf_dir, "sale_lines"), _table(spark, sf_dir, "items"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_LOWER_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SPACE_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_OP1_SQL = """
SELECT doc_id, lang, source, n_chars, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

# DuckDB has no base32: each group of five bits of the digest is looked up in its alphabet.
_OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS sha1 FROM p),
b AS (SELECT *, array_to_string(list_transform(range(40), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
             4 * (strpos('0123456789abcdef', substr(sha1, CAST(i + 1 AS INTEGER), 1)) - 1) + 1, 4)), '') AS bits FROM h),
d AS (SELECT page_id, payload_bytes, sha1,
             array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + CAST(substr(bits, CAST(5 * i + 1 AS INTEGER), 1) AS INTEGER) * 16 + CAST(substr(bits, CAST(5 * i + 2 AS INTEGER), 1) AS INTEGER) * 8
                 + CAST(substr(bits, CAST(5 * i + 3 AS INTEGER), 1) AS INTEGER) * 4 + CAST(substr(bits, CAST(5 * i + 4 AS INTEGER), 1) AS INTEGER) * 2
                 + CAST(substr(bits, CAST(5 * i + 5 AS INTEGER), 1) AS INTEGER), 1)), '') AS payload_digest,
             min(page_id) OVER (PARTITION BY sha1) AS first
      FROM b)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""

_OP3_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT doc_id, line, i,
             translate(trim(line, {_SPACE_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE f.last > k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE f.last IS NULL OR f.last = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key
GROUP BY k.doc_id
"""

_OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_LOWER_AZ} AS norm FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""


def queries() -> dict[str, Query]:
    return {"op1_sharding": op1_sharding, "op2_minhash_near_dedup": op2_minhash_near_dedup, "op3_line_dedup": op3_line_dedup, "op4_exact_dedup": op4_exact_dedup, "op5_html_extraction": op5_html_extraction, "op6_language_id": op6_language_id, "op7_warc": op7_warc, "op8_quality_rules": op8_quality_rules, "op9_mixing": op9_mixing, "op10_bpe": op10_bpe, "op11_conversation_repair": op11_conversation_repair, "op12_license_scan": op12_license_scan, "op13_band_join": op13_band_join, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": _OP1_SQL, "op3_line_dedup": _OP3_SQL, "op4_exact_dedup": _OP4_SQL, "op7_warc": _OP7_SQL, "op11_conversation_repair": statements.OP11, "op13_band_join": statements.OP13}
