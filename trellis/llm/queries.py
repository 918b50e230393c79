"""The registered query of each corpus operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trellis.llm import decontaminate, license_scan, line_dedup, lm_score, near_dedup, packing, pii, quality, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed lines as ranges `from-to` (to exclusive), and the digest of what is left."""
    rows = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.aggregate("line_runs", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"]).alias("n_removed"),
        F.array_join(F.transform("line_runs", lambda r: F.concat(r["a"].cast("string"), F.lit("-"), r["b"].cast("string"))), ",").alias("removed"),
        F.length("text").cast("long").alias("n_chars_left"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).drop("trust", "distrust")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    joined = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), "contaminated")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_scan.scan(_table(spark, sf_dir, "documents"))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(_table(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(quality.POLICIES["base"].mask)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=2)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.summarize(*pii.find_spans(_table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.size("all").cast("long").alias("n_spans"),
        F.sha2(pii.joined_spans("all", True), 256).alias("base_sha256"), pii.joined_spans("all", False).alias("spans"),
    )


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_decontaminate": op3_decontaminate,
    "op4_packing": op4_packing,
    "op5_license_scan": op5_license_scan,
    "op6_lm_score": op6_lm_score,
    "op7_quality": op7_quality,
    "op8_near_dedup": op8_near_dedup,
    "op9_warc": op9_warc,
    "op10_pii": op10_pii,
}
