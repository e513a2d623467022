"""The registered ``opN_*`` queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, language_model, line_dedup, near_dedup, packing, quality, secrets, suffix_dedup, warc
from .common import cut, read, remove_shared, shared_dir
from .oracles import ORACLES


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(read(spark, sf_dir, "documents")))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(read(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, folder = language_model.train_and_score(read(spark, sf_dir, "documents"))
    out = cut(scores)
    remove_shared(spark, folder)
    return out


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = warc.write_archives(read(spark, sf_dir, "pages"), folder)
    records = warc.read_archives(files)
    history = warc.merge_index(files, folder)
    where = history.groupBy(F.col("task").alias("t"), F.col("page_id").alias("p"), F.col("digest").alias("d")).agg(F.min(F.struct("number", "url_key", "timestamp")).alias("h"))
    same = (F.col("task") == F.col("t")) & F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    # the merge reads a table of a few ranges, which hides the size of its result from the planner: never broadcast it
    out = cut(records.join(where.hint("merge"), same, "left").select(*columns, "h.url_key", "h.timestamp", F.col("h.number").alias("capture_number")))
    remove_shared(spark, folder)
    return out


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_secret_scan, op3_near_dedup, op4_suffix_dedup, op5_html_text, op6_decontaminate, op7_language_model, op8_warc, op9_line_dedup, op10_packing)}


def oracles() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
