"""The operators with production parameters, one query each, over the tables of a data folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, quality_fm, toxicity
from .common import scratch, table
from .decontaminate import find_items
from .filter_audit import audit
from .line_dedup import report
from .packing import pack, pieces
from .quality_rules import quality_rules
from .simhash import groups
from .token_counts import count_tokens
from .url_filter import judge
from .warc import read_warc, with_revisits, write_warc
from .whitening import whiten


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


#: (host, path, verdict)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _scored(how, spark: SparkSession, sf_dir: str, label: str, folds: int, fold: int) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), quality_fm.held_out("doc_id", folds, fold)
    fitted = how.fit(docs, table(spark, sf_dir, "labels"), label=label, keep=~out)
    return how.score(docs, fitted).select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(quality_fm, spark, sf_dir, "quality", 5, 0)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_warc(with_revisits(table(spark, sf_dir, "pages")), scratch(spark, "warc"))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(.*)>', 1) as long)")
    return read_warc(spark, files).select(number("record_id").alias("page_id"), F.col("content_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(toxicity, spark, sf_dir, "toxic", 4, 2)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).drop("fp")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_url_filter, op3_line_dedup, op4_quality_rules, op5_decontamination, op6_quality_fm, op7_warc, op8_best_two_fit, op9_toxicity, op10_simhash, op11_whitening, op12_filter_audit, op13_exact_dedup)}
