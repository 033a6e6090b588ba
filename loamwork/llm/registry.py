"""The queries of this subpackage and their SQL, by name, each over its whole tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm import sql
from loamwork.llm.common import read
from loamwork.llm.decontamination import decontaminate
from loamwork.llm.exact_dedup import exact_dedup
from loamwork.llm.hard_negatives import mine
from loamwork.llm.language_id import language_id
from loamwork.llm.mixing import mix
from loamwork.llm.ngram_join import ngram_components
from loamwork.llm.pii import find_pii
from loamwork.llm.quality_classifier import quality_scores
from loamwork.llm.quality_rules import quality_rules
from loamwork.llm.revisits import resolve_revisits
from loamwork.llm.secrets import find_secrets
from loamwork.llm.token_counts import load_vocabulary, token_counts
from loamwork.llm.whitening import whiten

#: Where the public tokenizers' files are; never copied.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), load_vocabulary(str(Path(vocabulary))))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents")).drop("n_links")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read(spark, sf_dir, "documents"))


def page_records(pages: DataFrame) -> DataFrame:
    """Archive records of the raw pages: each is captured once in full and once as a not-modified answer.

    The pages name no captures, so the second is made here: the same address in another spelling, half a thousand steps
    after the first (of every seventh page before it, so that nothing is there yet). The etag is that of the edition
    (the language in the path); some answers have another one, or none.
    """
    two = pages.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("edition", F.md5(F.regexp_extract("url", "//[^/]+/([a-z]+)/", 1)))
    n, again, size = F.col("page_id"), F.col("again") == 1, F.length("html").cast("string")
    bare = F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "^[a-z]+://(www\\.)?", "")
    other = F.concat(F.lit("HTTP://WWW."), bare, F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_medium=feed#again"))
    ts = 2 * n + F.when(again, F.when(n % 7 == 0, -1).otherwise(1_001)).otherwise(0)
    etag = F.when(n % 2 == 0, F.when(again & (n % 6 == 0), "other").otherwise(F.col("edition")))
    headers = F.create_map(F.lit("Date"), ts.cast("string"), F.lit("ETag"), F.col("edition"), F.lit("Content-Length"), F.when(again, "0").otherwise(size))
    return two.select(
        (2 * n + F.col("again")).alias("record_id"), F.when(again, other).otherwise(F.col("url")).alias("url"), ts.alias("ts"), F.when(again, "revisit").otherwise("response").alias("kind"),
        etag.alias("etag"), F.when(~again | (n % 5 > 0), size).alias("last_modified"), headers.alias("headers"),
    )


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(page_records(read(spark, sf_dir, "pages")))
    return out.withColumn("headers", F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "&"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("hit_spans")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 7 get the next label; those whose vec_id is divisible by 100 are anchors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(read(spark, sf_dir, "embeddings").withColumn("label", label), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def queries() -> dict:
    own = [op1_quality_rules, op2_language_id, op3_token_counts, op4_quality_classifier, op5_secrets, op6_ngram_join, op7_pii, op8_mixing, op9_revisits, op10_decontamination, op11_hard_negatives, op12_whitening, op13_exact_dedup]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE)
