"""Operator 13: exact duplicates by combining in three steps: locally, by salt, globally. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import materialize

#: Salts of a hot digest: that many tasks merge what the map tasks send of it.
SALTS = 32
#: A digest is hot from this part of all rows on, so that there are at most HOT_PARTS hot digests.
HOT_PARTS = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(docs: DataFrame) -> DataFrame:
    """doc_id, text (A-Z lower-cased, null: empty) and sha (its SHA-256, 32 bytes) of each row."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumn("sha", F.unhex(F.sha2(F.col("text"), 256)))


def text_groups(rows: DataFrame, hot: DataFrame, salts: int = SALTS) -> DataFrame:
    """digest, n_texts, keep_id, group_size: one row a digest of rows (doc_id, text, digest).

    First each map task merges its rows of equal text (the partial aggregate). Of a hot digest the tasks' winners meet
    by salt, of any other at once, and are merged by their whole texts. Last the salts' winners of a hot digest are
    merged, again by text; the others are whole by then and leave their text behind. n_texts tells how many different
    texts share the digest; keep_id and group_size are those of the only one.
    """
    salted = rows.join(F.broadcast(hot.select("digest", F.lit(True).alias("is_hot"))), "digest", "left")
    salted = salted.withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(F.lit(0)))
    merged = salted.groupBy("digest", "is_hot", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winners = merged.select("digest", F.when(F.col("is_hot"), F.col("text")).alias("hot_text"), "keep_id", "group_size").repartition("digest")
    texts = F.when(F.col("hot_text").isNull(), F.count(F.lit(1))).otherwise(F.lit(1))
    whole = winners.groupBy("digest", "hot_text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), texts.alias("n"))
    return whole.groupBy("digest").agg(F.sum("n").alias("n_texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, salts: int = SALTS, hot_parts: int = HOT_PARTS, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs, whether it stays or not.

    Rows are equal when their whole texts are, but for the case of A-Z; of equal ones the row with the largest doc_id
    stays. Texts are read twice and shuffled once, and of copies only one from each map task; everything else is
    ids and digests. Digests only bring rows together: groups are made by whole texts, and a digest that different
    texts share is told (n_texts) and its rows are grouped by text alone.

    Hot digests (those of a thousandth of all rows or more, so at most a thousand) are salted where texts are merged,
    and broadcast where rows get their group; the rest is joined by digest. So no key of any size is one task.

    A null text counts as empty, and empty texts are equal; a null doc_id gives way to any other, and keep_id is null
    only where all are; of rows that share the largest doc_id too, one stays; very long texts are compared whole; an
    empty table gives no rows; other columns are ignored. `digest` makes the digest from the SHA-256 and is there for
    tests of collisions.
    """
    key = digest or (lambda sha: sha)
    narrow = materialize(normalised(docs).select("doc_id", "sha", key(F.col("sha")).alias("digest"), F.monotonically_increasing_id().alias("row_id")))
    newest = F.coalesce(F.max_by("row_id", "doc_id"), F.max("row_id")).alias("keep_row")
    counted = materialize(narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows"), newest))
    least = max(2, -(-narrow.count() // hot_parts))
    hot = counted.filter(F.col("n_rows") >= least).select("digest")  # at most hot_parts rows

    rows = normalised(docs).select("doc_id", "text", key(F.col("sha")).alias("digest"))
    groups = materialize(text_groups(rows, hot, salts).join(counted, "digest"))
    single = groups.filter("n_texts = 1").select("digest", "keep_id", "group_size", "keep_row", (F.col("n_rows") >= least).alias("is_hot"))
    placed = narrow.join(F.broadcast(single.filter("is_hot")), "digest").unionByName(
        narrow.join(F.broadcast(hot), "digest", "left_anti").join(single.filter("not is_hot"), "digest")
    )
    out = placed.select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    shared = groups.filter("n_texts > 1").select("digest")
    return out if shared.isEmpty() else out.unionByName(_by_text(docs, shared, key))


def _by_text(docs: DataFrame, shared: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """The same rows for the digests that different texts share, grouped by text alone."""
    rows = normalised(docs).withColumn("digest", key(F.col("sha"))).join(shared, "digest", "left_semi")
    rows = materialize(rows.select("doc_id", "text", "sha", F.monotonically_increasing_id().alias("row_id")))
    newest = F.coalesce(F.max_by("row_id", "doc_id"), F.max("row_id")).alias("keep_row")
    groups = rows.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), newest)
    return rows.join(groups, "text").select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
