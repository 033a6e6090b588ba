"""The corpus pipeline: language ID, near duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each stage's result as Parquet in the shared
folder and reads it again as the next stage's documents; a stage's own intermediate tables, and what it has read, are
deleted then. All but the last return the columns of documents.

Every stage takes texts of any length, whole, rows that repeat or share an id, rows without one, empty tables, and
further columns whatever their names. What becomes of null and empty texts, and of ties, its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamwork.llm.common import delete, last_written, read, released
from loamwork.llm.decontamination import keep_clean
from loamwork.llm.language_id import keep_accepted, train
from loamwork.llm.mixing import mix
from loamwork.llm.ngram_join import keep_first
from loamwork.llm.pii import redact


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a wide enough margin stay. Null texts and those without a letter go, as their
    language can't be told; all stay where no document has a language to learn from. A tie has no margin: it goes."""
    return keep_accepted(docs, train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of linked documents stays. Texts without words stay; rows with
    one id are judged by their texts; rows without an id give way to those with one."""
    return keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go. Null and empty texts stay; an empty benchmark takes
    nothing away."""
    return keep_clean(docs, read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in their texts becomes its kind in brackets. Null texts stay null; overlapping
    spans become one, of the first's kind. n_chars stays the original's."""
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of each document. A null text has size 0; a null source is a source,
    the last; quotients that are equal go by the source's order."""
    return mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]

#: The classifier's compressed sizes and the links can't be told in SQL: tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with released(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir))
        if before is not None:
            delete(spark, before)
        before = last_written()
    return docs
