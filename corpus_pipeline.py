"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents; the
last returns a row for each document of the mix with its token counts and digests.

Null and empty texts fail the quality rules and go there, very long ones are worked on whole. Rows that repeat an id stay
documents of their own as long as their texts differ; of equal rows near-dedup keeps those of the one document. Null ids, languages and
sources are kept as they are; rows without an id are never near duplicates. Other columns, whatever their names, pass through all stages but
the last. An empty table gives an empty result. A stage's tables are deleted when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candela.llm import bpe, host_rules, line_dedup, mixing, near_dup
from candela.llm.common import discard, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go."""
    return host_rules.keep_good(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut from the texts; documents left without words go."""
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: five words, similarity 0.8 or more."""
    return near_dup.without_near_duplicates(docs, how=near_dup.Similar(width=5, percent=80))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the number of tokens, and SHA-256 of the ids and of the decoded bytes."""
    return bpe.digest(docs.select("doc_id", "lang", "source", "text"), bpe.public_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("near-dedup", near_duplicates),
    ("mixing", source_mix),
    ("byte-level BPE", tokens),
]

#: Random rounding and tokenising have no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before = docs
        with scratch(spark) as keep:
            docs = keep(stage(spark, before, sf_dir))
        if before is not given:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
