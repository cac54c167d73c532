"""The training-text pipeline: language, repeated lines, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last give the columns of `documents`. Each stage calls one operator of fieldloom.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import decontamination, langid, line_dedup, near_dup
from fieldloom.llm.common import DOCUMENT_COLUMNS, table, written
from fieldloom.llm.packing import pack
from fieldloom.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language go on, labelled with the one found where they had no label; others go.

    A score of 0 means that no trigram is of any language, so what lang_pred names then is only the first of them.
    """
    found = langid.identify(docs, langid.learn(docs), carry=("text", "lang", "source", "n_chars"))
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") > 0)).withColumn("lang", F.coalesce("lang", "lang_pred"))
    return found.select(*DOCUMENT_COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that another document keeps; a document of which nothing is left goes."""
    kept = line_dedup.dedup_lines(docs, carry=("lang", "source"))
    kept = kept.where((F.col("n_dropped") == 0) | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays. Rows with one doc_id are one document, the row of the largest text stays; rows
    with a null doc_id can be no one's copy and all stay."""
    kept = near_dup.near_duplicates(docs).where("kept").select("doc_id")
    rows = F.max_by(F.struct(*DOCUMENT_COLUMNS), near_dup.text_rank("text")).alias("row")
    known = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(rows).select("row.*")
    return known.unionByName(docs.where(F.col("doc_id").isNull()).select(*DOCUMENT_COLUMNS))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"), carry=("lang", "source", "n_chars"))
    return found.where(~F.col("contaminated")).select(*DOCUMENT_COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())


STAGES = [
    ("language ID", language_id),
    ("line dedup", lines),
    ("near dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("packing", packing),
]

#: None of the stages but the second can be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
