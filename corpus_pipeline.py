"""A corpus pipeline of five of the training-data operators, each stage over all that the one before kept.

All stages but the last return the columns of ``documents`` and no others; extra columns go at the first stage, whatever their
names. Repeated rows stay or go together. A null doc_id can't be matched by id, so its row passes the near-duplicate and
decontamination stages. An empty table gives an empty result with the columns of the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import materialize, sized, table
from brindle.llm.decontaminate import decontaminate
from brindle.llm.jaccard_join import ngram_jaccard_join
from brindle.llm.line_dedup import line_dedup
from brindle.llm.packing import pack
from brindle.llm.quality import keep_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and wordless texts fail the base rules; a null lang is judged by script."""
    return keep_documents(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut; a document that loses every word goes. n_chars follows the text. The
    copy of the smallest (doc_id, position) stays, a null id first; texts of any length are taken whole."""
    out = line_dedup(docs).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, Jaccard 0.8) the document with the smallest id stays, so
    ties can't arise; texts that share an id are judged as documents of their own, and the id goes if one of them does."""
    gone = sized(ngram_jaccard_join(docs, width=5, percent=80).filter("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null items are skipped, and with an empty benchmark all stay."""
    found = sized(decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences; equal lengths are ordered by (doc_id, piece)."""
    return pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontamination), ("best_fit_packing", packing)]

#: SQL can't express the tokeniser, the components or the packing; tests/llm hold brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
