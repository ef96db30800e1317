"""A training corpus from `documents`, stage by stage.

Every stage is written as Parquet to the shared folder and read again, so a lost executor costs no more than the stage at work.
A stage judges what its predecessor kept. All but the last return the columns of documents. The tables that a stage makes for itself, and its
predecessor's result, are deleted once its own is written.

Defined results: columns of any names pass through unchanged, n_chars (where there is one) follows the text. A null or empty text is judged by the
quality rules, has no lines, n-grams or passages to drop, and gives no sequences. A null doc_id or source is no reason to drop a row. Repeated rows of one doc_id stay or
go together; of rows that are alike, near duplicates keep the group's lowest doc_id. Very long texts go through whole. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm import decision_list, decontam, jaccard, linededup, packing
from siftspark.llm.shared import dropped, scratch, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no learned rule rejects."""
    return decision_list.drop_rejected(docs, decision_list.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that their site repeats; n_chars follows the text."""
    out = linededup.drop_boilerplate(docs).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the lowest doc_id."""
    return jaccard.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no copy of a benchmark item."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("packing", pack)]
#: Learned rules, alignment scores and BPE ids aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
