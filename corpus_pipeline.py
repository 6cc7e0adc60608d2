"""Corpus pipeline: quality rules, line de-duplication, SimHash near-de-duplication, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all documents that its
predecessor kept and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes each stage's result and reads it again as the
next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import decontaminate, line_dedup, mixing, quality, simhash
from ticketlens.llm.common import Scratch, WORD


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep; the others go."""
    return quality.judge(docs).where("kept").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs cut out; a document of which no word is left goes.

    A document from which nothing was cut stays as it is; ``n_chars`` follows the text.
    """
    out = line_dedup.dedup_lines(docs)
    out = out.where((F.col("n_deleted") == 0) | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id."""
    return simhash.keep_one(docs, shingle=3, radius=3)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it (0: not drawn)."""
    return mixing.mix(docs, mixing.word_count(docs["text"]), mixing.quality_weight(docs["text"]))


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("simhash", dedup_near),
          ("decontamination", decontaminate_benchmark), ("mixing", mix_sources)]

#: SQL can't express the fitted rules, suffix ranks, SimHash or tiling; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
