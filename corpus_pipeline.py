"""Documents to a training mix in five stages; each one's result is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import read, write_shared
from lodestone.llm.mixing import mixed
from lodestone.llm.quality import fit_quality, keep_good
from lodestone.llm.secrets import redact
from lodestone.llm.shingles import keep_one
from lodestone.llm.tiling import decontaminate


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents' labels, doesn't reject.

    Null and empty texts get the score of the bias; repeated rows go or stay alike; with labels of one kind only, or
    none, every document scores the share of label 1. An empty table stays empty.
    """
    return keep_good(docs, fit_quality(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by Jaccard similarity 0.8 or more of five-word shingles.

    Candidates are what close SimHash fingerprints (vantage-point trees) or shared min-hash bands bring together.
    Texts without words are copies of each other; rows that repeat a doc_id count once, one of them is kept; rows
    without doc_id are all kept. An empty table stays empty.
    """
    return keep_one(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which tiles cover no benchmark item to 0.8 or more. Null and empty texts stay, as do all with an empty benchmark."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced, and n_chars of the texts as they are now. Null texts stay null."""
    clean = redact(docs)
    changed = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean
    return changed.select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, texts included, with how often the mix takes each: size, source_size, target, copies, taken.

    One row for each document, with 0 copies where the mix takes none; repeated rows count as documents of their own.
    A null text has size 0. An empty table stays empty.
    """
    return mixed(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixture", mixture)]
#: SQL can express neither the fitted classifier nor the fingerprints; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = write_shared(stage(spark, docs, sf_dir))
    return docs
