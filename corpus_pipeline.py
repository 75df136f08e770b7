"""The corpus pipeline: documents to a training mix, each stage written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import documents, finished, stored
from recollect.llm.decontam import clean
from recollect.llm.lines import dedup_texts
from recollect.llm.mixing import label_weights, mix
from recollect.llm.nearcopies import one_of_each
from recollect.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Null and empty texts score the share of good labels; repeated rows are
    scored each. In every stage extra columns stay whatever their names, and a long text is one row like others."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its lines that one with a smaller doc_id has too; n_chars follows the text. A null text stays
    null, rows that repeat a doc_id are one document, and a null doc_id owns no line."""
    return dedup_texts(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row, as it came: of the smallest doc_id, of several such rows one by the hash of its
    text. Near copies meet by op1's fingerprints (pivot tables in block buckets) and by min-hash bands, and are verified by a
    five-word Jaccard of 0.8. Rows that repeat a doc_id with unlike texts are in groups of their own; a row without doc_id
    is dropped only with a group that has one. Null and blank texts are one group."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document; a null source is a source, and equal keys go by doc_id."""
    weights = label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mix(docs, weights).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("quality", quality), ("lines", lines), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixture", mixture)]

#: The classifier, the fingerprints and the benchmark search have no SQL form; tests hold the stages against plain ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        finished(before)
    return docs
