"""The corpus pipeline: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import held_out, table, written
from strandline.llm.exact_dedup import drop_copies
from strandline.llm.mixing import mixed_documents
from strandline.llm.packing import pack
from strandline.llm.quality import keep_quality
from strandline.llm.shingle_join import Rule, drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking does not reject; a quarter of the labels stays unseen."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 4, 2))
    return keep_quality(docs, labels)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one of the largest id."""
    return drop_copies(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with similarity 0.8, the one of the smallest id."""
    return drop_near_copies(docs, rule=Rule(5, 80, 100))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources flattened until the smallest is read twice; no document is left out."""
    return mixed_documents(docs, repeats=2.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 512 to 8192 tokens with the ids, starts and sizes of the pieces in them."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("best-fit packing", packed)]

#: SQL cannot express the classifier; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
