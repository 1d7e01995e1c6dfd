"""A corpus pipeline: language identification, quality rules, near-duplicates, packing.

Every stage reads what its predecessor kept. The filtering stages return
their documents with all columns as they were; packing returns the places of
the documents that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from penstrata.llm import language, packing, quality, simhash
from penstrata.llm.common import dropped, new_folder, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents without a language go (null texts, texts without a letter or without an n-gram of any learned language)."""
    return language.identified(docs, language.learn(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the base rules or the robust outlier test reject go."""
    return quality.passed(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group of linked fingerprints stays."""
    return simhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: bucket, batch and slot of every document."""
    return packing.packed(docs)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("packing", pack)]
#: A model is learned in two of the stages, which SQL cannot express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread by the next.

    What a stage wrote for itself, and what its predecessor kept, goes as soon
    as its own rows are written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"pipeline-{name}")
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            schema = kept.schema
            kept.write.mode("overwrite").parquet(folder)
        if before is not None:
            dropped(before)
        docs = before = spark.read.schema(schema).parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
