"""A corpus of documents cleaned and packed for training, in stages that are each written and reread.

Stages take nulls in any column, empty and very long texts, repeated rows and empty tables: rows with a null id or text pass the filtering
stages, of rows with the same id and text one stays, and rows without a text have no place in a sequence. Other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodesearch.llm import decontaminate, packing, quality, secrets, simhash
from lodesearch.llm.shared import delete, kept_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; of rows that repeat an id, all go if one is rejected."""
    return quality.drop_outliers(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; texts without words have no duplicates."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy, go. An empty benchmark takes none."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials are struck from the texts, and n_chars follows."""
    return secrets.redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document in a training sequence, in tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Packing, SimHash and inferred automata can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents; the last one's rows. A stage's table is deleted once the next is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = kept_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(last)
        last = path
    return docs
