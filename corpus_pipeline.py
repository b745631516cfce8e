"""The corpus pipeline: five stages over ``documents``, each written and read again.

1. language identification: documents in no known language go;
2. SimHash near-duplicates: one document of each class stays;
3. benchmark decontamination: contaminated documents go;
4. personal data: spans are masked in the texts;
5. mixing: documents are sampled by calibrated probabilities, with the probability
   as a further column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slotcast.llm import decontaminate, language_id, mixing, near_dup, pii
from slotcast.llm.common import stored


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a known language, with the language found; null texts and texts without a letter go."""
    return language_id.keep_language(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-equal texts stays, the one of the smallest id; null, empty and blank texts are one class, repeated rows one row."""
    return near_dup.drop_near_duplicates(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without contamination, nulls and empty texts among them; repeated rows are judged alike."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in their texts masked and ``n_chars`` of changed texts counted anew; null texts stay null."""
    return pii.mask_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled rows with ``mix_probability`` (replaced if there); texts without a word are never drawn, repeated rows together."""
    return mixing.sample_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: Code lengths, fingerprint classes and the span classifier are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
