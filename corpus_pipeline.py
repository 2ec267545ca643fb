"""A corpus pipeline in five stages; each reads what its predecessor kept.

quality classifier -> exact dedup -> SimHash near-dedup -> suffix-array dedup -> best-fit packing.

All stages but the last return the columns of ``documents``. The suffix-array stage replaces texts by what is left of
them: bytes that no longer form a character are dropped, and n_chars is counted anew; a document that loses its whole
text stays as an empty one. The last stage returns the packed pieces with their token ids.

Defined cases, for every stage: a null or empty text is an empty document (the classifier scores it, equal empty ones are
copies, it packs as one end token); a null doc_id is a document like any other, and the earliest one; very long texts are
read as a whole; of tied or repeated rows one stays in the stages that drop copies; an empty table gives an empty result
with the same columns; extra columns are carried up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.llm import common, exact_dedup, packing, quality_model, simhash, substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not reject."""
    return quality_model.drop_low_quality(docs, common.table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints."""
    return simhash.drop_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that an earlier document has in a run of 50 or more."""
    return substring_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, with their ids, placed in sequences."""
    return packing.pack(docs, with_ids=True)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("suffix-array dedup", repeats), ("best-fit packing", pack)]

#: Learnt scores, fingerprints, suffixes and packing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = common.materialize(docs, f"pipeline-{at}")
    return docs
