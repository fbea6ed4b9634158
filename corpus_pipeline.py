"""Corpus pipeline: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionloom.llm.common import read, stored
from sessionloom.llm.fingerprints import first_of_groups
from sessionloom.llm.mixing import WITHOUT_LOW, sampled
from sessionloom.llm.packing import pack_documents
from sessionloom.llm.quality import good_documents
from sessionloom.llm.superkmers import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return first_of_groups(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sampled(docs, read(spark, sf_dir, "labels"), WITHOUT_LOW)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixing", mixing), ("packing", packing)]

#: Hashing, tokenizing and fitting are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
