"""A corpus pipeline of five stages; each is written as Parquet and read again by the next.

All stages take null keys, texts, languages and sources, empty and very long texts, repeated
rows, empty tables and further columns of any name: what each does with them stands in its
docstring.  All but the last return the columns that they were given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyrack.llm.common import shared_folder, table
from tallyrack.llm.mixing import repeated
from tallyrack.llm.neardup import deduplicated
from tallyrack.llm.packing import packed
from tallyrack.llm.quality import quality_filtered
from tallyrack.llm.toxicity import nontoxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text does not score as toxic; a null text scores as an empty one, equal texts alike."""
    return nontoxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the fixed rules and the limits of their language and source (null: a group of its own); null, empty and short texts go."""
    return quality_filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, once if its row is repeated; rows with a null key stay."""
    return deduplicated(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it (an empty one as the others of its source); a null source is one of its own."""
    return repeated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens; each row is a document, repeated or not; an empty text is its end id alone."""
    return packed(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs


#: Learned scores, MinHash and tokenisation have no SQL; tests hold each stage against plain code.
ORACLE_SQL = None
