"""A corpus pipeline: quality rules, exact dedup, SimHash near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents`` (and whatever others they got, of any names). Between stages the rows are written as Parquet and read again.
Empty tables give empty results at every stage; very long texts are read whole. Null texts have no words, which the first stage
rejects; a stage that gets some, called on its own, takes them for empty texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, mixing, packing, quality, similar
from tidemark.llm.cluster import shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and stand near their language's reference.

    Null and empty texts have fewer than ten words and go; a null language is one of its own; a null id names a document like any other. Rows that
    repeat an id are judged each by its own text, and repeated rows stay or go together.
    """
    return quality.accepted(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of equal texts.

    Null texts equal empty ones; null ids come after all others; of rows that repeat id and text one stays.
    """
    return exact_dedup.survivors(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near-duplicates: five-word shingles of Jaccard similarity 0.8 or more. SimHash fingerprints in
    multi-index tables find near ones, whole sets verify them, and an exact search finds those whose fingerprints lie farther apart.

    Null and empty texts are alike; a document without an id stays only if its group has none with one; rows that repeat an id stay or go together.
    """
    return similar.survivors(docs, shingle=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks, twice at most and perhaps not at all.

    Null texts have no words and are taken as their source's rate says; null sources are one source, the last; ties are broken by a hash, and rows that repeat an
    id are mixed each by itself, so reruns agree.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids, with the ids and their checksum.

    Null and empty texts have the one id that ends a document; repeated rows are documents each.
    """
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Tokenising and fingerprints are beyond SQL; tests/llm compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is kept in the session's shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
