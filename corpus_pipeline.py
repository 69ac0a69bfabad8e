"""A training corpus from documents: each stage's rows are written as Parquet and reread as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from affinis.llm.common import removed, shared_dir, table
from affinis.llm.mixing import mixed_documents
from affinis.llm.packing import pack, pieces
from affinis.llm.simhash import keep_one
from affinis.llm.suffix import without_repeats
from affinis.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that occur more than once."""
    return without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the source mix takes them."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens; pieces(docs, with_ids=True) would carry the ids along."""
    return pack(pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("suffix_array", drop_repeats),
    ("mixing", mix),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # the classifier and the tokenizer are beyond SQL; tests run the stages, and hold their operators against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for all documents."""
    docs = table(spark, sf_dir, "documents")
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{home}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            removed(spark, last)
        last = path
    return docs
