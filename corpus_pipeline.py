"""The training-data pipeline over documents: toxic documents go, then those without
an identified language, then all but one of each group of near duplicates; what
stays is packed into sequences.

Defined results: documents with a null or empty text, or one without letters, go at the language
stage; rows with a null id are documents like others but never near duplicates; rows that share an id stay or go
together at the third stage and are packed each; extra columns are kept till the last stage, whatever their names; an
empty table gives no rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvec.llm import bpe, language, packing, simhash, toxicity
from loomvec.session import remove, scratch, shared_dir

#: Viterbi and packing can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without significant toxic passages, by a model of the labelled ones."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model)


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at least half of whose letters are in identified languages."""
    return language.accepted(docs, language.train(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in sequences of packing.CAPACITY tokens of byte-level BPE."""
    sized = bpe.with_counts(docs.select("doc_id", "text"), "size").drop("text")
    return packing.pack(sized, length=F.col("size"))


STAGES = [("toxicity", without_toxic), ("language", with_language), ("near duplicates", without_copies), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each stage's result is written to the shared folder and read by the next, then removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/loomvec/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        if i:
            remove(spark, f"{base}/{i - 1}")
    return docs
