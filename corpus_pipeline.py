"""The training-text pipeline: five stages over ``documents``, each on all that the one before kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written to the shared
folder and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.compression_langid import classify, confident, learn_dictionaries
from tallyweave.llm.cube_mixing import mixed_rows
from tallyweave.llm.entries import tokenizer_path
from tallyweave.llm.near_copies import one_of_near_copies
from tallyweave.llm.nnls_packing import pack
from tallyweave.llm.quality_llr import bucket_ratios, judge_quality, kept_rows
from tallyweave.session import cut_lineage, ship_package


def prepared(spark: SparkSession) -> None:
    """The package on the workers, and batches of fewer whole texts: a worker holds one beside its caches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells with a margin, learned from the labelled ones."""
    prepared(spark)
    return confident(classify(docs, learn_dictionaries(docs))).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and the likelihood ratio against the trusted ones."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    ratios = bucket_ratios(docs, "text", trusted, "doc_id")
    judged = judge_quality(docs.select(F.struct("*").alias("doc"), "text"), ratios)
    return kept_rows(judged).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: 0.8 or more of the five-word shingles in common."""
    prepared(spark)
    return one_of_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it."""
    prepared(spark)
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4,096 tokens, with their ids."""
    prepared(spark)
    return pack(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: dictionaries, fingerprints, balanced draws and token ids are beyond SQL; see tests/llm
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
