"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, token encoding.

Each stage is written as Parquet to the shared folder and read again as the next one's documents.
Rows with a null text pass the filters and are encoded as empty; a null or repeated id is judged by its text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqfold.llm import byte_bpe, cgk_decontam, probminhash, secrets, toxicity_chain
from seqfold.llm.queries import TOKENIZER
from seqfold.llm.storage import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not reject. It is fitted on the labelled ones among docs."""
    chain = toxicity_chain.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_chain.score(docs, chain).where("not rejected").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return probminhash.deduplicated(docs).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return cgk_decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by their kind where the ledger's findings name its blob. The ledger is a folder of this run."""
    ledger = secrets.enter(docs, f"{shared_folder(spark)}/secrets-{uuid.uuid4().hex}")
    return secrets.masked(docs, ledger).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token counts and the digests of their ids and of what decodes from them."""
    return byte_bpe.digests(docs, TOKENIZER, public_tokenizers.PATTERN).drop("text")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secret_scan", secret_scan), ("encode", encode)]
ORACLE_SQL = None  # the first stage is a trained model; the tests hold each stage against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
