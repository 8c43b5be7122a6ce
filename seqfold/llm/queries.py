"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqfold.llm import byte_bpe, cgk_decontam, divergence_rules, importance, license_index, maxscore, ordinal_quality, preference_format, probminhash, secrets, toxicity_chain, url_bloom, whitening
from seqfold.llm.storage import shared_folder

#: Rules for URLs (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rules' findings are in the ledger when the other rules come: the second run scans the added pairs alone."""
    docs, folder = table(spark, sf_dir, "documents").select("doc_id", "text"), f"{shared_folder(spark)}/secrets-{uuid.uuid4().hex}"
    secrets.enter(docs, folder, secrets.BASE)
    found = secrets.report(docs, secrets.enter(docs, folder))
    kinds = [r.kind for r in secrets.BASE]

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = joined(F.filter("found", lambda s: s["kind"].isin(kinds)))
    return found.select("doc_id", *map(count, kinds), F.sha2(base, 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal_quality.fit(docs, table(spark, sf_dir, "labels"))
    return ordinal_quality.grade(docs, model).select("doc_id", "expected_grade", F.col("tail")[0].alias("p_sound"), F.col("tail")[1].alias("p_clean"), "keep")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity_chain.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity_chain.score(docs, chain).drop("text")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cgk_decontam.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = preference_format.threads(table(spark, sf_dir, "conversations"))
    return preference_format.format_pairs(conversations, preference_format.by_first_turn(conversations))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_bloom.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(docs, TOKENIZER, public_tokenizers.PATTERN).drop("text")


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", maxscore.quantised(F.col("embedding")).alias("vector"))
    return maxscore.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = divergence_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return told.withColumns({c: F.round(c, 6) for c in divergence_rules.LIMITS})


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_secret_scan, op2_quality, op3_toxicity, op4_decontamination, op5_preference, op6_url_filter, op7_license_scan, op8_byte_bpe, op9_maxscore, op10_near_duplicates, op11_quality_rules, op12_importance, op13_whitening)
    return {f.__name__: f for f in named}
