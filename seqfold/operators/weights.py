"""Weights of symbols and of entities: adaptation indices, demand, abundance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqfold.operators.sequences import occurrences


def with_copies(rules: DataFrame, copies: DataFrame) -> DataFrame:
    """rules with the copies of their anticodon; one that is not listed has 0."""
    return rules.join(F.broadcast(copies), "anticodon", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))


def tai_weights(rules: DataFrame, penalty: float = 0.5) -> DataFrame:
    """(codon, tai, wtai): copies over their maximum, for wtai times the penalty at wobble pairs; zeros become half a copy, unpenalised."""
    raw = rules.withColumn("p", F.col("copies") * F.when(F.col("decoding_type") == "wobble", penalty).otherwise(1.0))
    top = raw.agg(F.max("copies").alias("mc"), F.max("p").alias("mp"))

    def scaled(x: str, m: str):
        return F.when(F.col(x) > 0, F.col(x) / F.col(m)).otherwise(F.lit(0.5) / F.col(m))

    return raw.join(F.broadcast(top)).select("codon", scaled("copies", "mc").alias("tai"), scaled("p", "mp").alias("wtai"))


def geometric(counts: DataFrame, weights: DataFrame, value: str, name: str) -> DataFrame:
    """(gene, name): geometric mean of the weights of a gene's codons; codons without a positive weight are ignored, none at all give 0.

    counts: (gene, codon, cnt), so that a codon is looked up once for each gene."""
    w = F.col(value)
    used = counts.join(F.broadcast(weights.where(w > 0)), "codon", "left")
    return used.groupBy("gene").agg(F.coalesce(F.exp(F.sum(F.col("cnt") * F.log(w)) / F.sum(F.when(w.isNotNull(), F.col("cnt")))), F.lit(0.0)).alias(name))


def cai_weights(counts: DataFrame, expression: DataFrame, share: float = 0.05, least: int = 10, floor: float = 0.01) -> DataFrame:
    """(codon, aa, weight) from the most abundant genes: count over the family's largest; the floor for rare ones, 1 for codons
    without synonyms and for families not seen. The reference set's size is bounded by share of the genes."""
    n = expression.count()
    top = expression.orderBy(F.desc("tpm"), "gene").limit(max(least, int(n * share))).select("gene")
    used = counts.join(top, "gene", "left_semi").groupBy("codon", "aa", "n_syn").agg(F.sum("cnt").alias("cnt"))
    return used.select("codon", "aa", F.when(F.col("n_syn") == 1, 1.0).otherwise(F.greatest(F.col("cnt") / F.max("cnt").over(Window.partitionBy("aa")), F.lit(floor))).alias("weight"))


def tpm(counts: DataFrame) -> DataFrame:
    """(gene, tpm) of (gene, count, length): counts for each kilobase, scaled to a million. Rows without a count or a positive length are left out; if all counts are 0 the query fails."""
    rpk = counts.where("length > 0 and count >= 0").select("gene", (F.col("count") / (F.col("length") / 1000.0)).alias("rpk"))
    total = rpk.agg(F.sum("rpk").alias("total"))
    return rpk.join(F.broadcast(total)).select("gene", F.when(F.col("total") > 0, F.col("rpk") / F.col("total") * 1e6).otherwise(F.raise_error(F.lit("all counts are zero")).cast("double")).alias("tpm"))


def demand(cds: DataFrame, expression: DataFrame, k: int = 1, top: int | None = None) -> DataFrame:
    """(kmer, demand): frequencies weighted by abundance times length; with top, of the genes with the greatest weights only."""
    w = cds.join(expression, "gene", "left").select("gene", (F.coalesce("tpm", F.lit(0.0)) * F.length("seq") / 3).alias("w"), F.length("seq").alias("len")).where(f"w > 0 and len >= {3 * k}").select("gene", "w")
    if top is not None:
        w = w.orderBy(F.desc("w"), "gene").limit(top)
    total = w.agg(F.sum("w").alias("total"))
    weighted = cds.select("gene", "seq").join(w, "gene")  # whole sequences meet their weight, before there is a row for each symbol
    per = occurrences(weighted, k, "w").groupBy("kmer").agg(F.sum(F.col("w") / F.col("windows")).alias("s"))
    return per.join(F.broadcast(total)).select("kmer", (F.col("s") / F.col("total")).alias("demand"))


def demand_rank(cds: DataFrame, expression: DataFrame) -> DataFrame:
    """(gene, weight, share) of every gene, zero-weight ones too."""
    w = cds.join(expression, "gene", "left").select("gene", (F.coalesce("tpm", F.lit(0.0)) * F.length("seq") / 3).alias("weight"))
    return w.join(F.broadcast(w.agg(F.sum("weight").alias("total")))).select("gene", "weight", (F.col("weight") / F.col("total")).alias("share"))
