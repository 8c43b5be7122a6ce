"""Rows that a report shows: strongest in each direction, head and tail, biased regions, pairs in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqfold.operators.frequency import ALPHA


def strongest(tested: DataFrame, top: int = 30, key: str = "kmer", alpha: float | None = ALPHA) -> DataFrame:
    """The top significant rows of each direction by z_score, with direction and place; with alpha None whether significant or not."""
    rows = tested if alpha is None else tested.where(F.col("adjusted_p") < alpha)
    rows = rows.withColumn("_z", F.round("z_score", 6))

    def side(name: str, some, order) -> DataFrame:
        best = rows.where(some).orderBy(order, key).limit(top)
        named = best.agg(F.sort_array(F.collect_list(F.struct((F.col("_z") if name == "depleted" else -F.col("_z")).alias("o"), F.col(key).alias("key"))))["key"].alias("keys"))  # top rows
        return best.join(F.broadcast(named)).withColumns({"direction": F.lit(name), "place": F.array_position("keys", F.col(key)).cast("int")}).drop("keys", "_z")

    return side("enriched", F.col("_z") > 0, F.desc("_z")).unionByName(side("depleted", F.col("_z") < 0, F.col("_z")))


def head_and_tail(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The n largest and the n smallest rows by value; a row that is both stands twice, with its end."""
    head = df.orderBy(F.desc(value), key).limit(n).withColumn("end", F.lit("head"))
    return head.unionByName(df.orderBy(value, key).limit(n).withColumn("end", F.lit("tail")))


def biased(ramp: DataFrame, body: DataFrame, alpha: float = ALPHA, gap: float = 2.0) -> DataFrame:
    """(kmer, ramp_z, body_z, delta, biased) of two regions' tests: biased if either is significant and their scores are more than gap apart."""
    a = ramp.select("kmer", F.col("z_score").alias("ramp_z"), F.col("adjusted_p").alias("ramp_p"))
    both = a.join(body.select("kmer", F.col("z_score").alias("body_z"), F.col("adjusted_p").alias("body_p")), "kmer").withColumn("delta", F.col("ramp_z") - F.col("body_z"))
    return both.select("kmer", "ramp_z", "body_z", "delta", (((F.col("ramp_p") < alpha) | (F.col("body_p") < alpha)) & (F.abs("delta") > gap)).alias("biased"))


def slow_in_ramp(ramp: DataFrame, fast: list[str], least: float = 1.5) -> DataFrame:
    """The tests of a ramp's codons that are slow and have a score over least."""
    return ramp.where((F.col("z_score") > least) & ~F.col("kmer").isin(fast))


def ortholog_lookup(edges: DataFrame, genes: DataFrame, species: str) -> DataFrame:
    """(gene, ortholog): counterparts of genes (gene) of a species, on whichever side of the edges it stands.

    edges: (species1, gene1, species2, gene2)."""
    ahead = edges.where(F.col("species1") == species).select(F.col("gene1").alias("gene"), F.col("gene2").alias("ortholog"))
    back = edges.where(F.col("species2") == species).select(F.col("gene2").alias("gene"), F.col("gene1").alias("ortholog"))
    return ahead.unionByName(back).distinct().join(genes.select("gene").distinct(), "gene", "left_semi").groupBy("gene").agg(F.max("ortholog").alias("ortholog"))


def quartiles(df: DataFrame, value: str) -> DataFrame:
    """One row: n, least, q1, median, q3, most of a value: what a box plot draws."""
    q = [F.percentile(value, F.lit(p)).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return df.agg(F.count(value).alias("n"), F.min(value).alias("least"), *q, F.max(value).alias("most"))
