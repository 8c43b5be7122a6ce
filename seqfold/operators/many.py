"""Many sets and many regions in one pass over the sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqfold.functions import stats
from seqfold.operators import sequences
from seqfold.sources import shared

REGIONS = (("all", 0, None, 0), ("ramp", 1, 51, 3), ("body", 51, None, 3))  # name, first codon, end, least codons


def moments(cds: DataFrame, sets: DataFrame, k: int = 1, regions: tuple = REGIONS) -> DataFrame:
    """(name, region, kmer, s, q): sums of frequencies and of their squares over a set's genes, and with a null name over all genes. The empty k-mer's
    s is the number of genes. sets: (name, gene); a gene may be in any number of them, and in one it counts once.

    A gene brings the names of its sets along, and each region of it is a tag beside its k-mers, so the sequences are read once whatever the
    number of sets; sums combine before their shuffle, so no group fills a task."""
    held = sets.where("name is not null").groupBy("gene").agg(F.collect_set("name").alias("_sets"))
    parts = F.array(*[
        F.when(F.length(s) >= 3 * least, F.struct(F.lit(name).alias("region"), s.alias("seq")))
        for name, a, b, least in regions for s in (F.substring(F.coalesce("seq", F.lit("")), 3 * a + 1, 2**31 - 1 if b is None else 3 * (b - a)),)
    ])
    tagged = cds.join(held, "gene", "left").select("gene", "_sets", F.explode(F.array_compact(parts)).alias("p")).select("gene", "_sets", "p.region", "p.seq")
    of = F.concat(F.array(F.lit(None).cast("string")), F.coalesce("_sets", F.array().cast("array<string>")))
    cells = sequences.cells(tagged, ["gene", "region", "_sets"], k).select("region", "kmer", "freq", F.explode(of).alias("name"))
    return cells.groupBy("name", "region", "kmer").agg(F.sum("freq").alias("s"), F.sum(F.col("freq") * F.col("freq")).alias("q"))


def compositions(cds: DataFrame, sets: DataFrame, k: int = 1, regions: tuple = REGIONS) -> DataFrame:
    """(name, region, kmer, observed, expected, z_score, cohens_d, n_set, p_value, adjusted_p) of every set in every region, against all genes that have
    the region, in closed form; p is adjusted within a set and region. A set none of whose genes has a region has no rows there.

    The sums, whose rows are sets by regions by k-mers, are written to the shared folder: the sequences stand in one job, the joins read a summary."""
    sums = shared.written(moments(cds, sets, k, regions), "moments")
    total = sums.where("name is null and kmer = ''").select("region", F.col("s").alias("n"))
    base = sums.where("name is null and kmer <> ''").drop("name").join(F.broadcast(total), "region")
    own = sums.where("name is not null and kmer <> ''").select("name", "region", "kmer", F.col("s").alias("t"))
    sizes = sums.where("name is not null and kmer = ''").select("name", "region", F.col("s").alias("n_set"))
    grid = base.join(sizes, "region").join(own, ["name", "region", "kmer"], "left")
    mean, seen = F.col("s") / F.col("n"), F.coalesce("t", F.lit(0.0)) / F.col("n_set")
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    told = grid.select("name", "region", "kmer", "n_set", seen.alias("observed"), mean.alias("expected"), F.when(F.col("n") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0).alias("sd"))
    gap, some = F.col("observed") - F.col("expected"), F.col("sd") > 1e-12
    scored = told.select(
        "name", "region", "kmer", "observed", "expected", F.when(some, gap / (F.col("sd") / F.sqrt("n_set"))).otherwise(0.0).alias("z_score"),
        F.when(some, gap / F.col("sd")).otherwise(0.0).alias("cohens_d"), F.col("n_set").cast("long").alias("n_set"),
    )
    return stats.bh(scored.withColumn("p_value", stats.normal_p("z_score")), "p_value", "kmer", ["name", "region"])
