"""A store of backgrounds: mergeable moments of k-mer frequencies by species, k and shard of genes, as partitioned Parquet.

A row (kmer, s, q) holds the sum and the sum of squares of a k-mer's frequency over a shard's genes; the row of the empty k-mer holds their number.
Moments of shards add up, so that genes that change cost a recount of their shards alone and an analysis reads summary rows, never all sequences."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqfold.operators import sequences

SHARDS = 64
SCHEMA = "kmer string, s double, q double, species string, k int, shards int, shard int"


def shard_of(gene: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(gene.cast("string")), F.lit(shards)).cast("int")


def moments(cds: DataFrame, k: int, shards: int = SHARDS) -> DataFrame:
    """(shard, kmer, s, q) of (gene, seq), from one pass. A gene of several rows counts once for each."""
    cells = sequences.cells(cds, ["gene"], k)
    return cells.groupBy(shard_of(F.col("gene"), shards).alias("shard"), "kmer").agg(F.sum("freq").alias("s"), F.sum(F.col("freq") * F.col("freq")).alias("q"))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def shards_of(spark: SparkSession, path: str, species: str, k: int) -> int | None:
    """Into how many shards a background is divided; None if there is none."""
    held = _stored(spark, path)
    found = [] if held is None else [r.shards for r in held.where((F.col("species") == species) & (F.col("k") == k)).select("shards").distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"the background of {species}, k = {k}, is there in several divisions")
    return found[0] if found else None


def _put(cds: DataFrame, path: str, species: str, k: int, shards: int, which: list[int]) -> None:
    """Writes the shards which, those without a gene too: they replace what was there, and other shards stay."""
    spark = cds.sparkSession
    empty = spark.createDataFrame([(i, "", 0.0, 0.0) for i in which], "shard int, kmer string, s double, q double")
    sums = moments(cds, k, shards).unionByName(empty).groupBy("shard", "kmer").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    named = sums.select("kmer", "s", "q", F.lit(species).alias("species"), F.lit(k).alias("k"), F.lit(shards).alias("shards"), "shard")
    named.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("species", "k", "shards", "shard").parquet(path)


def write(cds: DataFrame, path: str, species: str, k: int, shards: int = SHARDS) -> None:
    """The background of all genes. One that is there already is replaced, if it has as many shards."""
    there = shards_of(cds.sparkSession, path, species, k)
    if there not in (None, shards):
        raise ValueError(f"the background of {species}, k = {k}, has {there} shards, not {shards}")
    _put(cds, path, species, k, shards, list(range(shards)))


def refresh(cds: DataFrame, path: str, species: str, k: int, changed: DataFrame) -> list[int]:
    """Counts the shards again that hold a gene of changed (gene); cds has all genes as they are now. Returns these shards."""
    shards = shards_of(cds.sparkSession, path, species, k)
    if shards is None:
        raise ValueError(f"no background of {species}, k = {k}")
    which = sorted(r.shard for r in changed.select(shard_of(F.col("gene"), shards).alias("shard")).distinct().collect())  # as many as shards, at most
    if which:
        _put(cds.where(shard_of(F.col("gene"), shards).isin(which)), path, species, k, shards, which)
    return which


def read(spark: SparkSession, path: str, species: str, k: int) -> DataFrame:
    """(kmer, mean, sd) over all genes of the store, as frequency.background has them; only the partitions of the species and k are read."""
    if shards_of(spark, path, species, k) is None:
        raise ValueError(f"no background of {species}, k = {k}")
    own = _stored(spark, path).where((F.col("species") == species) & (F.col("k") == k))
    n = own.where("kmer = ''").agg(F.sum("s").alias("n"))
    sums = own.where("kmer <> ''").groupBy("kmer").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    return sums.join(F.broadcast(n)).select("kmer", F.try_divide("s", "n").alias("mean"), F.when(F.col("n") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("sd"))
