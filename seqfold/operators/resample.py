"""Resampling: bootstrap scores and permutations, distributed by replicate or by entity."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqfold.functions.stats import draws
from seqfold.operators import run_null


SENT = 2_000_000  # values (a long and a double) that are broadcast


def bootstrap_mean(values: DataFrame, observed: DataFrame, n_draw: DataFrame, reps: int, seed: int) -> DataFrame:
    """(mean_b, sd_b, z_score): reps resamples, with replacement, of n_draw of the values (idx, value; idx counts from 0).

    The draws are rows and meet the values by an equi-join on the drawn index; moments of the replicate means follow. Values, of which there are far fewer than
    draws, go to the draws if their counted number is at most SENT, so that draws are never shuffled; more are met by a shuffle of both."""
    spark, n = values.sparkSession, values.agg(F.count("*").alias("n"))
    side = F.broadcast(values) if values.count() <= SENT else values
    rep = spark.range(0, reps, 1, min(reps, 4 * spark.sparkContext.defaultParallelism)).withColumnRenamed("id", "rep").join(F.broadcast(n_draw.join(F.broadcast(n))))
    drawn = rep.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))).withColumn("idx", draws(F.col("rep"), F.col("slot"), seed, F.col("n")))
    means = drawn.join(side, "idx").groupBy("rep").agg(F.avg("value").alias("mean"))
    stats = means.agg(F.avg("mean").alias("mean_b"), F.stddev_samp("mean").alias("sd_b"))
    return stats.join(F.broadcast(observed)).select("observed", "mean_b", "sd_b", F.when(F.col("sd_b") > 0, (F.col("observed") - F.col("mean_b")) / F.col("sd_b")).otherwise(0.0).alias("z_score"))


BINS = 512  # of entities, dealt by a hash: how many resampled entities a bin gets is drawn for all bins at once


RUN = 256  # rows of a bin that are drawn from together
SLICE = 500  # replicates whose draws from a run are held together


def _runs(batches):
    """(bin, [(w, at, v), ...]) of at most RUN rows of a bin, from batches that are sorted by bin; a run ends with its bin alone or when it is full,
    so runs do not depend on batches."""
    now, rows = None, []
    for pdf in batches:
        for b, w, at, v in zip(pdf["bin"], pdf["w"], pdf["at"], pdf["v"], strict=True):
            if rows and (b != now or len(rows) == RUN):
                yield now, rows
                rows = []
            now = b
            rows.append((w, at, v))
    if rows:
        yield now, rows


def multinomial(rows: DataFrame, n_draw: int, reps: int, width: int, seed: int) -> DataFrame:
    """(rep, at, sum): for each replicate of n_draw draws with replacement of the rows, the sum of their values at each place.

    rows: (key, w, at array<int>, v array<double>); a draw of a row adds w * v at its places and w at place -1. Draws are never rows. A replicate's draws
    are divided over BINS bins of rows by one multinomial number, which every task draws alike from the seed; inside a bin, over runs of RUN rows, by
    binomial numbers on condition of what is left and of how many rows are left; inside a run, each draw is one of its rows. Sums are then counts by values, a product of matrices. So each replicate has n_draw draws exactly, a bin needs no
    other one, and rows are read as a stream. A task holds (replicates of a pass) x (places), 160 MB at most, and adds them up over its rows; Spark adds up the tasks'."""
    dealt = rows.withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(BINS)).cast("int"))
    sizes = [0] * BINS
    for r in dealt.groupBy("bin").agg(F.count("*").alias("n")).collect():
        sizes[r.bin] = r.n
    total, block = sum(sizes), 250

    def partial(batches, first: int, last: int):
        n, sums = last - first, np.zeros((last - first, width + 1))  # the weights drawn stand in the last column
        share = np.random.default_rng([seed, first]).multinomial(n_draw, np.array(sizes) / total, size=n)
        now, left, rest, rng = -1, None, 0, None
        for b, rows in _runs(batches):
            if b != now:
                now, left, rest, rng = b, share[:, b].copy(), sizes[b], np.random.default_rng([seed, first, int(b)])
            m = len(rows)
            drawn = left if m >= rest else rng.binomial(left, m / rest)
            left, rest = left - drawn, rest - m
            values = np.zeros((m, width + 1))
            for i, (w, at, v) in enumerate(rows):
                values[i, np.asarray(at, int)] = w * np.asarray(v, float)
                values[i, width] = w
            for lo in range(0, n, SLICE):  # draws of a slice of replicates as numbers, then their counts by row
                some = drawn[lo : lo + SLICE]
                spot = np.repeat(np.arange(len(some)) * m, some) + rng.integers(0, m, int(some.sum()), dtype=np.int32)
                sums[lo : lo + SLICE] += np.bincount(spot, minlength=len(some) * m).reshape(len(some), m).astype(float) @ values
        mass = sums[:, width]
        some = np.flatnonzero(mass)
        yield pd.DataFrame({"rep": first + some, "at": np.int32(-1), "sum": mass[some]})
        rep, at = np.nonzero(sums[:, :width])
        for lo in range(0, len(rep), 100_000):
            one = slice(lo, lo + 100_000)
            yield pd.DataFrame({"rep": first + rep[one], "at": at[one].astype(np.int32), "sum": sums[rep[one], at[one]]})

    if not total or not n_draw:
        return rows.sparkSession.createDataFrame([], "rep long, at int, sum double")
    span = max(block, block * (20_000_000 // (block * max(1, width))))  # replicates of a pass
    held = dealt.repartition("bin").sortWithinPartitions("bin", "key")
    parts = None
    for first in range(0, reps, span):
        one = held.mapInPandas(lambda batches, first=first: partial(batches, first, min(first + span, reps)), "rep long, at int, sum double")
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("rep", "at").agg(F.sum("sum").alias("sum"))  # combined before the shuffle


def multinomial_mean(values: DataFrame, n_draw: int, reps: int = 10_000, seed: int = 42) -> DataFrame:
    """(rep, mean): means of reps resamples of n_draw of the values (key, value)."""
    rows = values.select("key", F.lit(1.0).alias("w"), F.array(F.lit(0)).alias("at"), F.array(F.col("value").cast("double")).alias("v"))
    sums = multinomial(rows, n_draw, reps, 1, seed)
    return sums.groupBy("rep").agg((F.coalesce(F.sum(F.when(F.col("at") == 0, F.col("sum"))), F.lit(0.0)) / F.sum(F.when(F.col("at") == -1, F.col("sum")))).alias("mean"))


def bootstrap_kmers(freq: DataFrame, genes: DataFrame, observed: DataFrame, n_set: int, reps: int = 10_000, seed: int = 42, weight: str | None = None) -> DataFrame:
    """(kmer, observed, mean_b, sd_b, z_score): resamples exactly n_set of the genes, reps times, for every k-mer at once.

    Replicates are never joined to cells: see multinomial. A replicate's mean is the weighted sum over the weights drawn; of a replicate that draws no weight
    there is none. For k of 1 and 2; triplets have the closed form. genes: (gene) or (gene, weight); freq: (gene, kmer, freq)."""
    kmers = [r.kmer for r in observed.select("kmer").orderBy("kmer").collect()]
    names = freq.sparkSession.createDataFrame(list(enumerate(kmers)), "at int, kmer string")  # 3,721 at most
    packed = freq.join(F.broadcast(names), "kmer").groupBy("gene").agg(F.collect_list("at").alias("at"), F.collect_list("freq").alias("v"))
    rows = genes.join(packed, "gene", "left").select(F.col("gene").alias("key"), F.col(weight).alias("w") if weight else F.lit(1.0).alias("w"), F.coalesce("at", F.array().cast("array<int>")).alias("at"), F.coalesce("v", F.array().cast("array<double>")).alias("v"))
    sums = multinomial(rows, n_set, reps, max(1, len(kmers)), seed)
    mass = sums.where("at < 0").select("rep", F.col("sum").alias("mass"))
    means = sums.where("at >= 0").join(F.broadcast(mass), "rep").select("at", (F.col("sum") / F.col("mass")).alias("mean"))
    n = mass.agg(F.count("*").alias("n"))
    moments = means.groupBy("at").agg(F.sum("mean").alias("s"), F.sum(F.col("mean") * F.col("mean")).alias("q")).join(F.broadcast(n))
    named = moments.join(F.broadcast(names), "at")
    mean, sd = F.col("s") / F.col("n"), F.sqrt(F.greatest((F.col("q") - F.col("s") ** 2 / F.col("n")) / (F.col("n") - 1), F.lit(0.0)))
    return observed.join(named, "kmer").select("kmer", "observed", mean.alias("mean_b"), sd.alias("sd_b"), F.when(sd > 0, (F.col("observed") - mean) / sd).otherwise(0.0).alias("z_score"))


def shuffled_runs(cds: DataFrame, family: dict[str, str], targets: list[str], permutations: int = 1000, seed: int = 42) -> DataFrame:
    """(gene, n_runs, p, exact): runs of two or more targets against synonymous shuffles, which permute codons within each family's places.

    p is the probability of so many runs or more, exact by the recurrence of run_null where its states are few enough (see CELLS there), else
    the share of the given number of shuffles, the observed order among them. A null or empty sequence has no run, and p 1; letters
    behind the last whole codon are no codon; equal genes with equal sequences have equal rows."""
    wanted = set(targets)

    def test(batches):
        for pdf in batches:
            out = []
            for gene, seq in zip(pdf["gene"], pdf["seq"], strict=True):
                codons = [seq[i : i + 3] for i in range(0, len(seq) - 2, 3)] if seq else []
                mark = np.array([c in wanted for c in codons], bool)
                numbers: dict[str, int] = {}
                group = np.array([numbers.setdefault(family.get(c, c), len(numbers)) for c in codons], int)
                out.append((gene, *run_null.test(mark, group, permutations, [seed, zlib.crc32(str(gene).encode())])))
            yield pd.DataFrame(out, columns=["gene", "n_runs", "p", "exact"])

    return cds.select("gene", "seq").mapInPandas(test, f"gene {cds.schema['gene'].dataType.simpleString()}, n_runs long, p double, exact boolean")
