"""Operators over the order of symbols within an entity. An entity's symbols stand in one row's array or one window partition, never more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqfold.functions import stats
from seqfold.operators import frequency, sequences
from seqfold.operators.sequences import codon_array


def scored(pos: DataFrame, weights: DataFrame, value: str = "weight") -> DataFrame:
    """(gene, pos, n, score): each position's weight, 0 where the symbol has none."""
    return pos.join(F.broadcast(weights.select("codon", F.col(value).alias("score"))), "codon", "left").select("gene", "pos", "n", F.coalesce("score", F.lit(0.0)).alias("score"))


def smoothed(track: DataFrame, width: int = 10) -> DataFrame:
    """(gene, pos, n, smooth): centred moving average; beyond the ends the track counts as zero."""
    near = Window.partitionBy("gene").orderBy("pos").rowsBetween(-(width // 2), (width - 1) // 2)
    return track.select("gene", "pos", "n", (F.sum("score").over(near) / width).alias("smooth"))


def metagene(smooth: DataFrame, bins: int = 100, least: int = 30) -> DataFrame:
    """(bin, profile): smoothed tracks read at bins equidistant places by linear interpolation, averaged over genes of least symbols or more."""
    step = F.lit(1.0) * (F.col("n") - 1) / (bins - 1)
    rows = smooth.where(F.col("n") >= least).withColumn("next", F.coalesce(F.lead("smooth").over(Window.partitionBy("gene").orderBy("pos")), F.col("smooth")))
    # the bins whose place lies in [pos, pos + 1)
    first, last = F.ceil(F.col("pos") / step - 1e-9), F.ceil((F.col("pos") + 1) / step - 1e-9) - 1
    bounded = rows.withColumn("bin", F.explode(F.when(first <= F.least(last, F.lit(bins - 1)), F.sequence(first, F.least(last, F.lit(bins - 1)))).otherwise(F.array().cast("array<bigint>"))))
    value = F.col("smooth") + (F.col("next") - F.col("smooth")) * (F.col("bin") * step - F.col("pos"))
    return bounded.groupBy("bin").agg(F.avg(value).alias("profile"))


def pair_counts(cds: DataFrame, fast: list[str]) -> DataFrame:
    """(gene, ff, fs, sf, ss): adjacent pairs by whether each symbol is fast."""
    quick = F.transform(codon_array(F.col("seq")), lambda c: c.isin(fast))
    pairs = F.zip_with(F.slice("q", F.lit(1), F.size("q") - 1), F.slice("q", F.lit(2), F.size("q") - 1), lambda a, b: F.when(a & b, 0).when(a, 1).when(b, 2).otherwise(3))
    rows = cds.select("gene", quick.alias("q")).where(F.size("q") > 1).select("gene", pairs.alias("p"))

    def count(kind: int) -> Column:
        return F.size(F.filter("p", lambda x: x == kind)).cast("long")

    return rows.select("gene", *[count(i).alias(n) for i, n in enumerate(("ff", "fs", "sf", "ss"))])


def proportions(counts: DataFrame) -> DataFrame:
    """One row: total, and the pooled shares of ff, fs, sf, ss."""
    kinds = ("ff", "fs", "sf", "ss")
    total = sum((F.sum(k) for k in kinds[1:]), F.sum("ff"))
    return counts.agg(total.alias("total"), *[(F.sum(k) / total).alias(k) for k in kinds])


KINDS = ("ff", "fs", "sf", "ss")


def ratio(x: Column, y: Column) -> Column:
    """x / y; without y infinite, or 1 if there is no x either."""
    return F.when(y > 0, x / y).when(x > 0, float("inf")).otherwise(1.0)


def compared(counts_a: DataFrame, counts_b: DataFrame) -> DataFrame:
    """One row: transitions of a set against all: fs_enrichment, fs_sf_set, fs_sf_all, folds of each kind, chi2 with its degrees of freedom and p."""
    a, b = (proportions(c).select([F.col(x).alias(f"{s}_{x}") for x in ("total", *KINDS)]) for c, s in ((counts_a, "a"), (counts_b, "b")))
    both = a.join(F.broadcast(b))
    col = F.col
    chi2 = sum((F.when(col(f"b_{k}") > 0, F.pow(col(f"a_{k}") - col(f"b_{k}"), F.lit(2)) / col(f"b_{k}")).otherwise(0.0) for k in KINDS[1:]), F.when(col("b_ff") > 0, F.pow(col("a_ff") - col("b_ff"), F.lit(2)) / col("b_ff")).otherwise(0.0))
    cells = sum(((col(f"b_{k}") > 0).cast("int") for k in KINDS[1:]), (col("b_ff") > 0).cast("int"))
    row = both.select(ratio(col("a_fs"), col("b_fs")).alias("fs_enrichment"), ratio(col("a_fs"), col("a_sf")).alias("fs_sf_set"), ratio(col("b_fs"), col("b_sf")).alias("fs_sf_all"), *[ratio(col(f"a_{k}"), col(f"b_{k}")).alias(f"fold_{k}") for k in KINDS], (col("a_total") * chi2).alias("chi2"), (cells - 1).alias("df"))
    return row.withColumn("p_value", stats.chi2_p(F.coalesce("chi2", F.lit(0.0)), F.coalesce("df", F.lit(0))))


def fs_deciles(cds: DataFrame, fast: list[str], bins: int = 10) -> DataFrame:
    """(bin, n): pairs of a fast symbol and one that is not, by the tenth of the sequence in which they begin."""
    codons = codon_array(F.col("seq"))
    rows = cds.select("gene", codons.alias("c")).select(F.size("c").alias("n"), F.posexplode(F.zip_with(F.slice("c", F.lit(1), F.greatest(F.size("c") - 1, F.lit(0))), F.slice("c", F.lit(2), F.size("c")), lambda a, b: a.isin(fast) & ~b.isin(fast))).alias("pos", "hit"))
    return rows.where("hit").groupBy(F.least(F.expr(f"pos * {bins} div (n - 1)"), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def fs_pairs(cds: DataFrame, chosen: DataFrame, symbols: DataFrame, fast: list[str]) -> DataFrame:
    """(kmer, n_set, n_all, fold, z_score) of pairs of a fast and a slow codon: their number in a set against what all genes let expect (Poisson)."""
    slow = [r.codon for r in symbols.collect() if r.codon not in fast]  # of 61
    pairs = frequency.marked(cds, chosen).select("inside", F.explode(sequences.kmer_array(F.col("seq"), 2)).alias("kmer")).where(F.substring("kmer", 1, 3).isin(fast) & F.substring("kmer", 4, 3).isin(slow))
    both = pairs.groupBy("kmer").agg(F.count("inside").alias("n_set"), F.count("*").alias("n_all"))  # in place: counts of each gene are not needed
    e = F.col("n_all") * F.col("ts") / F.col("ta")
    return both.join(F.broadcast(both.agg(F.sum("n_set").alias("ts"), F.sum("n_all").alias("ta")))).select("kmer", "n_set", "n_all", (F.col("n_set") / e).alias("fold"), ((F.col("n_set") - e) / F.sqrt(e)).alias("z_score"))


def runs(pos: DataFrame, target: Column, least: int = 2) -> DataFrame:
    """(gene, n_runs, longest): runs of least or more consecutive targets."""
    hit = pos.where(target).withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("gene").orderBy("pos")))
    sizes = hit.groupBy("gene", "island").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return sizes.groupBy("gene").agg(F.count("*").alias("n_runs"), F.max("size").alias("longest"))


def dense_windows(pos: DataFrame, target: Column, width: int = 15, factor: float = 2.0, least: int = 2) -> DataFrame:
    """(gene, n_windows): full windows with least or more targets, and over factor times the gene's density of them."""
    gene = Window.partitionBy("gene")
    ahead = gene.orderBy("pos").rowsBetween(0, width - 1)
    marked = pos.withColumn("t", target.cast("int"))
    rows = marked.select("gene", "pos", "n", F.sum("t").over(ahead).alias("inside"), (F.sum("t").over(gene) / F.col("n")).alias("density"))
    full = rows.where((F.col("pos") <= F.col("n") - width) & (F.col("inside") >= least) & (F.col("inside") / width > factor * F.col("density")))
    return full.groupBy("gene").agg(F.count("*").alias("n_windows"))
