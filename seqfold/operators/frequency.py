"""Means and spreads over entities, families, and their deviations. Absent cells count as zero: sums are divided by entity counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqfold.functions import stats
from seqfold.operators import sequences
from seqfold.operators.sequences import kmer_counts, kmer_freq, occurrences, positions


def members(cds: DataFrame, chosen: DataFrame) -> DataFrame:
    return cds.join(chosen, "gene", "left_semi")


def marked(cds: DataFrame, chosen: DataFrame) -> DataFrame:
    """cds with inside, 1 for the genes of a set, else null: whole sequences meet the set, before there is a row for each of their symbols or cells."""
    return cds.join(chosen.select("gene").distinct().withColumn("inside", F.lit(1)), "gene", "left")


def geneset_mean(cds: DataFrame, k: int) -> DataFrame:
    """(kmer, observed): the unweighted mean over genes. An occurrence adds 1 / windows, so no counts by gene are needed and only sums by k-mer are shuffled."""
    n = cds.agg(F.count("*").alias("n_genes"))
    return occurrences(cds, k).groupBy("kmer").agg(F.sum(1.0 / F.col("windows")).alias("s")).join(F.broadcast(n)).select("kmer", (F.col("s") / F.col("n_genes")).alias("observed"))


def background(cds: DataFrame, k: int) -> DataFrame:
    """(kmer, mean, sd): over all genes, sd with n - 1; from sums, so that zeros need no rows."""
    n = cds.agg(F.count("*").alias("n"))
    sums = kmer_freq(cds, k).groupBy("kmer").agg(F.sum("freq").alias("s"), F.sum(F.col("freq") * F.col("freq")).alias("q"))
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    return sums.join(F.broadcast(n)).select("kmer", (F.col("s") / F.col("n")).alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"))


def target_z(cds: DataFrame, targets: list[str]) -> DataFrame:
    """(gene, mean_z, min_z, max_z, sum_freq) of every gene over the target codons, against all genes; a codon without spread is left out.

    Frequencies come row by row and their moments are one row, so no cells are grouped or joined."""
    per = sequences.target_freq(cds, targets)
    moments = per.agg(*[f(c).alias(f"{name}_{c}") for c in targets for name, f in (("m", F.avg), ("sd", F.stddev_samp))])
    cells = F.filter(F.array(*[F.when(F.col(f"sd_{c}") > 0, F.struct(F.col(c).alias("f"), ((F.col(c) - F.col(f"m_{c}")) / F.col(f"sd_{c}")).alias("z"))) for c in targets]), lambda x: x.isNotNull())
    rows = per.join(F.broadcast(moments)).select("gene", cells.alias("x")).where(F.size("x") > 0)
    zs = F.transform("x", lambda x: x["z"])
    return rows.select("gene", (F.aggregate(zs, F.lit(0.0), lambda a, z: a + z) / F.size("x")).alias("mean_z"), F.array_min(zs).alias("min_z"), F.array_max(zs).alias("max_z"), F.aggregate("x", F.lit(0.0), lambda a, x: a + x["f"]).alias("sum_freq"))


def composition(cds: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(kmer, observed, expected, z_score, cohens_d, n_set): a set against all genes, in closed form: the standard error is sd / sqrt(n).

    One pass over the sequences: the sums of the set and of all genes come from the same cells."""
    flagged = marked(cds, chosen)
    n = flagged.agg(F.count("*").alias("n"), F.count("inside").alias("n_set"))
    d = deviation(kmer_freq(flagged, k, "inside"), "kmer", "freq", None, n)
    gap = F.col("observed") - F.col("expected")
    return d.select("kmer", "observed", "expected", "n_set", "z_score", F.when(F.col("sd") > 1e-12, gap / F.col("sd")).otherwise(0.0).alias("cohens_d"))


def against(known: DataFrame, inside: DataFrame, k: int) -> DataFrame:
    """composition of a set's sequences against known moments (kmer, mean, sd), as background or a store of backgrounds has them: all genes need
    not be read. A k-mer that the moments do not have is left out."""
    both = known.join(geneset_mean(inside, k), "kmer", "left").join(F.broadcast(inside.agg(F.count("*").alias("n_set"))))
    seen, some = F.when(F.col("n_set") > 0, F.coalesce("observed", F.lit(0.0))), F.col("sd") > 1e-12
    d = both.select("kmer", seen.alias("observed"), F.col("mean").alias("expected"), "sd", "n_set").withColumn("gap", F.col("observed") - F.col("expected"))
    return d.select("kmer", "observed", "expected", "n_set", F.when(some, F.col("gap") / (F.col("sd") / F.sqrt("n_set"))).otherwise(0.0).alias("z_score"), F.when(some, F.col("gap") / F.col("sd")).otherwise(0.0).alias("cohens_d"))


def matched_pool(stats: DataFrame, chosen: DataFrame) -> DataFrame:
    """Genes whose length and GC lie in the set's widened ranges. stats: (gene, len, gc)."""
    span = stats.join(chosen, "gene", "left_semi").agg((F.min("len") * 0.8).alias("l0"), (F.max("len") * 1.2).alias("l1"), (F.min("gc") - 0.05).alias("g0"), (F.max("gc") + 0.05).alias("g1"))
    return stats.join(F.broadcast(span), F.col("len").between(F.col("l0"), F.col("l1")) & F.col("gc").between(F.col("g0"), F.col("g1"))).select("gene", "len", "gc")


def codon_counts(cds: DataFrame, symbols: DataFrame) -> DataFrame:
    """(gene, codon, aa, n_syn, cnt) of sense codons."""
    return kmer_counts(cds, 1).withColumnRenamed("kmer", "codon").join(F.broadcast(symbols), "codon")


def aa_freq(counts: DataFrame) -> DataFrame:
    """(gene, aa, freq): of the recognised codons."""
    per = counts.groupBy("gene", "aa").agg(F.sum("cnt").alias("cnt"))
    return per.select("gene", "aa", (F.col("cnt") / F.sum("cnt").over(Window.partitionBy("gene"))).alias("freq"))


def rscu(counts: DataFrame) -> DataFrame:
    """(gene, codon, aa, rscu) of the families that a gene has; an unused codon of such a family is 0 and has no row."""
    family = Window.partitionBy("gene", "aa")
    return counts.select("gene", "codon", "aa", (F.col("n_syn") * F.col("cnt") / F.sum("cnt").over(family)).alias("rscu"))


def rscu_dense(cds: DataFrame, counts: DataFrame, symbols: DataFrame, least: int = 10) -> DataFrame:
    """(gene, codon, aa, rscu) for every codon of families with synonyms: 0 if unused, null if the family is missing or the gene has fewer than least codons."""
    used = counts.where("n_syn > 1")
    families = used.groupBy("gene", "aa").agg(F.sum("cnt").alias("total"))
    sizes = cds.select("gene", (F.length("seq") / 3).alias("n"))
    cells = families.join(F.broadcast(symbols.where("n_syn > 1")), "aa").join(sizes, "gene").join(used.select("gene", "codon", "cnt"), ["gene", "codon"], "left")
    return cells.where(F.col("n") >= least).select("gene", "codon", "aa", (F.col("n_syn") * F.coalesce("cnt", F.lit(0)) / F.col("total")).alias("rscu"))


def deviation(values: DataFrame, key: str, value: str, chosen: DataFrame | None, n_all: DataFrame) -> DataFrame:
    """(key, observed, expected, sd, z_score): a set's mean of a sparse value against all genes. n_all: one row, n and n_set. Without chosen, values
    have inside from marked."""
    held = values if chosen is None else values.join(chosen.withColumn("inside", F.lit(1)), "gene", "left")
    sums = held.groupBy(key).agg(
        F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"), F.coalesce(F.sum(F.when(F.col("inside") == 1, F.col(value))), F.lit(0.0)).alias("t"))
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    d = sums.join(F.broadcast(n_all)).select(key, (F.col("t") / F.col("n_set")).alias("observed"), (F.col("s") / F.col("n")).alias("expected"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"), "n_set")
    return d.select(key, "observed", "expected", "sd", "n_set", F.when(F.col("sd") > 1e-12, (F.col("observed") - F.col("expected")) / (F.col("sd") / F.sqrt("n_set"))).otherwise(0.0).alias("z_score"))


ALPHA = 0.05  # a test counts as significant if its adjusted p is below


def attribution(aa: DataFrame, codon: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(codon, aa, aa_z, rscu_z, aa_p, rscu_p, attribution). aa: (aa, z_score, adjusted_p); codon: (codon, aa, z_score, adjusted_p)."""
    left = aa.select("aa", F.col("z_score").alias("aa_z"), F.col("adjusted_p").alias("aa_p"))
    both = codon.select("codon", "aa", F.col("z_score").alias("rscu_z"), F.col("adjusted_p").alias("rscu_p")).join(F.broadcast(left), "aa", "left").na.fill({"aa_z": 0.0, "aa_p": 1.0})
    a, r = F.col("aa_p") < alpha, F.col("rscu_p") < alpha
    return both.select("codon", "aa", "aa_z", "rscu_z", "aa_p", "rscu_p", F.when(a & r, "Both").when(a, "AA-driven").when(r, "Synonymous-driven").otherwise("None").alias("attribution"))


def attribution_summary(attributed: DataFrame) -> DataFrame:
    """One row: n_significant, the numbers of each kind and their shares of the significant ones in percent, 0 without any."""
    kinds = (("aa_driven", "AA-driven"), ("synonymous_driven", "Synonymous-driven"), ("both", "Both"))
    n = attributed.agg(F.count_if(F.col("attribution") != "None").alias("n_significant"), *[F.count_if(F.col("attribution") == v).alias(f"n_{k}") for k, v in kinds])
    return n.select("n_significant", *[f"n_{k}" for k, _ in kinds], *[F.coalesce(F.try_divide(100.0 * F.col(f"n_{k}"), F.col("n_significant")), F.lit(0.0)).alias(f"pct_{k}") for k, _ in kinds])


def synonymous_drivers(codon: DataFrame, rules: DataFrame, alpha: float = ALPHA, high: int = 5) -> DataFrame:
    """(codon, aa, rscu_z, driver, gc3, decoding_type, copies) of the codons with a significant synonymous deviation.

    codon: (codon, aa, n_syn, z_score, adjusted_p). Of the explanations the first that fits counts: none for a family of one codon; a favoured
    codon that is read without wobble by a tRNA that exists; one with over high tRNA copies; favoured if it ends in G or C, or not if it does not."""
    rows = codon.where(F.col("adjusted_p") < alpha).join(F.broadcast(rules.select("codon", "decoding_type", "copies")), "codon", "left").withColumn("gc3", F.substring("codon", 3, 1).isin("G", "C").cast("int"))
    up, copies = F.col("z_score") > 0, F.coalesce("copies", F.lit(0))
    driver = (
        F.when(F.col("n_syn") <= 1, "not_applicable").when(up & (F.col("decoding_type") == "watson_crick") & (copies > 0), "wobble_avoidance").when(up & (copies > high), "tRNA_supply")
        .when((up & (F.col("gc3") == 1)) | (~up & (F.col("gc3") == 0)), "GC3_bias").otherwise("unclassified")
    )
    return rows.select("codon", "aa", F.col("z_score").alias("rscu_z"), driver.alias("driver"), "gc3", F.coalesce("decoding_type", F.lit("unknown")).alias("decoding_type"), copies.alias("copies"))


def contributions(cds: DataFrame, chosen: DataFrame, codons: list[str], means: DataFrame | None = None) -> DataFrame:
    """(kmer, gene, frequency, contribution) for each codon and gene of a set, as drivers has them, without ranks: the means of all genes (kmer, mean) are given, or come from one
    pass of sums by codon, and only the set's symbols are counted. Each row of the set brings one more of every codon asked for, which is taken off again."""
    if means is None:
        means = geneset_mean(cds, 1).select("kmer", F.col("observed").alias("mean"))
    means = means.where(F.col("kmer").isin(codons))
    held = members(cds, chosen).select("gene", F.coalesce("seq", F.lit("")).alias("seq"), F.monotonically_increasing_id().alias("row"))
    each = held.select("gene", "row", (F.length("seq") / 3).alias("n"), F.explode(F.concat(sequences.codon_array(F.col("seq")), F.array(*map(F.lit, codons)))).alias("kmer"))
    counts = each.where(F.col("kmer").isin(codons)).groupBy("gene", "row", "n", "kmer").agg((F.count("*") - 1).alias("cnt"))
    rows = counts.select("kmer", "gene", F.coalesce(F.try_divide("cnt", "n"), F.lit(0.0)).alias("frequency"))
    return rows.join(F.broadcast(means), "kmer", "left").select("kmer", "gene", "frequency", (F.col("frequency") - F.coalesce("mean", F.lit(0.0))).alias("contribution"))


def drivers(cds: DataFrame, chosen: DataFrame, codons: list[str]) -> DataFrame:
    """(kmer, gene, frequency, contribution, rank, cum, influential) for each codon and gene of a set.

    contribution: the gene's frequency less the mean of all genes. rank: by contribution, falling where the set's mean is above that of
    all genes and rising where it is below. by_size, cum: rank and share of the sizes by falling size. influential: leaving the gene out moves the
    set's z-score by over 2."""
    per = sequences.target_freq(cds, codons).drop("n").join(chosen.distinct().withColumn("_in", F.lit(True)), "gene", "left")
    moments = per.agg(*[f(c).alias(f"{name}_{c}") for c in codons for name, f in (("m", F.avg), ("sd", F.stddev_samp), ("g", lambda c: F.avg(F.when(F.col("_in"), F.col(c)))), ("a", lambda c: F.sum(F.abs(F.when(F.col("_in"), F.col(c))))))], F.count("_in").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("kmer"), F.col(c).alias("frequency"), F.col(f"m_{c}").alias("mean"), F.col(f"sd_{c}").alias("sd"), F.col(f"g_{c}").alias("set_mean")) for c in codons])).alias("x")
    rows = per.where("_in").join(F.broadcast(moments)).select("gene", "n", each).select("gene", "n", "x.*").withColumn("contribution", F.col("frequency") - F.col("mean")).withColumn("size", F.round(F.abs("contribution"), 15))
    spread = F.col("sd") / F.sqrt("n")
    left_out = ((F.col("n") * F.col("set_mean") - F.col("frequency")) / (F.col("n") - 1) - F.col("mean")) / (F.col("sd") / F.sqrt(F.col("n") - 1))
    moved = F.when((F.col("n") > 1) & (F.col("sd") > 0), F.abs((F.col("set_mean") - F.col("mean")) / spread - left_out) > 2).otherwise(False)
    rows = rows.select("kmer", "gene", "frequency", "contribution", "size", (-F.col("size")).alias("_size"), F.round(F.when(F.col("set_mean") > F.col("mean"), -F.col("contribution")).otherwise(F.col("contribution")), 15).alias("_signed"), moved.alias("influential")).persist()  # a row for each gene of the set and codon, read several times
    signed = stats.running(rows, ["kmer"], "_signed", ["gene"]).withColumnRenamed("rank", "_rank").drop("cum")
    total = rows.groupBy("kmer").agg(F.sum("size").alias("_total"))
    sized = stats.running(signed, ["kmer"], "_size", ["gene"], "size").join(F.broadcast(total), "kmer")
    return sized.select("kmer", "gene", "frequency", "contribution", "size", F.col("_rank").alias("rank"), F.col("rank").alias("by_size"), F.try_divide("cum", "_total").alias("cum"), "influential")


def driver_summary(genes: DataFrame) -> DataFrame:
    """(kmer, n_genes, n50, n80, gini, n_influential, top_driver, top_contribution): how few genes a codon's deviation rests on."""
    near = F.col("cum") + 1e-9
    n, s = F.count("*"), F.sum("size")
    return genes.groupBy("kmer").agg(
        n.alias("n_genes"), F.coalesce(F.min(F.when(near >= 0.5, F.col("by_size"))), n).alias("n50"), F.coalesce(F.min(F.when(near >= 0.8, F.col("by_size"))), n).alias("n80"),
        F.when(s > 0, (2 * ((n + 1) * s - F.sum(F.col("by_size") * F.col("size"))) / (n * s)) - (n + 1) / n).otherwise(0.0).alias("gini"),
        F.count_if("influential").alias("n_influential"), F.min_by("gene", "rank").alias("top_driver"), F.min_by("contribution", "rank").alias("top_contribution"),
    )


def positional_freq(cds: DataFrame, symbols: DataFrame, bins: int = 100, *carried: str) -> DataFrame:
    """(gene, bin, codon, freq): within bins of relative position, over sense codons. carried: columns of a gene that ride along."""
    binned = positions(cds, *carried).join(F.broadcast(symbols.select("codon")), "codon").withColumn("bin", F.least(F.floor(F.col("pos") / F.col("n") * bins), F.lit(bins - 1)).cast("int"))
    per = binned.groupBy("gene", "bin", "codon", *carried).agg(F.count("*").alias("cnt"))
    return per.select("gene", *carried, "bin", "codon", (F.col("cnt") / F.sum("cnt").over(Window.partitionBy("gene", "bin"))).alias("freq"))
