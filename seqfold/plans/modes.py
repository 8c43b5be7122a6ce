"""The analyses as functions of frames: sequences (gene, seq), sets (gene), abundances (gene, tpm), ortholog pairs (g1, g2).

Each returns a dictionary of DataFrames, lazily planned. Sets are frames, never lists. A resampled score comes from bootstrap
draws of whole genes, an analytic one from the closed form of the same standard error."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqfold.functions import dims, stats
from seqfold.operators import frequency, glm, many, names, ordered, resample, sequences, tables, weights
from seqfold.sources import ingest, shared

POWER = {1: 10, 2: 30, 3: 100}  # genes that a set should have for k


def _tested(df: DataFrame, key: str = "kmer") -> DataFrame:
    return stats.bh(df.withColumn("p_value", stats.normal_p("z_score")), "p_value", key)


def composition(cds: DataFrame, chosen: DataFrame, k: int = 1, background: str = "all", trim_ramp: int = 0, model: str = "analytic", n_bootstrap: int = 10_000, seed: int = 42, moments: DataFrame | None = None) -> dict[str, DataFrame]:
    """k-mer usage of a set against all genes, or against those with its range of length and GC. Trimming holds for the set only.
    moments: (kmer, mean, sd) of all genes, as backgrounds.read has them; they spare the pass over all sequences."""
    if k not in POWER:
        raise ValueError("k is 1, 2 or 3")
    if background not in ("all", "matched") or model not in ("analytic", "bootstrap", "glm"):
        raise ValueError("background is all or matched; model is analytic, bootstrap or glm")
    if k == 3 and model == "bootstrap":
        raise ValueError("triplets are tested in closed form")
    shape = cds.select("gene", F.length("seq").alias("len"), sequences.gc(F.col("seq")).alias("gc"))
    pool = cds if background == "all" else frequency.members(cds, frequency.matched_pool(shape, chosen).select("gene"))
    inside = sequences.trimmed(frequency.members(cds, chosen), trim_ramp)
    observed = frequency.geneset_mean(inside, k)
    marked = shape.join(chosen.distinct().withColumn("in_a", F.lit(True)), "gene", "left").na.fill(False, ["in_a"])
    out = {"length_ks": stats.ks(marked, "len", "in_a"), "gc_ks": stats.ks(marked, "gc", "in_a"), "n_genes": inside.agg(F.count("*").alias("n_genes"), (F.count("*") < POWER[k]).alias("underpowered"))}
    if model == "glm":
        if k != 1:
            raise ValueError("the regression is for k = 1")
        return out | {"results": _tested(_regression(cds, chosen), "codon")}
    stat = frequency.background(cds, k) if moments is None else moments
    if model == "bootstrap":
        scored = resample.bootstrap_kmers(sequences.kmer_freq(pool, k), pool.select("gene"), observed, inside.count(), n_bootstrap, seed).withColumnRenamed("mean_b", "expected").drop("sd_b")
    else:
        size = inside.agg(F.count("*").alias("n_set"))
        both = (stat if background == "all" else frequency.background(pool, k)).join(observed, "kmer", "left").join(F.broadcast(size))
        seen = F.coalesce("observed", F.lit(0.0))
        scored = both.select("kmer", seen.alias("observed"), F.col("mean").alias("expected"), F.when(F.col("sd") > 0, (seen - F.col("mean")) / (F.col("sd") / F.sqrt("n_set"))).otherwise(0.0).alias("z_score"))
    effect = scored.join(stat, "kmer").withColumn("cohens_d", F.when(F.col("sd") > 0, (F.col("observed") - F.col("mean")) / F.col("sd")).otherwise(0.0)).drop("mean", "sd")
    return out | {"results": _tested(effect).withColumn("families", families(F.col("kmer")))}


def families(kmer):
    """Lys-Ala of AAGGCT; ? for what is no sense codon."""
    table = F.create_map(*[F.lit(x) for c, f in dims.FAMILY.items() for x in (c, f)])
    return F.array_join(F.transform(sequences.codon_array(kmer), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("?"))), "-")


def annotated(kmer):
    """AAG-GCT (Lys-Ala) of AAGGCT."""
    return F.concat(F.array_join(sequences.codon_array(kmer), "-"), F.lit(" ("), families(kmer), F.lit(")"))


def tpm_of_counts(counts: DataFrame, keys: DataFrame | None = None, least: float = 0) -> DataFrame:
    """(gene, tpm), largest first, of raw counts (gene, count, length); without lengths of their own those under keys (key, length)."""
    known = counts if keys is None else ingest.with_lengths(counts, keys)
    return weights.tpm(known.where(F.col("count") >= least)).orderBy(F.desc("tpm"), "gene")


def _regression(cds: DataFrame, chosen: DataFrame) -> DataFrame:
    return glm.by_codon(glm.shares(cds, chosen, dims.symbols(cds.sparkSession)))


def expression_for(samples: DataFrame, tissue: str | None = None, cell_line: str | None = None, lines: DataFrame | None = None) -> DataFrame:
    """(gene, tpm) of one sample. samples, lines: (sample, gene, tpm) of tissues and of cell lines; without a name, the median over all tissues.

    A tissue is the one that is named, else the first, by name, that holds the asked one; a cell line is matched in both directions, and without a
    match the tissue that stands for it is taken. A name that fits nothing is an error that lists what there is."""
    if tissue is not None and cell_line is not None:
        raise ValueError("a tissue or a cell line, not both")
    if tissue is None and cell_line is None:
        return samples.groupBy("gene").agg(F.median("tpm").alias("tpm"))

    def listed(df: DataFrame) -> DataFrame:
        return df.select(F.col("sample").alias("name")).distinct().withColumn("place", F.col("name"))

    def asked(name: str) -> DataFrame:
        return samples.sparkSession.createDataFrame([(name,)], "ask string")

    found = None
    if cell_line is not None:
        known = listed(lines) if lines is not None else listed(samples).where("false")
        found = names.cell_lines(asked(cell_line), known).first()
        if found["how"] in ("exact", "substring"):
            return lines.where(F.col("sample") == found["name"]).select("gene", "tpm")
        tissue = found["name"]
    best = names.tissues(asked(tissue), listed(samples)).first()["name"] if tissue is not None else None
    if best is None:
        there = [r.name for r in listed(samples if cell_line is None or lines is None else lines).orderBy("name").limit(20).collect()]
        raise ValueError(f"no sample for {cell_line or tissue!r}; there are {', '.join(there)} and possibly more")
    return samples.where(F.col("sample") == best).select("gene", "tpm")


def demand(cds: DataFrame, chosen: DataFrame, expression: DataFrame, k: int = 1, top_n: int | None = None, n_bootstrap: int = 10_000, seed: int = 42) -> dict[str, DataFrame]:
    """Usage weighted by abundance and length, against resampled genes; top_n holds for the background only."""
    inside = frequency.members(cds, chosen)
    genes = weights.demand_rank(cds, expression).where("weight > 0").select("gene", "weight")
    if top_n is not None:
        genes = genes.orderBy(F.desc("weight"), "gene").limit(top_n)
    observed = weights.demand(inside, expression, k).withColumnRenamed("demand", "observed")
    scored = resample.bootstrap_kmers(sequences.kmer_freq(cds, k).join(genes.select("gene"), "gene", "left_semi"), genes, observed, inside.count(), n_bootstrap, seed, "weight")
    return {"results": _tested(scored), "top_genes": weights.demand_rank(inside, expression).orderBy(F.desc("weight"), "gene")}


def decoding_rules(spark: SparkSession, species: str, found: DataFrame | None = None) -> DataFrame:
    """How a species reads codons, with its tRNA copies: those found (aa, anticodon, copies) if they are enough, else its fixed ones."""
    return weights.with_copies(dims.wobble_rules(spark, species), dims.trna_copies(spark, species, found))


def profile(cds: DataFrame, chosen: DataFrame, window: int = 10, wobble_penalty: float = 0.5, ramp_codons: int = 50, method: str = "wtai", species: str = "yeast", found: DataFrame | None = None) -> dict[str, DataFrame]:
    """Optimality along genes by a species' tRNAs: metagene profiles, ramp against body, scores by gene, composition of both regions."""
    spark, inside = cds.sparkSession, frequency.members(cds, chosen)
    w = weights.tai_weights(decoding_rules(spark, species, found), wobble_penalty)
    lines = {name: ordered.metagene(ordered.smoothed(ordered.scored(sequences.positions(c), w, method), window)).withColumnRenamed("profile", name) for name, c in (("geneset", inside), ("genome", cds))}
    track = ordered.scored(sequences.positions(inside), w, method).where(F.col("n") > ramp_codons)
    halves = track.groupBy("gene").agg(F.avg(F.when(F.col("pos") < ramp_codons, F.col("score"))).alias("ramp"), F.avg(F.when(F.col("pos") >= ramp_codons, F.col("score"))).alias("body"))
    return {"metagene": lines["geneset"].join(lines["genome"], "bin"), "ramp": halves.agg(F.avg("ramp").alias("ramp"), F.avg("body").alias("body"), (F.avg("ramp") - F.avg("body")).alias("delta")), "genes": weights.geometric(frequency.codon_counts(cds, dims.symbols(spark)), w, method, method)} | {f"{k}_composition": v for k, v in regions(cds, chosen, 0, ramp_codons, 1).items()}


def regions(cds: DataFrame, chosen: DataFrame, start: int = 1, ramp_codons: int = 50, least: int = 3, least_set: int = 5, least_all: int = 100) -> dict[str, DataFrame]:
    """Tested composition of the ramp, codons from start on, and of the body behind it; without least_set genes of the set and least_all of all a region is left out."""
    out = {}
    for name, a, b in (("ramp", start, start + ramp_codons), ("body", start + ramp_codons, None)):
        part = sequences.region(cds, a, b, least)
        if part.limit(least_all).count() == least_all and frequency.members(part, chosen).limit(least_set).count() == least_set:
            out[name] = _tested(frequency.composition(part, chosen.distinct(), 1))
    return out


def collision(cds: DataFrame, chosen: DataFrame, wobble_penalty: float = 0.5, threshold: float | None = None, method: str = "wtai", species: str = "yeast", found: DataFrame | None = None) -> dict[str, DataFrame]:
    """Transitions between codons that a species reads fast and slowly. A codon is fast from the threshold on, by default the median weight."""
    spark, inside = cds.sparkSession, frequency.members(cds, chosen)
    w = weights.tai_weights(decoding_rules(spark, species, found), wobble_penalty)
    values = sorted((r[method], r.codon) for r in w.collect())  # 61 rows
    middle = (values[30][0] + values[(len(values) - 1) // 2][0]) / 2 if threshold is None else threshold
    fast = [c for v, c in values if v >= middle]
    a, b = ordered.pair_counts(inside, fast), ordered.pair_counts(cds, fast)
    both = ordered.proportions(a).withColumn("of", F.lit("geneset")).unionByName(ordered.proportions(b).withColumn("of", F.lit("genome")))
    share = F.try_divide("fs", F.col("ff") + F.col("fs") + F.col("sf") + F.col("ss"))
    deciles = ordered.fs_deciles(inside, fast).withColumnRenamed("n", "geneset").join(ordered.fs_deciles(cds, fast).withColumnRenamed("n", "genome"), "bin", "full").na.fill(0)
    return {
        "proportions": both, "comparison": ordered.compared(a, b), "genes": a.withColumn("fs_share", share).orderBy(F.desc("fs_share"), "gene"),
        "deciles": deciles, "dicodons": _tested(ordered.fs_pairs(cds, chosen.distinct(), dims.symbols(spark), fast)),
    }


def disentangle(cds: DataFrame, chosen: DataFrame, species: str = "yeast", found: DataFrame | None = None) -> dict[str, DataFrame]:
    """Family-level and within-family deviations, what each codon's deviation is due to, and what explains the synonymous ones."""
    spark, chosen = cds.sparkSession, chosen.distinct()
    symbols = dims.symbols(spark)
    counts = frequency.codon_counts(cds, symbols)
    n = cds.agg(F.count("*").alias("n")).join(F.broadcast(frequency.members(cds, chosen).agg(F.count("*").alias("n_set"))))
    aa = _tested(frequency.deviation(frequency.aa_freq(counts), "aa", "freq", chosen, n), "aa")
    codon = _tested(frequency.deviation(frequency.rscu(counts), "codon", "rscu", chosen, n), "codon").join(F.broadcast(symbols), "codon")
    named = frequency.attribution(aa, codon)
    rules = decoding_rules(spark, species, found)
    return {"families": aa, "codons": codon, "attribution": named, "summary": frequency.attribution_summary(named), "drivers": frequency.synonymous_drivers(codon, rules)}


def compare(cds1: DataFrame, cds2: DataFrame, pairs: DataFrame, chosen: DataFrame, n_bootstrap: int = 10_000, seed: int = 42) -> dict[str, DataFrame]:
    """Correlation of synonymous usage between paired genes of two populations; chosen: (g1). The set's mean is tested against resampled
    means of all pairs, and the set's pairs in the lowest quarter are listed with the number of families whose preferred codon differs."""
    symbols = dims.symbols(cds1.sparkSession)
    left, right = (frequency.rscu_dense(c, frequency.codon_counts(c, symbols), symbols) for c in (cds1, cds2))
    rows = pairs.join(left.select(F.col("gene").alias("g1"), "codon", "aa", F.col("rscu").alias("x")), "g1").join(right.select(F.col("gene").alias("g2"), "codon", F.col("rscu").alias("y")), ["g2", "codon"])
    ok = (F.count("*") >= 5) & (F.stddev_pop("x") > 1e-12) & (F.stddev_pop("y") > 1e-12)
    corr = rows.groupBy("g1", "g2").agg(F.count("*").alias("n"), F.when(ok, F.corr("x", "y")).alias("r")).persist()  # a row for each pair, read by every table
    marked = corr.where("r is not null").join(chosen.distinct().withColumn("in_a", F.lit(True)), "g1", "left").na.fill(False, ["in_a"]).withColumn("all", F.lit(1))
    inside, centre = marked.where("in_a"), marked.agg(F.avg("r").alias("mean_all"))
    means = resample.multinomial_mean(marked.select(F.struct("g1", "g2").alias("key"), F.col("r").alias("value")), inside.count(), n_bootstrap, seed)
    drawn = means.agg(F.stddev_samp("mean").alias("sd_b")).join(F.broadcast(inside.agg(F.avg("r").alias("observed"))))
    boot = drawn.join(F.broadcast(centre)).select("observed", "mean_all", "sd_b", F.when(F.col("sd_b") > 0, (F.col("observed") - F.col("mean_all")) / F.col("sd_b")).otherwise(0.0).alias("z_score"))
    summary = marked.groupBy("in_a").agg(F.count("*").alias("n"), F.avg("r").alias("mean_r"), F.median("r").alias("median_r"), F.stddev_samp("r").alias("sd_r"))
    own = marked.where("in_a")
    low = own.join(F.broadcast(own.agg(F.percentile("r", F.lit(0.25)).alias("cut"))), F.col("r") <= F.col("cut") + 1e-12).select("g1", "g2", "r")
    best = rows.join(low, ["g1", "g2"]).groupBy("g1", "g2", "r", "aa").agg(*[F.min(F.struct((-F.round(v, 9)).alias("o"), "codon"))["codon"].alias(n) for v, n in (("x", "c1"), ("y", "c2"))])
    divergent = best.groupBy("g1", "g2", "r").agg(F.count_if(F.col("c1") != F.col("c2")).alias("n_differ"))
    return {"pairs": corr, "scatter": rows, "summary": summary, "bootstrap": boot.withColumn("p_value", stats.normal_p("z_score")), "divergent": divergent, "test": stats.mann_whitney(marked, "r", "in_a", "all")}


def adaptation(cds: DataFrame, chosen: DataFrame, expression: DataFrame, top_fraction: float = 0.05) -> dict[str, DataFrame]:
    """Adaptation index of every gene to the most abundant ones, and a set's place among all."""
    counts = frequency.codon_counts(cds, dims.symbols(cds.sparkSession))
    w = weights.cai_weights(counts, expression, top_fraction)
    scores = weights.geometric(counts.where("n_syn > 1"), w, "weight", "cai")
    marked = scores.join(chosen.distinct().withColumn("in_a", F.lit(True)), "gene", "left").na.fill(False, ["in_a"]).withColumn("all", F.lit(1))
    mean = marked.where("in_a").agg(F.avg("cai").alias("mean"), F.median("cai").alias("median"))
    place = marked.join(F.broadcast(mean)).groupBy("mean", "median").agg((100 * F.avg((F.col("cai") <= F.col("mean")).cast("double"))).alias("percentile"))
    return {"genes": scores, "weights": w, "summary": place, "test": stats.mann_whitney(marked, "cai", "in_a", "all")}


def reverse(cds: DataFrame, codons: list[str], top: int | None = None, zscore_cutoff: float | None = None, percentile: float | None = None) -> DataFrame:
    """Genes rich in the codons: the top ones, else those over a z, else over a percentile, else over z = 2."""
    targets = [c.upper().replace("U", "T") for c in codons]
    if unknown := [c for c in targets if c not in dims.FAMILY]:
        raise ValueError(f"not sense codons: {unknown}")
    scored = frequency.target_z(cds, list(dict.fromkeys(targets)))
    if top is not None:
        return scored.orderBy(F.desc("mean_z"), "gene").limit(top)
    if zscore_cutoff is not None or percentile is None:
        return scored.where(F.col("mean_z") >= (2.0 if zscore_cutoff is None else zscore_cutoff))
    cut = scored.agg(F.percentile("mean_z", F.lit(percentile / 100)).alias("cut"))
    return scored.join(F.broadcast(cut), F.col("mean_z") >= F.col("cut")).drop("cut")


def differential(cds: DataFrame, a: DataFrame, b: DataFrame, species: str = "yeast", moments: DataFrame | None = None) -> dict[str, DataFrame]:
    """Two sets against each other: means, fold change with its direction, rank test and each set's score against all genes for each codon,
    and what each set's deviations are due to. A gene of both counts to a in the rank test. moments: of all genes, as for composition."""
    sides = a.distinct().withColumn("in_a", F.lit(True)).unionByName(b.distinct().join(a, "gene", "left_anti").withColumn("in_a", F.lit(False)))
    genes = cds.select("gene").join(sides, "gene")
    symbols = dims.symbols(cds.sparkSession).select(F.col("codon").alias("kmer"))
    freq = sequences.kmer_freq(cds, 1).join(genes, "gene")
    total = genes.agg(F.count_if("in_a").alias("na"), F.count("*").alias("nn"))
    seen = freq.groupBy("kmer").agg(F.count_if("in_a").alias("pa"), F.count("*").alias("pn"), F.sum(F.when(F.col("in_a"), F.col("freq"))).alias("sa"), F.sum(F.when(~F.col("in_a"), F.col("freq"))).alias("sb"))
    known = F.broadcast(symbols).join(seen, "kmer", "left").na.fill(0).join(F.broadcast(total))
    zeros = known.select("kmer", F.lit(0.0).alias("freq"), (F.col("na") - F.col("pa")).alias("a"), (F.col("nn") - F.col("pn")).alias("t")).where("t > 0")
    counts = freq.groupBy("kmer", F.round("freq", 12).alias("freq")).agg(F.count_if("in_a").alias("a"), F.count("*").alias("t")).unionByName(zeros)
    means = known.select("kmer", F.try_divide("sa", "na").alias("mean_a"), F.try_divide("sb", F.col("nn") - F.col("na")).alias("mean_b"))
    fold = (F.coalesce("mean_a", F.lit(0.0)) + 1e-9) / (F.coalesce("mean_b", F.lit(0.0)) + 1e-9)
    tested = stats.mann_whitney_counts(counts, "freq", "kmer").join(means, "kmer").withColumn("fold", fold).withColumn("direction", F.when(fold > 1, "a").otherwise("b"))
    def against_all(x: DataFrame, name: str) -> DataFrame:
        scored = frequency.composition(cds, x.distinct(), 1) if moments is None else frequency.against(moments, frequency.members(cds, x), 1)
        return scored.select("kmer", F.col("z_score").alias(name))

    scores = [against_all(a, "genome_z_a"), against_all(b, "genome_z_b")]
    results = stats.bh(tested.withColumnRenamed("z", "z_score"), "p_value", "kmer").join(scores[0], "kmer", "left").join(scores[1], "kmer", "left")
    return {"results": results} | {f"attribution_{n}": disentangle(cds, x, species)["attribution"] for x, n in ((a, "a"), (b, "b"))}


def deep_dive(cds: DataFrame, chosen: DataFrame, results: DataFrame, adj_p: float = frequency.ALPHA, cluster_top: int | None = None, window: int = 15, permutations: int = 1000, seed: int = 42) -> dict[str, DataFrame]:
    """What stands behind tested results (kmer, z_score, adjusted_p), which may have been read from a results folder: drivers of every significant
    codon and, if cluster_top is given, the runs of the top ones. The composition is not computed again."""
    codons = strongest(results, adj_p)
    out = {f"drivers_{k}": v for k, v in drivers(cds, chosen, codons).items()}
    if cluster_top is not None:
        out |= {f"cluster_{k}": v for k, v in clusters(cds, chosen, codons[:cluster_top], window, permutations, seed).items()}
    return out


def drivers(cds: DataFrame, chosen: DataFrame, codons: list[str] | None = None, adj_p: float = frequency.ALPHA) -> dict[str, DataFrame]:
    """Which genes a set's deviation comes from, for the codons asked for, else for all significant ones: contributions, cumulative
    shares, influence when a gene is left out."""
    genes = frequency.drivers(cds, chosen, codons or significant(cds, chosen, adj_p))
    return {"genes": genes, "summary": frequency.driver_summary(genes)}


def gene_sets(cds: DataFrame, sets: DataFrame, k: int = 1, top: int = 30) -> dict[str, DataFrame]:
    """Every set of sets (name, gene) in all of a gene, its ramp and its body: tested composition, its strongest k-mers, and those biased between
    ramp and body. One pass over the sequences serves all sets and regions."""
    results = shared.written(many.compositions(cds, sets, k), "sets")  # summary rows, read by three tables
    place = F.row_number().over(Window.partitionBy("name", "region").orderBy(F.abs(F.round("z_score", 6)).desc(), "kmer"))
    best = results.where(F.col("adjusted_p") < frequency.ALPHA).withColumn("place", place).where(F.col("place") <= top)
    side = {r: results.where(F.col("region") == r).select("name", "kmer", F.col("z_score").alias(f"{r}_z"), F.col("adjusted_p").alias(f"{r}_p")) for r in ("ramp", "body")}
    both = side["ramp"].join(side["body"], ["name", "kmer"]).withColumn("delta", F.col("ramp_z") - F.col("body_z"))
    biased = both.where(((F.col("ramp_p") < frequency.ALPHA) | (F.col("body_p") < frequency.ALPHA)) & (F.abs("delta") > 2))
    return {"results": results, "top": best, "biased": biased}


def significant(cds: DataFrame, chosen: DataFrame, adj_p: float = frequency.ALPHA, top: int = 61) -> list[str]:
    """The top significant codons of a set by falling score, at most 61; all of them if none is significant."""
    return strongest(_tested(frequency.composition(cds, chosen.distinct(), 1)), adj_p, top)


def strongest(results: DataFrame, adj_p: float = frequency.ALPHA, top: int = 61) -> list[str]:
    """significant of results that are there: (kmer, z_score, adjusted_p)."""
    tested = results.where(F.col("adjusted_p") < adj_p)
    return [r.kmer for r in tested.orderBy(F.round("z_score", 9).desc(), "kmer").limit(top).collect()] or sorted(dims.FAMILY)[:top]


def positional(cds: DataFrame, chosen: DataFrame, bins: int = 100, top: int = 5) -> dict[str, DataFrame]:
    """Usage by relative position: a tested score for each bin and codon, and the codons with the largest and the least scores."""
    symbols, chosen = dims.symbols(cds.sparkSession), chosen.distinct()
    n = cds.agg(F.count("*").alias("n")).join(F.broadcast(frequency.members(cds, chosen).agg(F.count("*").alias("n_set"))))
    cells = frequency.positional_freq(frequency.marked(cds, chosen), symbols, bins, "inside").withColumn("cell", F.struct("bin", "codon"))
    z = frequency.deviation(cells, "cell", "freq", None, n).select("cell", "cell.bin", "cell.codon", "observed", "expected", "z_score")
    tested = _tested(z, "cell").drop("cell").withColumn("shown", F.when(F.col("adjusted_p") < frequency.ALPHA, F.col("z_score")).otherwise(0.0))
    per = z.groupBy("codon").agg(F.max(F.abs("z_score")).alias("largest"), F.min("z_score").alias("least"))
    return {"cells": tested, "top_enriched": per.orderBy(F.round("largest", 9).desc(), "codon").limit(top), "top_depleted": per.orderBy(F.round("least", 9), "codon").limit(top)}


def clusters(cds: DataFrame, chosen: DataFrame, codons: list[str] | None = None, window: int = 15, permutations: int = 1000, seed: int = 42, top: int = 5) -> dict[str, DataFrame]:
    """Runs and dense windows of target codons, by default the set's top significant ones, against synonymous shuffles."""
    codons, inside = codons or significant(cds, chosen, top=top), frequency.members(cds, chosen)
    pos, target = sequences.positions(inside), F.col("codon").isin(codons)
    tested = resample.shuffled_runs(inside, dims.FAMILY, codons, permutations, seed)
    genes = tested.join(ordered.runs(pos, target).select("gene", "longest"), "gene", "left").join(ordered.dense_windows(pos, target, window), "gene", "left").na.fill(0, ["longest", "n_windows"])
    return {"genes": genes, "summary": genes.agg(F.count("*").alias("n_genes"), F.avg("n_runs").alias("mean_runs"), F.max("longest").alias("longest"), F.avg((F.col("n_windows") > 0).cast("double")).alias("share_dense"), F.avg((F.col("p") < 0.05).cast("double")).alias("share_significant"))}


def report(cds: DataFrame, chosen: DataFrame, expression: DataFrame | None = None, n_bootstrap: int = 10_000, seed: int = 42, species: str = "yeast", found: DataFrame | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The tables of all analyses of a set, and the message of each analysis that could not be planned. Tables are lazy, to be written by sinks.bundle."""
    cds = cds.persist()
    parts = {
        "mono": lambda: composition(cds, chosen, seed=seed), "matched": lambda: composition(cds, chosen, background="matched", seed=seed), "glm": lambda: composition(cds, chosen, model="glm"),
        "di": lambda: composition(cds, chosen, k=2, seed=seed), "regions": lambda: regions(cds, chosen), "attribution": lambda: disentangle(cds, chosen, species, found), "optimality": lambda: profile(cds, chosen, species=species, found=found), "collision": lambda: collision(cds, chosen, species=species, found=found),
    }
    if expression is not None:
        parts |= {"cai": lambda: adaptation(cds, chosen, expression), "demand": lambda: demand(cds, chosen, expression, n_bootstrap=n_bootstrap, seed=seed)}
    out, failed = {}, {}
    for name, make in parts.items():
        try:
            got = make()
        except (ValueError, AnalysisException) as e:  # one analysis that does not fit the set leaves the others
            failed[name] = str(e)
            continue
        out |= {f"{name}_{k}": v for k, v in got.items()}
        if name in ("mono", "matched", "di"):
            out[f"{name}_top"] = tables.strongest(got["results"], 30)
        if name == "regions" and len(got) == 2:
            out["regions_biased"] = tables.biased(got["ramp"], got["body"]).where("biased").orderBy(F.abs("delta").desc(), "kmer").limit(20)
    symbols = sorted(dims.FAMILY)
    out["per_gene_codon_freq"] = sequences.target_freq(frequency.members(cds, chosen), symbols).drop("n")
    out["gene_metadata"] = frequency.members(cds, chosen).select("gene", F.length("seq").alias("cds_length"), sequences.gc(F.col("seq")).alias("gc_content"))
    return out, failed
