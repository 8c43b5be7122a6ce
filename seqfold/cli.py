"""python -m seqfold.cli MODE --cds DIR --genes FILE ...: runs an analysis over Parquet or FASTA and writes tables of text."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqfold.functions import dims
from seqfold.plans import modes
from seqfold.sources import backgrounds, blocks, readers, results, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqfold")
    p.add_argument("mode", choices=["enrichment", "demand", "optimality", "collision", "compare", "attribution", "cai", "reverse", "deep-dive", "differential", "report", "sets", "background"])
    p.add_argument("--cds", required=True, help="Parquet (gene, seq), or FASTA by its suffix")
    p.add_argument("--species", default="yeast", choices=dims.known_species(), help="whose tRNAs and wobble rules hold")
    p.add_argument("--trna", help="FASTA of tRNA genes, whose copies hold instead of the fixed ones if they name 20 anticodons")
    p.add_argument("--genes", help="gene list: # comments, commas or white space")
    p.add_argument("--gene-sets", help="a folder of gene lists, for sets")
    p.add_argument("--results", help="a folder that an enrichment wrote, from which a deep-dive starts")
    p.add_argument("--backgrounds", help="a store that background wrote, read by enrichment and differential; background itself renews in it the shards of --genes, or all")
    p.add_argument("--genes-b", help="second list of a differential")
    p.add_argument("--expression", help="tab-separated: gene, tpm")
    p.add_argument("--samples", help="tab-separated: sample, gene, tpm of tissues, from which the abundances are chosen")
    p.add_argument("--line-samples", help="the same of cell lines")
    p.add_argument("--tissue", help="which tissue of --samples; without one their median")
    p.add_argument("--cell-line", help="which cell line of --line-samples, or the tissue that stands for it")
    p.add_argument("--output-dir", help="where the tables go; not needed by background")
    p.add_argument("--digits", type=int, default=6, help="significant digits of what is written; 17 keep all, for a later deep-dive")
    p.add_argument("--kmer", type=int, default=1, choices=[1, 2, 3])
    p.add_argument("--background", default="all", choices=["all", "matched"])
    p.add_argument("--model", default="analytic", choices=["analytic", "bootstrap", "glm"])
    p.add_argument("--trim-ramp", type=int, default=0)
    p.add_argument("--n-bootstrap", type=int, default=10_000)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--window", type=int, default=10)
    p.add_argument("--wobble-penalty", type=float, default=0.5)
    p.add_argument("--ramp-codons", type=int, default=50)
    p.add_argument("--threshold", type=float)
    p.add_argument("--top-n", type=int)
    p.add_argument("--codons", default="")
    p.add_argument("--top", type=int)
    p.add_argument("--zscore-cutoff", type=float)
    p.add_argument("--percentile", type=float)
    p.add_argument("--check", action="store_true", help="test what reverse finds as a set of its own, if ten genes or more")
    p.add_argument("--method", default="wtai", choices=["tai", "wtai"])
    p.add_argument("--min-genes", type=int, default=10)
    p.add_argument("--adj-p", type=float, default=0.05)
    p.add_argument("--positional", action="store_true")
    p.add_argument("--cluster", action="store_true")
    p.add_argument("--cluster-codons", default="")
    p.add_argument("--cluster-top", type=int, default=5)
    p.add_argument("--cluster-window", type=int, default=15)
    p.add_argument("--permutations", type=int, default=1000)
    p.add_argument("--cds-2", help="sequences of the other species of compare")
    p.add_argument("--orthologs", help="tab-separated: g1, g2")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("seqfold").getOrCreate()

    def sequences(path: str):
        if not any(x in path for x in (".fa", ".fasta", ".fsa")):
            rows = spark.read.parquet(path)
        elif path.endswith((".gz", ".bgz")):
            rows = blocks.sequences(spark, path, ("gene", "seq"))  # in ranges, if the blocks allow it
        else:
            rows = readers.fasta(spark, path)
        return rows.select(F.col("gene").cast("string").alias("gene"), "seq")

    cds = sequences(a.cds)

    def listed(path: str):
        return readers.gene_list(spark.read.text(path)).select(F.col("token").alias("gene")).distinct()

    chosen = listed(a.genes) if a.genes else None
    earlier, _, problems = results.read(spark, a.results) if a.results else ({}, {}, [])
    for problem in problems:
        print(problem, file=sys.stderr)
    if chosen is None and "genes" in earlier:
        chosen = earlier["genes"]
    if a.mode == "background":
        if not a.backgrounds:
            raise SystemExit("background needs --backgrounds")
        if chosen is None:
            backgrounds.write(cds, a.backgrounds, a.species, a.kmer)
        else:
            backgrounds.refresh(cds, a.backgrounds, a.species, a.kmer, chosen)
        return
    if not a.output_dir:
        raise SystemExit("--output-dir is needed")

    def moments(k: int):
        return backgrounds.read(spark, a.backgrounds, a.species, k) if a.backgrounds else None

    expression = readers.table(spark, a.expression, "gene string, tpm double") if a.expression else None
    if expression is None and a.samples:
        tissues, lines = (readers.table(spark, x, "sample string, gene string, tpm double") if x else None for x in (a.samples, a.line_samples))
        expression = modes.expression_for(tissues, a.tissue, a.cell_line, lines)
    found = readers.trna_headers(spark.read.text(a.trna).where("startswith(value, '>')").withColumn("line", F.monotonically_increasing_id())) if a.trna else None
    run = {
        "enrichment": lambda: modes.composition(cds, chosen, a.kmer, a.background, a.trim_ramp, a.model, a.n_bootstrap, a.seed, moments(a.kmer)) | {"genes": chosen},
        "sets": lambda: modes.gene_sets(cds, readers.gene_sets(spark, a.gene_sets), a.kmer),
        "demand": lambda: modes.demand(cds, chosen, expression, a.kmer, a.top_n, a.n_bootstrap, a.seed),
        "optimality": lambda: modes.profile(cds, chosen, a.window, a.wobble_penalty, a.ramp_codons, a.method, a.species, found),
        "collision": lambda: modes.collision(cds, chosen, a.wobble_penalty, a.threshold, a.method, a.species, found),
        "compare": lambda: modes.compare(cds, sequences(a.cds_2), readers.table(spark, a.orthologs, "g1 string, g2 string"), chosen.withColumnRenamed("gene", "g1"), a.n_bootstrap, a.seed),
        "attribution": lambda: modes.disentangle(cds, chosen, a.species, found),
        "cai": lambda: modes.adaptation(cds, chosen, expression),
        "reverse": lambda: reverse(),
        "deep-dive": lambda: deep_dive(),
        "differential": lambda: modes.differential(cds, chosen, listed(a.genes_b), a.species, moments(1)),
        "report": lambda: modes.report(cds, chosen, expression, a.n_bootstrap, a.seed, a.species, found)[0],
    }

    def reverse() -> dict:
        found = modes.reverse(cds, a.codons.split(","), a.top, a.zscore_cutoff, a.percentile)
        enough = a.check and found.limit(10).count() == 10
        return {"genes": found} | ({"check": modes.composition(cds, found.select("gene"), n_bootstrap=a.n_bootstrap)["results"]} if enough else {})

    def deep_dive() -> dict:
        if "results" in earlier:
            out = modes.deep_dive(cds, chosen, earlier["results"], a.adj_p, a.cluster_top if a.cluster else None, a.cluster_window, a.permutations, a.seed)
            return out | ({f"positional_{k}": v for k, v in modes.positional(cds, chosen).items()} if a.positional else {})
        out = {f"drivers_{k}": v for k, v in modes.drivers(cds, chosen, adj_p=a.adj_p).items()}
        if a.positional:
            out |= {f"positional_{k}": v for k, v in modes.positional(cds, chosen).items()}
        if a.cluster:
            picked = [c for c in a.cluster_codons.split(",") if c] or None
            out |= {f"cluster_{k}": v for k, v in modes.clusters(cds, chosen, picked, a.cluster_window, a.permutations, a.seed, a.cluster_top).items()}
        return out

    sinks.bundle(run[a.mode](), {k: v for k, v in vars(a).items() if v is not None}, a.output_dir, a.digits)


if __name__ == "__main__":
    main()
