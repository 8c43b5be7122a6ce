import json

import pytest
from pyspark.sql import functions as F

from seqfold import cli
from seqfold.operators import sequences
from seqfold.plans import modes


@pytest.fixture(scope="module")
def cds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return sequences.from_documents(docs).select(F.col("gene").cast("string").alias("gene"), F.substring("seq", 1, 600).alias("seq")).cache()


@pytest.fixture(scope="module")
def chosen(cds):
    return cds.where("gene < '3'").select("gene").cache()


@pytest.fixture(scope="module")
def expression(cds):
    return cds.select("gene", (F.length("seq") + 1.0).alias("tpm")).cache()


def test_composition(cds, chosen):
    a = {r.kmer: r for r in modes.composition(cds, chosen)["results"].collect()}
    b = {r.kmer: r for r in modes.composition(cds, chosen, model="bootstrap", n_bootstrap=500)["results"].collect()}
    assert len(a) == 61 and a["AAA"].families == "Lys" and all(0 <= r.adjusted_p <= 1 and r.adjusted_p >= r.p_value - 1e-12 for r in a.values())
    assert all(abs(a[k].z_score - b[k].z_score) < 0.5 + 0.2 * abs(a[k].z_score) for k in a)
    m = modes.composition(cds, chosen, background="matched", trim_ramp=10)
    assert m["results"].count() == 61 and 0 <= m["length_ks"].first().d <= 1
    assert modes.composition(cds, chosen, model="glm")["results"].count() == 59
    with pytest.raises(ValueError):
        modes.composition(cds, chosen, k=0)


def test_other_modes(cds, chosen, expression):
    assert modes.demand(cds, chosen, expression, n_bootstrap=250)["results"].count() == 61
    assert modes.collision(cds, chosen)["proportions"].count() == 2
    parts = modes.disentangle(cds, chosen)
    assert parts["attribution"].count() == 61 and parts["summary"].first().n_significant == parts["attribution"].where("attribution <> 'None'").count()
    assert 0 <= modes.adaptation(cds, chosen, expression)["summary"].first().percentile <= 100
    assert modes.reverse(cds, ["gaa", "AGA"], top=7).count() == 7
    with pytest.raises(ValueError):
        modes.reverse(cds, ["TAA"])
    d = modes.differential(cds, chosen, cds.join(chosen, "gene", "left_anti").select("gene"))
    assert d["results"].count() == 61 and all((r.direction == "a") == (r.fold > 1) and r.genome_z_a * r.genome_z_b <= 0 for r in d["results"].collect()) and d["attribution_b"].count() == 61
    c = modes.collision(cds, chosen)
    assert 0 <= c["comparison"].first().p_value <= 1 and c["deciles"].count() == 10 and c["dicodons"].where("adjusted_p is null").count() == 0
    p = modes.positional(cds, chosen, 10)
    assert p["cells"].count() == 610 and p["top_enriched"].count() == p["top_depleted"].count() == 5
    s = modes.drivers(cds, chosen, ["GAA"])["summary"].first()
    assert 1 <= s.n50 <= s.n80 <= s.n_genes and 0 <= s.gini <= 1
    assert modes.clusters(cds, chosen.limit(5), ["GAA", "AGA"], permutations=20)["summary"].first().n_genes == 5


def test_profile_and_compare(cds, chosen):
    p = modes.profile(cds, chosen)
    assert p["metagene"].count() == 100 and p["ramp"].count() == 1
    pairs = cds.select(F.col("gene").alias("g1"), F.col("gene").alias("g2"))
    c = modes.compare(cds, cds, pairs, chosen.select(F.col("gene").alias("g1")))
    assert c["summary"].agg(F.min("mean_r")).first()[0] == pytest.approx(1.0)
    shifted = pairs.withColumn("g2", F.reverse("g2"))
    c = modes.compare(cds, cds, shifted, chosen.select(F.col("gene").alias("g1")), n_bootstrap=500)
    assert abs(c["bootstrap"].first().z_score) < 8 and c["divergent"].where("n_differ > 18").count() == 0
    assert set(modes.regions(cds, chosen)) == {"ramp", "body"} and modes.regions(cds.limit(20), chosen) == {}


def test_report_leaves_out_what_fails(cds, chosen, expression):
    tables, failed = modes.report(cds, chosen, expression, n_bootstrap=50)
    assert not failed and {"mono_results", "mono_top", "regions_biased", "attribution_drivers", "cai_summary", "demand_results", "per_gene_codon_freq"} <= set(tables)
    assert tables["per_gene_codon_freq"].count() == chosen.count() and len(tables["per_gene_codon_freq"].columns) == 62
    assert tables["mono_top"].count() <= 60


def test_command_line(cds, chosen, tmp_path):
    cds.write.parquet(str(tmp_path / "cds"))
    (tmp_path / "genes.txt").write_text("# a list\n" + ", ".join(r.gene for r in chosen.collect()) + "\n")
    cli.main(["attribution", "--cds", str(tmp_path / "cds"), "--genes", str(tmp_path / "genes.txt"), "--output-dir", str(tmp_path / "out")])
    spark = cds.sparkSession
    assert spark.read.csv(str(tmp_path / "out/codons"), sep="\t", header=True).count() == 61
    assert json.loads(spark.read.text(str(tmp_path / "out/config")).first().value)["mode"] == "attribution"
    cli.main(["deep-dive", "--cds", str(tmp_path / "cds"), "--genes", str(tmp_path / "genes.txt"), "--output-dir", str(tmp_path / "deep"), "--cluster", "--permutations", "5"])
    assert spark.read.csv(str(tmp_path / "deep/drivers_summary"), sep="\t", header=True).count() >= 1
    cli.main(["reverse", "--cds", str(tmp_path / "cds"), "--codons", "GAA", "--top", "12", "--check", "--output-dir", str(tmp_path / "rev")])
    assert spark.read.csv(str(tmp_path / "rev/check"), sep="\t", header=True).count() == 61


def test_species_decide_optimality_and_collision(spark, cds, chosen):
    scores = {s: {r.gene: r.wtai for r in modes.profile(cds, chosen, species=s)["genes"].collect()} for s in ("yeast", "human", "mouse")}
    assert scores["yeast"] != scores["human"] != scores["mouse"]
    fast = {s: modes.collision(cds, chosen, species=s)["proportions"].collect() for s in ("yeast", "human")}
    assert fast["yeast"] != fast["human"]
    few = spark.createDataFrame([("Leu", "UAA", 3)], "aa string, anticodon string, copies long")
    assert {r.gene: r.wtai for r in modes.profile(cds, chosen, found=few)["genes"].collect()} == scores["yeast"]  # too few are found: the fixed copies hold
    many = spark.createDataFrame([("X", a + b + "A", 1 + i) for i, (a, b) in enumerate((a, b) for a in "ACGU" for b in "ACGU")] + [("X", a + "AG", 2) for a in "ACGU"], "aa string, anticodon string, copies long")
    assert {r.gene: r.wtai for r in modes.profile(cds, chosen, found=many)["genes"].collect()} != scores["yeast"]


def test_weights_of_a_species_by_hand(spark):
    rules = {r.codon: r for r in modes.decoding_rules(spark, "human").collect()}
    most = max(r.copies for r in rules.values())
    w = {r.codon: r for r in modes.weights.tai_weights(modes.decoding_rules(spark, "human")).collect()}
    assert len(w) == 61 and all(abs(w[c].tai - (r.copies or 0.5) / most) < 1e-12 for c, r in rules.items())
