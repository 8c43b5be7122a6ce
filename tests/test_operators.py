"""Small inputs with answers worked out by hand."""

import math

import numpy as np
import pytest

from seqfold.functions import dims, stats
from seqfold.operators import glm, ids, ordered, resample, sequences, weights
from seqfold.sources import readers, sinks


def cds(spark, *seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "gene long, seq string")


def test_code_has_61_codons_in_20_families():
    assert len(dims.FAMILY) == 61 and len(set(dims.FAMILY.values())) == 20 and dims.SYNONYMS["ATG"] == 1
    assert len(dims.rules()) == 61 and sum(r[3] == "wobble" for r in dims.rules()) == 21
    assert len(dims.copies()) == 49 and sum(n for _, n in dims.copies()) == 287


def test_kmers(spark):
    one = {r.kmer: r.cnt for r in sequences.kmer_counts(cds(spark, "ATGAAAGAA"), 1).collect()}
    two = {r.kmer: r.cnt for r in sequences.kmer_counts(cds(spark, "ATGAAAGAA", "", "ATG"), 2).collect()}
    three = {r.kmer: r.cnt for r in sequences.kmer_counts(cds(spark, "ATGAAAGAACCC"), 3).collect()}
    assert one == {"ATG": 1, "AAA": 1, "GAA": 1} and two == {"ATGAAA": 1, "AAAGAA": 1} and three == {"ATGAAAGAA": 1, "AAAGAACCC": 1}


def test_gc3(spark):
    got = [r[0] for r in cds(spark, "AAGAACAAG", "AAAAATAAA", "AAGAAA", "").orderBy("gene").select(sequences.gc3(__import__("pyspark.sql.functions", fromlist=["col"]).col("seq"))).collect()]
    assert got == [1.0, 0.0, 0.5, 0.0]


def test_validation(spark):
    rows = sequences.validated(cds(spark, "ATGAAATAA", "ATGTAAAAATAA", "ATGAAA", "ATGNNNTAA", "ATGAATAA", None)).orderBy("gene").collect()
    assert [r.valid for r in rows] == [True, False, False, False, False, False] and rows[0].seq == "ATGAAA"


def test_bh_by_hand(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.20)], "k string, p double")
    got = {r.k: r.adjusted_p for r in stats.bh(df, "p", "k").collect()}
    assert got == pytest.approx({"a": 0.04, "b": 0.16 / 3, "c": 0.16 / 3, "d": 0.2})


def test_normal_tail(spark):
    got = [r[0] for r in spark.createDataFrame([(1.96,), (0.0,), (10.0,), (None,)], "z double").select(stats.normal_p("z")).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-4) and got[1] == 1.0 and got[2] == pytest.approx(1.5e-23, rel=0.05) and got[3] is None


def test_gini(spark):
    df = spark.createDataFrame([("u", i, 1.0) for i in range(200)] + [("c", i, 0.0) for i in range(199)] + [("c", 199, 1.0), ("z", 0, 0.0)], "k string, i int, v double")
    got = {r.k: r.gini for r in stats.gini(df, "k", "v", "i").collect()}
    assert abs(got["u"]) < 0.01 and got["c"] > 0.9 and got["z"] == 0.0


def test_smoothing_pads_with_zero(spark):
    track = spark.createDataFrame([(1, i, 12, float(i + 1)) for i in range(12)], "gene long, pos int, n int, score double")
    got = [round(r.smooth, 6) for r in ordered.smoothed(track).orderBy("pos").collect()]
    assert got == [1.5, 2.1, 2.8, 3.6, 4.5, 5.5, 6.5, 7.5, 7.2, 6.8, 6.3, 5.7]


def test_metagene_is_linear_interpolation(spark):
    rng = np.random.default_rng(1)
    tracks = {g: rng.random(n) for g, n in ((1, 30), (2, 77), (3, 250), (4, 10))}
    df = spark.createDataFrame([(g, i, len(v), float(x)) for g, v in tracks.items() for i, x in enumerate(v)], "gene long, pos int, n int, smooth double")
    got = [r.profile for r in ordered.metagene(df).orderBy("bin").collect()]
    want = np.mean([np.interp(np.linspace(0, len(v) - 1, 100), np.arange(len(v)), v) for v in tracks.values() if len(v) >= 30], axis=0)
    assert np.allclose(got, want)


def test_demand_weights(spark):
    seqs = cds(spark, "AAA" * 3, "TTT" * 4)
    expr = spark.createDataFrame([(0, 10000.0), (1, 1.0)], "gene long, tpm double")
    got = {r.kmer: r.demand for r in weights.demand(seqs, expr).collect()}
    assert got["AAA"] > 0.99 and got["TTT"] < 0.001
    assert {r.gene: r.weight for r in weights.demand_rank(seqs, expr).collect()} == {0: 30000.0, 1: 4.0}


def test_detection_and_resolution(spark):
    names = ["YAL001C", "ENSG00000141510.12", "ENST00000269305", "ENSMUSG00000059552", "NM_000546.6", "7157", "P04637", "SGD:S000000001", "MGI:98834", "TP53", "12"]
    kinds = [r.t for r in spark.createDataFrame([(x,) for x in names], "i string").select(ids.id_type(__import__("pyspark.sql.functions", fromlist=["col"]).col("i")).alias("t")).collect()]
    assert kinds == ["yeast_systematic", "ensg", "enst", "ensmusg", "refseq_nm", "entrez", "uniprot", "sgd_id", "mgi_id", "gene_symbol", "gene_symbol"]
    aliases = spark.createDataFrame([("TP53", "gene_symbol", "G1", 0), ("P53", "alias", "G1", 2), ("P53", "alias", "G0", 3), ("ENSG00000141510", "ensg", "G1", 0)], "key_upper string, id_type string, gene string, priority int")
    asked = spark.createDataFrame([(x,) for x in ("tp53", "p53", "ENSG00000141510.12", "nope", "tp53")], "input_id string")
    got = [(r.input_id, r.gene) for r in ids.resolve(asked, aliases).collect()]
    assert sorted(got, key=str) == sorted([("tp53", "G1"), ("tp53", "G1"), ("p53", "G1"), ("ENSG00000141510.12", "G1"), ("nope", None)], key=str)


def test_trna_headers(spark):
    lines = spark.createDataFrame([(0, ">x tRNA-Ala-AGC-1-1"), (1, ">y tRNA-Ala-AGC-2-1"), (2, ">z Val (TAC) 73 bp"), (3, ">q GlyGCC thing"), (4, ">i tRNA-iMet-CAT-1-1"), (5, ">s tRNA-Sup-TTA-1")], "line int, value string")
    got = {r.anticodon: (r.aa, r.copies) for r in readers.trna_headers(lines).collect()}
    assert got == {"AGC": ("Ala", 2), "UAC": ("Val", 1), "GCC": ("Gly", 1)}


def test_fasta_round_trip(spark, tmp_path):
    seqs = cds(spark, "ATGAAA", "CCC")
    sinks.fasta(seqs, str(tmp_path / "f"))
    got = {r.gene: r.seq for r in readers.fasta(spark, str(tmp_path / "f")).collect()}
    assert got == {"0": "ATGAAA", "1": "CCC"}


def test_gct_and_cell_lines(spark, tmp_path):
    p = tmp_path / "x.gct"
    p.write_text("#1.2\n2\t2\nName\tDescription\tliver\tbrain\nENSG1.5\tA\t1.5\tNA\nENSG2.1\tB\t0\t7\n")
    got = {(r.gene, r.sample): r.tpm for r in readers.gct(spark, str(p)).collect()}
    assert got == {("ENSG1", "liver"): 1.5, ("ENSG1", "brain"): 0.0, ("ENSG2", "liver"): 0.0, ("ENSG2", "brain"): 7.0}
    models = spark.createDataFrame([("m", 1.0, 2.0, -1.0)], "model_id string, `A (1)` double, `B (9)` double, `C (7)` double")
    genes = spark.createDataFrame([("G1", "A", "1"), ("G2", "B", None)], "gene string, symbol string, entrez string")
    assert {r.gene: r.tpm for r in readers.cell_lines(models, genes).collect()} == {"G1": 1.0, "G2": 3.0}


def test_bundle_writes(spark, tmp_path):
    sinks.bundle({"t": spark.createDataFrame([("a", 0.123456789)], "k string, v double")}, {"seed": 1}, str(tmp_path / "b"))
    assert [tuple(r) for r in readers.table(spark, str(tmp_path / "b/t"), "k string, v double").collect()] == [("a", 0.123457)]


def test_regression_finds_its_coefficients():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(4000), rng.integers(0, 2, 4000), rng.random(4000)])
    n = np.full(4000, 50.0)
    k = rng.binomial(50, 1 / (1 + np.exp(-(x @ np.array([-1.0, 0.4, 0.7])))))
    beta, z = glm.wald(k.astype(float), n, x)
    assert np.allclose(beta, [-1.0, 0.4, 0.7], atol=0.05) and z[1] > 20


def test_permutations(spark):
    got = {r.gene: (r.n_runs, r.p) for r in resample.shuffled_runs(cds(spark, "GAAGAA" + "GAGCCC" * 8, "CCC" * 5), dims.FAMILY, ["GAA"], permutations=99).collect()}
    assert got[0][0] == 1 and 0 < got[0][1] <= 0.6 and got[1] == (0, 1.0)


def test_bootstrap_standard_error(spark):
    values = spark.createDataFrame([(i, float(i % 10)) for i in range(500)], "idx long, value double")
    one = spark.createDataFrame([(4.5, 40)], "observed double, m long")
    r = resample.bootstrap_mean(values, one.select("observed"), one.select("m"), 400, 7).first()
    assert r.sd_b == pytest.approx(math.sqrt(8.25 / 40), rel=0.15) and abs(r.z_score) < 0.3
