"""What keeps driver, tasks and shuffles from growing faster than the tables: plans, partitions and memory."""

import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqfold import plans
from seqfold.operators import frequency, names, resample
from seqfold.plans import registry
from seqfold.plans.registry import Tables
from seqfold.sources import readers

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_contributions_need_no_ranks_and_equal_those_of_the_drivers(spark):
    assert "Window" not in plan(plans.QUERIES["dive_from_folder"](spark, FOLDER))
    t = Tables(spark, FOLDER)
    cds = t.cds.unionByName(spark.createDataFrame([(10**9, None, "x", 0), (10**9 + 1, "", "x", 0), (10**9 + 2, "GAA", "x", 3), (10**9 + 2, "GAA", "x", 3)], t.cds.schema)).cache()
    chosen = t.set_a.unionByName(spark.createDataFrame([(10**9 + i,) for i in range(3)], "gene long"))
    ours = frequency.contributions(cds, chosen, ["GAA", "CTG"])
    theirs = frequency.drivers(cds, chosen, ["GAA", "CTG"])
    rows = lambda df: sorted((r.kmer, r.gene, round(r.frequency, 9), round(r.contribution, 9)) for r in df.collect())
    assert rows(ours) == rows(theirs)


def test_a_matrix_has_no_column_for_each_gene(spark, tmp_path):
    assert len(plan(plans.QUERIES["scan_cell_lines"](spark, FOLDER))) < 20_000 and "SYM1 (1001)" not in plan(plans.QUERIES["scan_cell_lines"](spark, FOLDER))
    (tmp_path / "m.csv").write_text("model_id,A (1),is_default,B (9),C (7),A (1)\nm,1.0,Yes,2.0,-1.0,9\nm,5,No,5,5,5\nn,,yes,3.0,x,\n\nm,7,Yes,7,7,7\n")
    genes = spark.createDataFrame([("G1", "A", "1"), ("G2", "B", None), ("G3", "C", None)], "gene string, symbol string, entrez string")
    got = {(r.gene, r.model): r.tpm for r in readers.cell_line_files(spark, str(tmp_path / "m.csv"), genes).collect()}
    assert got == {("G1", "m"): 1.0, ("G2", "m"): 3.0, ("G3", "m"): 0.0, ("G2", "n"): 7.0, ("G3", "n"): 0.0}


def test_names_are_neither_broadcast_nor_met_under_common_grams(spark):
    asked = spark.range(2000).select(F.format_string("my Customer#%09d (cell)", "id").alias("needle"))
    found = names.contained(asked, spark.range(2000).select(F.format_string("x my Customer#%09d (cell)", "id").alias("straw")))
    assert "Broadcast" not in physical(found) and found.count() == 2000
    assert names.GRAM >= 8  # of numbered names, even the rarest trigram is in a fixed share of all


def test_texts_are_dealt_by_their_size(spark, monkeypatch):
    monkeypatch.setattr(registry, "DEALT", 1 << 15)
    t = Tables(spark, FOLDER)
    size = t.read("documents").agg(F.sum(F.octet_length("text")).alias("s")).first().s
    assert t.cds.rdd.getNumPartitions() == -(-size // (1 << 15)) > 4
    assert physical(plans.QUERIES["kmer_count_3"](spark, FOLDER)).count("Exchange hash") == 1


@pytest.mark.parametrize("name", ["positional_z", "positional_freq", "composition_k2", "composition_k3", "background_stats_k3", "codon_runs"])
def test_rows_of_cells_and_positions_are_not_shuffled_by_gene(spark, monkeypatch, name):
    monkeypatch.setattr(registry, "spread", lambda df, key: df)  # as with many files
    held = physical(plans.QUERIES[name](spark, FOLDER))
    assert not re.search(r"hashpartitioning\(gene#\w+, (kmer|bin|codon)", held) and (name[-1] in "z23" or "hashpartitioning(gene" not in held)  # but for the ids of a set


@pytest.mark.parametrize("name", ["composition_k2", "positional_z", "fs_dicodon", "demand_vector"])
def test_genes_meet_sets_and_weights_before_their_symbols_are_rows(spark, name):
    lines = plan(plans.QUERIES[name](spark, FOLDER)).splitlines()
    explode = next(i for i, line in enumerate(lines) if "explode" in line and "Generate" in line)
    assert any("gene" in line and "Join" in line for line in lines[explode:]) and not any("Join" in line and "gene" in line for line in lines[:explode])


@pytest.mark.parametrize("name", ["fs_dicodon", "kmer_enumerate"])
def test_totals_are_not_counted_by_gene(spark, name):
    assert not re.search(r"Aggregate \[gene#\w+, kmer", plan(plans.QUERIES[name](spark, FOLDER)))


def test_weighted_resamples_over_many_runs_meet_the_closed_form(spark):
    rng = np.random.default_rng(4)
    n, w, v = 3 * resample.RUN * resample.BINS // 100, None, None
    w, v = rng.gamma(2.0, size=n), rng.normal(1.0, 1.0, size=n)
    rows = spark.createDataFrame([(i, float(w[i]), [1], [float(v[i])]) for i in range(n)], "key long, w double, at array<int>, v array<double>")
    got = resample.multinomial(rows, 60, 1500, 2, 5).collect()
    mass, sums = ({r.rep: r.sum for r in got if r.at == at} for at in (-1, 1))
    assert len(mass) == len(sums) == 1500
    assert np.mean(list(mass.values())) == pytest.approx(60 * w.mean(), rel=0.01) and np.std(list(mass.values())) == pytest.approx(w.std() * 60**0.5, rel=0.07)
    assert np.mean(list(sums.values())) == pytest.approx(60 * (w * v).mean(), rel=0.03) and np.std(list(sums.values())) == pytest.approx((w * v).std() * 60**0.5, rel=0.07)


def test_draws_are_not_shuffled_to_their_values(spark):
    values = spark.range(500).select(F.col("id").alias("idx"), F.rand(1).alias("value"))
    z = resample.bootstrap_mean(values, values.agg(F.avg("value").alias("observed")), values.agg(F.count("*").alias("m")), 50, 42)
    assert "hashpartitioning(idx" not in physical(z)


def test_pairs_are_counted_once_and_without_other_genes(spark):
    assert plan(plans.QUERIES["divergent_pairs"](spark, FOLDER)).count("regexp_extract_all") == 0  # read from what is written


def test_the_fit_holds_no_products_of_all_cells():
    linear = pytest.importorskip("seqfold.llm.linear")
    rng, cells = np.random.default_rng(1), 2_000_000
    x = linear.Sparse(rng.integers(0, 4000, cells).astype(np.int32), rng.integers(0, 5000, cells).astype(np.int32), rng.random(cells).astype(np.float32), 4000, np.arange(5000, dtype=np.uint64))
    y, rows = (rng.random(4000) < 0.3).astype(float), np.ones(4000)
    m = linear.Linear(np.arange(0, 5000, 3, dtype=np.uint64), rng.normal(size=1667))
    tracemalloc.start()
    top, s = linear.screened(x, y, rows, 100), linear.scores(m, x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * cells
    at, known = linear.locate(m.vocab, x.vocab[x.col])
    assert len(top) == 100 and (s == np.bincount(x.row[known], m.weight[at] * x.val[known], x.n)).all()
