import os

import pytest
from pyspark.sql import functions as F

from seqfold import cli
from seqfold.operators import frequency, many, sequences
from seqfold.plans import modes
from seqfold.sources import backgrounds, readers, results, sinks

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cds(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return sequences.from_documents(docs).select(F.col("gene").cast("string").alias("gene"), F.substring("seq", 1, 300).alias("seq")).cache()


@pytest.fixture(scope="module")
def chosen(cds):
    return cds.where("gene < '3'").select("gene").cache()


def by_kmer(df, *columns):
    return {r.kmer: tuple(r[c] for c in columns) for r in df.collect()}


def parts(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def close(a, b):
    assert a.keys() == b.keys() and a
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("k", [1, 2])
def test_store_equals_a_recount_and_a_changed_shard_replaces_its_own_alone(spark, cds, tmp_path, k):
    path = str(tmp_path / "store")
    backgrounds.write(cds, path, "yeast", k, 8)
    backgrounds.write(cds.limit(20), path, "human", k, 8)
    close(by_kmer(backgrounds.read(spark, path, "yeast", k), "mean", "sd"), by_kmer(frequency.background(cds, k), "mean", "sd"))
    gone = [r.gene for r in cds.orderBy("gene").limit(3).collect()]
    changed = cds.where(~F.col("gene").isin(gone[:2])).withColumn("seq", F.when(F.col("gene") == gone[2], F.reverse("seq")).otherwise(F.col("seq")))
    before = parts(path)
    which = backgrounds.refresh(changed, path, "yeast", k, spark.createDataFrame([(g,) for g in gone], "gene string"))
    assert 1 <= len(which) <= 3
    after = parts(path)
    assert len(before - after) == len(which) == len(after - before)
    close(by_kmer(backgrounds.read(spark, path, "yeast", k), "mean", "sd"), by_kmer(frequency.background(changed, k), "mean", "sd"))
    close(by_kmer(backgrounds.read(spark, path, "human", k), "mean", "sd"), by_kmer(frequency.background(cds.limit(20), k), "mean", "sd"))


def test_store_of_few_and_odd_genes(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", "AAAGAA"), ("b", ""), ("c", None), ("d", "TAAAAA")], "gene string, seq string")
    with pytest.raises(ValueError):
        backgrounds.read(spark, path, "yeast", 1)
    backgrounds.write(rows, path, "yeast", 1, 4)
    got = by_kmer(backgrounds.read(spark, path, "yeast", 1), "mean", "sd")
    assert got.keys() == {"AAA", "GAA"} and got["AAA"][0] == pytest.approx(0.25) and got["GAA"][0] == pytest.approx(0.125)  # of four genes, two have no codon
    with pytest.raises(ValueError):
        backgrounds.write(rows, path, "yeast", 1, 8)
    backgrounds.refresh(rows.where("false"), path, "yeast", 1, rows.select("gene"))
    assert backgrounds.read(spark, path, "yeast", 1).count() == 0
    plan = backgrounds.read(spark, path, "yeast", 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "species" in plan.split("PartitionFilters: [")[1][:200]


def test_analyses_from_the_store_read_as_without(spark, cds, chosen, tmp_path):
    path = str(tmp_path / "store")
    backgrounds.write(cds, path, "yeast", 1, 8)
    known = backgrounds.read(spark, path, "yeast", 1)
    columns = ("observed", "expected", "z_score", "cohens_d", "adjusted_p")
    close(by_kmer(modes.composition(cds, chosen, moments=known)["results"], *columns), by_kmer(modes.composition(cds, chosen)["results"], *columns))
    other = cds.join(chosen, "gene", "left_anti").select("gene")
    close(by_kmer(modes.differential(cds, chosen, other, moments=known)["results"], "fold", "genome_z_a", "genome_z_b"), by_kmer(modes.differential(cds, chosen, other)["results"], "fold", "genome_z_a", "genome_z_b"))
    close(by_kmer(frequency.against(known, frequency.members(cds, chosen), 1), "z_score", "n_set"), by_kmer(frequency.composition(cds, chosen, 1), "z_score", "n_set"))


@pytest.mark.parametrize("k", [1, 2])
def test_many_sets_equal_each_set_alone(spark, cds, chosen, k):
    other = cds.where("gene like '%7%'").select("gene")
    sets = chosen.withColumn("name", F.lit("a")).unionByName(other.withColumn("name", F.lit("b"))).unionByName(chosen.withColumn("name", F.lit("a")))
    sets = sets.unionByName(spark.createDataFrame([("no such gene", "c"), (None, "a")], "gene string, name string"))
    got = many.compositions(cds, sets, k).cache()
    assert {r.name for r in got.select("name").distinct().collect()} == {"a", "b"}  # no gene of c is there
    for name, one in (("a", chosen), ("b", other)):
        for region, start, end, least in many.REGIONS:
            alone = frequency.composition(sequences.region(cds, start, end, least), one, k)
            close(by_kmer(got.where((F.col("name") == name) & (F.col("region") == region)), "observed", "expected", "z_score", "cohens_d", "n_set"), by_kmer(alone, "observed", "expected", "z_score", "cohens_d", "n_set"))
    p = got.where("name = 'a' and region = 'all'").orderBy("p_value").select("p_value", "adjusted_p").collect()
    n = len(p)
    assert [r.adjusted_p for r in p] == pytest.approx([min(min(1.0, p[j].p_value * n / (j + 1)) for j in range(i, n)) for i in range(n)])
    got.unpersist()


def test_many_sets_plan_reads_the_sequences_once(spark, chosen):
    from seqfold.plans.registry import Tables

    t = Tables(spark, FOLDER)
    plan = many.moments(t.cds, t.set_a.withColumn("name", F.lit("a")).unionByName(t.set_b.withColumn("name", F.lit("b"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 1 and "Python" not in plan


def test_many_sets_of_nothing(spark, cds, chosen):
    none = spark.createDataFrame([], "name string, gene string")
    assert many.compositions(cds, none).count() == 0
    assert many.compositions(cds.where("false"), chosen.withColumn("name", F.lit("a"))).count() == 0


def test_results_folder_comes_back_and_is_dived_into(spark, cds, chosen, tmp_path):
    path = str(tmp_path / "run")
    made = modes.composition(cds, chosen)["results"]
    sinks.bundle({"results": made, "genes": chosen}, {"mode": "enrichment", "species": "yeast", "kmer": 1}, path, 17)
    tables, config, problems = results.read(spark, path)
    assert not problems and config["mode"] == "enrichment" and set(tables) == {"results", "genes"}
    assert tables["results"].dtypes == made.dtypes and by_kmer(tables["results"], *made.columns) == by_kmer(made, *made.columns)
    direct, later = modes.drivers(cds, chosen)["genes"], modes.deep_dive(cds, tables["genes"], tables["results"])["drivers_genes"]
    assert sorted((r.kmer, r.gene, round(r.contribution, 12), r.rank) for r in later.collect()) == sorted((r.kmer, r.gene, round(r.contribution, 12), r.rank) for r in direct.collect())


@pytest.mark.parametrize("text, told", [('{"mode": "enrich', "damaged"), ('{"mode": 1, "kmer": 1}', "no schemas"), (None, "no configuration")])
def test_damaged_configuration_is_told_and_not_fatal(spark, tmp_path, text, told):
    path = str(tmp_path / "run")
    sinks.tsv(spark.createDataFrame([("AAA", 0.5)], "kmer string, z_score double"), f"{path}/results")
    if text:
        os.makedirs(f"{path}/config")
        with open(f"{path}/config/part-0.txt", "w") as f:
            f.write(text)
    tables, config, problems = results.read(spark, path)
    assert config == {} and told in problems[0] and tables["results"].first().kmer == "AAA"


def test_missing_and_unnamed_tables_are_told(spark, tmp_path):
    path = str(tmp_path / "run")
    one = spark.createDataFrame([(1,)], "x int")
    sinks.bundle({"a": one, "b": one}, {"mode": "m"}, path)
    os.rename(f"{path}/b", f"{path}/c")
    tables, _, problems = results.read(spark, path)
    assert set(tables) == {"a", "c"} and len(problems) == 2 and tables["a"].dtypes == [("x", "int")]


def test_command_line_of_store_sets_and_folder(spark, cds, chosen, tmp_path):
    cds.write.parquet(str(tmp_path / "cds"))
    (tmp_path / "lists").mkdir()
    for name, genes in (("one.txt", chosen), ("two.long.txt", cds.where("gene like '%7%'"))):
        (tmp_path / "lists" / name).write_text("# a list\n" + "\n".join(r.gene for r in genes.collect()) + "\n")
    assert {r.name for r in readers.gene_sets(spark, str(tmp_path / "lists")).select("name").distinct().collect()} == {"one", "two.long"}
    base, store = ["--cds", str(tmp_path / "cds")], ["--backgrounds", str(tmp_path / "store")]
    cli.main(["background", *base, *store])
    cli.main(["background", *base, *store, "--genes", str(tmp_path / "lists/one.txt")])
    cli.main(["enrichment", *base, *store, "--genes", str(tmp_path / "lists/one.txt"), "--output-dir", str(tmp_path / "run")])
    cli.main(["deep-dive", *base, "--results", str(tmp_path / "run"), "--output-dir", str(tmp_path / "dive")])
    cli.main(["sets", *base, "--gene-sets", str(tmp_path / "lists"), "--output-dir", str(tmp_path / "sets")])
    tables, _, problems = results.read(spark, str(tmp_path / "sets"))
    assert not problems and tables["results"].select("name").distinct().count() == 2 and "biased" in tables
    tables, _, problems = results.read(spark, str(tmp_path / "dive"))
    assert not problems and tables["drivers_summary"].count() >= 1
