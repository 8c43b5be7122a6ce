"""Queries over raw sources (headers, reports, counts, matrices) made from the tables, and over the rows that a report shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqfold.functions import dims, stats
from seqfold.operators import frequency, ids, ordered, sequences, tables, weights
from seqfold.plans import modes
from seqfold.plans.queries import _cai, _correlations, _layers, _tested
from seqfold.plans.registry import OFTEN, PARTS, Tables, query, r6, tested
from seqfold.sources import ingest, readers, shared

C = F.col


def _z(x: str = "z_score") -> Column:
    return (F.round(x, 4) + 0.0).alias(x)


# --- sources ---------------------------------------------------------------------------------------------------------------------


def _orf(size: Column, stop: Column) -> Column:
    """A sequence of size + 1 symbols, with a stop inside where stop holds."""
    return F.concat(F.lit("ATG"), F.when(stop, "TGA").otherwise(""), F.expr("repeat('gac', cast(size as int))"), F.lit("TAA"))


def _parts(t: Tables) -> DataFrame:
    return t.read("part").select(C("p_partkey").alias("k"), "p_name", "p_brand", "p_type", C("p_size").alias("size"))


@query("SELECT 'Y' || p_partkey AS gene, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'N' || p_partkey END AS common_name, 'SGD:S' || lpad(p_partkey::VARCHAR, 9, '0') AS sgd_id, CASE WHEN p_size < 20 THEN 'Verified' WHEN p_size < 40 THEN 'Uncharacterized' ELSE 'Dubious' END AS status, 3 + 3 * p_size AS cds_length, round((1 + 2 * p_size) / (3 + 3 * p_size), 6) AS gc FROM part WHERE p_partkey % 10 <> 0 AND p_size % 7 <> 0")
def scan_yeast_headers(t: Tables) -> DataFrame:
    p = _parts(t)
    name = F.concat(F.when(C("k") % 10 == 0, "Q0").otherwise("Y"), "k", F.lit(" "), F.when(C("size") % 3 == 0, "").otherwise(F.concat(F.lit("N"), "k", F.lit(" "))), F.lit("SGDID:S"), F.lpad(C("k").cast("string"), 9, "0"))
    status = F.when(C("size") < 20, "Verified ORF").when(C("size") < 40, "Uncharacterized ORF").otherwise("Dubious ORF")
    records = p.select(F.concat(name, F.lit(", Chr I from 1-9, "), status).alias("header"), _orf(C("size"), C("size") % 7 == 0).alias("seq"))
    return ingest.yeast_genes(records).select("gene", "common_name", "sgd_id", "status", "cds_length", F.round("gc", 6).alias("gc"))


_SUMMARY = "p_partkey % 4 <> 0"


@query(f"SELECT 'ENSG' || (p_partkey // 2) AS gene, p_name AS symbol, 'ENST' || p_partkey AS transcript, 'NM_' || p_partkey AS refseq, p_partkey::VARCHAR AS entrez, 3 + 3 * p_size AS cds_length FROM part WHERE {_SUMMARY} AND p_size % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY p_partkey // 2 ORDER BY p_partkey) = 1")
def scan_selected_cds(t: Tables) -> DataFrame:
    """Sequences of the transcripts that a summary table selects; the first of a gene."""
    p = _parts(t)
    raw = p.select(F.concat(F.lit("GeneID:"), "k").alias("#NCBI_GeneID"), F.concat(F.lit("ENSG"), F.expr("k div 2"), F.lit(".3")).alias("Ensembl_Gene"), C("p_name").alias("symbol"), F.concat(F.lit("NM_"), "k").alias("RefSeq_nuc"), F.concat(F.lit("ENST"), "k", F.lit(".2")).alias("Ensembl_nuc"), F.when(C("k") % 4 == 0, "MANE Plus Clinical").otherwise("MANE Select").alias("MANE_status"))
    records = p.select(C("k").alias("nth"), F.concat(F.lit("ENST"), "k", F.lit(".8 cds chromosome:1 gene:x")).alias("header"), _orf(C("size"), C("size") % 7 == 0).alias("seq"))
    return ingest.selected_cds(records, readers.mane_summary(raw)).select("gene", "symbol", "transcript", "refseq", "entrez", "cds_length")


@query("SELECT 'ENSMUSG' || (p_partkey // 4) AS gene, 'ENSMUST' || p_partkey AS transcript, p_brand AS symbol, 3 + 3 * p_size AS cds_length FROM part WHERE p_size % 7 <> 0 AND 3 + 3 * p_size >= 9 QUALIFY row_number() OVER (PARTITION BY p_partkey // 4 ORDER BY (p_partkey % 12 = 1) DESC, p_size DESC, p_partkey) = 1")
def scan_best_cds(t: Tables) -> DataFrame:
    """Of a gene's transcripts the canonical one, else the longest."""
    p = _parts(t)
    records = p.select(C("k").alias("nth"), F.concat(F.lit("ENSMUST"), "k", F.lit(".1 cds gene:ENSMUSG"), F.expr("k div 4"), F.lit(".5 gene_symbol:"), "p_brand", F.lit(" x")).alias("header"), _orf(C("size"), C("size") % 7 == 0).alias("seq"))
    canonical = p.where("k % 12 = 1").select(F.concat(F.lit("ENSMUSG"), F.expr("k div 4")).alias("gene"), F.concat(F.lit("ENSMUST"), "k").alias("transcript"))
    return ingest.best_cds(records, canonical).select("gene", "transcript", "symbol", "cds_length")


@query("SELECT 'MGI:' || p_partkey AS mgi_id, p_name AS symbol, (p_partkey + 9)::VARCHAR AS entrez, p_type || '|' || p_brand AS synonyms, coalesce(g::VARCHAR, '') AS gene FROM part LEFT JOIN (SELECT upper(p_name) AS key, max(p_partkey) AS g FROM part WHERE p_size < 25 GROUP BY ALL) ON key = upper(p_name) WHERE p_size % 5 <> 0")
def scan_mgi(t: Tables) -> DataFrame:
    p = _parts(t)
    lines = p.select(F.concat_ws("\t", F.concat(F.lit("MGI:"), "k"), "p_name", F.when(C("size") % 5 == 0, "W").otherwise("O"), *map(F.lit, "abcde"), (C("k") + 9).cast("string"), F.concat("p_type", F.lit("|"), "p_brand")).alias("value"))
    return ingest.mgi_report(lines, p.where("size < 25").select(C("k").alias("gene"), F.upper("p_name").alias("name")))


@query("SELECT DISTINCT 'P' || l_suppkey AS uniprot, l_partkey AS gene FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def protein_map(t: Tables) -> DataFrame:
    rows = t.read("lineitem").select(F.concat(F.lit("P"), "l_suppkey").alias("uniprot"), C("l_partkey").alias("gene"))
    return ingest.protein_map(rows, t.read("part").where("p_size < 10").select(C("p_partkey").alias("gene")))


@query("SELECT DISTINCT o_custkey AS gene1, o_orderkey AS gene2 FROM orders WHERE o_orderstatus = 'F'")
def ortholog_dispatch(t: Tables) -> DataFrame:
    """A source with too few pairs gives way to the next one."""
    o = t.read("orders").select(C("o_custkey").alias("gene1"), C("o_orderkey").alias("gene2"), "o_orderstatus")
    return ingest.orthologs_or(o.limit(5).drop("o_orderstatus"), o.where("o_orderstatus = 'F'").drop("o_orderstatus"))


@query("SELECT arg_min(CASE WHEN p_partkey % 2 = 0 THEN 'Leu' ELSE 'Val' END, p_partkey) AS aa, count(*) AS copies, translate(right('00' || (p_partkey % 40), 3), '0123456789', 'AUGCAUGCAU') AS anticodon FROM part WHERE p_size % 6 <> 0 GROUP BY 3")
def trna_counts(t: Tables) -> DataFrame:
    """Copies by anticodon, from three styles of headers; initiators are left out."""
    p = _parts(t)
    anti = F.translate(F.substring(F.concat(F.lit("00"), C("k") % 40), -3, 3), "0123456789", "ATGCATGCAT")
    aa = F.when(C("k") % 2 == 0, "Leu").otherwise("Val")
    plain = F.when(C("size") % 6 == 1, F.concat(F.lit("x "), aa, F.lit(" ("), anti, F.lit(")"))).when(C("size") % 6 == 2, F.concat(F.lit("x "), aa, anti)).otherwise(F.concat(F.lit("x tRNA-"), aa, F.lit("-"), anti, F.lit("-1-1")))
    style = F.when(C("size") % 6 == 0, F.concat(F.lit("x tRNA-iMet-"), anti, F.lit("-1-1"))).otherwise(plain)
    return readers.trna_headers(p.select(style.alias("value"), C("k").alias("line"))).select("aa", "copies", "anticodon")


@query("SELECT 'G' || l_suppkey AS gene, 'S' || l_suppkey AS symbol, l_returnflag AS sample, round(sum(l_quantity), 4) AS tpm FROM lineitem GROUP BY ALL")
def scan_gct(t: Tables) -> DataFrame:
    """A table of tissues with its preamble, as lines."""
    wide = t.read("lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    rows = wide.select(F.concat_ws("\t", F.concat(F.lit("G"), "l_suppkey", F.lit(".7")), F.concat(F.lit("S"), "l_suppkey"), *[F.coalesce(C(c).cast("string"), F.lit("NaN")) for c in ("A", "N", "R")]).alias("value"))
    lines = t.spark.createDataFrame([("#1.2",), ("100\t3",), ("Name\tDescription\tA\tN\tR",)], "value string").unionByName(rows)
    return readers.gct_lines(lines).where("tpm > 0").withColumn("tpm", F.round("tpm", 4))


@query("SELECT s_suppkey AS gene, 'L' || l_linestatus AS model, round(greatest(2 ** (q % 7) - 1, 0), 4) AS tpm FROM (SELECT l_suppkey, l_linestatus, count(*) AS q FROM lineitem GROUP BY ALL) JOIN supplier ON s_suppkey = l_suppkey")
def scan_cell_lines(t: Tables) -> DataFrame:
    """A matrix of models by genes, written as a text file of a line for each model and read back: rows that are not a model's default are left out, values are
    turned back from logarithms. Its lines hold a cell for each supplier, as such files do."""
    path, suppliers = shared.folder(t.spark, "cell_lines"), t.read("supplier").select(C("s_suppkey").alias("i")).where("i is not null").distinct()
    per = t.read("lineitem").groupBy(F.concat(F.lit("L"), "l_linestatus").alias("model_id"), C("l_suppkey").alias("i")).agg((F.count("*") % 7).cast("double").cast("string").alias("x"))
    grid = per.select("model_id").distinct().where("model_id is not null").join(suppliers).join(per, ["model_id", "i"], "left")

    def line(first: Column, cell: Column, last: Column) -> Column:
        cells = F.transform(F.array_sort(F.collect_list(F.struct("i", cell.alias("x")))), lambda c: c["x"])
        return F.concat_ws(",", first, F.array_join(cells, ","), last).alias("value")

    measured = F.coalesce("x", F.lit(""))
    header = suppliers.agg(line(F.lit("model_id"), F.concat(F.lit("SYM"), "i", F.lit(" ("), C("i") + 1000, F.lit(")")), F.lit("is_default")))
    lines = grid.groupBy("model_id").agg(line(C("model_id"), measured, F.lit("Yes"))).unionByName(grid.groupBy("model_id").agg(line(C("model_id"), F.lit("3.0"), F.lit("No"))))
    header.unionByName(lines.select("value")).write.text(path)
    genes = t.read("supplier").select(C("s_suppkey").alias("gene"), F.concat(F.lit("SYM"), "s_suppkey").alias("symbol"), F.when(C("s_suppkey") % 2 == 0, (C("s_suppkey") + 1000).cast("string")).alias("entrez"))
    return readers.cell_line_files(t.spark, path, genes).select("gene", "model", F.round("tpm", 4).alias("tpm"))


def _counts(t: Tables) -> DataFrame:
    """A table as a counting program writes it: ids, a text column, two samples, summary rows."""
    p = t.read("part")
    own = p.select(F.when(C("p_partkey") % 3 == 0, F.lower("p_name")).otherwise(C("p_name")).alias("Geneid"), C("p_brand").alias("Chr"), C("p_size").cast("long").alias("s1"), (C("p_size") * 2).cast("long").alias("s2"))
    return own.unionByName(t.spark.createDataFrame([("__no_feature", "x", 7, 7)], own.schema))


@query("SELECT CASE WHEN p_partkey % 3 = 0 THEN lower(p_name) ELSE p_name END AS gene, p_size::DOUBLE AS count FROM part")
def raw_counts(t: Tables) -> DataFrame:
    return ingest.raw_counts(_counts(t)).select("gene", "count")


_LEN = "SELECT CASE WHEN p_partkey % 3 = 0 THEN lower(p_name) ELSE p_name END AS gene, p_size * 2 AS count, g * 3.0 AS length FROM part LEFT JOIN (SELECT upper(p_name) AS key, arg_max(p_partkey, p_partkey::VARCHAR) AS g FROM part WHERE p_partkey % 4 <> 0 GROUP BY ALL) ON key = upper(p_name)"


@query(f"SELECT gene, round(count / (length / 1000) / sum(count / (length / 1000)) OVER () * 1e6, 4) AS tpm FROM ({_LEN}) WHERE length IS NOT NULL AND count >= 10")
def counts_with_lengths(t: Tables) -> DataFrame:
    """Counts of a chosen sample, lengths of known genes by name or upper-cased name, a least count, TPM."""
    genes = t.read("part").where("p_partkey % 4 <> 0").select(C("p_partkey").alias("systematic"), F.upper("p_name").alias("common"), F.lit(None).cast("string").alias("transcript"), F.lit(None).cast("string").alias("entrez"), (C("p_partkey") * 3).alias("cds_length"))
    tpm = modes.tpm_of_counts(ingest.raw_counts(_counts(t), sample="s2"), ingest.length_keys(genes.withColumn("systematic", C("systematic").cast("string"))), least=10)
    return tpm.select("gene", F.round("tpm", 4).alias("tpm"))


@query("SELECT c_custkey AS gene, max_by(o_totalprice, o_orderkey) AS tpm FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey")
def custom_expression(t: Tables) -> DataFrame:
    """Abundances under a user's names; the last row of a gene counts."""
    named = t.read("orders").join(t.read("customer").select(C("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select(F.lower("c_name").alias("gene_id"), C("o_totalprice").alias("tpm"), C("o_orderkey").alias("row"))
    aliases = t.read("customer").select(F.upper("c_name").alias("key_upper"), F.lit("gene_symbol").alias("id_type"), C("c_custkey").alias("gene"), F.lit(0).alias("priority"))
    return ingest.custom_expression(named, aliases, "row")


@query("SELECT l_partkey AS gene, sum(l_quantity) AS tpm FROM lineitem WHERE l_shipdate IS NOT NULL AND l_returnflag = 'R' GROUP BY l_partkey")
def expression_of(t: Tables) -> DataFrame:
    """The sample of a species by a name that differs in case and signs."""
    rows = t.read("lineitem").where("l_shipdate is not null").groupBy(F.lit("human").alias("species"), F.concat(F.lit("Tissue ("), "l_returnflag", F.lit(")")).alias("sample"), C("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("tpm"))
    return ingest.expression_of(rows, "human", "tissue-r")


@query("SELECT name FROM (SELECT DISTINCT o_orderpriority AS name FROM orders UNION SELECT DISTINCT c_mktsegment FROM customer)")
def line_names(t: Tables) -> DataFrame:
    return ingest.line_names(t.read("orders").select(C("o_orderpriority").alias("sample")), t.read("customer").select(C("c_mktsegment").alias("sample")))


@query("SELECT c_custkey AS gene, max(o_orderkey) AS ortholog FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey < 12 GROUP BY c_custkey")
def ortholog_lookup(t: Tables) -> DataFrame:
    """Counterparts of genes whose species stands on either side of the edges."""
    o = t.read("orders")
    ahead = o.where("o_orderkey % 2 = 0").select(F.lit("a").alias("species1"), C("o_custkey").alias("gene1"), F.lit("b").alias("species2"), C("o_orderkey").alias("gene2"))
    back = o.where("o_orderkey % 2 = 1").select(F.lit("b").alias("species1"), C("o_orderkey").alias("gene1"), F.lit("a").alias("species2"), C("o_custkey").alias("gene2"))
    return tables.ortholog_lookup(ahead.unionByName(back), t.read("customer").where("c_nationkey < 12").select(C("c_custkey").alias("gene")), "a")


@query("SELECT kmer, families, coalesce(n, 0)::BIGINT AS n FROM (SELECT a.codon || b.codon AS kmer, a.aa || '-' || b.aa AS families FROM {sym} a, {sym} b) LEFT JOIN (SELECT kmer, sum(cnt)::BIGINT AS n FROM {k2} GROUP BY kmer) USING (kmer)")
def kmer_enumerate(t: Tables) -> DataFrame:
    """Every pair of sense codons with its families, and how often it occurs, which may be never."""
    seen = sequences.kmer_totals(t.rows, 2)
    return dims.kmers(t.spark, 2).join(seen, "kmer", "left").select("kmer", "families", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT kmer, substr(kmer, 1, 3) || '-' || substr(kmer, 4, 3) || ' (' || coalesce(a.aa, '?') || '-' || coalesce(b.aa, '?') || ')' AS label FROM (SELECT DISTINCT kmer FROM {k2}) LEFT JOIN {sym} a ON a.codon = substr(kmer, 1, 3) LEFT JOIN {sym} b ON b.codon = substr(kmer, 4, 3)")
def kmer_annotate(t: Tables) -> DataFrame:
    return sequences.kmer_totals(t.rows, 2).select("kmer").withColumn("label", modes.annotated(C("kmer")))


@query("SELECT p_partkey, (floor(p_retailprice)::BIGINT)::VARCHAR AS id FROM part")
def numeric_ids(t: Tables) -> DataFrame:
    """Identifiers that a table holds as numbers, as text without a fraction."""
    p = t.read("part")
    return p.select("p_partkey", ids.numeric_text(F.floor("p_retailprice").cast("double").cast("string")).alias("id"))


# --- what a report shows ---------------------------------------------------------------------------------------------------------


@query("SELECT kmer, round(z_score, 4) + 0.0 AS z_score, round(least(-log10(greatest(p, 1e-300)), 6), 3) + 0.0 AS height FROM {bhcomp1}")
def volcano(t: Tables) -> DataFrame:
    """Scores of all codons against the logarithm of p, which is clipped at a height of 6, where the plot ends."""
    c = _tested(frequency.composition(t.cds, t.set_a, 1), "kmer")
    return c.select("kmer", _z(), (F.round(F.least(-F.log10(F.greatest("p_value", F.lit(1e-300))), F.lit(6.0)), 3) + 0.0).alias("height"))


def _top(source: str, key: str, top: int, where: str = "adjusted_p < 0.05") -> str:
    side = "SELECT {k} AS {k}, '{d}' AS direction, row_number() OVER (ORDER BY {o}, {k})::INT AS place, round(z_score, 4) + 0.0 AS z_score FROM (SELECT *, round(z_score, 6) AS zz FROM {s}) WHERE {w} AND zz {c} 0"
    return " UNION ALL ".join(f"SELECT * FROM ({side.format(k=key, d=d, o=o, s=source, w=where, c=c)}) WHERE place <= {top}" for d, o, c in (("enriched", "zz DESC", ">"), ("depleted", "zz", "<")))


@query(_top("{bhcomp1}", "kmer", 30))
def top_codons(t: Tables) -> DataFrame:
    best = tables.strongest(_tested(frequency.composition(t.cds, t.set_a, 1), "kmer"), 30)
    return best.select("kmer", "direction", "place", _z())


@query(_top("{bhcomp2}", "kmer", 30))
def top_dicodons(t: Tables) -> DataFrame:
    best = tables.strongest(_tested(frequency.composition(t.cds, t.set_a, 2), "kmer"), 30)
    return best.select("kmer", "direction", "place", _z())


@query("SELECT * FROM (SELECT kmer, 'head' AS \"end\", round(z_score, 4) + 0.0 AS z_score FROM {comp2} ORDER BY round(z_score, 6) DESC, kmer LIMIT 30) UNION ALL SELECT * FROM (SELECT kmer, 'tail', round(z_score, 4) + 0.0 FROM {comp2} ORDER BY round(z_score, 6), kmer LIMIT 30)")
def waterfall(t: Tables) -> DataFrame:
    c = frequency.composition(t.cds, t.set_a, 2).withColumn("zz", F.round("z_score", 6))
    return tables.head_and_tail(c, "zz", "kmer", 30).select("kmer", "end", _z())


def _region(start: int, end: int | None) -> tuple[str, str, str]:
    """SQL of a region's composition: cells, its genes, deviations."""
    inside = f"pos >= {start}" + (f" AND pos < {end}" if end else "")
    width = f"least(n, {end}) - {start}" if end else f"n - {start}"
    genes = f"SELECT gene, {width} AS k FROM (SELECT gene, length(seq) // 3 AS n FROM {{cds}}) WHERE {width} >= 3"
    cells = f"SELECT c.gene, codon AS kmer, count(*) / any_value(k) AS freq FROM {{codons}} c JOIN ({genes}) g ON g.gene = c.gene WHERE {inside} AND codon NOT IN ('TAA', 'TAG', 'TGA') GROUP BY c.gene, codon"
    moments = f"SELECT kmer, n, m, sum(freq) AS s, coalesce(sum(freq) FILTER (WHERE a.gene IS NOT NULL), 0) AS t, sqrt(greatest((sum(freq * freq) - sum(freq) * sum(freq) / n) / (n - 1), 0)) AS sd FROM ({cells}) v LEFT JOIN {{seta}} a ON a.gene = v.gene, (SELECT count(*) AS n, count(a.gene) AS m FROM ({genes}) g LEFT JOIN {{seta}} a ON a.gene = g.gene) GROUP BY kmer, n, m"
    return f"SELECT kmer, t / m AS observed, s / n AS expected, CASE WHEN sd > 1e-12 THEN (t / m - s / n) / (sd / sqrt(m)) ELSE 0 END AS z_score FROM ({moments})"


PARTS |= {"ramp": tested(f"({_region(1, 51)})", "kmer"), "body": tested(f"({_region(51, None)})", "kmer")}
OFTEN |= {"ramp", "body"}


def _regions(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Tested composition of the codons 1 to 50 and of those behind them."""
    return tuple(_tested(frequency.composition(sequences.region(t.cds, a, b, 3), t.set_a, 1), "kmer") for a, b in ((1, 51), (51, None)))


@query("SELECT kmer, round(r.z_score, 4) + 0.0 AS ramp_z, round(b.z_score, 4) + 0.0 AS body_z, (r.adjusted_p < 0.05 OR b.adjusted_p < 0.05) AND abs(r.z_score - b.z_score) > 2 AS biased FROM {ramp} r JOIN {body} b USING (kmer)")
def positional_bias(t: Tables) -> DataFrame:
    return tables.biased(*_regions(t)).select("kmer", _z("ramp_z"), _z("body_z"), "biased")


@query("SELECT kmer, round(z_score, 4) + 0.0 AS z_score FROM {ramp} WHERE z_score > 1.5 AND kmer NOT IN (SELECT codon FROM {fast})")
def slow_in_ramp(t: Tables) -> DataFrame:
    return tables.slow_in_ramp(_regions(t)[0], t.fast).select("kmer", _z())


@query(_top("{ramp}", "kmer", 10))
def ramp_table(t: Tables) -> DataFrame:
    return tables.strongest(_regions(t)[0], 10).select("kmer", "direction", "place", _z())


@query("SELECT codon, attribution, CASE WHEN attribution IN ('Both', 'Synonymous-driven') THEN 'yes' ELSE 'no' END AS has_driver FROM {attr} WHERE attribution <> 'None'")
def attribution_rows(t: Tables) -> DataFrame:
    """Codons with a significant deviation, and whether their synonymous usage has one to be explained."""
    aa, codon = _layers(t)
    explained = frequency.synonymous_drivers(codon, t.rules).select("codon", F.lit("yes").alias("has_driver"))
    return frequency.attribution(aa, codon).where("attribution <> 'None'").join(explained, "codon", "left").select("codon", "attribution", F.coalesce("has_driver", F.lit("no")).alias("has_driver"))


_FSD = "SELECT kmer, n_set, n_all, n_set / e AS fold, (n_set - e) / sqrt(e) AS z_score FROM (SELECT kmer, coalesce(a.n, 0) AS n_set, b.n AS n_all, b.n * (SELECT sum(n) FROM {fsa}) / (SELECT sum(n) FROM {fsb}) AS e FROM {fsb} b LEFT JOIN {fsa} a USING (kmer))"
_FSN = "SELECT codon || c2 AS kmer, count(*) AS n FROM {nxt} %s WHERE codon IN (SELECT codon FROM {fast}) AND c2 IN (SELECT codon FROM {sym} WHERE codon NOT IN (SELECT codon FROM {fast})) GROUP BY ALL"
PARTS |= {"fsa": _FSN % "SEMI JOIN {seta} USING (gene)", "fsb": _FSN % "", "fsd": tested(f"({_FSD})", "kmer")}
OFTEN |= {"fsa", "fsb", "fsd"}


@query("SELECT kmer, n_set, n_all, CASE WHEN fold > 100 THEN '>100' ELSE (round(fold, 2) + 0.0)::VARCHAR END AS fold, round(z_score, 4) + 0.0 AS z_score, round(adjusted_p, 6) AS adjusted_p FROM {fsd} ORDER BY round(z_score, 6) DESC, kmer LIMIT 30")
def top_fs_dicodons(t: Tables) -> DataFrame:
    """Pairs of a fast and a slow codon by their excess in the set, tested and adjusted."""
    tested_ = _tested(ordered.fs_pairs(t.rows, t.set_a, t.symbols, t.fast), "kmer")
    fold = F.when(C("fold") > 100, ">100").otherwise((F.round("fold", 2) + 0.0).cast("string"))
    best = tested_.orderBy(F.round("z_score", 6).desc(), "kmer").limit(30)
    return best.select("kmer", "n_set", "n_all", fold.alias("fold"), _z(), F.round("adjusted_p", 6).alias("adjusted_p"))


@query("SELECT gene, round(w / total, 9) AS share FROM {w} SEMI JOIN {seta} USING (gene), (SELECT sum(w) AS total FROM {w} SEMI JOIN {seta} USING (gene)) ORDER BY round(w, 6) DESC, gene LIMIT 20")
def demand_top_genes(t: Tables) -> DataFrame:
    rank = weights.demand_rank(frequency.members(t.cds, t.set_a), t.expression)
    return rank.orderBy(F.round("weight", 6).desc(), "gene").limit(20).select("gene", F.round("share", 9).alias("share"))


@query("SELECT * FROM (SELECT pair, 'head' AS \"end\", round(r, 6) + 0.0 AS r FROM {corrs} WHERE r IS NOT NULL ORDER BY round(r, 9) DESC, pair LIMIT 10) UNION ALL SELECT * FROM (SELECT pair, 'tail', round(r, 6) + 0.0 FROM {corrs} WHERE r IS NOT NULL ORDER BY round(r, 9), pair LIMIT 10)")
def conserved_and_divergent(t: Tables) -> DataFrame:
    """The ten pairs with the greatest and the ten with the least correlation."""
    corr = _correlations(t).where("r is not null").withColumn("rr", F.round("r", 9))
    return tables.head_and_tail(corr, "rr", "pair", 10).select("pair", "end", r6("r").alias("r"))


@query("WITH x AS ({CAI}) SELECT side, count(*) AS n, round(min(cai), 5) AS least, round(quantile_cont(cai, 0.25), 5) AS q1, round(median(cai), 5) AS median, round(quantile_cont(cai, 0.75), 5) AS q3, round(max(cai), 5) AS most FROM (SELECT 'genome' AS side, cai FROM x UNION ALL SELECT 'set', cai FROM x SEMI JOIN {seta} USING (gene)) GROUP BY side".replace("({CAI})", "(SELECT * FROM {cai})"))
def cai_box(t: Tables) -> DataFrame:
    scores = _cai(t)
    both = tables.quartiles(scores, "cai").withColumn("side", F.lit("genome")).unionByName(tables.quartiles(scores.join(t.set_a, "gene", "left_semi"), "cai").withColumn("side", F.lit("set")))
    return both.select("side", "n", *[F.round(c, 5).alias(c) for c in ("least", "q1", "median", "q3", "most")])


@query("SELECT i::INT AS bin, round(count(*) / sum(count(*)) OVER () / 0.05, 6) AS density FROM (SELECT least(greatest(floor((r + 1) / 0.05 + 1e-9), 0), 39) AS i FROM {corrs} WHERE r IS NOT NULL) GROUP BY i")
def correlation_histogram(t: Tables) -> DataFrame:
    """40 equal bins on [-1, 1], as densities."""
    rows = _correlations(t).where("r is not null").select(F.least(F.greatest(F.floor((C("r") + 1) / 0.05 + 1e-9), F.lit(0)), F.lit(39)).cast("int").alias("bin"))
    n = rows.groupBy("bin").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("total")))).select("bin", F.round(C("n") / C("total") / 0.05, 6).alias("density"))
