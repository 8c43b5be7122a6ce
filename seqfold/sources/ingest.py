"""From raw tables and sequence headers to genes, lengths and abundances. Sources are frames of local files; nothing is fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqfold.operators import ids, sequences


def _coding(records: DataFrame) -> DataFrame:
    """The valid ones of records (.., seq), upper-cased and without their end codon, with cds_length and gc."""
    upper = records.withColumn("seq", F.upper("seq"))
    kept = upper.where(sequences.is_coding(F.col("seq"))).withColumn("seq", F.expr("substring(seq, 1, length(seq) - 3)"))
    return kept.withColumns({"cds_length": F.length("seq"), "gc": sequences.gc(F.col("seq"))})


def yeast_genes(records: DataFrame) -> DataFrame:
    """(gene, common_name, sgd_id, status, cds_length, gc, seq) of records (header, seq).

    The header's first part has the systematic name and, unless an id follows, the common one; mitochondrial genes (Q0) are left out."""
    name = F.split(F.trim(F.split("header", ",")[0]), "\\s+")
    sgd, low = F.regexp_extract("header", r"SGDID:(S\d+)", 1), F.lower("header")
    status = F.when(low.contains("verified"), "Verified").when(low.contains("uncharacterized"), "Uncharacterized").when(low.contains("dubious"), "Dubious").otherwise("")
    told = records.where(F.size(name) >= 2).select(name[0].alias("gene"), F.when(name[1].startswith("SGDID"), "").otherwise(name[1]).alias("common_name"), F.when(sgd != "", F.concat(F.lit("SGD:"), sgd)).otherwise("").alias("sgd_id"), status.alias("status"), "seq")
    return _coding(told.where("not startswith(gene, 'Q0')")).select("gene", "common_name", "sgd_id", "status", "cds_length", "gc", "seq")


def selected_cds(records: DataFrame, summary: DataFrame) -> DataFrame:
    """(gene, symbol, transcript, refseq, entrez, cds_length, gc, seq): of records (nth, header, seq) the valid ones whose transcript the summary selects; a gene's first one counts."""
    told = records.select("nth", F.substring_index(F.split("header", "\\s+")[0], ".", 1).alias("transcript"), "seq").join(summary, "transcript")
    return ids.first_per(_coding(told), ["gene"], [F.col("nth")]).select("gene", "symbol", "transcript", "refseq", "entrez", "cds_length", "gc", "seq")


def best_cds(records: DataFrame, canonical: DataFrame | None = None, least: int = 9) -> DataFrame:
    """(gene, symbol, transcript, cds_length, gc, seq): of each gene's valid records (nth, header, seq) the canonical transcript, else the longest, else the first.

    canonical: (gene, transcript). Headers name gene:ID and gene_symbol:NAME."""
    gene = F.substring_index(F.regexp_extract("header", r"gene:(\S+)", 1), ".", 1)
    told = records.select("nth", gene.alias("gene"), F.regexp_extract("header", r"gene_symbol:(\S+)", 1).alias("symbol"), F.substring_index(F.split("header", "\\s+")[0], ".", 1).alias("transcript"), "seq").where("gene <> ''")
    valid = _coding(told).where(F.col("cds_length") >= least)
    if canonical is None:
        marked = valid.withColumn("chosen", F.lit(False))
    else:
        marked = valid.join(canonical.select("gene", "transcript", F.lit(True).alias("chosen")), ["gene", "transcript"], "left").na.fill(False, ["chosen"])
    return ids.first_per(marked, ["gene"], [F.desc("chosen"), F.desc("cds_length"), F.col("nth")]).select("gene", "symbol", "transcript", "cds_length", "gc", "seq")


def mgi_report(lines: DataFrame, genes: DataFrame) -> DataFrame:
    """(mgi_id, symbol, entrez, synonyms, gene) of the report's lines (value) that are not withdrawn; genes: (gene, name); without a gene of the symbol it is empty."""
    cell = F.split("value", "\t")

    def at(i: int) -> Column:
        return F.trim(F.coalesce(F.get(cell, F.lit(i)), F.lit("")))

    rows = lines.where(F.col("value").startswith("MGI:") & (F.size(cell) >= 3) & (F.lower(at(2)) != "w")).select(at(0).alias("mgi_id"), at(1).alias("symbol"), at(8).alias("entrez"), at(9).alias("synonyms"))
    named = genes.where("trim(name) <> ''").groupBy(F.upper(F.trim("name")).alias("key")).agg(F.max("gene").alias("gene"))
    return rows.withColumn("key", F.upper("symbol")).join(named, "key", "left").select("mgi_id", "symbol", "entrez", "synonyms", F.coalesce(F.col("gene").cast("string"), F.lit("")).alias("gene"))


def protein_map(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(uniprot, gene), distinct, of known genes."""
    return rows.select("uniprot", "gene").join(known.select("gene"), "gene", "left_semi").select("uniprot", "gene").distinct()


def orthologs_or(found: DataFrame, fallback: DataFrame, least: int = 100) -> DataFrame:
    """(gene1, gene2), distinct: the pairs found if there are least of them, else the fallback's."""
    return (found if found.limit(least).count() == least else fallback).select("gene1", "gene2").distinct()


#: Names of the id column of a counts table, and of an abundance table, in the order in which they are looked for.
COUNT_IDS = ("Geneid", "gene_id", "Gene", "gene", "GeneID", "gene_name", "GeneName", "Symbol", "symbol")
EXPRESSION_IDS = ("gene_id", "systematic_name", "ensembl_gene", "symbol", "gene")


def _column(df: DataFrame, asked: str | None, candidates: tuple[str, ...]) -> str:
    if asked is not None and asked not in df.columns:
        raise ValueError(f"no column {asked}; there are {df.columns}")
    return asked or next((c for c in candidates if c in df.columns), df.columns[0])


def raw_counts(table: DataFrame, gene_column: str | None = None, length_column: str | None = None, sample: str | None = None) -> DataFrame:
    """(gene, count, length) of a counts table: one sample, by default the first numeric column; summary rows (__) are dropped; length is null if there is none."""
    gene = _column(table, gene_column, COUNT_IDS)
    length = _column(table, length_column, ()) if length_column else "Length" if "Length" in table.columns else None
    samples = [f.name for f in table.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in (gene, length)]
    if sample is not None and sample not in samples:
        raise ValueError(f"no sample {sample}; there are {samples}")
    if not samples:
        raise ValueError("no numeric column")
    size = F.col(f"`{length}`").cast("double") if length else F.lit(None).cast("double")
    return table.where(~F.col(f"`{gene}`").cast("string").startswith("__")).select(F.col(f"`{gene}`").cast("string").alias("gene"), F.col(f"`{sample or samples[0]}`").cast("double").alias("count"), size.alias("length"))


def length_keys(genes: DataFrame) -> DataFrame:
    """(key, length): lengths under every kind of name of genes (systematic, common, transcript, entrez, cds_length); of genes with equal names the later kind, then the larger gene, counts."""
    names = ((0, F.col("systematic")), (1, F.col("common")), (2, F.upper("common")), (3, F.col("transcript")), (4, F.col("entrez").cast("double").cast("long").cast("string")))
    each = genes.select("systematic", "cds_length", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), n.cast("string").alias("key")) for k, n in names])).alias("n")).where("n.key is not null and n.key <> ''")
    return each.groupBy(F.col("n.key").alias("key")).agg(F.max_by("cds_length", F.struct("n.kind", "systematic")).cast("double").alias("length"))


def with_lengths(counts: DataFrame, keys: DataFrame) -> DataFrame:
    """counts (gene, count, ..) with the length of their name, else of their upper-cased name; others are left out."""
    by_name = counts.drop("length").join(keys.select(F.col("key").alias("gene"), F.col("length").alias("l1")), "gene", "left")
    both = by_name.withColumn("key", F.upper("gene")).join(keys.select("key", F.col("length").alias("l2")), "key", "left").drop("key")
    return both.withColumn("length", F.coalesce("l1", "l2")).drop("l1", "l2").where("length is not null")


def custom_expression(table: DataFrame, aliases: DataFrame, order: str | None = None) -> DataFrame:
    """(gene, tpm) of a user's table: needs a column tpm; ids are resolved by aliases; of a gene's rows the last one counts (by order, else as read)."""
    if "tpm" not in table.columns:
        raise ValueError(f"no column tpm; there are {table.columns}")
    named = table.select(F.col(f"`{_column(table, None, EXPRESSION_IDS)}`").cast("string").alias("input_id"), F.col("tpm").cast("double").alias("tpm"), (F.col(order) if order else F.monotonically_increasing_id()).alias("nth"))
    found = ids.resolve(named.select("input_id").distinct(), aliases).where("gene is not null").select("input_id", "gene")
    return named.join(found, "input_id").groupBy("gene").agg(F.max_by("tpm", "nth").alias("tpm"))


#: The sample that stands for a species if none is asked for.
DEFAULT_SAMPLE = {"yeast": "rich_media", "human": "HEK293T", "mouse": "estimates"}


def expression_of(table: DataFrame, species: str, sample: str | None = None) -> DataFrame:
    """(gene, tpm) of a table (species, sample, gene, tpm): the sample whose name, without case, blanks and signs, is the one asked for, else the first that contains it."""
    plain = ids.normalised_line(F.col("sample"))
    asked = ids.normalised_line(F.lit(sample or DEFAULT_SAMPLE[species]))
    hits = table.where((F.col("species") == species) & plain.contains(asked))
    best = hits.select("sample", (plain != asked).cast("int").alias("far")).distinct().orderBy("far", "sample").limit(1).select("sample")
    return hits.join(F.broadcast(best), "sample").select("gene", "tpm")


def line_names(*tables: DataFrame) -> DataFrame:
    """(name), distinct and in order: the samples that several tables (sample, ..) offer."""
    out = tables[0].select(F.col("sample").alias("name"))
    for t in tables[1:]:
        out = out.unionByName(t.select(F.col("sample").alias("name")))
    return out.distinct().orderBy("name")
