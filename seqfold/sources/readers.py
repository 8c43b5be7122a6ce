"""Readers for the text formats of sequence analysis. All take paths that Spark can read and declare their columns; none infers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(gene, header, seq): a record is a header after ">" and lines of sequence; the gene is the header's first word. Compressed files are read whole."""
    return fasta_records(spark.read.option("lineSep", "\n>").text(path).where("trim(value) <> ''"))


def fasta_records(records: DataFrame) -> DataFrame:
    """fasta of records in a column value, with or without their leading ">"."""
    parts = F.split(F.regexp_replace("value", "^\\s*>", ""), "\n", 2)
    seq = F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "\\s", "")
    return records.select(F.split(F.trim(parts[0]), "\\s+")[0].alias("gene"), F.trim(parts[0]).alias("header"), seq.alias("seq")).where("gene <> ''")


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated with a header. Identifiers that look like numbers stay strings if the schema says so."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def wide_expression(wide: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, sample, tpm) of one column for each sample."""
    samples = [c for c in wide.columns if c not in ids]
    return wide.unpivot(ids, samples, "sample", "tpm").withColumn("tpm", F.coalesce(F.expr("try_cast(tpm as double)"), F.lit(0.0)))


def gct(spark: SparkSession, path: str) -> DataFrame:
    """gct_lines of a file, compressed or not."""
    return gct_lines(spark.read.text(path))


def gct_lines(lines: DataFrame) -> DataFrame:
    """(gene, symbol, sample, tpm) of lines (value): two lines of preamble, a header, then rows; versions are cut from genes; what is no number is 0."""
    lines = lines.where("value not like '#%' and not value rlike '^[0-9]+\\\\t[0-9]+$'")
    header = lines.where("value like 'Name\\t%'").first().value.split("\t")  # one line
    cells = F.split("value", "\t")
    rows = lines.where("value not like 'Name\\t%'").select(F.substring_index(cells[0], ".", 1).alias("gene"), cells[1].alias("symbol"), F.posexplode(F.slice(cells, 3, len(header))).alias("i", "raw"))
    names = F.array(*map(F.lit, header[2:]))
    number = F.expr("try_cast(raw as double)")
    return rows.select("gene", "symbol", F.get(names, F.col("i")).alias("sample"), F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0)).alias("tpm"))


def cell_lines(models: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, model, tpm) of a matrix of models by genes: columns "SYMBOL (ENTREZ)", values log2(tpm + 1).

    models: model_id and one column for each gene, and perhaps is_default, then "Yes" or true for the row of a model that counts;
    genes: (gene, symbol, entrez). Without that column the first row of a model counts, an
    Entrez match goes before a symbol match, and of several columns of a gene the first."""
    if "is_default" in models.columns:
        models = models.where(F.lower(F.col("is_default").cast("string")).isin("yes", "true")).drop("is_default")
    columns = [c for c in models.columns if c != "model_id"]
    cells = models.dropDuplicates(["model_id"]).select("model_id", F.posexplode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns])).alias("at", "c"))
    return _named_cells(cells.select("model_id", "at", "c.*"), genes)


def cell_line_files(spark: SparkSession, path: str, genes: DataFrame) -> DataFrame:
    """cell_lines of comma-separated files, each of which begins with the same header. A matrix of very many genes has no column of a frame for each: a
    line is cut into cells by place, and the header's cells meet them by place, so that neither plan nor driver grows with the genes.
    The header's first cell names the column of models, is_default may stand anywhere, and an empty cell is no measurement. Of several rows of a model the first in the order of files and places counts."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("row")).where("trim(value) <> ''")
    lines = lines.withColumn("head", F.col("value").startswith("model_id,"))
    names = lines.where("head").orderBy("row").limit(1).select(F.posexplode(F.split("value", ",")).alias("at", "column"))
    default = names.where("column = 'is_default'").agg(F.max("at").alias("flag"))  # one row; null without that column
    rows = lines.where("not head").join(F.broadcast(default)).select("row", F.split("value", ",").alias("cells"), "flag").where("flag is null or lower(cells[flag]) in ('yes', 'true')")
    ids = rows.select(F.col("cells")[0].alias("model_id"), "row")
    first = ids.groupBy("model_id").agg(F.min("row").alias("row"))
    cells = rows.join(first.select("row"), "row", "left_semi").select(F.col("cells")[0].alias("model_id"), F.posexplode("cells").alias("at", "raw")).where("at > 0 and raw <> ''")
    return _named_cells(cells.join(names.where("at > 0 and column <> 'is_default'"), "at").select("model_id", "at", "column", F.expr("try_cast(raw as double)").alias("x")), genes)


def _named_cells(cells: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, model, tpm) of (model_id, at, column, x)."""
    keyed = cells.select("model_id", "at", F.regexp_extract("column", r"^(\S+)", 1).alias("symbol"), F.regexp_extract("column", r"\((\d+)\)", 1).alias("entrez"), F.greatest(F.pow(F.lit(2.0), F.col("x")) - 1, F.lit(0.0)).alias("tpm"))
    by_id = genes.where("entrez is not null").groupBy("entrez").agg(F.min("gene").alias("g1"))
    by_name = genes.groupBy("symbol").agg(F.min("gene").alias("g2"))
    named = keyed.join(by_id, "entrez", "left").join(by_name, "symbol", "left").withColumn("gene", F.coalesce("g1", "g2")).where("gene is not null")
    return named.groupBy("gene", "model_id").agg(F.min(F.struct("at", "tpm"))["tpm"].alias("tpm")).withColumnRenamed("model_id", "model")


def trna_headers(lines: DataFrame) -> DataFrame:
    """(anticodon, aa, copies) from headers in a column value: "tRNA-Ala-AGC-1-1", "Ala (AGC)" or "AlaAGC" in this order; T is read
    as U; initiator, selenocysteine, suppressor and undetermined ones are left out; of a repeated anticodon the first family counts."""
    styles = (r"tRNA-([A-Za-z]+)-([ACGTU]{3})", r"([A-Z][a-z]{2}) \(([ACGTU]{3})\)", r"\b([A-Z][a-z]{2})([ACGTU]{3})\b")
    aa = F.coalesce(*[F.nullif(F.regexp_extract("value", s, 1), F.lit("")) for s in styles])
    anti = F.coalesce(*[F.nullif(F.regexp_extract("value", s, 2), F.lit("")) for s in styles])
    found = lines.select("value", "line", aa.alias("aa"), F.translate(anti, "T", "U").alias("anticodon")).where("anticodon is not null and aa not in ('iMet', 'SeC', 'Sup', 'Undet')")
    return found.groupBy("anticodon").agg(F.min_by("aa", "line").alias("aa"), F.count("*").alias("copies"))


def gene_list(lines: DataFrame) -> DataFrame:
    """(token) of a column value: lines that begin with # and empty ones are dropped, others split at commas, tabs and blanks."""
    used = lines.where("trim(value) <> '' and not trim(value) like '#%'")
    return used.select(*[c for c in lines.columns if c != "value"], F.explode(F.split(F.trim(F.translate("value", ",\t", "  ")), "\\s+")).alias("token")).where("token <> ''")


def mane_summary(rows: DataFrame) -> DataFrame:
    """(transcript, gene, symbol, refseq, entrez) of the selected transcripts of a summary table."""
    return rows.where("MANE_status = 'MANE Select'").select(F.substring_index("Ensembl_nuc", ".", 1).alias("transcript"), F.substring_index("Ensembl_Gene", ".", 1).alias("gene"), "symbol", F.col("RefSeq_nuc").alias("refseq"), F.regexp_replace("`#NCBI_GeneID`", "^GeneID:", "").alias("entrez"))


def orthologs(rows: DataFrame, target: str) -> DataFrame:
    """(gene1, gene2), distinct: one-to-one pairs with the target species that are not of low confidence."""
    ok = rows.where((F.col("homology_type") == "ortholog_one2one") & (F.col("homology_species") == target) & (F.coalesce("is_high_confidence", F.lit("1")) != "0"))
    return ok.select(F.col("gene_stable_id").alias("gene1"), F.col("homology_gene_stable_id").alias("gene2")).distinct()


def gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """(name, gene), distinct, of a folder of gene lists; a list's name is its file's, without the last suffix."""
    lines = spark.read.text(path).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("name"), "value")
    return gene_list(lines).select("name", F.col("token").alias("gene")).distinct()
