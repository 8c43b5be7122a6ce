"""Identifier detection and resolution as joins, and the deduplications that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Type of an identifier and its pattern, in the order in which they are tried.
PATTERNS = (
    ("yeast_systematic", r"^Y[A-P][LR]\d{3}[WC](-[A-Z])?$"),
    ("ensmusg", r"^ENSMUSG\d{11}(\.\d+)?$"),
    ("ensmust", r"^ENSMUST\d{11}(\.\d+)?$"),
    ("ensg", r"^ENSG\d{11}(\.\d+)?$"),
    ("enst", r"^ENST\d{11}(\.\d+)?$"),
    ("ensembl_other", r"^ENS.*\d"),
    ("mgi_id", r"^MGI:\d+$"),
    ("sgd_id", r"^SGD:S\d+$"),
    ("refseq_nm", r"^NM_\d+(\.\d+)?$"),
    ("entrez", r"^\d{4,}$"),
    ("uniprot", r"^([OPQ]\d[A-Z0-9]{3}\d|[A-NR-Z]\d([A-Z][A-Z0-9]{2}\d){1,2})$"),
)


def id_type(identifier: Column) -> Column:
    upper = F.upper(F.trim(identifier))
    kind = F.lit(None)
    for name, pattern in reversed(PATTERNS):
        kind = F.when(upper.rlike(pattern), name).otherwise(kind)
    return F.coalesce(kind, F.lit("gene_symbol"))


def resolve(inputs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(input_id, gene, matched): each input with its gene, or null.

    aliases: (key_upper, id_type, gene, priority). An input meets aliases under its upper-cased form and without its
    version; symbols also meet lower-ranked names. The exact form comes before the stripped one, then
    the lower priority, then the lower gene. Candidates are reduced by a minimum, which combines before the shuffle."""
    upper = F.upper(F.trim("input_id"))
    forms = F.array_distinct(F.array(upper, F.substring_index(upper, ".", 1)))
    asked = inputs.select("input_id").distinct().withColumn("type", id_type(F.col("input_id"))).select("input_id", "type", F.posexplode(forms).alias("form", "key_upper"))
    fits = (F.col("id_type") == F.col("type")) | F.col("type").isin("gene_symbol", "uniprot", "ensembl_other") & F.col("id_type").isin("gene_symbol", "systematic", "alias")
    hits = asked.join(aliases, "key_upper").where(fits)
    best = hits.groupBy("input_id").agg(F.min(F.struct("form", "priority", "gene", "id_type")).alias("b"))
    return inputs.join(best, "input_id", "left").select("input_id", F.col("b.gene").alias("gene"), F.col("b.id_type").alias("matched"))


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; the engine prunes each partition to its group's best rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def exploded_aliases(names: DataFrame, known: DataFrame) -> DataFrame:
    """(alias, gene, kind): pipe-separated previous names, then aliases, of known genes; without self-aliases, the first gene of each.

    names: (gene, symbol, previous, aliases)."""
    def part(column: str, kind: str, rank: int) -> DataFrame:
        one = names.select("gene", "symbol", F.explode(F.split(F.translate(F.coalesce(column, F.lit("")), '"', ""), r"\|")).alias("alias"))
        return one.select(F.trim("alias").alias("alias"), "gene", "symbol", F.lit(kind).alias("kind"), F.lit(rank).alias("rank"))

    both = part("previous", "previous", 0).unionByName(part("aliases", "alias", 1)).where("alias <> '' and upper(alias) <> upper(symbol)")
    kept = both.join(known.select("gene"), "gene", "left_semi").withColumn("alias", F.upper("alias"))
    return first_per(kept, ["alias"], [F.col("rank"), F.col("gene")]).select("alias", "gene", "kind")


def name_matched(left: DataFrame, right: DataFrame, curated: DataFrame, blocked: DataFrame) -> DataFrame:
    """(gene1, gene2): curated pairs first, then equal upper-cased names that are not blocked; each gene2 is used once.

    left, right: (gene, name); curated: (name1, name2); blocked: (name)."""
    a, b = left.select(F.col("gene").alias("gene1"), F.upper("name").alias("n1")), right.select(F.col("gene").alias("gene2"), F.upper("name").alias("n2"))
    chosen = curated.select(F.upper("name1").alias("n1"), F.upper("name2").alias("n2")).join(a, "n1").join(b, "n2").select("gene1", "gene2", F.lit(0).alias("rank"))
    free = a.join(blocked.select(F.upper("name").alias("n1")), "n1", "left_anti")
    equal = free.join(b.withColumnRenamed("n2", "n1"), "n1").select("gene1", "gene2", F.lit(1).alias("rank"))
    return first_per(chosen.unionByName(equal), ["gene2"], [F.col("rank"), F.col("gene1")]).select("gene1", "gene2")


def normalised_line(name: Column) -> Column:
    return F.translate(F.upper(name), " -():", "")


def numeric_text(number: Column) -> Column:
    """An identifier that was read as a number, as text: 6122.0 is 6122."""
    return number.cast("double").cast("long").cast("string")
