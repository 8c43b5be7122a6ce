"""Sequences, their symbols and k-mers. An entity is a gene, its sequence a string over ACGT read in threes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqfold.functions.dims import STOPS

_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def from_documents(docs: DataFrame) -> DataFrame:
    """(gene, seq, lang, n_chars): letters of a text mapped onto ACGT in turn, cut to a multiple of three; null texts are empty."""
    letters = F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z]", ""), _LETTERS, ("ACGT" * 13)[:52])
    raw = docs.select(F.col("doc_id").alias("gene"), letters.alias("raw"), "lang", "n_chars")
    return raw.select("gene", F.expr("substring(raw, 1, int(length(raw) div 3) * 3)").alias("seq"), "lang", "n_chars")


def codon_array(seq: Column) -> Column:
    """The symbols in order, in one linear pass."""
    return F.regexp_extract_all(seq, F.lit("..."), F.lit(0))


def kmer_array(seq: Column, k: int) -> Column:
    """Overlapping runs of k symbols of a sequence, in one linear pass: each match moves on by a symbol and looks k symbols ahead."""
    return codon_array(seq) if k == 1 else F.regexp_extract_all(seq, F.lit(f"(?=(.{{{3 * k}}}))..."), F.lit(1))


# The arrays below are exploded where they are made: an array that is a column of its own first is several times slower to explode.


def positions(cds: DataFrame, *carried: str) -> DataFrame:
    """(gene, pos, codon, n): one row for each symbol; n is the number of the gene's symbols. carried: columns of cds that ride along."""
    return cds.select("gene", *carried, (F.length("seq") / 3).cast("int").alias("n"), F.posexplode(codon_array(F.col("seq"))).alias("pos", "codon"))


def kmer_counts(cds: DataFrame, k: int) -> DataFrame:
    """(gene, kmer, cnt): how often each run of k symbols occurs. Counts are combined before the shuffle."""
    return cds.select("gene", F.explode(kmer_array(F.col("seq"), k)).alias("kmer")).groupBy("gene", "kmer").agg(F.count("*").alias("cnt"))


def kmer_totals(cds: DataFrame, k: int) -> DataFrame:
    """(kmer, n): how often each run of k symbols occurs in all genes together; only sums by k-mer are shuffled."""
    return cds.select(F.explode(kmer_array(F.col("seq"), k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def sense(kmer: Column, k: int) -> Column:
    """Whether a k-mer has sense codons only."""
    out = ~F.substring(kmer, 1, 3).isin(*STOPS)
    for i in range(1, k):
        out = out & ~F.substring(kmer, 3 * i + 1, 3).isin(*STOPS)
    return out


def occurrences(cds: DataFrame, k: int, *carried: str) -> DataFrame:
    """(gene, kmer, windows): a row for each sense k-mer in place; windows counts all of the gene's runs, with stops too. carried: columns of cds that ride along."""
    rows = cds.select("gene", *carried, (F.length("seq") / 3 - (k - 1)).cast("int").alias("windows"), F.explode(kmer_array(F.col("seq"), k)).alias("kmer"))
    return rows.where(sense(F.col("kmer"), k))


def kmer_freq(cds: DataFrame, k: int, *carried: str) -> DataFrame:
    """(gene, kmer, freq) of sense k-mers. The number of windows rides along in the grouping key, which spares a join, and so do carried columns of a gene."""
    counts = occurrences(cds, k, *carried).groupBy("gene", "kmer", "windows", *carried).agg(F.count("*").alias("cnt"))
    return counts.select("gene", *carried, "kmer", (F.col("cnt") / F.col("windows")).alias("freq"))


def cells(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, kmer, freq) of sense k-mers of rows (keys, seq), and for each row an empty k-mer that counts as 1: its sum is the number of rows, those
    with a null or short sequence too, so that means need no second pass."""
    windows = F.greatest(F.length(F.coalesce("seq", F.lit(""))) / 3 - (k - 1), F.lit(0)).cast("int").alias("windows")
    each = rows.select(*keys, windows, F.explode(F.concat(F.array(F.lit("")), kmer_array(F.coalesce("seq", F.lit("")), k))).alias("kmer"))
    counts = each.where(sense(F.col("kmer"), k)).groupBy(*keys, "kmer", "windows").agg(F.count("*").alias("cnt"))
    return counts.select(*keys, "kmer", F.when(F.col("kmer") == "", F.col("cnt").cast("double")).otherwise(F.try_divide("cnt", "windows")).alias("freq"))


def target_freq(cds: DataFrame, targets: list[str]) -> DataFrame:
    """(gene, n, and a column for each target codon): its frequency in the gene, 0 where it is absent. Row by row, without a shuffle."""
    held = cds.select("gene", codon_array(F.col("seq")).alias("c")).select("gene", F.size("c").alias("n"), *[(F.size("c") - F.size(F.array_remove("c", t))).alias(t) for t in targets])
    return held.select("gene", "n", *[F.when(F.col("n") > 0, F.col(t) / F.col("n")).otherwise(0.0).alias(t) for t in targets])


def trimmed(cds: DataFrame, codons: int) -> DataFrame:
    """cds without the first codons; genes that end before stay, with an empty sequence."""
    return cds.withColumn("seq", F.substring("seq", 3 * codons + 1, 2**31 - 1))


def region(cds: DataFrame, start: int, end: int | None, least: int = 1) -> DataFrame:
    """Codons [start, end) of each gene that keeps at least least of them."""
    size = 2**31 - 1 if end is None else 3 * (end - start)
    return cds.withColumn("seq", F.substring("seq", 3 * start + 1, size)).where(F.length("seq") >= 3 * least)


def is_coding(s: Column) -> Column:
    """Whether a sequence has ACGT only, a length in threes, a start and an end codon and none inside; never null."""
    inside = F.exists(codon_array(s.substr(F.lit(1), F.length(s) - 3)), lambda c: c.isin(*STOPS))
    return F.coalesce(s.rlike("^[ACGT]+$") & (F.length(s) % 3 == 0) & s.startswith("ATG") & s.rlike(f"({'|'.join(STOPS)})$") & ~inside, F.lit(False))


def validated(raw: DataFrame) -> DataFrame:
    """(gene, valid, seq) of (gene, seq): whether it is a coding sequence, and if so the sequence without its end codon."""
    ok = is_coding(F.col("seq"))
    return raw.select("gene", ok.alias("valid"), F.when(ok, F.expr("substring(seq, 1, length(seq) - 3)")).alias("seq"))


def gc(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, F.length(F.translate(seq, "AT", "")).cast("double") / F.length(seq)).otherwise(0.0)


def gc3(seq: Column) -> Column:
    """GC share of the third positions."""
    return gc(F.regexp_replace(seq, "..(.)", "$1"))
