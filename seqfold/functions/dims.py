"""Dimension tables: symbols (codons) with their families, decoding rules, tRNA copies, name constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqfold.functions import decoding

#: The standard genetic code, codons in the order of bases TCAG.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
THREE = dict(zip("ARNDCQEGHILKMFPSTWYV", "Ala Arg Asn Asp Cys Gln Glu Gly His Ile Leu Lys Met Phe Pro Ser Thr Trp Tyr Val".split(), strict=True))
FAMILY = {a + b + c: THREE[CODE[16 * i + 4 * j + k]] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG") if CODE[16 * i + 4 * j + k] != "*"}
SYNONYMS = {c: sum(g == f for g in FAMILY.values()) for c, f in FAMILY.items()}
STOPS = ("TAA", "TAG", "TGA")

#: Cell lines, and the tissue that stands for each where it was not measured.
LINE_TISSUES = (
    ("HEK293T", "Kidney - Cortex"),
    ("HEK293", "Kidney - Cortex"),
    ("HELA", "Uterus"),
    ("U2OS", "Cells - Cultured fibroblasts"),
    ("A549", "Lung"),
    ("MCF7", "Breast - Mammary Tissue"),
    ("K562", "Cells - EBV-transformed lymphocytes"),
    ("JURKAT", "Cells - EBV-transformed lymphocytes"),
    ("HEPG2", "Liver"),
    ("SHSY5Y", "Brain - Cortex"),
    ("RPE1", "Cells - Cultured fibroblasts"),
)


def known_species() -> list[str]:
    return list(decoding.RULES)


def rules(species: str = "yeast") -> list[tuple[str, str, str, str]]:
    """(codon, family, anticodon, decoding type)."""
    return list(decoding.RULES[species])


def copies(species: str = "yeast") -> list[tuple[str, int]]:
    """(anticodon, copies)."""
    return list(decoding.COPIES[species])


def symbols(spark: SparkSession) -> DataFrame:
    """(codon, aa, n_syn): the 61 sense codons."""
    return spark.createDataFrame([(c, FAMILY[c], SYNONYMS[c]) for c in sorted(FAMILY)], "codon string, aa string, n_syn int")


def wobble_rules(spark: SparkSession, species: str = "yeast") -> DataFrame:
    return spark.createDataFrame(rules(species), "codon string, aa string, anticodon string, decoding_type string")


def trna_copies(spark: SparkSession, species: str = "yeast", found: DataFrame | None = None, least: int = 20) -> DataFrame:
    """(anticodon, copies): those found in headers if they name least anticodons, else the fixed ones of the species."""
    if found is not None and found.limit(least).count() == least:
        return found.select("anticodon", F.col("copies").cast("int").alias("copies"))
    return spark.createDataFrame(copies(species), "anticodon string, copies int")


def kmers(spark: SparkSession, k: int, sense_only: bool = True) -> DataFrame:
    """(kmer, families): all runs of k codons, in order; 61, 3,721 or 226,981 of sense codons. families: Lys-Ala of AAGGCT, ? for a stop."""
    codons = sorted(FAMILY) if sense_only else sorted(a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT")
    one = spark.createDataFrame([(c, FAMILY.get(c, "?")) for c in codons], "codon string, family string")
    out = one.select(F.col("codon").alias("kmer"), F.col("family").alias("families"))
    for _ in range(k - 1):  # k is 1 to 3
        out = out.crossJoin(F.broadcast(one)).select(F.concat("kmer", "codon").alias("kmer"), F.concat("families", F.lit("-"), "family").alias("families"))
    return out.orderBy("kmer")
