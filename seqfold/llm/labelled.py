"""The bounded sample of labelled documents that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 8000
SAMPLE_CHARS = 40_000_000  # of all texts of the sample together; a text of more than an eighth of it takes no part


def sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", chars: int = SAMPLE_CHARS) -> list:
    """Rows (doc_id, quality, toxic, text) of at most limit labelled documents, in the order of a hash of the id.

    Texts are taken whole. One of more than an eighth of chars characters is left out; where the others of limit rows have more than chars
    characters together, the sample ends before the row that goes over, so it has eight rows at least, if there are as many. Where
    labelled documents are there, but all of them too long, a ValueError tells so; without labelled documents the sample is empty. Labels with a null stay out; of several labels of an id the largest counts, of several texts
    the least."""
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null")
    picked = rated.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    one = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text"))
    sofar = F.sum(F.length("text")).over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id"))  # limit rows at most
    short = one.where(F.length("text") <= chars // 8)
    rows = sorted(short.withColumn("sofar", sofar).where(F.col("sofar") <= chars).drop("sofar").collect(), key=lambda r: r.doc_id)
    if not rows and not one.isEmpty():
        raise ValueError(f"every labelled text has more than {chars // 8} characters")
    return rows
