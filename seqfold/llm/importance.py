"""Target-distribution importance resampling over hashed words (DSIR), in DataFrame functions.

Features are a text's words (A-Z lower-cased; runs of digits, a-z and characters beyond ASCII), hashed to BUCKETS by CRC-32.
Identical texts are collapsed by grouping the full text: features, and later the weight, are worked out once for each text, and its counts enter the
source's histogram times the number of its rows. A bucket's gain is 1000 times the log ratio of its smoothed shares in the target and in the
source, rounded down; a text's weight is the mean gain of its words, rounded down. Weights join back to rows by the text's SHA-256, and only
then comes the Gumbel noise of each document, which makes the draw a sample without replacement in proportion to the weights' exponentials.

The draw is a global order without a global sort: scores are whole numbers, so rows are counted by score, the score of the last place is
read from these counts (as many as there are distinct scores: some tens of thousands, for gains and noise are logarithms), and only rows at or above
it are dealt by ranges of (score, id), numbered within their range and moved up by the rows of the ranges before.

A null text has no words, weight 0 and is not drawn; a null id is written as an empty one and comes last among ties; repeated rows are
drawn each for itself; an empty source gives an empty result, an empty target a histogram of nothing but its smoothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqfold.llm.license_index import words_of
from seqfold.llm.storage import kept

BUCKETS = 10_000
SEED = 2024
PERCENT = 10
MIN_WORDS = 20


def _buckets(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: (F.crc32(w.cast("binary")) % BUCKETS).cast("int"))


def collapsed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, copies, buckets) of each distinct text; a null one counts as empty."""
    each = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    return each.select(_key(F.col("text")).alias("key"), "copies", _buckets(F.col("text")).alias("buckets"))


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def histogram(texts: DataFrame) -> list[int]:
    """Features in each bucket, of (copies, buckets): at most BUCKETS rows come to the driver."""
    counts = [0] * BUCKETS
    for r in texts.select("copies", F.explode("buckets").alias("b")).groupBy("b").agg(F.sum("copies").alias("n")).collect():
        counts[r.b] = r.n
    return counts


def gains(spark, source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each bucket, by Spark's logarithm."""
    total_s, total_t = sum(source) + BUCKETS, sum(target) + BUCKETS
    rows = spark.createDataFrame(list(zip(range(BUCKETS), source, target, strict=True)), "b int, s long, t long")
    ratio = ((F.col("t") + 1).cast("double") * float(total_s)) / ((F.col("s") + 1).cast("double") * float(total_t))
    return [r.g for r in rows.select("b", F.floor(1000 * F.log(ratio)).alias("g")).orderBy("b").collect()]


def weights(texts: DataFrame, gain: list[int]) -> DataFrame:
    """(key, n_features, weight) of (key, buckets)."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded into one literal
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda s, b: s + F.get(table, b))
    n = F.size("buckets").cast("long")
    return texts.select("key", n.alias("n_features"), F.when(n > 0, F.floor(total / n)).otherwise(0).cast("long").alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 times a Gumbel number) from the first 8 hex digits of SHA-256 of seed:id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score) for every row of docs."""
    texts = kept(collapsed(docs, text_col))
    gain = gains(docs.sparkSession, histogram(texts), histogram(target.select(F.lit(1).alias("copies"), _buckets(F.col(target_text)).alias("buckets"))))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _key(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    return rows.join(weights(texts, gain), "key").select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))


def _ranked(rows: DataFrame) -> DataFrame:
    """rows (doc_id, score, ..) with rank, from 1, by falling score, then id (null last)."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = kept(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("own", own).join(F.broadcast(before), "part").withColumn("rank", (F.col("own") + F.col("before")).cast("long")).drop("part", "own", "before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = PERCENT, least: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of docs: floor(percent * N / 100) of the N rows with at least least words are drawn,
    those with the highest scores, ties to the smaller id; rank is null for the others."""
    rows = kept(scored(docs, target, id_col, text_col, target_text, seed))
    fit = F.col("n_features") >= least
    counts = rows.where(fit).groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()
    places = percent * sum(r.n for r in counts) // 100
    cut, sofar = None, 0
    for r in counts:
        if sofar >= places:
            break
        cut, sofar = r.score, sofar + r.n
    if cut is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    near = F.coalesce(fit & (F.col("score") >= cut), F.lit(False))
    drawn = _ranked(rows.where(near)).withColumn("rank", F.when(F.col("rank") <= places, F.col("rank")))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank").unionByName(rows.where(~near).withColumn("rank", F.lit(None).cast("long")))
