"""Choosing one sample (a tissue or a cell line) for each asked name, by substrings in both directions over an index of runs of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqfold.functions import dims
from seqfold.operators import ids
from seqfold.sources import shared

GRAM = 8


def tissue_name(name: Column) -> Column:
    """Lower-cased, with a blank for - and _."""
    return F.translate(F.lower(name), "_-", "  ")


def _grams(text: Column, size: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(text, i, size)))


def contained(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """(needle, straw): every distinct text of hay (straw) that holds one of needles (needle). Empty texts take no part.

    Each needle is looked up under the one of its grams (runs of GRAM characters) that the fewest straws have, a shorter needle under itself, and what is found there is
    verified. Postings are kept only for grams that needles have, and made only of lengths that needles have. So work follows the postings of rare grams,
    not the product of both sides: GRAM is long, since of the trigrams of numbered names even the rarest is in a fixed share of all of them.
    All joins are by merging: estimates of exploded rows are far too small, and what they would broadcast grows with the tables."""
    asked = needles.where("needle <> ''").distinct()
    own = asked.select("needle", F.explode(_grams(F.col("needle"), F.least(F.length("needle"), F.lit(GRAM)))).alias("gram"))
    lengths = sorted(r.k for r in asked.select(F.least(F.length("needle"), F.lit(GRAM)).alias("k")).distinct().collect())  # GRAM at most
    sizes = F.flatten(F.transform(F.array(*map(F.lit, lengths or [GRAM])), lambda k: _grams(F.col("straw"), k)))
    cut = hay.where("straw <> ''").distinct().select("straw", F.explode(F.array_distinct(sizes)).alias("gram"))
    postings = shared.written(cut.join(own.select("gram").distinct().hint("merge"), "gram", "left_semi"), "postings")
    common = postings.groupBy("gram").agg(F.count("*").alias("n"))
    rare = own.join(common.hint("merge"), "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("needle", "r.gram")
    return rare.join(postings.hint("merge"), "gram").where(F.contains("straw", "needle")).select("needle", "straw")


def matched(asked: DataFrame, names: DataFrame, normal, both_ways: bool = True) -> DataFrame:
    """(ask, name, how) for each distinct ask of asked: how is exact or substring; without a match both are null.

    names: (name, place). Names and asked ones are compared in their normal form (a function of a column). An equal one comes first, else of those that hold the asked one, or with
    both_ways are held by it, the first in place. Names of one normal form stand at the first one's place and are told as the last one."""
    ask = asked.select("ask").where("ask is not null").distinct().withColumn("a", normal(F.col("ask")))
    known = names.where("name is not null").groupBy(normal(F.col("name")).alias("n")).agg(F.min("place").alias("place"), F.max_by("name", "place").alias("name"))
    equal = ask.select("a").distinct().join(known.hint("merge"), F.col("a") == F.col("n")).where("a <> ''").select("a", "n", F.lit(0).alias("rank"))
    inside = contained(ask.select(F.col("a").alias("needle")), known.select(F.col("n").alias("straw"))).select(F.col("needle").alias("a"), F.col("straw").alias("n"), F.lit(1).alias("rank"))
    found = equal.unionByName(inside)
    if both_ways:
        around = contained(known.select(F.col("n").alias("needle")), ask.select(F.col("a").alias("straw")))
        found = found.unionByName(around.select(F.col("straw").alias("a"), F.col("needle").alias("n"), F.lit(1).alias("rank")))
    best = found.join(known.hint("merge"), "n").groupBy("a").agg(F.min(F.struct("rank", "place", "name")).alias("b"))
    return ask.join(best.hint("merge"), "a", "left").select("ask", F.col("b.name").alias("name"), F.when(F.col("b.rank") == 0, "exact").when(F.col("b.rank") == 1, "substring").alias("how"))


def tissues(asked: DataFrame, names: DataFrame) -> DataFrame:
    """The tissue of each asked name: equal, else the first that holds it."""
    return matched(asked, names, tissue_name, both_ways=False)


def cell_lines(asked: DataFrame, names: DataFrame, proxies: DataFrame | None = None) -> DataFrame:
    """(ask, name, how): the cell line of each asked name by matched in both directions, else the tissue that stands for it (how: proxy).

    proxies: (line, tissue, place), by default the fixed ones; their lines are matched like the names."""
    own = shared.written(matched(asked, names, ids.normalised_line), "lines")  # read twice
    if proxies is None:
        rows = [(line, tissue, i) for i, (line, tissue) in enumerate(dims.LINE_TISSUES)]
        proxies = asked.sparkSession.createDataFrame(rows, "line string, tissue string, place int")
    stand_in = matched(own.where("name is null").select("ask"), proxies.select(F.col("line").alias("name"), "place"), ids.normalised_line).withColumnRenamed("name", "line").drop("how")
    tissue = stand_in.join(F.broadcast(proxies.select("line", "tissue")) if proxies.count() <= 10_000 else proxies.select("line", "tissue"), "line").select("ask", "tissue")
    return own.join(tissue.hint("merge"), "ask", "left").select("ask", F.coalesce("name", "tissue").alias("name"), F.coalesce("how", F.when(F.col("tissue").isNotNull(), "proxy")).alias("how"))
