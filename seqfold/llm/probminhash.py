"""Near-duplicate documents by ProbMinHash over word shingles, banding and exact verification.

Signature: every distinct shingle of a document (five words) is a Poisson process of the rate of its weight; its points fall on random registers and each register keeps the shingle that reaches it first.
Points come in rounds, and a shingle stops as soon as its next point lies beyond the document's slowest
register. Two documents agree in a register with the probability Jaccard of their weighted shingles. Here every
shingle has the weight 1, however often it stands in a text, so that is the Jaccard of the shingle sets, the measure verified.

Bands of the signature give candidate links; a link holds if the Jaccard similarity of the shingle sets is
0.8 or more, computed exactly. A band's bucket is not expanded into pairs. First its members are held against
its most central one, which shares most buckets with others; then, PIVOT_ROUNDS times, those outside the bucket's largest
component against another of its members; last, whatever is still outside against all of the bucket that it can be
similar to. Two sets cannot be if too many of their shingles are in no other open set at all, nor if none of their rarest
shingles is common, of so many that the others alone fall short of the similarity (prefix filter). Both bounds are exact, so
no link between buckets' members is lost, and a large group of copies costs a few comparisons for each copy. Texts with equal
words collapse to one member beforehand.

Rows are told apart by a key, a hash of id and text, so that repeated or null ids are compared like others; rows with equal
ids and texts are one document. Null texts and texts without words have no shingles: a null is a class of its own, texts
without words are copies of each other only if equal. A text of fewer than five words has one shingle, all its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqfold.llm import tokens as T
from seqfold.llm.components import components
from seqfold.llm.storage import kept, unused

U = np.uint64
BANDS, ROWS = 25, 5
SIMILARITY = 0.8
SHINGLE = 5
PIVOT_ROUNDS = 1
BROADCAST_IDS = 1_000_000  # ids (8 bytes each) up to this count are broadcast, more are joined by a shuffle


def signatures(key: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """(n_docs, registers) of shingle hashes; 0 where a document has no shingle. key, doc: distinct pairs."""
    time = np.full(n_docs * registers, np.inf)
    sig = np.zeros(n_docs * registers, U)
    now = np.zeros(len(key))
    live, rounds = np.arange(len(key)), 0
    while len(live):
        r = T.salted(key[live], 2 * rounds + 101)
        now[live] += -np.log(((r >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
        slot = doc[live] * registers + (T.salted(key[live], 2 * rounds + 102) % U(registers)).astype(np.int64)
        np.minimum.at(time, slot, now[live])
        won = time[slot] == now[live]
        sig[slot[won]] = key[live[won]]
        slowest = time.reshape(n_docs, registers).max(axis=1)
        live = live[now[live] < slowest[doc[live]]]
        rounds += 1
    return sig.reshape(n_docs, registers)


def _weighted(w: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, document) and counts, by document."""
    h, doc = T.shingles(w, SHINGLE)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return h[at], doc[at], np.diff(np.append(at, len(h))).astype(float)


def _content(w: T.Words, seed: int) -> np.ndarray:
    """A hash of each document's sequence of words."""
    place = np.arange(len(w.hash)) - w.bounds[:-1][w.doc]
    sums = np.concatenate([[U(0)], np.cumsum(T.salted(w.hash ^ T.salted(place.astype(U), seed), seed + 1))])
    return sums[w.bounds[1:]] - sums[w.bounds[:-1]]


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, name, c1, c2, band): two hashes of a text's words and the hash of each band; band is empty for texts without words."""

    def sketch(batches):
        for b in batches:
            ids, names, texts = b.column("id"), b.column("name"), b.column("text").to_pylist()
            for lo, hi in T.chunks(texts):
                part, n = texts[lo:hi], hi - lo
                w = T.words(part)
                key, doc, _ = _weighted(w)
                sig = signatures(key, doc, np.ones(len(key)), n, bands * rows)  # equal weights: registers agree by what is verified
                band = np.zeros((bands, n), U)
                for k in range(bands):
                    band[k] = U(k + 1)
                    for r in range(rows):
                        band[k] = T.mix(band[k] * U(3) + sig[:, k * rows + r])
                c1, c2, has = _content(w, 31), _content(w, 57), np.diff(w.bounds) > 0
                for i in np.flatnonzero(~has):
                    raw = T.words([(part[i] or "").encode("utf-8", "replace").hex()])  # no words: the text itself, as one word
                    c1[i], c2[i] = (_content(raw, 5)[0], _content(raw, 9)[0])
                sizes = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)
                values = band.T[has].ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, n), names.slice(lo, n), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.ListArray.from_arrays(sizes, pa.array(values))], ["id", "name", "c1", "c2", "band"])

    return docs.mapInArrow(sketch, "id long, name long, c1 long, c2 long, band array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, set): the distinct shingle hashes of each text."""

    def cut(batches):
        for b in batches:
            ids, texts = b.column("id"), b.column("text").to_pylist()
            for lo, hi in T.chunks(texts):
                key, doc, _ = _weighted(T.words(texts[lo:hi]))
                sizes = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=hi - lo))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.ListArray.from_arrays(sizes, pa.array(key.view(np.int64)))], ["id", "set"])

    return docs.mapInArrow(cut, "id long, set array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the distinct pairs (a, b) whose shingle sets have the similarity."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").where(F.least(F.size("x"), F.size("y")) >= similarity * F.greatest(F.size("x"), F.size("y")))
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= F.lit(similarity) * (F.size("x") + F.size("y") - common)).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a over b, of (id, pivot)."""
    return pairs.where("id <> pivot").select(F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b")).distinct()


def _facts(sets: DataFrame, similarity: float) -> DataFrame:
    """(id, n, a, rare): the size of each set, how many of its shingles another of the sets has, and of these the rarest.

    The rarest n - ceil(similarity * n) + 1 shingles of two similar sets have one in common, since both follow one order;
    rare leaves out those that no other set has, which come first in it."""
    each = sets.select("id", F.explode("set").alias("x"))
    common = each.groupBy("x").agg(F.count("*").alias("c")).where("c > 1")
    own = each.join(common, "x").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "x")))["x"].alias("own"))
    held = sets.select("id", F.size("set").alias("n")).join(own, "id", "left").select("id", "n", F.coalesce("own", F.array().cast("array<long>")).alias("own"))
    needed = F.ceil(F.lit(similarity) * F.col("n") - 1e-9)
    return held.select("id", "n", F.size("own").alias("a"), F.slice("own", 1, F.greatest(F.lit(0), F.size("own") - needed + 1).cast("int")).alias("rare"))


def _links(shared: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, label): the components of the links within buckets. shared: (bucket, id)."""
    sizes = shared.groupBy("bucket").agg(F.count("*").alias("size"))
    central = shared.join(sizes, "bucket").groupBy("id").agg(F.sum("size").alias("c"))
    pivots = shared.join(central, "id").groupBy("bucket").agg(F.max(F.struct("c", (-F.col("id")).alias("m")))["m"].alias("m"))
    stars = _ordered(shared.join(pivots.select("bucket", (-F.col("m")).alias("pivot")), "bucket"))
    links = kept(_verified(stars, sets, similarity))
    for step in range(PIVOT_ROUNDS + 1):
        label = components(links)
        named = shared.join(label.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label"))
        parts = named.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id", F.lit(step)).alias("h"), "id"))["id"].alias("pivot"))
        largest = parts.groupBy("bucket").agg(F.count("*").alias("k"), F.max(F.struct("n", "label", "pivot")).alias("top")).where("k > 1")
        outside = kept(named.join(largest.select("bucket", "top.label", "top.pivot").withColumnRenamed("label", "main"), "bucket").where("label <> main").select("bucket", "id", "label", "main", "pivot"))
        if outside.isEmpty():
            return label
        if step < PIVOT_ROUNDS:
            pairs = _ordered(outside)
        else:
            open_ = kept(named.join(outside.select("bucket").distinct(), "bucket"))
            shares = open_.groupBy("id").agg(F.collect_list("bucket").alias("in"))  # a bucket for each band at most
            facts = kept(_facts(sets.join(open_.select("id").distinct(), "id"), similarity).join(shares, "id"))
            mine = outside.select("bucket", "id", "label", "main").join(facts, "id").where(F.col("a") >= similarity * F.col("n"))
            other = open_.join(facts, "id").select("bucket", *[F.col(c).alias(f"o_{c}") for c in ("id", "label", "n", "a", "rare", "in")])
            common = F.least("a", "o_a")
            once = F.array_min(F.array_intersect("in", "o_in")) == F.col("bucket")  # a pair counts in the first of its buckets
            fits = (F.col("label") != F.col("o_label")) & ((F.col("id") > F.col("o_id")) | (F.col("o_label") == F.col("main"))) & (common >= similarity * (F.col("n") + F.col("o_n") - common))
            pairs = _ordered(mine.join(other, "bucket").where(F.when(fits, F.when(F.arrays_overlap("rare", "o_rare"), once)).otherwise(False)).select("id", F.col("o_id").alias("pivot")))
        links = kept(links.unionByName(_verified(pairs, sets, similarity)))
    return components(links)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A hash of a row's id and text, never null."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("long"), F.col(text_col))


def _told(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(id, name, label) for every row of docs with a text: its key, its id and a key that stands for its class of near duplicates."""
    texts = docs.where(F.col(text_col).isNotNull()).select(row_key(id_col, text_col).alias("id"), F.col(id_col).cast("long").alias("name"), F.col(text_col).alias("text"))
    told = kept(sketches(texts))
    exact = kept(told.groupBy("c1", "c2").agg(F.min("id").alias("rep")))  # written, so that the join below can split a text with very many copies
    copies = kept(told.select("id", "name", "c1", "c2").join(exact, ["c1", "c2"]).select("id", "name", "rep"))
    member = told.where(F.size("band") > 0).join(exact.select(F.col("rep").alias("id")), "id", "left_semi").select("id", F.explode("band").alias("bucket")).distinct()
    several = member.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("bucket")
    shared = kept(member.join(several, "bucket").select("bucket", "id"))
    used = kept(shared.select("id").distinct())
    side = F.broadcast(used) if used.count() <= BROADCAST_IDS else used
    sets = kept(shingle_sets(texts.join(side, "id", "left_semi")).dropDuplicates(["id"]))
    label = _links(shared, sets, similarity)
    return copies.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left").select("id", "name", F.coalesce("label", "rep").alias("label"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id) for every row of docs with an id: the least id of its class of near duplicates.

    An id with several texts has a row for each class that they are in. Rows with a null id are compared, but left out."""
    told = kept(_told(docs, id_col, text_col, similarity))
    least = kept(told.groupBy("label").agg(F.min("name").alias("class_id")))  # written, so that the join below can split a very large class
    found = told.where("name is not null").join(least, "label").select(F.col("name").alias("id"), "class_id")
    alone = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNull()).select(F.col(id_col).cast("long").alias("id"), F.col(id_col).cast("long").alias("class_id"))
    return found.unionByName(alone).distinct()


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class, one with the least id (a null id is the last); rows with a null text stay."""
    (row,) = unused(docs, "row")
    told = kept(_told(docs, id_col, text_col, similarity))
    least = kept(told.groupBy("label").agg(F.min(F.struct(F.col("name").isNull().alias("n"), "name", "id"))["id"].alias("keep")))
    drop = told.join(least, "label").where("id <> keep").select(F.col("id").alias(row))
    once = docs.where(F.col(text_col).isNotNull()).withColumn(row, row_key(id_col, text_col)).join(drop, row, "left_anti").dropDuplicates([row]).drop(row)
    return once.unionByName(docs.where(F.col(text_col).isNull())).select(docs.columns)
