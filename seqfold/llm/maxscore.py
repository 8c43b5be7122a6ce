"""Exact top-k inner products by MaxScore over sharded vectors.

A dimension is a term. Its postings in a shard are the vectors with a positive and those with a negative component, by sign; for a
query the list whose sign is that of the query's component can raise a score, and the term's bound is the most that it adds in
this shard. The terms with the least bounds, whose sum stays below the threshold, are non-essential: a vector that is in
no essential list cannot reach the threshold. Essential lists are traversed first and give each vector they hold an upper score;
the vectors that can still compete are then probed for what was left out, in falling order of the bounds, and dropped as
soon as they cannot.

The threshold of a query is the k-th best score among a bounded sample of the vectors, the same for all shards; within a shard it
rises to the k-th best score found. Shards give their best k, which are merged. Vectors are dealt into shards of bounded size, each
once; only the queries are repeated, a row for each shard, and stream through the held shard in Arrow batches: the
query set, in blocks, is held against all rows.

Vectors that are null, or hold nulls, NaN or infinities, or differ in length from the query, take no part;
rows with a null id neither. A query's own id is no candidate, so of repeated ids no row finds another one.
Equal scores go to the smaller id. Other input columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD, LARGEST = 8192, 262_144  # vectors in a shard: from about SHARD on, and LARGEST where there are more than SPREAD shards
SPREAD = 64
SEEDS = 2048  # vectors of the sample that thresholds come from


class Shard:
    """Vectors by dimension: postings by sign, and the range of each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, x = ids[order], vectors[order]
        self.low, self.high = x.min(axis=0), x.max(axis=0)
        self.most = int(np.abs(x).max(initial=0))
        self.by_dim = self._typed(np.ascontiguousarray(x.T), self.most**2 * x.shape[1])
        self.lists = [{s: (at := np.flatnonzero(d * s > 0), d[at]) for s in (1, -1)} for d in self.by_dim]

    def _typed(self, x: np.ndarray, largest: int) -> np.ndarray:
        """x in the smallest type in which sums up to largest are exact."""
        return x.astype(np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64)

    def top(self, own: int, query: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best of score floor or more, in order."""
        by_dim = self.by_dim
        largest = int(np.abs(query).max(initial=0)) * self.most * len(query)
        if largest >= (2**24 if by_dim.dtype == np.float32 else 2**53 if by_dim.dtype == np.float64 else 2**63):
            by_dim = self._typed(by_dim, largest)
        q = query.astype(by_dim.dtype)
        bound = np.maximum(np.maximum(query * self.high, query * self.low), 0)
        order = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # what the terms from here on can add
        if floor is None or floor <= 0:  # a vector in no list can have this score too
            split, alive = len(order), np.arange(len(self.ids))
            upper = q @ by_dim
        else:
            split = int((rest[:-1] >= floor).sum())
            upper = np.zeros(len(self.ids), by_dim.dtype)
            for d in order[:split]:
                held, value = self.lists[d][1 if query[d] > 0 else -1]
                upper[held] += q[d] * value.astype(by_dim.dtype, copy=False)
            alive = np.flatnonzero(upper + rest[split] >= floor)
            upper = self._added(by_dim, q, order[:split], alive)  # with what lowers the score
            alive, upper = self._competing(alive, upper, rest[split], floor)
        for i in range(split, len(order), 4):
            terms = order[i : i + 4]
            upper = upper + self._added(by_dim, q, terms, alive)
            alive, upper = self._competing(alive, upper, rest[min(i + 4, len(order))], floor)
        others = self.ids[alive] != own
        alive, score = alive[others], upper[others]
        if len(alive) > k:  # of equal scores the smaller ids, and ids rise with the place
            cut = np.partition(score, -k)[-k]
            above = np.flatnonzero(score > cut)
            pick = np.concatenate([above, np.flatnonzero(score == cut)[: k - len(above)]])
            alive, score = alive[pick], score[pick]
        best = np.lexsort((self.ids[alive], -score))
        return self.ids[alive][best], score[best]

    @staticmethod
    def _added(by_dim: np.ndarray, q: np.ndarray, terms: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """What terms add to the score of the vectors alive; where these are many, whole rows cost less than their places."""
        if 4 * len(alive) > by_dim.shape[1]:
            return (q[terms] @ by_dim[terms])[alive]
        return q[terms] @ by_dim[np.ix_(terms, alive)]

    @staticmethod
    def _competing(alive: np.ndarray, score: np.ndarray, more, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        near = score + more >= (-np.inf if floor is None else floor)
        return alive[near], score[near]


def quantised(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as array<long>; null if a component is null or not finite."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _by_width(rows: list[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors: the places of the rows, and the vectors as a matrix."""
    lists = pa.chunked_array([b.column("v") for b in rows]).combine_chunks() if rows else pa.array([], pa.list_(pa.int64()))
    size, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().to_numpy()
    begin, out = np.cumsum(size) - size, {}
    for width in np.unique(size):
        at = np.flatnonzero(size == width)
        out[int(width)] = (at, flat[begin[at][:, None] + np.arange(width)])
    return out


def _shards(rows: list[pa.RecordBatch]) -> dict[int, Shard]:
    ids = np.concatenate([b.column("id").to_numpy() for b in rows])
    return {width: Shard(ids[at], x) for width, (at, x) in _by_width(rows).items() if width}


def _asked(batch: pa.RecordBatch, shards: dict[int, Shard], k: int):
    """(row, ids, scores) of the k best for each row of a batch of queries."""
    ids, floors = batch.column("id").to_numpy(), batch.column("floor").to_pylist()
    for width, (at, q) in _by_width([batch]).items():
        if width in shards:
            for row, vec in zip(at.tolist(), q, strict=True):
                yield row, *shards[width].top(ids[row], vec, k, floors[row])


def _floors(asks: DataFrame, sample: list, k: int) -> DataFrame:
    """asks with floor, the k-th best score in the sample of vectors; null if it holds fewer."""
    rows = pa.RecordBatch.from_arrays([pa.array([r.id for r in sample], pa.int64()), pa.array([r.v for r in sample], pa.list_(pa.int64()))], ["id", "v"])
    shared = asks.sparkSession.sparkContext.broadcast(rows)

    def floors(batches):
        shards = _shards([shared.value]) if shared.value.num_rows else {}
        for b in batches:
            none = pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.nulls(b.num_rows, pa.int64())], ["id", "v", "floor"])
            found = {row: int(score[-1]) for row, _, score in _asked(none, shards, k) if len(score) == k}
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array([found.get(i) for i in range(b.num_rows)], pa.int64())], ["id", "v", "floor"])

    return asks.mapInArrow(floors, "id long, v array<long>, floor long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of vectors for each row of queries (both: id, array<long>)."""
    usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.coalesce(F.exists(vector_col, lambda x: x.isNull()), F.lit(False))
    rows = vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asks = queries.where(usable).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    n = rows.count()
    shards = max(1, -(-n // LARGEST), min(SPREAD, -(-n // SHARD)))
    sample = rows.orderBy(F.xxhash64("v", "id"), "id").limit(SEEDS).collect() if shards > 1 else []
    held = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asked"), "id", F.lit(None).cast("long").alias("floor"), "v")
    asked = _floors(asks, sample, k).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asked"), "id", "floor", "v")
    dealt = held.unionByName(asked).repartition(4 * shards, "shard").sortWithinPartitions("shard", "asked")  # a shard's vectors come before its queries

    def search(batches):
        current, waiting, ready = None, [], {}
        for b in batches:
            kind = b.column("shard").to_numpy() * 2 + b.column("asked").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                part = b.slice(lo, hi - lo)
                if lo == hi:
                    continue
                if kind[lo] // 2 != current:
                    current, waiting, ready = kind[lo] // 2, [], {}
                if kind[lo] % 2 == 0:
                    waiting.append(part)
                    continue
                if waiting:
                    waiting, ready = [], _shards(waiting)
                own, found = part.column("id").to_numpy(), [(row, ids, score) for row, ids, score in _asked(part, ready, k) if len(ids)]
                cols = [np.concatenate([np.zeros(0, np.int64), *c]) for c in ([np.full(len(i), own[r]) for r, i, _ in found], [i for _, i, _ in found], [s.astype(np.int64) for *_, s in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
