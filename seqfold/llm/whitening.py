"""Whitening of embeddings by LOBPCG over distributed covariance-block products.

Vectors are quantised to whole numbers x = floor(256 c), so counts, sums and deviations are exact. The fit list holds each distinct x once. The
leading eigenvectors of its covariance V come from the locally optimal block preconditioned conjugate gradient method: one
iteration multiplies V by the block of what the residuals and the previous direction add to the iterate, (1/n) sum (x - mean)((x - mean)' B), where each task
takes its rows in matrix products and Spark adds up the cells, and does a Rayleigh-Ritz step on the span of all three. V itself is never formed. The
iterate's product follows from that of the span it lies in; what is accepted is certified by a product of its own: for
each component |V v - e v| is at most twice TOLERANCE of the largest eigenvalue (after half of ROUNDS, where rounding may stand in the way, 100 times as much). The block has GUARD columns more than are asked for, so that close eigenvalues behind
the last component do not slow it down.

The driver holds blocks of dimension x 3 (components + GUARD), whatever the number of rows. Rows whose vector is null, empty or holds null or
non-finite entries take no part, nor do those of a length other than the most frequent one (of equally frequent ones the longest). Repeated vectors
count once in the fit and get equal results each; ids may be null or repeated. Fewer than two distinct vectors, or a component without
variance, give no rows for it; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqfold.llm.storage import kept

SCALE = 256
COMPONENTS = 4
GUARD = 8
TOLERANCE = 1e-13
ROUNDS = 120
ROWS = 4096  # of a matrix product inside a task


def quantised(vector: Column) -> Column:
    """floor(256 c) of each entry as longs; null for a vector that is null, empty or has null or non-finite entries."""
    c = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad | (F.size(c) == 0), F.lit(True)), F.transform(c, lambda x: F.floor(x * SCALE).cast("long")))


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    known = rows.select(F.col(id_col).alias("vec_id"), quantised(F.col(vector_col)).alias("x")).where("x is not null")
    sizes = known.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return known.where(F.size("x") == (sizes.d if sizes else 0))


def _matrices(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[np.ndarray]:
    """The vectors of Arrow batches as matrices of at most ROWS rows."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.column(column).slice(at, ROWS)
            flat = part.flatten().to_numpy(zero_copy_only=False)
            yield flat.reshape(len(part), -1) if len(part) else np.zeros((0, 0), np.int64)


@dataclass
class Fit:
    """The distinct vectors (x), their number and exact sums."""

    vectors: DataFrame
    n: int
    sums: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def summed(self, part, shape: tuple[int, int]) -> np.ndarray:
        """The sum over all matrices of vectors of part(matrix), an array of shape. A task sends a row for each cell, and Spark adds them up."""

        def cells(batches):
            total = np.zeros(shape)
            for m in _matrices(batches):
                if len(m):
                    total += part(m)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int64()), pa.array(total.ravel())], ["cell", "value"])

        out = np.zeros(shape[0] * shape[1])
        for r in self.vectors.mapInArrow(cells, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
            out[r.cell] = r.value
        return out.reshape(shape)

    def product(self, block: np.ndarray) -> np.ndarray:
        """V times block."""
        mean = self.mean

        def part(m: np.ndarray) -> np.ndarray:
            c = m - mean
            return c.T @ (c @ block)

        return self.summed(part, block.shape) / self.n

    def trace(self) -> float:
        mean = self.mean
        return float(self.summed(lambda m: ((m - mean) ** 2).sum(axis=0)[None, :], (1, len(self.sums))).sum() / self.n)


def fitted(rows: DataFrame) -> Fit | None:
    """The fit list of rows (vec_id, x), kept in the shared folder; None for an empty one."""
    distinct = kept(rows.select("x").distinct())
    sums = distinct.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum("v").alias("s"), F.count("*").alias("n")).orderBy("d").collect()
    return Fit(distinct, sums[0].n, [r.s for r in sums]) if sums else None


def _ritz(b: np.ndarray, vb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values in falling order and the vectors in terms of the orthonormal columns of b."""
    w, u = np.linalg.eigh((b.T @ vb + vb.T @ b) / 2)
    return w[::-1], u[:, ::-1]


def _residual(x: np.ndarray, vx: np.ndarray, w: np.ndarray, k: int) -> tuple[float, float, np.ndarray]:
    """The largest Ritz value, the largest residual of the first k, and all residuals."""
    r = vx - x * w
    return max(float(w[0]), 0.0), float(np.linalg.norm(r[:, :k], axis=0).max()), r


def leading(fit: Fit, k: int = COMPONENTS, guard: int = GUARD, tolerance: float = TOLERANCE, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors as columns, largest certified residual as a share of the largest eigenvalue) of the k largest, by falling value."""
    d = len(fit.sums)
    m = min(d, k + guard)
    x, p = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))[0], np.zeros((d, 0))
    vx = fit.product(x)
    for step in range(rounds):
        limit = tolerance if step < rounds // 2 else 100 * tolerance  # where rounding of very long sums keeps residuals above it
        w, turn = _ritz(x, vx)
        x, vx = x @ turn, vx @ turn
        top, worst, r = _residual(x, vx, w, k)
        if worst <= limit * top:
            x = np.linalg.qr(x)[0]
            vx = fit.product(x)  # a product of its own certifies what is accepted
            w, turn = _ritz(x, vx)
            x, vx = x @ turn, vx @ turn
            top, worst, r = _residual(x, vx, w, k)
            if worst <= 2 * limit * top:
                return w[:k], x[:, :k], worst / top if top else 0.0
        q = np.linalg.qr(np.hstack([x, r, p]))[0][:, m:]  # what residuals and direction add to the iterate's span
        b, vb = np.hstack([x, q]), np.hstack([vx, fit.product(q)]) if q.shape[1] else vx
        c = _ritz(b, vb)[1][:, :m]
        new = b @ c
        p, x, vx = new - x @ (x.T @ new), new, vb @ c
    raise RuntimeError(f"the components are not certified after {rounds} rounds")


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component with variance, at most components of them.

    deviation is exact; the query fails if it could exceed a long. identity_error comes from the whitened values of the fit list themselves."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    used = usable(rows, id_col, vector_col).withColumn("vec_id", F.col("vec_id").cast("long"))
    fit = fitted(used)
    values, vectors, trace = np.zeros(0), np.zeros((0, 0)), 0.0
    if fit is not None and fit.n > 1:
        values, vectors, _ = leading(fit, components)
        trace = fit.trace()
        good = values > 1e-12 * max(trace, 1e-300)
        values, vectors = values[good], vectors[:, good]
    if not len(values):
        return rows.sparkSession.createDataFrame([], schema)
    mean, turn, n, sums, k = fit.mean, vectors / np.sqrt(values), fit.n, np.array(fit.sums, dtype=object), len(values)

    def moments(m: np.ndarray) -> np.ndarray:
        y = np.hstack([(m - mean) @ turn, np.ones((len(m), 1))])
        return y.T @ y

    sofar = fit.summed(moments, (k + 1, k + 1)) / n
    error = float(np.abs(sofar[:k, :k] - np.outer(sofar[:k, k], sofar[:k, k]) - np.eye(k)).max())
    explained = values / trace

    def project(batches):
        s = sums.astype(np.int64)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                m = next(_matrices([part]))
                largest = int(np.abs(m).max(initial=0))
                if len(s) * (n * largest + max(map(abs, sums.tolist()))) ** 2 >= 1 << 63:
                    raise OverflowError("a deviation may exceed a long")
                y, off = (m - mean) @ turn, ((n * m - s) ** 2).sum(axis=1)
                ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(len(m)), k)))
                told = [np.tile(np.arange(1, k + 1, dtype=np.int32), len(m)), np.full(len(m) * k, n), np.repeat(off, k), y.ravel(), np.tile(explained, len(m)), np.full(len(m) * k, error)]
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, told)], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return used.select("vec_id", "x").mapInArrow(project, schema)
