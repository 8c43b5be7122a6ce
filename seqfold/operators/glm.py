"""Per-symbol binomial regressions, all at once: sums over rows in Spark, a 3 by 3 solve for each symbol on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqfold.operators import frequency, sequences


def wald(k: np.ndarray, n: np.ndarray, x: np.ndarray, steps: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and Wald scores of logit(k / n) = x beta, by iteratively reweighted least squares."""
    beta = np.zeros(x.shape[1])
    beta[0] = np.log((k.sum() + 0.5) / (n.sum() - k.sum() + 0.5))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = np.maximum(n * p * (1 - p), 1e-12)
        info = x.T @ (x * w[:, None])
        step = np.linalg.solve(info, x.T @ (k - n * p))
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    return beta, beta / np.sqrt(np.diag(np.linalg.inv(info)))


def shares(cds: DataFrame, chosen: DataFrame, symbols: DataFrame) -> DataFrame:
    """(codon, k, n, inside, gc3): how often each gene uses each codon of the families with synonyms that it has, of how many; whether it is in the set; its GC3."""
    many = symbols.where("n_syn > 1")
    counts = frequency.codon_counts(cds, many)
    family = counts.groupBy("gene", "aa").agg(F.sum("cnt").alias("n"))
    grid = family.join(F.broadcast(many), "aa").join(counts.select("gene", "codon", "cnt"), ["gene", "codon"], "left")
    gene = cds.select("gene", sequences.gc3(F.col("seq")).alias("gc3")).join(chosen.distinct().withColumn("i", F.lit(1)), "gene", "left").select("gene", "gc3", F.coalesce("i", F.lit(0)).alias("inside"))
    return grid.join(gene, "gene").select("codon", F.coalesce("cnt", F.lit(0)).alias("k"), "n", "inside", "gc3")


def by_codon(rows: DataFrame, least: int = 10, steps: int = 25) -> DataFrame:
    """(codon, beta, z_score): the effect of the set on a codon's share of its family, with the gene's GC3 held, by reweighted least squares.

    rows: (codon, k, n, inside, gc3). A step sums each codon's information and gradient over all rows where they are and solves on the driver, which
    holds ten numbers a codon. A fit that fails, has fewer than least rows or rows of one side only gives z 0."""
    spark, rows = rows.sparkSession, rows.persist()
    size = rows.groupBy("codon").agg(F.count("*").alias("rows"), F.sum("inside").alias("inside"), F.sum("k").alias("k"), F.sum("n").alias("n")).collect()
    beta = {r.codon: np.array([np.log((r.k + 0.5) / (r.n - r.k + 0.5)), 0.0, 0.0]) for r in size if r.rows >= least and 0 < r.inside < r.rows}
    x, open_, z = (F.lit(1.0), F.col("inside"), F.col("gc3")), set(beta), dict.fromkeys((r.codon for r in size), 0.0)
    for _ in range(steps):
        if not open_:
            break
        now = spark.createDataFrame([(c, *map(float, beta[c])) for c in sorted(open_)], "codon string, b0 double, b1 double, b2 double")
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("b0") + F.col("b1") * x[1] + F.col("b2") * x[2]))))
        at = rows.join(F.broadcast(now), "codon").withColumn("p", p).withColumn("w", F.greatest(F.col("n") * F.col("p") * (1 - F.col("p")), F.lit(1e-12)))
        info = [F.sum(F.col("w") * x[i] * x[j]).alias(f"i{i}{j}") for i in range(3) for j in range(i, 3)]
        for r in at.groupBy("codon").agg(*info, *[F.sum(x[i] * (F.col("k") - F.col("n") * F.col("p"))).alias(f"g{i}") for i in range(3)]).collect():
            m = np.array([[r[f"i{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)])
            try:
                step, spread = np.linalg.solve(m, [r.g0, r.g1, r.g2]), np.linalg.inv(m)[1, 1]
            except np.linalg.LinAlgError:
                step, spread = np.full(3, np.nan), np.nan
            beta[r.codon] = beta[r.codon] + step
            z[r.codon] = beta[r.codon][1] / np.sqrt(spread) if spread > 0 else np.nan
            if not np.isfinite(step).all() or np.abs(step).max() < 1e-10:
                open_.discard(r.codon)
    rows.unpersist()
    good = {c: np.isfinite(v) and (c not in beta or np.isfinite(beta[c][1])) for c, v in z.items()}
    return spark.createDataFrame([(c, float(beta[c][1]) if c in beta and good[c] else 0.0, float(v) if good[c] else 0.0) for c, v in sorted(z.items())], "codon string, beta double, z_score double")
