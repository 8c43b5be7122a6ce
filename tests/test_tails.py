"""Tails as column expressions, against the platform's error function, exact fractions, integration and printed tables."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqfold.functions import stats
from seqfold.operators import frequency
from seqfold.plans import modes
from seqfold.plans.registry import Tables


def test_normal_tail_to_the_least_doubles(spark):
    zs = [float(z) for z in np.concatenate([np.linspace(0, 6, 601), np.linspace(6, 37, 200), 2**0.5 * 2 + np.linspace(-1e-6, 1e-6, 9)])]
    got = spark.createDataFrame([(z, s * z) for z in zs for s in (1.0, -1.0)], "size double, z double").select("size", stats.normal_p("z").alias("p")).collect()
    exact = {z: math.erfc(z / math.sqrt(2)) for z in zs}
    assert min(exact.values()) < 1e-295 and len(got) == 2 * len(zs)
    assert max(abs(r.p / exact[r.size] - 1) for r in got) < 1e-10
    odd = spark.createDataFrame([(None,), (0.0,), (1e3,), (float("inf"),), (float("nan"),)], "z double").select(stats.normal_p("z").alias("p")).collect()
    assert odd[0].p is None and odd[1].p == 1.0 and odd[2].p == odd[3].p == 0.0 and math.isnan(odd[4].p)


def test_tails_beside_an_alias_of_their_column(spark):
    row = spark.createDataFrame([(1.23456, 7, 9)], "z double, n long, m long")
    got = row.select(F.lit(50.0).alias("z"), F.lit(1).alias("n"), stats.normal_p("z").alias("p"), stats.chi2_p(F.col("z"), F.col("n").cast("int")).alias("c"), stats.ks_p(F.col("z"), F.col("n"), F.col("m")).alias("k")).first()
    alone = row.select(stats.normal_p("z").alias("p"), stats.chi2_p(F.col("z"), F.col("n").cast("int")).alias("c"), stats.ks_p(F.col("z"), F.col("n"), F.col("m")).alias("k")).first()
    assert got.p == alone.p == pytest.approx(math.erfc(1.23456 / math.sqrt(2)), rel=1e-12) and got.c == alone.c == pytest.approx(integrated(1.23456, 7), rel=1e-8) and got.k == alone.k


def even(x: int, df: int) -> float:
    """exp(-y) times an exact sum."""
    y = Fraction(x, 2)
    term = total = Fraction(1)
    for i in range(1, df // 2):
        term = term * y / i
        total += term
    return math.exp(math.log(total.numerator) - math.log(total.denominator) - x / 2)


def integrated(x: float, df: int) -> float:
    """The density's integral from x on, by Gauss-Legendre over many short pieces."""
    at, weight = np.polynomial.legendre.leggauss(40)
    edges = np.linspace(x, x + 40 * math.sqrt(2 * df) + 400, 2001)
    t = edges[:-1, None] + (at + 1) / 2 * np.diff(edges)[:, None]
    return float((np.exp((df / 2 - 1) * np.log(t) - t / 2 - df / 2 * math.log(2) - math.lgamma(df / 2)) * weight * np.diff(edges)[:, None] / 2).sum())


def chi2(spark, rows):
    return [r.p for r in spark.createDataFrame(rows, "x double, df int").select(stats.chi2_p(F.col("x"), F.col("df")).alias("p")).collect()]


def test_chi_squared_tail_for_any_degrees_of_freedom(spark):
    cases = [(x, df) for df in (2, 4, 10, 60, 400) for x in (1, 7, 60, 350, 1200)]
    assert chi2(spark, [(float(x), df) for x, df in cases]) == pytest.approx([even(x, df) for x, df in cases], rel=1e-10, abs=1e-300)
    cases = [(x, df) for df in (3, 5, 15, 101, 999) for x in (0.5, 4.0, 30.0, 120.0, 1100.0)]
    assert chi2(spark, cases) == pytest.approx([integrated(*c) for c in cases], rel=1e-8, abs=1e-300)
    assert chi2(spark, [(3.841, 1), (5.991, 2), (7.815, 3), (18.307, 10), (124.342, 100), (43.773, 30)]) == pytest.approx([0.05] * 6, abs=1e-4)
    assert chi2(spark, [(1.0, 1)]) == pytest.approx([math.erfc(math.sqrt(0.5))], rel=1e-12)
    assert chi2(spark, [(0.0, 3), (5.0, 0), (None, 3), (5.0, None), (0.0, 0)]) == [1.0, 1.0, None, None, 1.0]


def test_chi_squared_tail_of_many_degrees(spark):
    got = chi2(spark, [(3000.0, 2000), (2000.0, 2001), (100_000.0, 100_000)])
    assert got == pytest.approx([even(3000, 2000), integrated(2000.0, 2001), 0.5], rel=2e-3) and got[0] == pytest.approx(even(3000, 2000), rel=1e-10)


def test_kolmogorov_smirnov_tail(spark):
    def plain(d, n, m):
        lam = d * math.sqrt(n * m / (n + m))
        return 1.0 if lam < 0.2 else max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))))

    rows = [(d, n, m) for d in (0.0, 0.01, 0.1, 0.3, 0.9, 1.0) for n, m in ((1, 1), (10, 10), (100, 100), (100, 5000), (3, 10**12))]
    got = [r.p for r in spark.createDataFrame([*rows, (0.5, 0, 9), (None, 3, 9)], "d double, n long, m long").select(stats.ks_p(F.col("d"), F.col("n"), F.col("m")).alias("p")).collect()]
    assert got[:-2] == pytest.approx([plain(*r) for r in rows], rel=1e-10, abs=1e-15) and got[-2:] == [None, None]


def test_no_python_worker_in_a_tested_composition(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    tested = modes._tested(frequency.composition(t.cds, t.set_a, 2))
    assert "Python" not in tested._jdf.queryExecution().executedPlan().toString()
