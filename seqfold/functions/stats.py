"""Statistics as column expressions and frame functions."""

from __future__ import annotations

import functools
import math
import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


TERMS = 60  # of the series and of the continued fraction below; they meet at 2, where both have all digits of a double


def _folded(steps: Column, y: Column, start: float, step: Callable[[Column, Column, Column], Column]) -> Column:
    """t, from start on replaced by step(y, t, i) for each i of steps. y goes along in a struct: a column that a lambda names itself may be taken
    for an alias of the same select that has its name."""
    first = F.struct(y.alias("y"), F.lit(start).alias("t"))
    return F.aggregate(steps, first, lambda a, i: F.struct(a["y"].alias("y"), step(a["y"], a["t"], i).alias("t")), lambda a: a["t"])


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0, to about 1e-12 of its value down to the least double; null for null.

    Below 2 by the series whose terms are all positive, above by the continued fraction, each from its end, so nothing cancels."""
    low, high = F.least(x, F.lit(2.0)), F.greatest(x, F.lit(2.0))
    down = F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1))
    series = _folded(down, low * low, 1.0, lambda y, t, i: 1.0 + 2.0 * y / (2 * i + 1) * t)
    fraction = _folded(down, high, 0.0, lambda y, t, i: i / 2.0 / (y + t))
    near = 1.0 - 2.0 / math.sqrt(math.pi) * low * F.exp(-low * low) * series
    return F.when(x < 2.0, near).when(x >= 2.0, F.exp(-high * high) / math.sqrt(math.pi) / (high + fraction))


def normal_p(z: Column | str) -> Column:
    """Two-sided tail of the standard normal."""
    return erfc(F.abs(F.col(z) if isinstance(z, str) else z) / math.sqrt(2.0))


def bh(df: DataFrame, p: str, key: str, by: list[str] | None = None) -> DataFrame:
    """df with adjusted_p, Benjamini-Hochberg. One family of tests (by) is one window partition: as many rows as tests."""
    family = Window.partitionBy(*[F.col(c) for c in by or []]) if by else Window.partitionBy(F.lit(0))
    ranked = df.withColumn("_r", F.row_number().over(family.orderBy(p, key))).withColumn("_n", F.count("*").over(family))
    least = F.min(F.col(p) * F.col("_n") / F.col("_r")).over(family.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("adjusted_p", F.least(F.lit(1.0), least)).drop("_r", "_n")


BINS = 256  # of ranked rows, a power of two
SAMPLE = 8_192  # rows, about, that the bins' bounds are read from


def _bounds(df: DataFrame, place: Column) -> DataFrame:
    """One row: bounds, BINS - 1 places at equal steps of the sorted sample. Rows enter the sample by a hash of their place, so it depends on the
    data alone, and equal places enter once."""
    total = df.agg(F.count("*").alias("_n"))
    told = df.select(place.alias("_p"), F.xxhash64(place).alias("_h")).join(F.broadcast(total))
    drawn = told.where(F.pmod("_h", F.greatest(F.lit(1), F.expr(f"_n div {SAMPLE}"))) == 0)
    one = drawn.agg(F.sort_array(F.collect_set("_p")).alias("_s"))
    steps = F.sequence(F.lit(1), F.lit(BINS - 1))
    return one.select(F.transform(steps, lambda k: F.get("_s", F.least(F.floor(k * F.size("_s") / BINS).cast("int"), F.size("_s") - 1))).alias("_bounds"))


def running(df: DataFrame, by: list[str], value: str, ties: list[str], add: str | None = None) -> DataFrame:
    """df with rank, from 1, in the order of value and then of ties within by, and with cum, the sum of add up to the row.

    No task sorts a whole group: rows are dealt by ranges of (by, value, ties), whose bounds are quantiles of a sample of these, and what
    lies in a group's lower ranges is added from a row for each range and group in it. Neither values far out nor very many equal ones
    fill a range: equal ones are divided by ties, in order. Only rows that are alike in all of them stay together. The bounds follow from the
    data alone, so ranks do not depend on partitions."""
    keys = [F.col(c) for c in by]
    total = F.sum(add) if add else F.count("*")
    place = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate([*by, value, *ties])])
    told = df.join(F.broadcast(_bounds(df, place))).withColumn("_place", place)
    step, at = BINS // 2, F.lit(0)
    while step:  # a binary search; a range begins at its bound
        told = told.withColumn("_bin", at)
        at = F.col("_bin") + F.when(F.coalesce(F.get("_bounds", F.col("_bin") + (step - 1)) <= F.col("_place"), F.lit(False)), step).otherwise(0)
        step //= 2
    binned = told.withColumn("_bin", at).drop("_bounds", "_place")
    below = (Window.partitionBy(*keys) if by else Window.partitionBy(F.lit(0))).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"), total.alias("_s"))  # BINS rows and one more for each group, at most
    before = sums.select(*keys, "_bin", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(below), F.lit(0)).alias("_s0"))
    inner = Window.partitionBy(*keys, "_bin").orderBy(value, *ties)
    told = binned.withColumn("_i", F.row_number().over(inner)).withColumn("_c", (F.sum(add) if add else F.count("*")).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    return told.join(before, [*by, "_bin"]).withColumns({"rank": F.col("_i") + F.col("_n0"), "cum": F.col("_c") + F.col("_s0")}).drop("_bin", "_n0", "_s0", "_i", "_c")


def gini(df: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """(key, gini) of non-negative values; 0 for an empty or all-zero group."""
    n, s = F.count("*"), F.sum(value)
    return running(df.select(key, value, tie), [key], value, [tie]).groupBy(key).agg(F.when(s > 0, 2 * F.sum(F.col("rank") * F.col(value)) / (n * s) - (n + 1) / n).otherwise(0.0).alias("gini"))


EXACT_SIDE = 8  # the exact distribution serves where one side has at most so many members and no values are tied
EXACT_CELLS = 2_000_000  # and the product of both sides is at most this, which bounds the table below; the normal form is close long before


@functools.lru_cache(maxsize=64)
def rank_sum_tail(m: int, n: int) -> np.ndarray:
    """How many of the C(m + n, m) arrangements have U of at most 0, 1, .. m n / 2: exact whole numbers.

    Arrangements with U = u are the partitions of u into at most m parts of at most n, the coefficients of the product over i <= m of
    (1 - q^(n + i)) / (1 - q^i). Each division is a running sum with stride i and each factor one shifted difference, so the table costs
    O(m^2 n) and no step depends on another test."""
    m, n = min(m, n), max(m, n)
    size = m * n // 2 + 1
    ways = np.zeros(size, np.int64 if math.comb(m + n, m) < 1 << 62 else object)
    ways[0] = 1
    for i in range(1, m + 1):
        rows = -(-size // i)
        padded = np.concatenate([ways, np.zeros(rows * i - size, ways.dtype)]).reshape(rows, i)
        ways = np.add.accumulate(padded, axis=0).ravel()[:size]
    for i in range(1, m + 1):
        if n + i < size:
            ways = ways - np.concatenate([np.zeros(n + i, ways.dtype), ways[: size - n - i]])
    return np.add.accumulate(ways)


def rank_sum_p(n_a: int, n_b: int, u: float) -> float:
    """Two-sided p of U without ties: twice the smaller tail, 1 at most."""
    low = int(min(u, n_a * n_b - u))
    return min(1.0, 2 * (int(rank_sum_tail(n_a, n_b)[low]) / math.comb(n_a + n_b, n_a)))


@F.pandas_udf(T.DoubleType())
def mann_whitney_p(n_a: pd.Series, n_b: pd.Series, u: pd.Series, ties: pd.Series, z: pd.Series) -> pd.Series:
    """p of summary rows: exact for small untied samples, else from the normal score. Tests of equal sizes share a table."""
    def one(a: int, b: int, u: float, tied: float, z: float) -> float:
        exact = min(a, b) <= EXACT_SIDE and tied == 0 and a * b <= EXACT_CELLS
        return rank_sum_p(int(a), int(b), u) if exact else math.erfc(abs(z) / math.sqrt(2.0))

    return pd.Series([one(*x) for x in zip(n_a, n_b, u, ties, z, strict=True)], dtype=float)


def mann_whitney(df: DataFrame, value: str, in_a: str, by: str) -> DataFrame:
    """(by, n_a, n_b, u, rank_biserial, z, p_value): U of group a from mean ranks, the tie-corrected normal score with continuity, and the two-sided p:
    from the exact distribution where one side has EXACT_SIDE members at most and no values are tied, else from the score.

    Values are counted first, so that ranks come from the distinct values of a group and ties need no sort."""
    return mann_whitney_counts(df.groupBy(by, value).agg(F.sum(F.col(in_a).cast("long")).alias("a"), F.count("*").alias("t")), value, by)


def mann_whitney_counts(counts: DataFrame, value: str, by: str) -> DataFrame:
    """mann_whitney of (by, value, a, t): how many rows of group a, and in all, have each distinct value. They are read several times, and kept meanwhile."""
    ranked = running(counts.select(by, value, "a", "t").persist(), [by], value, [], "t").withColumn("rank", F.col("cum") - F.col("t") + (F.col("t") + 1) / 2)
    sums = ranked.groupBy(by).agg(F.sum("a").alias("n_a"), F.sum("t").alias("n"), F.sum(F.col("a") * F.col("rank")).alias("ra"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    u = sums.withColumn("n_b", F.col("n") - F.col("n_a")).withColumn("u", F.col("ra") - F.col("n_a") * (F.col("n_a") + 1) / 2)
    pairs = F.col("n_a") * F.col("n_b")
    sd = F.sqrt(pairs / 12 * (F.col("n") + 1 - F.col("ties") / (F.col("n") * (F.col("n") - 1))))
    gap = F.abs(F.col("u") - pairs / 2) - 0.5
    score = F.when(sd > 0, F.greatest(gap, F.lit(0.0)) / sd * F.signum(F.col("u") - pairs / 2)).otherwise(0.0)
    told = u.where("n_a > 0 and n_b > 0").select(by, "n_a", "n_b", "u", (1 - 2 * F.col("u") / pairs).alias("rank_biserial"), score.alias("z"), F.col("ties").cast("double").alias("ties"))
    return told.withColumn("p_value", mann_whitney_p("n_a", "n_b", "u", "ties", "z")).drop("ties")


def ks(df: DataFrame, value: str, in_a: str) -> DataFrame:
    """One row: n_a, n_all, the two-sample Kolmogorov-Smirnov statistic d of the rows of a against all rows, and its asymptotic p.
    Values are counted first."""
    counts = df.groupBy(value).agg(F.sum(F.col(in_a).cast("long")).alias("a"), F.count("*").alias("t"))
    steps = running(running(counts, [], value, [], "a").withColumnRenamed("cum", "ca").drop("rank"), [], value, [], "t").select("ca", F.col("cum").alias("ct"))
    total = counts.agg(F.sum("a").alias("na"), F.sum("t").alias("nt"))
    d = steps.join(F.broadcast(total)).agg(F.max("na").alias("n_a"), F.max("nt").alias("n_all"), F.max(F.abs(F.col("ca") / F.col("na") - F.col("ct") / F.col("nt"))).alias("d"))
    return d.withColumn("p_value", ks_p(F.col("d"), F.coalesce("n_a", F.lit(0)), F.coalesce("n_all", F.lit(0))))


def ks_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic p of the statistic; null where a side is empty. Below 0.2 the scaled statistic has p = 1 to all digits that its series keeps."""
    size = F.when((n > 0) & (m > 0), n.cast("double") * m / (n.cast("double") + m))
    lam = d * F.sqrt(size)
    series = _folded(F.sequence(F.lit(1), F.lit(100)), lam, 0.0, lambda y, t, k: t + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * y * y))
    return F.when(lam < 0.2, 1.0).when(lam.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def chi2_p(x: Column, df: Column) -> Column:
    """Upper tail of chi-squared, for any whole number of degrees of freedom; 1 without one.

    With y = x / 2 it is the sum of y^e exp(-y) / gamma(e + 1) over e below df / 2 in steps of 1 from 0, or from 1/2 behind erfc(sqrt(y)) where df is odd.
    Terms are positive and go by their logarithms, so small tails keep their digits and large df do not underflow."""
    y = F.greatest(x.cast("double"), F.lit(0.0)) / 2.0
    log, odd, n = F.ln(F.greatest(y, F.lit(sys.float_info.min))), df % 2 == 1, F.floor(df / 2).cast("int")
    first = F.when(odd, 0.5 * log - math.lgamma(1.5)).otherwise(0.0) - y
    start = F.struct(log.alias("y"), F.when(odd, 0.5).otherwise(0.0).alias("e"), first.alias("l"), F.lit(0.0).alias("s"))  # as in _folded
    terms = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, lambda a, i: F.struct(a["y"].alias("y"), a["e"].alias("e"), (a["l"] + a["y"] - F.ln(a["e"] + i)).alias("l"), (a["s"] + F.exp(a["l"])).alias("s")), lambda a: a["s"])
    total = F.when(n > 0, terms).otherwise(0.0) + F.when(odd, erfc(F.sqrt(y))).otherwise(0.0)
    return F.when(df.isNull() | x.isNull(), F.lit(None).cast("double")).when((df <= 0) | (x <= 0), 1.0).otherwise(F.least(F.lit(1.0), total))


def draws(reps: Column, slot: Column, seed: int, n: Column) -> Column:
    """A repeatable draw in [0, n) for a replicate and slot, by integer arithmetic that other SQL engines share."""
    p = F.lit(2147483647)
    h = (reps.cast("long") * 1103515245 + slot.cast("long") * 12345 + F.lit(seed)) % p
    for _ in range(3):
        h = ((h * h) % p * 48271 + 11) % p
    return h % n
