"""Exact distributions and resampling against enumeration and closed forms."""

import bisect
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqfold.functions import stats
from seqfold.operators import resample


def test_rank_sum_distribution_by_enumeration():
    for m, n in [(1, 1), (1, 7), (2, 5), (3, 3), (4, 6), (5, 8), (8, 5)]:
        us = [sum(c) - m * (m + 1) // 2 for c in itertools.combinations(range(1, m + n + 1), m)]
        for u in range(m * n + 1):
            low = min(u, m * n - u)
            assert stats.rank_sum_p(m, n, u) == pytest.approx(min(1.0, 2 * sum(x <= low for x in us) / len(us)), abs=1e-14)


def test_rank_sum_tables_are_whole_for_sizes_to_50():
    for m in range(1, 9):
        for n in (1, 2, 9, 25, 50):
            tail = stats.rank_sum_tail(m, n)
            half, total = m * n // 2, math.comb(m + n, m)
            middle = int(tail[half]) - (int(tail[half - 1]) if half else 0)
            assert 2 * int(tail[half]) - (middle if m * n % 2 == 0 else 0) == total  # the distribution is symmetric


def test_exact_and_normal_p_by_size_and_ties(spark):
    rng = random.Random(4)
    rows = [(g, float(v), i < a) for g, a, b in [("small", 3, 9), ("large", 20, 30), ("edge", 8, 60)] for i, v in enumerate(rng.sample(range(1000), a + b))]
    rows += [("tied", float(v), i < 4) for i, v in enumerate([1, 1, 2, 3, 4, 5, 6, 7])] + [("none", 1.0, True)]
    got = {r.g: r for r in stats.mann_whitney(spark.createDataFrame(rows, "g string, x double, in_a boolean"), "x", "in_a", "g").collect()}
    assert set(got) == {"small", "large", "edge", "tied"}
    for g in ("small", "edge"):
        assert got[g].p_value == pytest.approx(stats.rank_sum_p(got[g].n_a, got[g].n_b, got[g].u), abs=1e-14)
    for g in ("large", "tied"):
        assert got[g].p_value == pytest.approx(math.erfc(abs(got[g].z) / math.sqrt(2)), abs=1e-14)
    assert abs(got["edge"].p_value - math.erfc(abs(got["edge"].z) / math.sqrt(2))) < 0.02  # both forms are near there


def test_multinomial_resamples_have_exactly_so_many_draws(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=700).tolist()
    rows = spark.createDataFrame([(i, 1.0, [0, 2], [v, 1.0]) for i, v in enumerate(values)] + [(900, 1.0, [], [])], "key long, w double, at array<int>, v array<double>")
    got = resample.multinomial(rows, 37, 600, 3, 5).collect()
    assert {r.sum for r in got if r.at == -1} == {37.0} and {r.rep for r in got} == set(range(600))
    ones = {r.rep: r.sum for r in got if r.at == 2}
    assert all(0 < x <= 37 and x == int(x) for x in ones.values()) and not any(r.at == 1 for r in got)
    assert np.mean(list(ones.values())) == pytest.approx(37 * 700 / 701, abs=0.05)
    assert resample.multinomial(rows.where("false"), 37, 10, 3, 5).count() == 0


def test_multinomial_means_meet_the_closed_form(spark):
    values = np.random.default_rng(3).gamma(1.0, size=2000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "key long, value double")
    means = [r["mean"] for r in resample.multinomial_mean(df, 50, 4000, 9).collect()]
    assert len(means) == 4000
    assert np.mean(means) == pytest.approx(values.mean(), abs=4 * values.std() / math.sqrt(50 * 4000))
    assert np.std(means) == pytest.approx(values.std() / math.sqrt(50), rel=0.05)
    again = [r["mean"] for r in resample.multinomial_mean(df.repartition(7), 50, 4000, 9).collect()]
    assert sorted(again) == pytest.approx(sorted(means), abs=1e-12)  # draws follow the seed, not the partitions


def ranked(rows, by, value, ties, add):
    out, sofar = {}, {}
    for r in sorted(rows, key=lambda r: (r[by], r[value], r[ties])):
        n, s = sofar.get(r[by], (0, 0))
        sofar[r[by]] = (n + 1, s + r[add])
        out[r[by], r[ties]] = sofar[r[by]]
    return out


def test_ranks_stand_ties_and_outliers(spark):
    rng = random.Random(6)
    n = 60_000
    values = {"ties": [0.0 if rng.random() < 0.99 else rng.random() for _ in range(n)], "outlier": [1e9, *(rng.random() for _ in range(n - 1))], "few": [3.0, -1.0, 3.0]}
    rows = [(g, v, f"n{i:06d}", i % 7) for g, vs in values.items() for i, v in enumerate(vs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double, name string, w long")
    got = stats.running(df, ["g"], "v", ["name"], "w")
    assert {(r.g, r.name): (r["rank"], r.cum) for r in got.collect()} == ranked([{"g": g, "v": v, "name": t, "w": w} for g, v, t, w in rows], "g", "v", "name", "w")
    assert got.columns == ["g", "v", "name", "w", "rank", "cum"]
    place = F.struct(F.col("g").alias("k0"), F.col("v").alias("k1"), F.col("name").alias("k2"))
    bounds = stats._bounds(df, place).first()["_bounds"]
    assert len(bounds) == stats.BINS - 1 and [tuple(b) for b in bounds] == sorted(tuple(b) for b in bounds)
    cuts = [tuple(b) for b in bounds]
    sizes = np.bincount([bisect.bisect_right(cuts, (g, v, t)) for g, v, t, _ in rows], minlength=stats.BINS)
    assert sizes.max() < 3 * sizes.mean()
    assert {(r.g, r.name): r["rank"] for r in stats.running(df.repartition(9), ["g"], "v", ["name"]).collect()} == {(r.g, r.name): r["rank"] for r in got.collect()}


def test_ranks_of_nothing_and_of_equal_rows(spark):
    df = spark.createDataFrame([(1.0, 5)] * 40 + [(None, 1)], "v double, w long")
    assert sorted(r["rank"] for r in stats.running(df, [], "v", [], "w").collect()) == list(range(1, 42))
    assert stats.running(df.where("false"), [], "v", []).count() == 0
