"""Exact tests of runs against enumeration, closed forms and shuffles."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqfold.functions import dims
from seqfold.operators import resample, run_null


def plain_count(mark):
    return sum(1 for on, run in itertools.groupby(mark) if on and len(list(run)) >= 2)


def enumerated(mark, group):
    """P(runs >= those of mark) over all choices of places within each group."""
    seen, total, above = plain_count(mark), 0, 0
    where = [[i for i, g in enumerate(group) if g == k] for k in sorted(set(group))]
    choices = [list(itertools.combinations(w, sum(mark[i] for i in w))) for w in where]
    for one in itertools.product(*choices):
        on = set(itertools.chain(*one))
        total += 1
        above += plain_count([i in on for i in range(len(mark))]) >= seen
    return above / total


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.booleans()), min_size=1, max_size=12))
def test_recurrence_equals_enumeration(rows):
    names: dict[int, int] = {}
    group = np.array([names.setdefault(g, len(names)) for g, _ in rows])
    mark = np.array([m for _, m in rows], bool)
    n, p, exact = run_null.test(mark, group, 10, [1])
    assert exact and n == plain_count(mark) and p == pytest.approx(enumerated(mark.tolist(), group.tolist()) if n else 1.0, rel=1e-12)


@pytest.mark.parametrize("n", [2, 3, 10, 400])
def test_two_targets_in_a_row_of_one_family(n):
    mark = np.zeros(n, bool)
    mark[:2] = True
    assert run_null.test(mark, np.zeros(n, int), 10, [1])[1] == pytest.approx((n - 1) / math.comb(n, 2), rel=1e-12)


def test_recurrence_meets_100000_shuffles(monkeypatch):
    rng = np.random.default_rng(3)
    for families in (1, 2, 4):
        group, mark = rng.integers(0, families + 2, 300), rng.random(300) < 0.25
        mark[group >= families] = False
        names = {g: i for i, g in enumerate(dict.fromkeys(group.tolist()))}
        group = np.array([names[g] for g in group.tolist()])
        with monkeypatch.context() as m:
            m.setattr(run_null, "CELLS", 10**9)
            m.setattr(run_null, "STATE", 10**8)
            n, p, exact = run_null.test(mark, group, 10, [1])
        with monkeypatch.context() as m:
            m.setattr(run_null, "CELLS", 0)
            same, q, sampled = run_null.test(mark, group, 100_000, [7])
        assert exact and not sampled and n == same and 0 < p < 1
        assert abs(p - q) < 5 * math.sqrt(p * (1 - p) / 100_000) + 1e-4


def test_shuffled_runs_on_odd_sequences(spark):
    rows = [("one", "GAAGAA" + "GAGCCC" * 8), ("none", "CCC" * 5), ("empty", ""), ("null", None), ("rest", "GAAGAAGAGG"), ("rest", "GAAGAAGAGG"), ("all", "GAA" * 50)]
    df = spark.createDataFrame(rows, "gene string, seq string")
    got = sorted((r.gene, r.n_runs, round(r.p, 12), r.exact) for r in resample.shuffled_runs(df, dims.FAMILY, ["GAA"]).collect())
    # ten places of one family, of which only the first three lie side by side: 2 of 45 pairs
    want = [("all", 1, 1.0, True), ("empty", 0, 1.0, True), ("none", 0, 1.0, True), ("null", 0, 1.0, True), ("one", 1, round(2 / 45, 12), True), ("rest", 1, round(2 / 3, 12), True), ("rest", 1, round(2 / 3, 12), True)]
    assert got == want
    assert resample.shuffled_runs(df.limit(0), dims.FAMILY, ["GAA"]).count() == 0


def test_long_genes_are_sampled_in_blocks(spark):
    rng = np.random.default_rng(5)
    seq = "".join(rng.choice(["GAA", "GAG", "AGA", "CGT", "TTT"], size=60_000))
    df = spark.createDataFrame([("long", seq)], "gene string, seq string")
    row = resample.shuffled_runs(df, dims.FAMILY, ["GAA", "AGA"], permutations=99).collect()[0]
    assert not row.exact and row.n_runs > 1000 and 0 < row.p <= 1
