import pytest

import __spark_entry__ as entry
from seqfold import plans
from seqfold.operators import resample
from tests.compare import connection, same

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, con, name):
    same(spark, con, FOLDER, plans.QUERIES[name], plans.ORACLES[name])


def test_entry(spark):
    found = entry.entry(spark).collect()
    assert len(found) == 61 and sum(r.observed for r in found) <= 1 + 1e-9
    assert [abs(r.z_score) for r in found] == sorted((abs(r.z_score) for r in found), reverse=True)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bootstrap_converges_to_closed_form(spark):
    exact = {r.kmer: r.z_score for r in plans.QUERIES["analytic_z"](spark, FOLDER).collect()}
    drawn = {r.kmer: r.z_score for r in plans.QUERIES["composition_bootstrap"](spark, FOLDER).collect()}
    strong = [k for k in drawn if abs(exact[k]) > 0.5]
    assert strong and all(abs(drawn[k] / exact[k] - 1) < 0.35 for k in strong)
    assert all(abs(drawn[k] - exact[k]) < 0.35 for k in drawn if abs(exact[k]) <= 0.5)


def test_resampling_has_the_counts_of_the_reference(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(resample, "bootstrap_kmers", lambda *a, reps, weight=None: asked.update({weight: reps}))
    monkeypatch.setattr(resample, "shuffled_runs", lambda *a, permutations: asked.update(runs=permutations))
    for name in ("composition_bootstrap", "demand_bootstrap", "run_permutations"):
        plans.QUERIES[name](spark, FOLDER)
    assert asked == {None: 10_000, "weight": 10_000, "runs": 1000}
