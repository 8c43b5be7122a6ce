"""Names matched by trigrams against all pairs, and the samples that analyses choose by them."""

import random

import pytest

from seqfold.functions import dims
from seqfold.operators import names
from seqfold.plans import modes


def line(x):
    return "".join(c for c in x.upper() if c not in " -():")


def plain(ask, known, proxies):
    def best(pairs):
        forms = {}
        for n, _ in sorted(pairs, key=lambda p: p[1]):
            forms.setdefault(line(n), []).append(n)
        if line(ask) in forms and line(ask):
            return forms[line(ask)][-1], "exact"
        for f, ns in forms.items():
            if line(ask) and f and (line(ask) in f or f in line(ask)):
                return ns[-1], "substring"
        return None, None

    name, how = best(known)
    if name is None:
        stand = best([(p, i) for i, (p, _) in enumerate(proxies)])[0]
        return (dict(proxies)[stand], "proxy") if stand else (None, None)
    return name, how


def test_lines_against_all_pairs(spark):
    rng = random.Random(2)
    word = lambda k: "".join(rng.choice("abC-1 é") for _ in range(k))
    known = [(word(rng.randrange(1, 9)), i) for i in range(60)] + [("", 60), ("MCF-7", 61), ("mcf 7", 62)]
    asked = [word(rng.randrange(0, 12)) for _ in range(120)] + ["mcf7", "HeLa", "hela s3", "xK562x", "zzz", "", None, "MCF7 (line)"]
    got = names.cell_lines(spark.createDataFrame([(a, 1) for a in asked], "ask string, name int"), spark.createDataFrame(known, "name string, place int")).collect()
    assert {r.ask: (r.name, r.how) for r in got} == {a: plain(a, known, dims.LINE_TISSUES) for a in asked if a is not None}
    assert len(got) == len({a for a in asked if a is not None})
    none = spark.createDataFrame([], "name string, place int")
    assert names.tissues(spark.createDataFrame([("x",)], "ask string"), none).first().name is None
    assert names.cell_lines(spark.createDataFrame([], "ask string"), none).count() == 0


def test_tissues_hold_the_asked_name(spark):
    known = spark.createDataFrame([("Brain - Cortex", 1), ("Kidney_Cortex", 2), ("Cortex", 3)], "name string, place int")
    got = {r.ask: (r.name, r.how) for r in names.tissues(spark.createDataFrame([("cortex",), ("kidney-cortex",), ("ney",), ("Brain - Cortex x",), ("c",)], "ask string"), known).collect()}
    assert got == {"cortex": ("Cortex", "exact"), "kidney-cortex": ("Kidney_Cortex", "exact"), "ney": ("Kidney_Cortex", "substring"), "Brain - Cortex x": (None, None), "c": ("Brain - Cortex", "substring")}


def test_expression_of_a_chosen_sample(spark):
    tissues = spark.createDataFrame([(s, g, float(len(s) + i)) for s in ("Lung", "Uterus", "Liver") for i, g in enumerate("ab")], "sample string, gene string, tpm double")
    lines = spark.createDataFrame([("MCF-7", "a", 70.0)], "sample string, gene string, tpm double")
    take = lambda **k: sorted((r.gene, r.tpm) for r in modes.expression_for(tissues, **k).collect())
    assert take(tissue="lung") == [("a", 4.0), ("b", 5.0)] and take(tissue="uter") == [("a", 6.0), ("b", 7.0)]
    assert take(cell_line="mcf7", lines=lines) == [("a", 70.0)] and take(cell_line="HeLa", lines=lines) == [("a", 6.0), ("b", 7.0)]
    assert take() == [("a", 5.0), ("b", 6.0)]
    for bad in ({"tissue": "spleen"}, {"cell_line": "zzz", "lines": lines}, {"tissue": "a", "cell_line": "b"}):
        with pytest.raises(ValueError):
            take(**bad)
