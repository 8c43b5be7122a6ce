"""Decontamination by long items with dense edits: one verification for each stretch of hits, with the results of a plain search."""

import random

import numpy as np
import pytest

from seqfold.llm import cgk_decontam as C
from seqfold.llm import tokens as T


def edited(words, rng, rate):
    out = []
    for w in words:
        r = rng.random()
        if r < rate / 2:
            continue
        out.append(w)
        if r > 1 - rate / 2:
            out.append(f"added{rng.randrange(1000)}")
    return out


def hashes(text):
    return T.words([text]).hash


@pytest.mark.parametrize("n", [30, 200, 900])
def test_stretches_give_the_least_distance_in_the_document(n):
    rng = random.Random(n)
    items = [[f"w{rng.randrange(400)}" for _ in range(n)] for _ in range(6)]
    index = C.index(list(range(6)), [" ".join(x) for x in items])
    docs = []
    for k, x in enumerate(items):
        filler = [f"w{rng.randrange(400)}" for _ in range(2 * n)]
        docs.append(" ".join([*filler[:n], *edited(x, rng, 0.1), *filler[n:]]))
        docs.append(" ".join([*edited(x, rng, 0.12), *edited(x, rng, 0.05), *filler, *x] if k % 2 else [*x, *x[: n // 2]]))
        docs.append(" ".join(filler))
    found = {(d, i): (first, e) for d, i, first, e in C.search(docs, index)}
    for d, text in enumerate(docs):
        for k, x in enumerate(items):
            least, _ = C.best_span(hashes(" ".join(x)), hashes(text))
            assert ((d, k) in found) == (least <= C.RATE * n)
            if (d, k) in found:
                first, e = found[d, k]
                assert e == least and C.best_span(hashes(" ".join(x)), hashes(text)[first : first + n + e])[0] == e


def test_an_item_of_20000_words_takes_one_programme(monkeypatch):
    rng, rows = random.Random(9), []
    words = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    plain = C.best_span
    monkeypatch.setattr(C, "best_span", lambda item, text: rows.append(len(text)) or plain(item, text))
    text = " ".join([*["before"] * 50, *edited(words, rng, 0.1), *["after"] * 50])
    got = C.search([text], C.index([7], [" ".join(words)]))
    assert [g[:2] for g in got] == [(0, 7)] and 1500 < got[0][3] < 2500 and len(rows) == 1
    assert C.search([" ".join(words)], C.index([7], [" ".join(words)])) == [(0, 7, 0, 0)] and len(rows) == 1  # a copy takes none


def test_very_frequent_words_and_repeats(monkeypatch):
    rng, calls = np.random.default_rng(2), []
    plain = C.best_span
    monkeypatch.setattr(C, "best_span", lambda item, text: calls.append(len(text)) or plain(item, text))
    common = " ".join(rng.choice(["the", "of", "a"], size=30_000))
    items = C.index([1, 2, 3], ["the of a the of a the a", "a b", "the " * 40])
    found = C.search([common, "", "x a b a b"], items)
    assert (0, 1) in {f[:2] for f in found} and [f for f in found if f[0] == 2] == [(2, 2, 1, 0)]
    assert sum(calls) <= 3 * 30_000
