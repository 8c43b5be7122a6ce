"""Every operator against a plain version, and on odd input: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from seqfold.llm import byte_bpe, cgk_decontam, components, labelled, license_index, linear, maxscore, oracles, ordinal_quality, preference_format, probminhash, queries, secrets, storage, toxicity_chain, url_bloom
from seqfold.llm import tokens as T
from tests.compare import connection, same

FOLDER = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 20_000
ODD = [None, "", "   \n\t ", "!!! ***", "one", LONG, "token = abcdef123456 AKIA" + "Z" * 16, "token = abcdef123456 AKIA" + "Z" * 16, "naïve é 東京 🙂 cc by nc 4 0", "secret:token:abcdefgh"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 1, 2.0, "b") for i, t in enumerate(ODD)] + [(9, ODD[9], "x", 1, 2.0, "b"), (None, "no id", "x", 1, 2.0, "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, blob string, keep int, p_toxic double, band string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, connection(FOLDER), FOLDER, queries.queries()[name], oracles.oracle_sql()[name])


def plain_spans(text):
    found, text = [], text or ""
    assign = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    more = [(r.kind, r.pattern, r.group, r.least) for r in secrets.RULES[3:]]
    for rank, (kind, pattern, group, least) in enumerate([("assign", assign, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24), *more]):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(found)


def test_secrets_on_odd_input(spark, odd, none):
    got = {(r.doc_id, tuple(map(tuple, r.found))) for r in secrets.report(odd, secrets.scan(odd)).collect()}
    assert got == {(r.doc_id, tuple(plain_spans(r.text))) for r in odd.collect()}
    assert secrets.report(none, secrets.scan(none)).count() == 0


def test_secret_ledger_is_incremental(spark, odd):
    first = secrets.scan(odd)
    assert secrets.scan(odd, first).count() == 0
    more = odd.unionByName(odd.limit(1).withColumn("text", F.lit("passwd=zzzzzz9")))
    fresh = secrets.scan(more, first)
    assert {r.kind for r in fresh.collect()} == {r.kind for r in secrets.RULES} and fresh.select("blob").distinct().count() == 1
    newer = (secrets.Rule("hex", "2", r"[0-9a-f]{30,}", 0, 30), *secrets.RULES[:2])
    again = secrets.scan(odd, first, newer).collect()
    assert {(r.kind, r.version) for r in again} == {("hex", "2")} and len(again) == odd.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_ledger_folder_grows_by_what_is_new(spark, odd, tmp_path):
    folder = str(tmp_path / "ledger")
    blobs = odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert secrets.ledger(spark, folder) is None
    assert secrets.enter(odd, folder, secrets.BASE).count() == 3 * blobs
    assert secrets.enter(odd, folder).count() == len(secrets.RULES) * blobs  # the added rules alone
    assert secrets.enter(odd.limit(3), folder).count() == len(secrets.RULES) * blobs
    more = spark.createDataFrame([(50, "a new version: secret=abcdef9")], "doc_id long, text string")
    whole = secrets.enter(more, folder)
    assert whole.count() == len(secrets.RULES) * (blobs + 1) and whole.select("blob", "kind", "version").distinct().count() == whole.count()
    got = {(r.doc_id, tuple(map(tuple, r.found))) for r in secrets.report(odd.select("doc_id", "text").unionByName(more), whole).collect()}
    assert got == {(r.doc_id, tuple(plain_spans(r.text))) for r in odd.select("doc_id", "text").unionByName(more).collect()}


def test_masking_by_brute_force(spark):
    rng, rows = random.Random(1), [(999, None), (1000, "")]
    parts = ["token = abcdef123456", "secret:token:abcdefgh", "AKIA" + "Z" * 16, "deadbeef" * 4, "x://me:secret=abcdef12@h", "passwd=://u:pw1@", "gho_" + "a" * 36, "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", "AIza" + "b" * 36, "xoxb-1234567890-a"]
    for i in range(120):
        rows.append((i, "".join(rng.choice([*parts, "é" * rng.randrange(4000), "".join(rng.choices("ab é:/@=x🙂 \n", k=30))]) for _ in range(rng.randrange(12)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit(1), "_none": F.lit(2)})
    got = {r.doc_id: r.text for r in secrets.masked(docs, secrets.scan(docs)).collect()}
    for d, t in rows:
        out, at = "", 0
        for start, _, kind, end in sorted((a, b, k, e) for a, _, k, e in plain_spans(t) for b in [e]):
            if start >= at:
                out += t[at:start] + f"[{kind}]"
            at = max(at, end)
        assert got[d] == (None if t is None else out + t[at:])


def test_masking(spark, odd):
    got = {(r.doc_id, r.text) for r in secrets.masked(odd, secrets.scan(odd)).collect()}
    assert (6, "[assign] [access]") in got and (0, None) in got and (5, LONG) in got and len(got) == odd.distinct().count()
    assert secrets.masked(odd, secrets.scan(odd)).columns == odd.columns


def test_classifiers_held_out(spark):
    docs, marks = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = labelled.sample(docs, marks, 3900)
    random.Random(1).shuffle(rows)
    train, test = rows[:2900], rows[2900:]
    chain = toxicity_chain.fit_texts([r.text for r in train], np.array([[int(f(r.quality, r.toxic)) for _, f in toxicity_chain.CATEGORIES] for r in train]), [n for n, _ in toxicity_chain.CATEGORIES])
    p = chain.probabilities([r.text for r in test])[:, -1] >= toxicity_chain.REJECT_AT
    y = np.array([r.toxic for r in test]) == 1
    assert (p & y).sum() / y.sum() > 0.85 and (p & ~y).sum() / (~y).sum() < 0.01
    grade = np.array([0 if r.quality == 0 else 1 if r.toxic else 2 for r in train])
    model = ordinal_quality.fit_texts([r.text for r in train], grade, 3)
    tails = model.tails([r.text for r in test])
    good = np.array([r.quality for r in test]) == 1
    assert (np.diff(model.thresholds) > 0).all() and (np.diff(tails, axis=1) <= 0).all()
    assert ((tails[:, 0] >= 0.5) == good).mean() > 0.9


def plain_features(text):
    """Counts of words, of their prefixes and of runs of symbols."""
    coded, counts = (text or "").lower(), {}
    words, symbols = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", coded), re.findall(r"[!-/:-@\[-`{-~]+", coded)
    for w in words:
        raw = w.encode()
        for f in [("w", raw)] + [(n, raw[:n]) for n in linear.PREFIXES if len(raw) > n]:
            counts[f] = counts.get(f, 0) + 1
    for x in symbols:
        counts["s", x.encode()] = counts.get(("s", x.encode()), 0) + 1
    return {f: 0.5 + (8 * c / max(1, len(words) + len(symbols))) ** 0.5 for f, c in counts.items()}


def test_features_by_brute_force(texts):
    some = [t for t in ODD if t != LONG] + list(texts.values())[:40]
    row, key, val = linear.features(some)
    names = {}
    for i, t in enumerate(some):
        want, mine = sorted(plain_features(t).values()), sorted(val[row == i].tolist())
        assert np.allclose(want, mine, atol=1e-5)
    for i in (5, 12, 20):  # equal features have equal ids in all texts
        names.setdefault(i, set(key[row == i].tolist()))
    assert len(names[12] & names[20]) == len(plain_features(some[12]).keys() & plain_features(some[20]).keys())


def dense(x):
    out = np.zeros((x.n, len(x.vocab)))
    np.add.at(out, (x.row, x.col), x.val)
    return out


def small_corpus(n=160):
    rng = random.Random(4)
    marks = [rng.randrange(3) for _ in range(n)]
    return [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "one", "two"][g : g + 4], k=30)) for g in marks], np.array(marks)


def test_logistic_regression_by_brute_force():
    """The fitted loss, penalties and all, is that of plain proximal steps on the dense matrix; so are the chain's probabilities."""
    texts, grade = small_corpus()
    x, y = linear.matrix(texts, 1), (grade == 2).astype(float)
    full, w, b = dense(x), np.zeros(len(x.vocab)), 0.0
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(full @ w + b)))
        w, b = w - 0.05 * (full.T @ (p - y) / len(y) + 1e-5 * w), b - 0.05 * (p - y).mean()
        w = np.sign(w) * np.maximum(np.abs(w) - 0.05 * 2e-4, 0)

    def loss(w, b):
        s = full @ w + b
        return np.mean(np.log1p(np.exp(-np.where(y == 1, s, -s)))) + 2e-4 * np.abs(w).sum() + 5e-6 * (w * w).sum()

    m = linear.fit_logistic(x, y, steps=3000)
    own = np.zeros(len(x.vocab))
    own[np.searchsorted(x.vocab, m.vocab)] = m.weight
    assert loss(own, m.bias) <= loss(w, b) + 2e-3
    chain = toxicity_chain.fit_texts(texts, np.stack([grade > 0, grade == 2], axis=1).astype(int), ["a", "b"])
    seen = np.zeros((len(texts), 0))
    for k, m in enumerate(chain.models):
        own = np.zeros(len(x.vocab))
        own[np.searchsorted(x.vocab, m.vocab)] = m.weight
        s = full @ own + m.bias + seen @ m.extra
        assert np.allclose(1 / (1 + np.exp(-np.clip(s, -12, 12))), chain.probabilities(texts)[:, k], atol=1e-6)
        seen = np.column_stack([seen, np.clip(s, -12, 12)])
    assert chain.models[1].extra.size == 1


def test_ordinal_regression_by_brute_force():
    texts, grade = small_corpus()
    x = linear.matrix(texts, 1)
    full = dense(x)

    def loss(w, cuts):
        tail = 1 / (1 + np.exp(-(full @ w)[:, None] + cuts))
        edges, each = np.column_stack([np.ones(len(grade)), tail, np.zeros(len(grade))]), np.arange(len(grade))
        p = edges[each, grade] - edges[each, grade + 1]
        return -np.log(np.maximum(p, 1e-9)).mean()

    m = ordinal_quality.OrdinalModel(*linear.fit_ordinal(x, grade, 3, steps=2000))
    own = np.zeros(len(x.vocab))
    own[np.searchsorted(x.vocab, m.linear.vocab)] = m.linear.weight
    here, cuts, rng = loss(own, m.thresholds), m.thresholds, np.random.default_rng(1)
    penalty = 1e-4 * np.abs(own).sum()
    for _ in range(300):  # no small step in any direction is better
        step, cut = rng.normal(0, 0.02, len(own)), rng.normal(0, 0.02, 2)
        assert loss(own + step, cuts + cut) + 1e-4 * np.abs(own + step).sum() >= here + penalty - 1e-3
    tails = m.tails(texts)
    assert np.allclose(tails, 1 / (1 + np.exp(-((full @ own)[:, None] - cuts))), atol=1e-6) and (tails.argmin(axis=1) == 1).all()
    assert ((tails > 0.5).sum(axis=1) == grade).mean() > 0.9


def test_sample_is_bounded_by_characters_whatever_the_length_of_a_text(spark, odd):
    marks = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in labelled.sample(odd, marks)} == set(range(10))  # the longest text too
    few = labelled.sample(odd, marks, chars=400_000)
    assert 0 < len(few) <= 10 and sum(len(r.text) for r in few) <= 400_000 and len(labelled.sample(odd, marks, limit=4)) == 4


def test_classifiers_on_odd_input(spark, odd, none):
    marks = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (4, None, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    for m in (marks, marks.where("false")):
        scored = toxicity_chain.score(odd, toxicity_chain.fit(odd, m)).collect()
        graded = ordinal_quality.grade(odd, ordinal_quality.fit(odd, m)).collect()
        assert len(scored) == len(graded) == odd.count()
        assert all(0 <= r.p_toxic <= 1 for r in scored) and all(0 <= r.expected_grade <= 2 for r in graded)
        assert len({r.p_toxic for r in scored if r.doc_id == 9}) == 1
    assert toxicity_chain.score(none, toxicity_chain.fit(none, marks)).count() == 0
    assert ordinal_quality.grade(none, ordinal_quality.fit(none, marks)).count() == 0


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_best_span_is_the_least_edit_distance():
    rng = random.Random(3)
    for _ in range(30):
        item, text = (np.array([rng.randrange(4) for _ in range(n)], np.uint64) for n in (5, 14))
        want = min(plain_edits(item.tolist(), text[i:j].tolist()) for i in range(15) for j in range(i, 15))
        got, start = cgk_decontam.best_span(item, text)
        assert got == want and any(plain_edits(item.tolist(), text[start:j].tolist()) == want for j in range(start, 15))


def test_decontamination_recall(spark, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    vocab, rng = [w for t in texts.values() for w in t.split()][:20000], random.Random(2)
    index = cgk_decontam.index([i for i, _ in items], [t for _, t in items])
    for rate in (0.0, 0.05, 0.1, 0.14):
        edited = []
        for _, t in items:
            ws = t.split()
            for _ in range(int(rate * len(ws))):
                p = rng.randrange(len(ws))
                ws[p : p + rng.randrange(2)] = [rng.choice(vocab)] * rng.randrange(1, 2)
            edited.append(" ".join(rng.choices(vocab, k=50) + ws + rng.choices(vocab, k=50)))
        found = {(d, i) for d, i, *_ in cgk_decontam.search(edited, index)}
        assert all((k, i) in found for k, (i, _) in enumerate(items))


def edited(ws, kind, k, rng):
    """ws with k of its words replaced in its head, its head cut off, or words deleted, replaced or added anywhere."""
    new = [f"new{rng.randrange(10**12)}" for _ in range(k)]
    if kind == "head replaced":
        return [*new, *ws[k:]]
    if kind == "head missing":
        return ws[k:]
    ws = list(ws)
    if kind == "head scattered":
        for p, x in zip(rng.sample(range(min(len(ws), 96)), k), new, strict=True):
            ws[p] = x
    for x in new if kind in ("deleted", "mixed") else []:
        p, keep = rng.randrange(len(ws)), kind == "mixed" and rng.randrange(3)
        ws[p : p + (keep != 1)] = [x] * (keep > 0)
    return ws


@pytest.mark.parametrize("size", [7, 14, 20, 37, 59, 120, 250, 500])
def test_decontamination_finds_every_kind_of_edit_up_to_the_limit(size):
    rng, vocab = random.Random(size), [f"w{i}" for i in range(5000)]
    items = [rng.choices(vocab, k=size) for _ in range(20)]
    index, k = cgk_decontam.index(list(range(20)), [" ".join(x) for x in items]), int(cgk_decontam.RATE * size)
    for kind in ("head replaced", "head missing", "head scattered", "deleted", "mixed"):
        docs = [" ".join(rng.choices(vocab, k=30) + edited(x, kind, k, rng) + rng.choices(vocab, k=30)) for x in items]
        found = {(d, i): e for d, i, _, e in cgk_decontam.search(docs, index)}
        assert all(found.get((d, d), 99) <= k for d in range(20)), kind


def test_decontamination_against_containment(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    norm = {d: " " + " ".join(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower())) + " " for d, t in texts.items()}
    want = {(d, i) for d, t in norm.items() for i, x in items.items() if " " + " ".join(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", x.lower())) + " " in t}
    got = {(r.doc_id, r.item_id) for r in queries.op4_decontamination(spark, FOLDER).collect()}
    assert want and got == want


def test_decontamination_on_odd_input(spark, odd, none):
    bench = spark.createDataFrame([(1, "AKIA" + "z" * 16), (2, None), (3, ""), (None, "one"), (4, "lorem ipsum dolor lorem ipsum dolor lorem ipsum"), (4, "lorem ipsum dolor lorem ipsum dolor lorem ipsum")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in cgk_decontam.contaminated(odd, bench).collect()}
    assert got == {(6, 1), (7, 1), (5, 4)}
    assert cgk_decontam.contaminated(none, bench).count() == 0 and cgk_decontam.contaminated(odd, bench.where("false")).count() == 0
    assert cgk_decontam.clean(odd, bench).count() == odd.count() - 3


def test_preferences_by_hand(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 1, "assistant", "no"), (3, 0, "user", "alone"), (4, 0, None, None), (None, 0, "user", "hi"), (5, 0, "user", "hi"), (5, 1, "assistant", "yes"), (5, 2, "user", "more")]
    conv = preference_format.threads(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {(r.chosen_id, r.rejected_id): r for r in preference_format.format_pairs(conv, preference_format.by_first_turn(conv)).collect()}
    assert set(got) == {(1, 2), (1, 5), (3, None), (4, None)}
    r = got[1, 2]
    assert r.prefix_turns == 1 and r.prompt == "<|user|>\nhi\n" and r.chosen == "<|assistant|>\nyes\n<|user|>\nmore\n" and r.rejected == "<|assistant|>\nno\n"
    a, b = map(int, r.chosen_mask.split(":"))
    assert r.chosen[a:b] == "yes" and r.rejected[slice(*map(int, r.rejected_mask.split(":")))] == "no"
    assert got[1, 5].prefix_turns == 3 and got[1, 5].chosen == "" and got[3, None].prefix_turns == 0 and got[3, None].chosen_mask == ""
    empty = preference_format.threads(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert preference_format.format_pairs(empty, preference_format.by_first_turn(empty)).count() == 0


def plain_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "http://ORG/", "https://a.example.org/es/1", "https://example.org/en/12", "https://xexample.org/en/12", "x://b.com/de/?a", "x://com/fr/#z", "x://b.com/de", "a://b://c.org/x", "http://é.org/é", "http://org/\nx", "http://" + "a." * 3000 + "org/" + "p" * 5000]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(4, urls[4], "x")], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = [(r.page_id, (r.host, r.path, r.rule, r.verdict)) for r in url_bloom.judge(pages, rules).collect()]
    assert sorted(got, key=str) == sorted([(r.page_id, plain_verdict(r.url, queries.URL_RULES)) for r in pages.collect()], key=str)
    assert url_bloom.judge(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in url_bloom.judge(pages, rules.where("false")).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom, blocks = url_bloom.build(keys)
    assert blocks > 50 and url_bloom.possible(keys, bloom, blocks).count() == 3000
    others = spark.range(20000).select(F.concat(F.lit("other"), "id").alias("key"))
    assert url_bloom.possible(others, bloom, blocks).count() < 400


def plain_licence(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in license_index.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(ws)) if ws[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    more, score = set(), 0.0
    for label, t, key in license_index.TEMPLATES:
        t, key = t.split(), key.split()
        k = next(i for i in range(len(t)) if t[i : i + len(key)] == key)
        for i in range(-len(t), len(ws)):
            same_words = [0 <= i + j < len(ws) and ws[i + j] == w for j, w in enumerate(t)]
            if sum(same_words) >= license_index.LEAST * len(t) and all(same_words[k : k + len(key)]):
                more.add(label)
                score = max(score, sum(same_words) / len(t))
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), score


def test_licences(spark, odd, none):
    extra = ["CC BY cc-by; General Public\nLicense. All rights reserved", "Licensed under the Apache License, Version 3.0", "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files", "the mit license released under the MIT license" * 3]
    docs = odd.select("doc_id", "text", "keep").unionByName(spark.createDataFrame([(100 + i, t, 1) for i, t in enumerate(extra)], "doc_id long, text string, keep int"))
    got = [tuple(r) for r in license_index.scan(docs).collect()]
    assert sorted(got, key=str) == sorted([(r.doc_id, *plain_licence(r.text)) for r in docs.collect()], key=str)
    assert license_index.scan(none).count() == 0
    short = (("one", "zlib", "zlib"), ("two", "curl zlib", "zlib"))
    assert [(r.labels, r.score) for r in license_index.scan(spark.createDataFrame([(1, "zlib"), (2, "curl zlib zlib")], "doc_id long, text string"), short).orderBy("doc_id").collect()] == [("one", 1.0), ("one,two", 1.0)]


def test_bpe_equals_the_library(spark, odd, none, texts):
    bpe = byte_bpe.load(queries.TOKENIZER, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(5)
    made = ["".join(rng.choice("aabbetinor é的🙂 \n\t\u00a0\u2003\x1c\x8512!?'sll") for _ in range(rng.randrange(60))) for _ in range(1500)]
    for t in [*filter(None, ODD), *list(texts.values())[:60], *made, "ab" * 5000 + " " * 3000 + "x" * 5000]:
        ids = np.frombuffer(bpe.encode(t), np.uint32).tolist()
        assert ids == lib.encode_ordinary(t) and bpe.decode(ids) == t.encode()
    docs = odd.select("doc_id", "text", "blob")
    for r in byte_bpe.digests(docs, queries.TOKENIZER, public_tokenizers.PATTERN).where("doc_id is not null").collect():
        t = ODD[r.doc_id] or ""
        ids = lib.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    back = byte_bpe.decode(byte_bpe.encode(docs, queries.TOKENIZER, public_tokenizers.PATTERN), queries.TOKENIZER, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back.collect())
    assert byte_bpe.digests(none, queries.TOKENIZER, public_tokenizers.PATTERN).count() == 0


def test_top_k_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (400, 9))
    x[100:200] = x[100]  # many ties
    df = spark.createDataFrame([(i, [int(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (None, [1] * 9), (901, [1, 2])], "vec_id long, vector array<long>")
    got = {}
    for r in maxscore.top_k(df, df.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 400, 20):
        s = x @ x[q]
        best = sorted((-int(s[i]), i) for i in range(400) if i != q)[:20]
        assert sorted(got[q]) == [(k + 1, i, -v) for k, (v, i) in enumerate(best)]
    assert set(got) == set(range(0, 400, 20))
    assert maxscore.top_k(df.where("false"), df.where("false")).count() == 0
    again = df.withColumns({"shard": F.lit("x"), "v": F.lit(1), "asked": F.lit(2)})
    monkeypatch.setattr(maxscore, "SHARD", 50)
    monkeypatch.setattr(maxscore, "SEEDS", 64)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in maxscore.top_k(again, again.where("vec_id % 20 = 0"), 20).collect()} == {(q, *r) for q, rows in got.items() for r in rows}


def test_quantising(spark):
    rows = [(1, [0.5, -0.01]), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, None), (5, [float("inf")])]
    got = {r.vec_id: r.v for r in spark.createDataFrame(rows, "vec_id long, e array<float>").select("vec_id", maxscore.quantised(F.col("e")).alias("v")).collect()}
    assert got == {1: [32, -1], 2: None, 3: None, 4: None, 5: None}


def plain_classes(texts):
    sets, parent = {}, {d: d for d in texts}
    for d, t in texts.items():
        ws = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
        sets[d] = {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else None

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in texts:
        for b in texts:
            if a > b and texts[a] is not None and texts[b] is not None:
                x, y = sets[a], sets[b]
                if (texts[a] == texts[b]) if x is None or y is None else len(x & y) >= 0.8 * len(x | y):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in texts}


def test_near_duplicates_by_brute_force(spark):
    rng, vocab = random.Random(8), [f"w{i}" for i in range(3000)]
    base = [rng.choices(vocab, k=120) for _ in range(12)]
    made = []
    for k in range(150):  # chains of edits, exact copies and strangers
        ws = list(base[k % 12])
        for _ in range(rng.choice((0, 0, 1, 2, 3, 6))):
            ws[rng.randrange(len(ws))] = rng.choice(vocab)
        made.append(" ".join(ws))
    texts = dict(enumerate([*made, *[t if t != LONG else LONG[:3000] for t in ODD]]))
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(0, texts[0], "x"), (None, "w1", "x")], "doc_id long, text string, label string")
    got = dict(map(tuple, probminhash.classes(df).collect()))
    assert got == plain_classes(texts)
    kept = [r.doc_id for r in probminhash.deduplicated(df).collect()]
    assert set(kept) == {*set(got.values()), None} and probminhash.deduplicated(df).columns == df.columns
    assert probminhash.classes(df.where("false")).count() == 0


def test_near_duplicates_that_differ_in_repeats_of_a_line(spark):
    rng, texts = random.Random(9), {}
    for k in range(8):
        ws = [f"v{k}x{i}" for i in range(200)]
        at = 12 * rng.randrange(16)
        for repeats in (0, 20, 40, 60):
            texts[len(texts)] = " ".join(ws + ws[at : at + 12] * repeats)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = plain_classes(texts)
    assert len(set(want.values())) == 8 and dict(map(tuple, probminhash.classes(df).collect())) == want


def test_rows_with_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, a), (2, a + " more"), (None, a), (3, b), (3, c), (None, c), (None, "z " + b), (None, "lone text"), (None, "lone text"), (4, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, probminhash.deduplicated(df).collect()), key=str)
    assert got == sorted([(1, a), (3, b), (3, c), (None, "lone text"), (4, None), (None, None)], key=str)
    bench = spark.createDataFrame([(1, c)], "item_id long, text string")
    left = sorted(map(tuple, cgk_decontam.clean(df, bench).collect()), key=str)
    assert left == sorted([r for r in rows if r[1] != c], key=str)


def test_no_link_within_a_bucket_is_lost(spark, monkeypatch):
    """Everything in one bucket: 400 pairs of 8 and 9 words with 4 of 5 shingles in common, and 30 with 20 of 25."""
    texts = {}
    for k in range(430):
        ws = [f"u{k}x{i}" for i in range(9 if k < 400 else 29)]
        texts |= {2 * k: " ".join(ws), 2 * k + 1: " ".join(ws[: 8 if k < 400 else 24])}
    whole = probminhash.sketches
    monkeypatch.setattr(probminhash, "sketches", lambda *a: whole(*a).withColumn("band", F.array(F.lit(1).cast("long"))))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert dict(map(tuple, probminhash.classes(df).collect())) == {d: d - d % 2 for d in texts}


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    keys = rng.integers(1, 2**62, 300).astype(np.uint64)
    a, b = rng.integers(1, 5, 300).astype(float), rng.integers(1, 5, 300).astype(float)
    b[:60] = 0
    want = sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in range(300)) for i in range(60, 300))
    sig = probminhash.signatures(np.concatenate([keys, keys[60:]]), np.repeat([0, 1], [300, 240]), np.concatenate([a, b[60:]]), 2, 4000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.03)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (101, 50), (7, 7), (None, 1), (200, 201), (200, 201)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 100: 50, 101: 50, 200: 200, 201: 200}


def test_words_and_shingles():
    w = T.words([None, "Aa bb-cc", "é", "a b c d e f"])
    assert np.diff(w.bounds).tolist() == [0, 3, 1, 6] and w.hash[0] == T.words(["x aA"]).hash[1]
    h, doc = T.shingles(w)
    assert doc.tolist() == [1, 2, 3, 3] and len(set(h.tolist())) == 4
    assert [x for x in T.chunks(["a" * 5, None, "b" * 9, "c"], 8)] == [(0, 2), (2, 3), (3, 4)]


def test_logistic_of_one_class_is_constant():
    m = linear.fit_logistic(linear.matrix(["a b", "c d"] * 5), np.ones(10))
    assert m.bias == 20.0 and not len(m.vocab)


def test_pipeline(spark, texts):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    clean = corpus_pipeline.toxicity(spark, docs, FOLDER)
    bad = {r.doc_id for r in queries.op3_toxicity(spark, FOLDER).where("rejected").collect()}
    assert {r.doc_id for r in clean.collect()} == set(texts) - bad
    once = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert {r.doc_id for r in once.collect()} == set(plain_classes(texts).values())
    leaks = {r.doc_id for r in queries.op4_decontamination(spark, FOLDER).collect()}
    assert {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, FOLDER).collect()} == set(texts) - leaks
    hidden = {r.doc_id: r for r in corpus_pipeline.secret_scan(spark, docs, FOLDER).collect()}
    for d, t in texts.items():
        out, at = "", 0
        for start, _, kind, end in plain_spans(t):
            if start >= at:
                out += t[at:start] + f"[{kind}]"
            at = max(at, end)
        assert hidden[d].text == out + t[at:] and hidden[d].n_chars == len(hidden[d].text)
    result = corpus_pipeline.run(spark, FOLDER)
    assert set(result.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert {r.doc_id for r in result.collect()} <= set(texts) - bad


def test_pipeline_stages_on_odd_input(spark, odd):
    docs = odd.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    all_rows = sorted((r.doc_id, r.text) for r in docs.where("doc_id is not null").collect() if r.text is not None)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), FOLDER).count() == 0, name
        left = stage(spark, docs, FOLDER).collect()
        if name in ("secret_scan", "encode"):
            assert len(left) == docs.count(), name
        if name in ("near_duplicates", "decontaminate"):  # each text stays, once or as often as it stood
            assert {r.text for r in left} == {t for _, t in all_rows} | {None, "no id"}, name
            assert len(left) == docs.count() if name == "decontaminate" else len(left) == docs.select("text").distinct().count(), name


def test_a_cluster_has_to_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    with pytest.raises(ValueError):
        storage.shared_folder(type("Session", (), {"sparkContext": Context()})())


def test_preference_pairs_of_a_very_common_first_turn(spark):
    turns = spark.range(3000).selectExpr("id % 1000 as conv_id", "id div 1000 as turn", "'user' as role", "case when id < 1000 then 'hi' else concat('t', id % 7) end as text")
    conv = preference_format.threads(turns)
    got = preference_format.format_pairs(conv, preference_format.by_first_turn(conv)).collect()
    assert len(got) == 999 and {r.chosen_id for r in got} == {0} and {r.prefix_turns for r in got} == {1, 3}
