"""Quality rules by divergence, importance resampling and whitening against plain versions, and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqfold.llm import divergence_rules, importance, queries, whitening

FOLDER = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


# --- quality rules ---------------------------------------------------------------------------------------------------------------


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(zip(words, words[1:], words[2:], strict=False))
    held = {i + k for i, r in enumerate(zip(words, words[1:], words[2:], strict=False)) if runs[r] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(held) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(held), failed


def test_base_rules_on_odd_input(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\r\n\x0b\x0c ", "one", "one two", "a b c a b c", "a a a a", "x\ny\nx\r\nx\n\n \nx", "naïve é 東京 🙂   | <b>", "w " * 40_000, prose(rng, 30_000, [f"w{i}" for i in range(40)]), "a\x00b " * 60, "a b c" + " q" * 50]
    texts += [prose(rng, rng.randrange(1, 200), WORDS[: rng.randrange(1, 12)]) + rng.choice(["", "\n" + "###", "\n\nalpha"]) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, rng.choice(["en", None, "xx"]), 1, "z") for i, t in enumerate(texts)] + [(1, "", "en", 1, "z"), (None, "one", "en", 1, "z")], "doc_id long, text string, lang string, n_words int, words string")
    got = [tuple(r) for r in divergence_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    assert sorted(map(str, got)) == sorted(str((r.doc_id, *plain_base(r.text))) for r in docs.collect())
    assert divergence_rules.judge(docs.where("false")).count() == 0


def js(p, q):
    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, q, strict=True)) / 2))


def test_divergence_against_a_plain_version(spark):
    rng = random.Random(5)
    good = [prose(rng, rng.randrange(60, 300), WORDS + [f"w{chr(97 + i)}" for i in range(26)]) for _ in range(120)]
    bad = [" ".join("w" + chr(97 + rng.randrange(26)) + "###" for _ in range(120)), prose(rng, 200).upper(), " ".join(f"x{i}y" for i in range(150))]
    copied = prose(rng, 120, ["spam", "ham", *map(str, range(99))])
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(1000 + i, copied) for i in range(70)] + [(2000, "short text")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows] + [(3000, good[0] + " tail", "rare")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in divergence_rules.judge(docs).collect()}
    patterns = [r"[a-z]", r"[\x20\x09-\x0D]", r"[^\x00-\x7F]", r"[A-Z]", r"[0-9]", r"[.,;:!?'\"()-]"]

    def classes(t):
        c = [len(re.findall(p, t)) for p in patterns]
        return [*c, len(t) - sum(c)]

    used = [t for t in good + bad if len(t) >= divergence_rules.MIN_CHARS]  # the copied text is left out
    total = np.sum([classes(t) for t in used], axis=0)
    counts = Counter(w for t in used for w in t.lower().split())
    n = sum(counts.values())
    common = sorted(((-m, w) for w, m in counts.items() if not re.search(r"[\x00-\x60\x7B-\x7F]", w)))[: divergence_rules.COMMON]
    q = [-m / n for m, _ in common]
    for i, t in rows[:-1]:
        own = Counter(t.lower().split())
        size = len(t.split())
        p = [own[w] / size for _, w in common]
        assert got[i].char_distance == pytest.approx(js([c / len(t) for c in classes(t)], total / total.sum()), abs=1e-9)
        assert got[i].word_distance == pytest.approx(js([*p, 1 - sum(p)], [*q, 1 - sum(q)]), abs=1e-7)
    assert sum(not got[i].kept for i in range(120) if not got[i].base_failed) <= 2 and sum(got[i].base_failed for i in range(120)) < 60
    assert not any(got[120 + k].kept for k in range(3))
    assert got[2000].char_distance is None and not got[2000].kept  # too short to be compared
    assert got[3000].char_distance is None and got[3000].kept == (not got[3000].base_failed)  # its language has too few words


def test_rules_keep_good_documents_and_find_junk(spark):
    got = queries.queries()["op11_quality_rules"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    r = got.agg(F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("double"))).alias("good"), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("double"))).alias("junk")).first()
    assert r.good > 0.995 and r.junk < 0.15


# --- importance resampling -------------------------------------------------------------------------------------------------------


def plain_sample(rows, target, percent=10, least=20):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    words = [cut(t) for _, t in rows]
    s, t = Counter(bucket(w) for ws in words for w in ws), Counter(bucket(w) for x in target for w in cut(x))
    ns, nt = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * ns / ((s[b] + 1) * nt))) for b in s}
    out = []
    for (i, _), ws in zip(rows, words, strict=True):
        weight = sum(gain[bucket(w)] for w in ws) // len(ws) if ws else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(ws), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = k
    return out


def test_importance_against_a_plain_version(spark):
    rng = random.Random(8)
    texts = [None, "", "...", "É é K word", "İstanbul " * 30, "x" * 70_000 + " tail"] + [prose(rng, rng.randrange(5, 90), WORDS + ["Rare", "ÄÖ", "東京"]) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, texts[40])] * 60 + [(700 + i, texts[41]) for i in range(60)] + [(None, texts[42])] * 3
    docs = spark.createDataFrame([(i, t, 1, "k", 2.0) for i, t in rows], "doc_id long, text string, copies int, key string, score double")
    target = [None, "", "Rare rare ÄÖ words", "alpha beta"]
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, b int")
    key = lambda r: tuple(str(x) for x in r)
    for percent in (10, 73, 100):
        got = sorted((tuple(r) for r in importance.resample(docs, aim, percent=percent).collect()), key=key)
        assert got == sorted((tuple(r) for r in plain_sample(rows, target, percent)), key=key)
    assert importance.resample(docs.where("false"), aim).count() == 0
    none = importance.resample(docs, aim.where("false")).collect()
    assert len(none) == len(rows) and sum(r.rank is not None for r in none) > 0
    assert importance.resample(docs.limit(4), aim).where("rank is not null").count() == 0


def test_weights_favour_the_target(spark):
    got = queries.queries()["op12_importance"](spark, "/root/testdata/sf0.01")
    r = got.where("n_features >= 20").groupBy(F.col("rank").isNotNull().alias("drawn")).agg(F.avg("weight").alias("w")).collect()
    means = {x.drawn: x.w for x in r}
    assert means[True] > means[False]


# --- whitening -------------------------------------------------------------------------------------------------------------------


def test_whitening_against_a_dense_decomposition(spark):
    rng = np.random.default_rng(2)
    base = (rng.standard_normal((400, 20)) * np.linspace(3, 0.2, 20)) @ np.linalg.qr(rng.standard_normal((20, 20)))[0]
    vectors = [[float(v) for v in r] for r in base]
    rows = [(i, v, 1) for i, v in enumerate(vectors)] + [(1000 + i, vectors[0], 1) for i in range(300)] + [(2000, None, 1), (2001, [], 1), (2002, [1.0] * 3, 1), (2003, [float("nan")] * 20, 1), (2004, [float("inf")] * 20, 1), (2005, [None] * 20, 1), (None, vectors[1], 1), (5, vectors[5], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x int")
    got = whitening.whiten(df).collect()
    x = np.unique(np.floor(256 * np.array(vectors)).astype(np.int64), axis=0)
    n, sums = len(x), x.sum(axis=0)
    w, u = np.linalg.eigh(np.cov(x.T, bias=True))
    w, u = w[::-1], u[:, ::-1]
    assert len(got) == 4 * 702 and {r.n for r in got} == {n} and {r.component for r in got} == {1, 2, 3, 4}
    assert max(r.identity_error for r in got) < 1e-10
    own = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v, _ in rows if v and len(v) == 20 and i not in (2003, 2004, 2005)}
    sign = {}
    for r in got:
        v, k = own[r.vec_id], r.component - 1
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums, strict=True))
        assert r.explained == pytest.approx(w[k] / w.sum(), rel=1e-10)
        y = (v - sums / n) @ u[:, k] / math.sqrt(w[k])
        s = sign.setdefault(k, np.sign(y * r.whitened))
        assert r.whitened == pytest.approx(s * y, abs=1e-8)


def test_whitening_of_few_or_flat_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(1, None)])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = whitening.whiten(make([(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0]), (3, [7.0, 2.0, 0.0])])).collect()
    assert [r.component for r in flat] == [1, 1, 1] and all(r.explained == pytest.approx(1) for r in flat)


def test_eigenvectors_are_certified_where_values_are_close(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (3000, 64))
    fit = whitening.fitted(spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, x array<long>"))
    values, vectors, residual = whitening.leading(fit)
    w = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert residual < 1e-12 and values == pytest.approx(w[:4], rel=1e-11)
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12 and fit.trace() == pytest.approx(w.sum())
