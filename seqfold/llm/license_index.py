"""License scans by a positional index of rare licence words, in DataFrame functions alone.

Document frequencies of the licence vocabulary are counted over all documents. The index holds postings (word, template,
position) of the highest inverse document frequency of each template: the rarest word of its mandatory key phrase, its pivot, and then
its rarest other words, two more in all than a match may lack. A document looks up those of these words that it
has; each place of a pivot proposes where its template begins, and the template's other postings are intersected with it by
relative position: one of them at least has to stand where the proposed beginning puts it. A match that has the share LEAST of the
template's words in their places, those of the key phrase among them, always passes, so no place is missed; what passes is verified on all
words. Base labels come from exact phrases, wherever they stand.

A word is a run of digits, a-z (A-Z are lower-cased) and characters beyond ASCII. A null text counts as empty: no words, no
labels, score 0. Texts are read whole; repeated rows get equal results; input columns other than id
and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST = 0.8

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, template, mandatory key phrase (standard notices of public licences, as words).
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
)


def words_of(text: Column) -> Column:
    """array<string>; empty for a text without words."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, " "))
    return F.when(plain != "", F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, t, _ in templates for w in t.split()})


def rarity(docs: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of each licence word, over all documents; the vocabulary bounds what is collected."""
    vocab = F.array(*map(F.lit, vocabulary(templates)))
    found = docs.select(F.array_intersect("words", vocab).alias("w"))
    counts = found.select(F.explode(F.concat("w", F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    df = {r.w: r.df for r in counts.collect()}
    total = df.get("", 0)
    return {w: (total + 1.0) / (df.get(w, 0) + 1.0) for w in vocabulary(templates)}


def lacking(n: int, least: float = LEAST) -> int:
    """How many words of a template of n a match may lack."""
    return n - math.ceil(least * n - 1e-9)


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    last = F.size(words) - len(parts)
    at = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: _all([F.get(words, i + k) == F.lit(p) for k, p in enumerate(parts)]))
    return F.when((last >= 0) & F.array_contains(words, parts[-1]) & F.array_contains(words, parts[0]), at).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))


def scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs.

    score: the largest share of a template's words found in place, its key phrase among them; else 0."""
    worded = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    idf = rarity(worded, templates)
    catalogue, pivots = [], {}
    for n, (label, text, key) in enumerate(templates):
        words, phrase = text.split(), key.split()
        start = next(k for k in range(len(words)) if words[k : k + len(phrase)] == phrase)
        pivot = max(range(start, start + len(phrase)), key=lambda k: (idf[words[k]], words[k]))
        others = sorted((k for k in range(len(words)) if k != pivot), key=lambda k: (-idf[words[k]], words[k], k))[: lacking(len(words), least) + 1]
        pivots.setdefault(words[pivot], []).append((n, pivot))
        posted = F.array(*[F.struct(F.lit(k).alias("p"), F.lit(words[k]).alias("w")) for k in others])
        catalogue.append(F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, words)).alias("words"), F.lit(start).alias("start"), F.lit(len(phrase)).alias("size"), posted.alias("posted")))
    catalogue = F.array(*catalogue)
    ranked = F.array(*map(F.lit, sorted(pivots, key=lambda w: (-idf[w], w))))
    index = F.create_map(*[x for w, ps in pivots.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(n).alias("n"), F.lit(p).alias("p")) for n, p in ps]))])
    base = [_places(F.col("words"), p) for p in PHRASES]
    found = worded.select("doc_id", "words", *[b.alias(f"b{k}") for k, b in enumerate(base)], F.array_intersect(ranked, "words").alias("rare"))

    def stands(at: Column, word: Column) -> Column:
        return F.when(at >= 0, F.coalesce(F.get(F.col("words"), at) == word, F.lit(False))).otherwise(False)

    def proposed(words: Column, rare: Column) -> Column:
        """(template, beginning) of each place of a pivot; a template has one pivot, so none comes twice."""
        at = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(rare, w), i)), lambda i: i.isNotNull())
        return F.flatten(F.transform(at, lambda i: F.transform(F.element_at(index, F.get(words, i)), lambda p: F.struct(p["n"].alias("n"), (i - p["p"]).alias("at")))))

    def met(c: Column) -> Column:
        posted = F.get(catalogue, c["n"])["posted"]  # none for a template of one word
        return (F.size(posted) == 0) | F.exists(posted, lambda p: stands(c["at"] + p["p"], p["w"]))

    def matched(c: Column) -> Column:
        t = F.get(catalogue, c["n"])
        same = F.transform(t["words"], lambda w, p: stands(c["at"] + p, w))
        share = F.size(F.filter(same, lambda s: s)) / F.size(same)
        return F.struct(t["label"].alias("label"), share.alias("share"), F.forall(F.slice(same, t["start"] + 1, t["size"]), lambda s: s).alias("key"))

    meets = F.filter(proposed(F.col("words"), F.col("rare")), met)
    cands = found.withColumn("hits", F.when(F.size("rare") > 0, F.filter(F.transform(meets, matched), lambda m: m["key"] & (m["share"] >= least))).otherwise(F.array().cast("array<struct<label:string,share:double,key:boolean>>")))
    named = F.array_compact(F.array(*[F.when(F.size(f"b{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]))
    places = cands.withColumns({"base": F.concat(*[F.col(f"b{k}") for k in range(len(base))]), "named": named})
    return places.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"), F.array_min("base").cast("long").alias("first_word"), F.array_max("base").cast("long").alias("last_word"),
        F.array_join(F.array_sort("named"), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat("named", F.transform("hits", lambda h: h["label"])))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0)).alias("score"),
    )
