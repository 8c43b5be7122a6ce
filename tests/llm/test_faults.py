"""Retried runs, texts beyond a sample's bound, and tables whose columns have the names that operators use inside."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seqfold.llm import byte_bpe, cgk_decontam, labelled, probminhash, queries, secrets, storage, toxicity_chain

INSIDE = ("blob", "found", "tail", "chunks", "row", "digest", "chain", "id", "name", "label", "n_found", "bucket")


@pytest.fixture(scope="module")
def clashing(spark):
    """Three rows with every name that an operator gives to a column of its own, with one and two underscores and in capitals."""
    text = "the quick brown fox jumps over the lazy dog while nine small birds sing in a tall old tree"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "password = hunter2hunter2"), (4, None)], "doc_id long, text string")
    return docs.withColumns({p + n: F.concat(F.lit(p + n), F.col("doc_id").cast("string")) for n in INSIDE for p in ("", "_", "__")}).withColumn("___ROW", F.lit("kept"))


def extras(df, keys=("doc_id",)):
    names = [c for c in df.columns if c.lstrip("_").lower() in INSIDE]
    return {tuple(r) for r in df.select(*keys, *names).collect()}


def test_unused_names_ignore_case(spark):
    df = spark.range(1).select(F.lit(1).alias("Row"), F.lit(1).alias("_ROW"), F.lit(1).alias("blob"))
    assert storage.unused(df, "row", "blob", "tail") == ["__row", "_blob", "tail"]


def test_columns_of_inner_names_come_back(clashing, spark):
    whole = extras(clashing)
    hidden = secrets.masked(clashing, secrets.scan(clashing))
    assert hidden.columns == clashing.columns and extras(hidden) == whole
    assert {r.text for r in hidden.where("doc_id = 3").collect()} == {"[assign]"}
    once = probminhash.deduplicated(clashing)
    assert once.columns == clashing.columns and extras(once) == {t for t in whole if t[0] != 2}
    items = spark.createDataFrame([(7, "nine small birds sing in a tall old tree")], "item_id long, text string")
    left = cgk_decontam.clean(clashing, items)
    assert left.columns == clashing.columns and extras(left) == {t for t in whole if t[0] > 2}
    told = byte_bpe.digests(clashing, queries.TOKENIZER, public_tokenizers.PATTERN)
    assert told.columns == [*clashing.columns, "n_tokens", "ids_sha256", "decoded_sha256"] and extras(told) == whole
    chain = toxicity_chain.fit(clashing, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    scored = toxicity_chain.score(clashing, chain)
    assert scored.columns == [*clashing.columns, *[f"p_{n}" for n in chain.names], "rejected"] and extras(scored) == whole


def test_a_pair_entered_twice_counts_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token = abcdef123456 " + "ab12" * 8), (2, "nothing"), (3, "token = abcdef123456 " + "ab12" * 8)], "doc_id long, text string")
    once = {(r.doc_id, tuple(map(tuple, r.found))) for r in secrets.report(docs, secrets.scan(docs)).collect()}
    folder = str(tmp_path / "ledger")
    late = [secrets.scan(docs, secrets.ledger(spark, folder)) for _ in range(2)]  # two runs that see the same, empty state
    for n, one in enumerate(late):
        one.write.parquet(f"{folder}/run{n}")
    twice = secrets.ledger(spark, folder)
    assert twice.count() == 2 * 2 * len(secrets.RULES)
    assert {(r.doc_id, tuple(map(tuple, r.found))) for r in secrets.report(docs, twice).collect()} == once
    assert {(r.doc_id, r.text) for r in secrets.masked(docs, twice).collect()} == {(1, "[assign] [hex]"), (2, "nothing"), (3, "[assign] [hex]")}
    assert secrets.scan(docs, twice).count() == 0
    short = secrets.compacted(spark, folder, str(tmp_path / "next"))
    assert short.count() == 2 * len(secrets.RULES) == secrets.enter(docs, str(tmp_path / "next")).count()
    assert {(r.doc_id, tuple(map(tuple, r.found))) for r in secrets.report(docs, short).collect()} == once


def test_one_long_text_does_not_empty_the_sample(spark):
    docs = spark.createDataFrame([(i, "word " * (20_000 if i % 3 == 0 else 20)) for i in range(30)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in labelled.sample(docs, marks, chars=90_000)} == {i for i in range(30) if i % 3}
    with pytest.raises(ValueError, match="every labelled text has more than 10 characters"):
        labelled.sample(docs, marks, chars=80)
    assert labelled.sample(docs.limit(0), marks) == []
