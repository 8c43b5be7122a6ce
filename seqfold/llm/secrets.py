"""Secret scans over an incremental blob ledger, in DataFrame functions alone.

Every version of a text is a blob, named by the SHA-256 of its content. A ledger has a row for each blob
and rule version that was scanned, with the spans found. A scan takes the blobs that documents bring,
drops the pairs the ledger has, runs only the remaining rules over only the remaining blobs, and findings
join back to every path that holds the blob. Spans are in code points, end exclusive; of a rule's
matches, leftmost and non-overlapping, those stay whose measured group has the rule's least length.

The ledger is a folder of increments, one written by each run of `enter`, and read back by the next one: a blob that any earlier
run has scanned under a rule's version is never scanned under it again, whatever path or version of a file brings it.

Two runs that enter a blob at the same time, or a run that is retried, write a pair twice; what a rule's version finds in a blob is
always the same, so readers count a pair once, and `compacted` writes each pair once.

A null text counts as empty. Repeated rows share a blob and are each reported. Long texts are scanned
whole; their matches are numbered and summed in rows, not in nested arrays. A report ignores input columns other than the
id and the text; `masked` returns all of them, whatever their names. An empty table gives an empty report.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqfold.llm.storage import kept, unused

CHUNK = 2048  # characters


@dataclass(frozen=True)
class Rule:
    kind: str
    version: str
    pattern: str
    group: int  # whose length counts
    least: int


#: The base rules, in the order in which kinds are listed. {24,} and {16,} find exactly the runs that are long enough.
BASE = (
    Rule("assign", "1", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "1", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", "1", r"[0-9a-f]{24,}", 0, 24),
)
#: What is looked for beside them: tokens of public services by their documented prefixes, web tokens, key blocks, passwords in URLs.
RULES = (
    *BASE,
    Rule("github", "1", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", "1", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("google", "1", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    Rule("jwt", "1", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    Rule("key_block", "1", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 27),
    Rule("url_password", "1", r"://[A-Za-z0-9._-]{1,64}:([A-Za-z0-9._~!$*+=-]{3,64})@", 1, 3),
)


def with_blob(docs: DataFrame, text_col: str = "text", name: str = "blob") -> DataFrame:
    return docs.withColumn(name, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)))


def _matches(rule: Rule, number: int, text: Column) -> Column:
    """array<struct<rule, gap, size, ok>>: what lies between matches and the matches, in order."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    measured = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    rows = F.transform(
        F.arrays_zip(found.alias("found"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), measured.alias("part")),
        lambda x: F.struct(F.lit(number).alias("rule"), F.length(x["gap"]).alias("gap"), F.length(x["found"]).alias("size"), (F.length(x["part"]) >= rule.least).alias("ok")),
    )
    return F.when(text.rlike(rule.pattern), rows)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """New ledger rows (blob, kind, version, spans): one for each blob of docs and rule version that the ledger lacks."""
    blobs = with_blob(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text").dropDuplicates(["blob"])
    numbers = list(range(len(rules)))
    every = F.array(*map(F.lit, numbers))
    if ledger is None:
        due = blobs.withColumn("due", every)
    else:
        catalogue = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for n, r in enumerate(rules)])
        rule_rows = ledger.select("blob", F.get(F.filter(catalogue, lambda c: (c["kind"] == F.col("kind")) & (c["version"] == F.col("version"))), F.lit(0))["n"].alias("n")).where("n is not null")
        seen = rule_rows.groupBy("blob").agg(F.collect_set("n").alias("seen"))  # as many as there are rules, at most
        due = blobs.join(seen, "blob", "left").withColumn("due", F.array_except(every, F.coalesce("seen", F.array().cast("array<int>")))).where(F.size("due") > 0).drop("seen")
    arrays = [F.when(F.array_contains("due", n), _matches(r, n, F.col("text"))) for n, r in enumerate(rules)]
    empty = F.array().cast("array<struct<rule:int,gap:int,size:int,ok:boolean>>")
    hits = due.select("blob", "due", F.concat(*[F.coalesce(a, empty) for a in arrays]).alias("hits"))
    rows = hits.select("blob", "due", F.posexplode_outer("hits").alias("nth", "hit")).select("blob", "due", "nth", "hit.*")
    sofar = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("blob", "rule").orderBy("nth"))
    placed = rows.withColumn("end", sofar.cast("long")).withColumn("start", F.col("end") - F.col("size"))
    found = placed.groupBy("blob").agg(F.first("due").alias("due"), F.collect_list(F.when(F.col("ok"), F.struct("rule", "start", "end"))).alias("found"))
    spans = F.array_sort(F.transform(F.filter("found", lambda s: s["rule"] == F.col("n")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    kind, version = (F.element_at(F.create_map(*[F.lit(x) for n, r in enumerate(rules) for x in (n, getattr(r, what))]), F.col("n")) for what in ("kind", "version"))
    return found.select("blob", "found", F.explode("due").alias("n")).select("blob", kind.alias("kind"), version.alias("version"), spans.alias("spans"))


def enter(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The ledger in folder after docs came in: what they bring that is not in it is scanned and written to it as one more increment."""
    scan(docs, ledger(docs.sparkSession, folder), rules, text_col).write.parquet(f"{folder}/{uuid.uuid4().hex}")
    return ledger(docs.sparkSession, folder)


def ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """All increments in folder; None if there is no such folder yet."""
    try:
        return spark.read.schema("blob binary, kind string, version string, spans array<struct<start:bigint,end:bigint>>").option("recursiveFileLookup", True).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def compacted(spark: SparkSession, folder: str, to: str) -> DataFrame:
    """The ledger in folder as one increment in the folder to, each pair of a blob and a rule's version once. Later runs enter into that one."""
    unique = ledger(spark, folder).dropDuplicates(["blob", "kind", "version"])
    unique.write.parquet(f"{to}/{uuid.uuid4().hex}")
    return ledger(spark, to)


def report(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found) for every row of docs: array<struct<start, rank, kind, end>> in order of start, then rank of the kind."""
    rank = F.element_at(F.create_map(*[F.lit(x) for n, r in enumerate(rules) for x in (f"{r.kind}@{r.version}", n)]), F.concat("kind", F.lit("@"), "version"))
    hits = ledger.where(F.size("spans") > 0).select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank.alias("rank"), F.col("kind").alias("kind"), s["end"].alias("end"))).alias("part")).where(F.get("part", F.lit(0))["rank"].isNotNull())
    # a row for each rule and run that entered it is gathered, and repeats fall away; written, so that the join can split a blob with very many paths
    by_blob = kept(hits.groupBy("blob").agg(F.array_sort(F.flatten(F.array_distinct(F.collect_list("part")))).alias("found")))
    paths = with_blob(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text").drop("text")
    return paths.join(by_blob, "blob", "left").select("doc_id", F.coalesce("found", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")).alias("found"))


def _merged(ledger: DataFrame, blob: str, found: str, tail: str) -> DataFrame:
    """(blob, found, tail), so named: the spans of a blob that begin at or behind the end of those before, in order, each with where the text
    between begins, and the end of all."""
    each = ledger.where(F.size("spans") > 0).select("blob", "kind", F.explode("spans").alias("s")).select("blob", "kind", "s.start", "s.end")
    sofar = Window.partitionBy("blob").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    told = each.withColumn("from", F.coalesce(F.max("end").over(sofar), F.lit(0).cast("long")))
    fresh = F.when(F.col("start") >= F.col("from"), F.struct("from", "start", "end", "kind"))
    return told.groupBy(F.col("blob").alias(blob)).agg(F.array_sort(F.collect_list(fresh)).alias(found), F.max("end").alias(tail))


def _part(chunks: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) of a text that is cut into chunks, without a walk from the text's beginning."""
    a, b = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    head, tail = F.coalesce(F.get(chunks, a), F.lit("")), F.coalesce(F.get(chunks, b), F.lit(""))
    inner = F.array_join(F.slice(chunks, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
    within = head.substr((start - a * CHUNK + 1).cast("int"), (end - start).cast("int"))
    return F.when(a == b, within).otherwise(F.concat(head.substr((start - a * CHUNK + 1).cast("int"), F.lit(CHUNK)), inner, tail.substr(F.lit(1), (end - b * CHUNK).cast("int"))))


def masked(docs: DataFrame, ledger: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the spans that the ledger has for a text's blob replaced by [kind]; overlapping spans become the first's kind.

    Rows without a finding, null texts among them, stay as they are. The work is linear in a text's length and findings: spans are merged
    as rows, and the text is cut into chunks once."""
    blob, found, tail, cut = unused(docs, "blob", "found", "tail", "chunks")
    by_blob, text = kept(_merged(ledger, blob, found, tail)), F.col(text_col)
    hit = F.col(found).isNotNull()
    chunks = F.when(hit, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))
    joined = with_blob(docs, text_col, blob).join(by_blob, blob, "left").withColumn(cut, chunks)
    pieces = F.transform(found, lambda s: F.concat(_part(F.col(cut), s["from"], s["start"]), F.lit("["), s["kind"], F.lit("]")))
    rest = _part(F.col(cut), F.col(tail), F.length(text))
    return joined.withColumn(text_col, F.when(hit, F.concat(F.array_join(pieces, ""), rest)).otherwise(text)).select(docs.columns)
