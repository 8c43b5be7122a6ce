"""The registered queries: each is a function of a session and a folder of tables, most with the same query as DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqfold.functions import dims
from seqfold.operators import sequences, weights
from seqfold.sources import shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DEALT = 8 << 20  # bytes of text of a partition that is dealt by gene: what is made of it (a row for each symbol or cell, some 100 bytes each) stays in memory
SENT = 2_000_000  # ids of a set that are broadcast, about 60 MB; beyond, they are shuffled


class Tables:
    """The tables of a folder, and the frames that the queries share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def parts(self) -> int:
        """Into how many partitions whole texts are dealt by gene: as many as their bytes ask for, and as there are cores at least."""
        size = self.read("documents").agg(F.sum(F.octet_length("text")).alias("s")).first().s or 0
        return max(self.spark.sparkContext.defaultParallelism, -(-size // DEALT))

    @property
    def cds(self) -> DataFrame:
        """Sequences dealt by gene, in partitions of bounded size. Texts are shuffled once, as they are; counts, cells and positions of a gene, which are
        many times larger, then need no shuffle to be grouped, and no task holds more than a partition's."""
        return sequences.from_documents(self.read("documents").select("doc_id", "text", "lang", "n_chars").repartition(self.parts, "doc_id"))

    @property
    def rows(self) -> DataFrame:
        """cds for work row by row, or for sums without genes: files lie as they are, if they are as many as cores."""
        return sequences.from_documents(spread(self.read("documents").select("doc_id", "text", "lang", "n_chars"), "doc_id"))

    def members(self, chosen: DataFrame) -> DataFrame:
        """cds of a set alone, chosen before texts are dealt, so that the others are neither cut into codons nor shuffled for it. A set of at most
        SENT ids, which is counted, goes to the texts; a larger one meets them by a shuffle of both."""
        docs, ids = self.read("documents").select("doc_id", "text", "lang", "n_chars"), chosen.withColumnRenamed("gene", "doc_id")
        side = F.broadcast(ids) if ids.count() <= SENT else ids
        return sequences.from_documents(spread(docs.join(side, "doc_id", "left_semi"), "doc_id"))

    def rated(self, quality: int) -> DataFrame:
        """The genes of a set: each id once."""
        return self.read("labels").where(F.col("quality") == quality).select(F.col("doc_id").alias("gene")).distinct()

    @property
    def set_a(self) -> DataFrame:
        return self.rated(1)

    @property
    def set_b(self) -> DataFrame:
        return self.rated(0)

    @property
    def symbols(self) -> DataFrame:
        return dims.symbols(self.spark)

    @property
    def rules(self) -> DataFrame:
        return weights.with_copies(dims.wobble_rules(self.spark), dims.trna_copies(self.spark))

    @property
    def tai(self) -> DataFrame:
        return weights.tai_weights(self.rules)

    def tai_of(self, species: str) -> DataFrame:
        return weights.tai_weights(weights.with_copies(dims.wobble_rules(self.spark, species), dims.trna_copies(self.spark, species)))

    def fast_of(self, species: str) -> list[str]:
        return upper_half(self.tai_of(species))

    @cached_property
    def expression(self) -> DataFrame:
        """Abundances, written once as a row for each gene: their total and what joins them need the lengths of all texts several times."""
        return shared.written(weights.tpm(shared.written(self.rows.select("gene", F.col("n_chars").alias("count"), F.length("seq").alias("length")), "lengths")), "expression")

    @property
    def fast(self) -> list[str]:
        return upper_half(self.tai)


def upper_half(tai: DataFrame) -> list[str]:
    """Codons whose wobble-adjusted weight is at least the median: at most 61 of them."""
    w = sorted((r.wtai, r.codon) for r in tai.collect())
    n = len(w)
    middle = (w[(n - 1) // 2][0] + w[n // 2][0]) / 2
    return [c for x, c in w if x >= middle]


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, dealt by its key if it has fewer files than there are cores. What groups by the key later then needs no other shuffle;
    a table of many files is left as it lies, and counts are combined before their shuffle instead."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def r6(x: Column | str) -> Column:
    """Six digits, without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def query(sql: str | None = None):
    """Registers a function of Tables under its name, and its SQL; {name} in the SQL stands for a shared part."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[f.__name__] = assembled(sql)
        return f

    return add


#: Parts that others name several times: derived once.
OFTEN = {"cds", "codons", "nxt", "k1", "k2", "k3", "f1", "f2", "f3", "cc", "dense", "rscu", "aaf", "tai", "fast", "expr", "trans", "stats", "track", "smooth", "pfreq", "pz", "comp1", "comp2", "bhcomp1", "bhaa", "bhrscu", "corrs", "rpairs", "drv", "cai"}


def assembled(sql: str) -> str:
    """sql behind a WITH clause of the shared parts that it names, directly or through others."""
    need: dict[str, str] = {}

    def visit(text: str) -> str:
        for name in re.findall(r"\{(\w+)\}", text):
            if name not in need:
                body = visit(PARTS[name])
                need[name] = body
        return re.sub(r"\{(\w+)\}", r"\1", text)

    main = visit(sql)
    if need and main.startswith("WITH "):
        main = ", " + main[5:]
    return ("WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in OFTEN else ''}({b})" for n, b in need.items()) + "\n" if need else "") + main


def _values(rows: list[tuple], names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + f") AS v({names})"


_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SENSE = "NOT regexp_matches(kmer, '^(...)*(TAA|TAG|TGA)')"
_SD = "sqrt(greatest((sum(freq * freq) - sum(freq) * sum(freq) / n) / (n - 1), 0))"

#: Two-sided normal tail from the series of the error function, clamped where it is zero to nine digits.
P_SQL = "greatest(0, 1 - exp(-x * x) * list_sum(list_transform(range(0, 160), lambda i: exp((2 * i + 1) * ln(x) - lgamma(i + 1.5)))))"


def tested(source: str, key: str) -> str:
    """SQL of source (key, z_score, ...) with p and adjusted_p, Benjamini-Hochberg."""
    p = f"SELECT *, {P_SQL} AS p FROM (SELECT *, greatest(1e-12, least(6.5, abs(z_score) / sqrt(2))) AS x FROM {source})"
    return f"SELECT *, least(1, min(p * bh_n / bh_k) OVER (ORDER BY bh_k DESC ROWS UNBOUNDED PRECEDING)) AS adjusted_p FROM (SELECT *, row_number() OVER (ORDER BY p, {key}) AS bh_k, count(*) OVER () AS bh_n FROM ({p}))"


PARTS: dict[str, str] = {
    "cds": f"SELECT doc_id AS gene, substr(s, 1, (length(s) // 3) * 3) AS seq, lang, n_chars FROM (SELECT doc_id, lang, n_chars, translate(regexp_replace(coalesce(text, ''), '[^a-zA-Z]', '', 'g'), '{_LETTERS}', '{('ACGT' * 13)[:52]}') AS s FROM documents)",
    "ca": "SELECT gene, regexp_extract_all(seq, '...') AS c FROM {cds}",
    "codons": "SELECT gene, len(c) AS n, unnest(c) AS codon, unnest(range(len(c))) AS pos FROM {ca}",
    "nxt": "SELECT gene, n, pos, codon, lead(codon) OVER (PARTITION BY gene ORDER BY pos) AS c2, lead(codon, 2) OVER (PARTITION BY gene ORDER BY pos) AS c3 FROM {codons}",
    "ng": "SELECT count(*) AS n FROM {cds}",
    "seta": "SELECT DISTINCT doc_id AS gene FROM labels WHERE quality = 1",
    "setb": "SELECT DISTINCT doc_id AS gene FROM labels WHERE quality = 0",
    "na": "SELECT count(*) AS m FROM {cds} JOIN {seta} USING (gene)",
    "nb": "SELECT count(*) AS m FROM {cds} JOIN {setb} USING (gene)",
    "sym": _values([(c, dims.FAMILY[c], dims.SYNONYMS[c]) for c in sorted(dims.FAMILY)], "codon, aa, n_syn"),
    "rules0": _values(dims.rules(), "codon, aa, anticodon, decoding_type"),
    "copies": _values(dims.copies(), "anticodon, copies"),
    "rules": "SELECT r.codon, r.aa, r.anticodon, r.decoding_type, coalesce(c.copies, 0) AS copies FROM {rules0} r LEFT JOIN {copies} c ON r.anticodon = c.anticodon",
    "pen": "SELECT *, copies * CASE WHEN decoding_type = 'wobble' THEN 0.5 ELSE 1.0 END::DOUBLE AS p FROM {rules}",
    "tai": "SELECT codon, CASE WHEN copies > 0 THEN copies / mc::DOUBLE ELSE 0.5 / mc END::DOUBLE AS tai, CASE WHEN p > 0 THEN p / mp ELSE 0.5 / mp END::DOUBLE AS wtai FROM {pen}, (SELECT max(copies)::DOUBLE AS mc, max(p)::DOUBLE AS mp FROM {pen})",
    "fast": "SELECT codon FROM {tai} WHERE wtai >= (SELECT median(wtai) FROM {tai})",
    "k1": "SELECT gene, codon AS kmer, count(*) AS cnt FROM {codons} GROUP BY ALL",
    "k2": "SELECT gene, codon || c2 AS kmer, count(*) AS cnt FROM {nxt} WHERE c2 IS NOT NULL GROUP BY ALL",
    "k3": "SELECT gene, codon || c2 || c3 AS kmer, count(*) AS cnt FROM {nxt} WHERE c3 IS NOT NULL GROUP BY ALL",
    "expr": "SELECT gene, rpk / sum(rpk) OVER () * 1e6 AS tpm FROM (SELECT gene, n_chars / (length(seq) / 1000.0) AS rpk FROM {cds} WHERE length(seq) > 0)",
    "cc": "SELECT gene, codon, aa, n_syn, cnt FROM {k1} JOIN {sym} ON kmer = codon",
    "aaf": "SELECT gene, aa, cnt / sum(cnt) OVER (PARTITION BY gene) AS freq FROM (SELECT gene, aa, sum(cnt)::DOUBLE AS cnt FROM {cc} GROUP BY ALL)",
    "rscu": "SELECT gene, codon, aa, n_syn * cnt / sum(cnt) OVER (PARTITION BY gene, aa) AS freq FROM {cc}",
    "dense": "SELECT f.gene, s.codon, f.aa, s.n_syn * coalesce(c.cnt, 0) / f.total AS rscu FROM (SELECT gene, aa, sum(cnt)::DOUBLE AS total FROM {cc} WHERE n_syn > 1 GROUP BY ALL) f JOIN {sym} s ON s.aa = f.aa JOIN {cds} d ON d.gene = f.gene LEFT JOIN {cc} c ON c.gene = f.gene AND c.codon = s.codon WHERE length(d.seq) >= 30",
    "w": "SELECT gene, coalesce(tpm, 0) * length(seq) / 3 AS w, length(seq) AS len FROM {cds} LEFT JOIN {expr} USING (gene)",
    "trans": "SELECT gene, count(*) FILTER (WHERE a AND b) AS ff, count(*) FILTER (WHERE a AND NOT b) AS fs, count(*) FILTER (WHERE NOT a AND b) AS sf, count(*) FILTER (WHERE NOT a AND NOT b) AS ss FROM (SELECT gene, codon IN (SELECT codon FROM {fast}) AS a, c2 IN (SELECT codon FROM {fast}) AS b FROM {nxt} WHERE c2 IS NOT NULL) GROUP BY gene",
    "stats": "SELECT gene, length(seq) AS len, CASE WHEN length(seq) > 0 THEN length(translate(seq, 'AT', '')) / length(seq) ELSE 0.0 END::DOUBLE AS gc, CASE WHEN length(seq) > 0 THEN length(translate(regexp_replace(seq, '..(.)', '\\1', 'g'), 'AT', '')) / (length(seq) / 3) ELSE 0.0 END::DOUBLE AS gc3 FROM {cds}",
    "track": "SELECT gene, pos, n, coalesce(wtai, 0) AS score FROM {codons} LEFT JOIN {tai} USING (codon)",
    "smooth": "SELECT gene, pos, n, sum(score) OVER (PARTITION BY gene ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10 AS smooth FROM {track}",
    "pfreq": "SELECT gene, bin, codon, cnt / sum(cnt) OVER (PARTITION BY gene, bin) AS freq FROM (SELECT gene, least(floor(pos / n * 100), 99)::INT AS bin, codon, count(*)::DOUBLE AS cnt FROM {codons} SEMI JOIN {sym} USING (codon) GROUP BY ALL)",
    "geom": "SELECT gene, coalesce(exp(sum(cnt * ln(wtai)) / sum(cnt) FILTER (WHERE wtai IS NOT NULL)), 0) AS v FROM {cc} LEFT JOIN {tai} USING (codon) GROUP BY gene",
    "ords": "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events",
    "li": "SELECT l_suppkey AS gene, l_returnflag AS aa, l_linestatus AS codon, count(*) AS cnt FROM lineitem GROUP BY ALL",
}
for _s in ("human", "mouse"):  # the same parts by the rules and copies of another species
    PARTS |= {f"rules0_{_s}": _values(dims.rules(_s), "codon, aa, anticodon, decoding_type"), f"copies_{_s}": _values(dims.copies(_s), "anticodon, copies")}
    for _n in ("rules", "pen", "tai", "fast", "geom", "trans"):
        PARTS[f"{_n}_{_s}"] = re.sub(r"\{(rules0|copies|rules|pen|tai|fast)\}", rf"{{\1_{_s}}}", PARTS[_n])
    OFTEN |= {f"tai_{_s}", f"fast_{_s}"}
for _k in (1, 2, 3):
    PARTS[f"f{_k}"] = f"SELECT gene, kmer, cnt / (length(seq) / 3 - {_k - 1}) AS freq FROM {{k{_k}}} JOIN {{cds}} USING (gene) WHERE {_SENSE}"
    PARTS[f"bg{_k}"] = f"SELECT kmer, sum(freq) / n AS mean, {_SD} AS sd FROM {{f{_k}}}, {{ng}} GROUP BY kmer, n"
    PARTS[f"gm{_k}"] = f"SELECT kmer, sum(freq) / m AS observed FROM {{f{_k}}} JOIN {{seta}} USING (gene), {{na}} GROUP BY kmer, m"
    PARTS[f"comp{_k}"] = f"SELECT kmer, coalesce(observed, 0) AS observed, mean AS expected, m AS n_set, CASE WHEN sd > 0 THEN (coalesce(observed, 0) - mean) / (sd / sqrt(m)) ELSE 0 END AS z_score, CASE WHEN sd > 0 THEN (coalesce(observed, 0) - mean) / sd ELSE 0 END AS cohens_d FROM {{bg{_k}}} LEFT JOIN {{gm{_k}}} USING (kmer), {{na}}"
for _n, _src, _key in (("aadev", "aaf", "aa"), ("rdev", "rscu", "codon")):
    PARTS[_n] = f"SELECT {_key}, t / m AS observed, s / n AS expected, sd, CASE WHEN sd > 1e-12 THEN (t / m - s / n) / (sd / sqrt(m)) ELSE 0 END AS z_score FROM (SELECT {_key}, n, m, sum(freq) AS s, coalesce(sum(freq) FILTER (WHERE a.gene IS NOT NULL), 0) AS t, {_SD} AS sd FROM {{{_src}}} v LEFT JOIN {{seta}} a ON a.gene = v.gene, {{ng}}, {{na}} GROUP BY {_key}, n, m)"
PARTS |= {
    "bhcomp1": tested("{comp1}", "kmer"),
    "bhcomp2": tested("{comp2}", "kmer"),
    "bhaa": tested("{aadev}", "aa"),
    "bhrscu": tested("{rdev}", "codon"),
    "attr": "SELECT r.codon, s.aa, coalesce(a.z_score, 0) AS aa_z, r.z_score AS rscu_z, coalesce(a.adjusted_p, 1) AS aa_p, r.adjusted_p AS rscu_p, CASE WHEN coalesce(a.adjusted_p, 1) < 0.05 AND r.adjusted_p < 0.05 THEN 'Both' WHEN a.adjusted_p < 0.05 THEN 'AA-driven' WHEN r.adjusted_p < 0.05 THEN 'Synonymous-driven' ELSE 'None' END AS attribution FROM {bhrscu} r JOIN {sym} s ON s.codon = r.codon LEFT JOIN {bhaa} a ON a.aa = s.aa",
    "pz": "SELECT bin, codon, t / m AS observed, s / n AS expected, CASE WHEN sd > 1e-12 THEN (t / m - s / n) / (sd / sqrt(m)) ELSE 0 END AS z_score FROM (SELECT bin, codon, n, m, sum(freq) AS s, coalesce(sum(freq) FILTER (WHERE a.gene IS NOT NULL), 0) AS t, sqrt(greatest((sum(freq * freq) - sum(freq) * sum(freq) / n) / (n - 1), 0)) AS sd FROM {pfreq} v LEFT JOIN {seta} a ON a.gene = v.gene, {ng}, {na} GROUP BY bin, codon, n, m)",
    "tz": "SELECT gene, avg(z) AS mean_z, min(z) AS min_z, max(z) AS max_z, sum(freq) AS sum_freq FROM (SELECT c.gene, coalesce(freq, 0) AS freq, (coalesce(freq, 0) - mean) / sd AS z FROM {cds} c CROSS JOIN (SELECT * FROM {bg1} WHERE kmer IN ('GAA', 'AGA') AND sd > 0) b LEFT JOIN {f1} f USING (gene, kmer)) GROUP BY gene",
    "drv": "SELECT kmer, gene, freq, contribution, size, row_number() OVER (PARTITION BY kmer ORDER BY round(CASE WHEN up THEN -contribution ELSE contribution END, 15), gene) AS rank, row_number() OVER (PARTITION BY kmer ORDER BY size DESC, gene) AS by_size, sum(size) OVER (PARTITION BY kmer ORDER BY size DESC, gene ROWS UNBOUNDED PRECEDING) / sum(size) OVER (PARTITION BY kmer) AS cum FROM (SELECT kmer, gene, freq, freq - mean AS contribution, round(abs(freq - mean), 15) AS size, avg(freq) OVER (PARTITION BY kmer) > mean AS up FROM (SELECT g.kmer, g.gene, coalesce(freq, 0) AS freq, mean FROM (SELECT gene, unnest(['GAA', 'AGA', 'CTG']) AS kmer FROM {cds} SEMI JOIN {seta} USING (gene)) g LEFT JOIN {f1} f USING (gene, kmer) JOIN {bg1} b USING (kmer)))",
}
