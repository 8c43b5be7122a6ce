"""Queries over the driver's tables: composition, families, weights, order, tests, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqfold.functions import stats
from seqfold.operators import frequency, ordered, resample, sequences, weights
from seqfold.plans.registry import P_SQL, PARTS, Tables, query, r6
from seqfold.sources import shared

R = "round({}, 6) + 0.0"


@query("SELECT gene, length(seq) AS length, round(gc, 6) + 0.0 AS gc FROM {cds} JOIN {stats} USING (gene)")
def gc_content(t: Tables) -> DataFrame:
    return t.rows.select("gene", F.length("seq").cast("long").alias("length"), r6(sequences.gc(F.col("seq"))).alias("gc"))


@query("SELECT gene, round(gc3, 6) + 0.0 AS gc3 FROM {stats}")
def gc3(t: Tables) -> DataFrame:
    return t.rows.select("gene", r6(sequences.gc3(F.col("seq"))).alias("gc3"))


@query("SELECT gene, coalesce(regexp_matches(s, '^ATG') AND regexp_matches(s, '(TAA|TAG|TGA)$') AND length(s) % 3 = 0 AND len(list_filter(regexp_extract_all(substr(s, 1, length(s) - 3), '...'), lambda c: c IN ('TAA', 'TAG', 'TGA'))) = 0, false) AS valid FROM (SELECT gene, 'ATG' || seq || 'TAA' AS s FROM {cds})")
def cds_validate(t: Tables) -> DataFrame:
    framed = t.rows.select("gene", F.concat(F.lit("ATG"), "seq", F.lit("TAA")).alias("seq"))
    return sequences.validated(framed).select("gene", "valid")


@query("SELECT gene, least(length(seq), 150) // 3 AS n_ramp, greatest(length(seq) - 150, 0) // 3 AS n_body FROM {cds} WHERE length(seq) >= 3")
def region_slice(t: Tables) -> DataFrame:
    ramp = sequences.region(t.cds, 0, 50).select("gene", (F.length("seq") / 3).cast("long").alias("n_ramp"))
    body = sequences.region(t.cds, 50, None).select("gene", (F.length("seq") / 3).cast("long").alias("n_body"))
    return ramp.join(body, "gene", "left").select("gene", "n_ramp", F.coalesce("n_body", F.lit(0).cast("long")).alias("n_body"))


@query("SELECT gene, kmer, cnt FROM {k1}")
def kmer_count_1(t: Tables) -> DataFrame:
    return sequences.kmer_counts(t.cds, 1)


@query("SELECT gene, kmer, cnt FROM {k2}")
def kmer_count_2(t: Tables) -> DataFrame:
    return sequences.kmer_counts(t.cds, 2)


@query("SELECT gene, kmer, cnt FROM {k3}")
def kmer_count_3(t: Tables) -> DataFrame:
    return sequences.kmer_counts(t.cds, 3)


@query("SELECT gene, kmer, round(freq, 9) AS freq FROM {f1}")
def kmer_freq(t: Tables) -> DataFrame:
    return sequences.kmer_freq(t.cds, 1).withColumn("freq", F.round("freq", 9))


@query("SELECT kmer, round(sum(cnt / (length(seq) / 3 - 50)) / m, 6) + 0.0 AS observed FROM (SELECT gene, codon AS kmer, count(*) AS cnt FROM {codons} WHERE pos >= 50 GROUP BY ALL) JOIN {cds} USING (gene) SEMI JOIN {seta} USING (gene), {na} WHERE NOT regexp_matches(kmer, '^(TAA|TAG|TGA)') GROUP BY kmer, m")
def kmer_freq_trim(t: Tables) -> DataFrame:
    inside = frequency.members(sequences.trimmed(t.cds, 50), t.set_a)
    return frequency.geneset_mean(inside, 1).withColumn("observed", r6("observed"))


@query(f"SELECT kmer, {R.format('observed')} AS observed FROM {{gm1}}")
def geneset_mean(t: Tables) -> DataFrame:
    return frequency.geneset_mean(frequency.members(t.cds, t.set_a), 1).withColumn("observed", r6("observed"))


@query(f"SELECT kmer, {R.format('mean')} AS mean, {R.format('sd')} AS sd FROM {{bg1}}")
def background_stats(t: Tables) -> DataFrame:
    return frequency.background(t.cds, 1).select("kmer", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query("SELECT kmer, round(mean, 9) AS mean, round(sd, 7) AS sd FROM {bg3}")
def background_stats_k3(t: Tables) -> DataFrame:
    return frequency.background(t.cds, 3).select("kmer", F.round("mean", 9).alias("mean"), F.round("sd", 7).alias("sd"))


def _composition(t: Tables, k: int) -> DataFrame:
    c = frequency.composition(t.cds, t.set_a, k)
    return c.select("kmer", r6("observed").alias("observed"), r6("expected").alias("expected"), F.round("z_score", 4).alias("z_score"))


_COMP = "SELECT kmer, round(observed, 6) + 0.0 AS observed, round(expected, 6) + 0.0 AS expected, round(z_score, 4) AS z_score FROM "


@query(_COMP + "{comp1}")
def analytic_z(t: Tables) -> DataFrame:
    return _composition(t, 1)


@query(_COMP + "{comp2}")
def composition_k2(t: Tables) -> DataFrame:
    return _composition(t, 2)


@query(_COMP + "{comp3}")
def composition_k3(t: Tables) -> DataFrame:
    return _composition(t, 3)


@query("SELECT kmer, round(cohens_d, 5) + 0.0 AS cohens_d FROM {comp1}")
def cohens_d(t: Tables) -> DataFrame:
    return frequency.composition(t.cds, t.set_a, 1).select("kmer", (F.round("cohens_d", 5) + 0.0).alias("cohens_d"))


@query(f"SELECT kmer, round(z_score, 4) AS z_score, round({P_SQL}, 6) AS p_value FROM (SELECT *, greatest(1e-12, least(6.5, abs(z_score) / sqrt(2))) AS x FROM {{comp1}})")
def normal_p(t: Tables) -> DataFrame:
    c = frequency.composition(t.cds, t.set_a, 1)
    return c.select("kmer", F.round("z_score", 4).alias("z_score"), F.round(stats.normal_p("z_score"), 6).alias("p_value"))


@query("SELECT kmer, round(adjusted_p, 6) AS adjusted_p FROM {bhcomp1}")
def bh_adjust(t: Tables) -> DataFrame:
    return _tested(frequency.composition(t.cds, t.set_a, 1), "kmer").select("kmer", F.round("adjusted_p", 6).alias("adjusted_p"))


def _tested(scored: DataFrame, key: str) -> DataFrame:
    return stats.bh(scored.withColumn("p_value", stats.normal_p("z_score")), "p_value", key)


@query("SELECT kmer, aa, round(observed, 6) + 0.0 AS observed, round(expected, 6) + 0.0 AS expected, round(z_score, 4) + 0.0 AS z_score, round(p, 6) AS p_value, round(adjusted_p, 6) AS adjusted_p, round(cohens_d, 5) + 0.0 AS cohens_d FROM {bhcomp1} JOIN {sym} ON codon = kmer")
def enrichment(t: Tables) -> DataFrame:
    """The flagship: a set's composition against all, with tests adjusted and families named."""
    named = _tested(frequency.composition(t.cds, t.set_a, 1), "kmer").join(F.broadcast(t.symbols.withColumnRenamed("codon", "kmer")), "kmer")
    shown = named.orderBy(F.abs("z_score").desc(), "kmer")
    return shown.select("kmer", "aa", r6("observed").alias("observed"), r6("expected").alias("expected"), (F.round("z_score", 4) + 0.0).alias("z_score"), F.round("p_value", 6).alias("p_value"), F.round("adjusted_p", 6).alias("adjusted_p"), (F.round("cohens_d", 5) + 0.0).alias("cohens_d"))


@query(f"""SELECT gene, round(freq, 9) AS freq, aa FROM {{aaf}}""")
def aa_freq(t: Tables) -> DataFrame:
    return frequency.aa_freq(frequency.codon_counts(t.cds, t.symbols)).withColumn("freq", F.round("freq", 9))


@query("SELECT gene, codon, aa, round(freq, 6) AS rscu FROM {rscu}")
def rscu(t: Tables) -> DataFrame:
    return frequency.rscu(frequency.codon_counts(t.cds, t.symbols)).withColumn("rscu", F.round("rscu", 6))


@query("SELECT gene, codon, aa, round(rscu, 6) + 0.0 AS rscu FROM {dense}")
def rscu_nullable(t: Tables) -> DataFrame:
    return frequency.rscu_dense(t.cds, frequency.codon_counts(t.cds, t.symbols), t.symbols).withColumn("rscu", r6("rscu"))


def _sizes(t: Tables) -> DataFrame:
    n = t.cds.agg(F.count("*").alias("n"))
    return n.join(F.broadcast(frequency.members(t.cds, t.set_a).agg(F.count("*").alias("n_set"))))


def _layers(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Tested deviations of families and of synonymous usage."""
    counts = frequency.codon_counts(t.cds, t.symbols)
    aa = frequency.deviation(frequency.aa_freq(counts), "aa", "freq", t.set_a, _sizes(t))
    codon = frequency.deviation(frequency.rscu(counts), "codon", "rscu", t.set_a, _sizes(t))
    return _tested(aa, "aa"), _tested(codon, "codon").join(F.broadcast(t.symbols), "codon")


@query("SELECT aa, round(observed, 6) + 0.0 AS observed, round(expected, 6) + 0.0 AS expected, round(z_score, 4) + 0.0 AS z_score FROM {aadev}")
def aa_deviation(t: Tables) -> DataFrame:
    return _layers(t)[0].select("aa", r6("observed").alias("observed"), r6("expected").alias("expected"), (F.round("z_score", 4) + 0.0).alias("z_score"))


@query("SELECT codon, aa, round(aa_z, 4) + 0.0 AS aa_z, round(rscu_z, 4) + 0.0 AS rscu_z, attribution FROM {attr}")
def attribution(t: Tables) -> DataFrame:
    a = frequency.attribution(*_layers(t))
    return a.select("codon", "aa", (F.round("aa_z", 4) + 0.0).alias("aa_z"), (F.round("rscu_z", 4) + 0.0).alias("rscu_z"), "attribution")


_KINDS = (("aa_driven", "AA-driven"), ("synonymous_driven", "Synonymous-driven"), ("both", "Both"))
_N = "count(*) FILTER (WHERE attribution <> 'None')"


@query(f"SELECT {_N} AS n_significant, " + ", ".join(f"count(*) FILTER (WHERE attribution = '{v}') AS n_{k}, round(CASE WHEN {_N} > 0 THEN 100.0 * count(*) FILTER (WHERE attribution = '{v}') / {_N} ELSE 0 END::DOUBLE, 4) AS pct_{k}" for k, v in _KINDS) + " FROM {attr}")
def attribution_summary(t: Tables) -> DataFrame:
    s = frequency.attribution_summary(frequency.attribution(*_layers(t)))
    return s.select([F.round(c, 4).alias(c) if c.startswith("pct_") else F.col(c) for c in s.columns])


@query("SELECT codon, aa, round(z_score, 4) + 0.0 AS rscu_z, CASE WHEN n_syn <= 1 THEN 'not_applicable' WHEN z_score > 0 AND decoding_type = 'watson_crick' AND copies > 0 THEN 'wobble_avoidance' WHEN z_score > 0 AND copies > 5 THEN 'tRNA_supply' WHEN (z_score > 0) = (substr(codon, 3, 1) IN ('G', 'C')) THEN 'GC3_bias' ELSE 'unclassified' END AS driver FROM {bhrscu} JOIN {sym} USING (codon) JOIN (SELECT codon, decoding_type, copies FROM {rules}) USING (codon) WHERE adjusted_p < 0.05")
def synonymous_drivers(t: Tables) -> DataFrame:
    d = frequency.synonymous_drivers(_layers(t)[1], t.rules)
    return d.select("codon", "aa", (F.round("rscu_z", 4) + 0.0).alias("rscu_z"), "driver")


@query("SELECT codon, aa, anticodon, decoding_type, copies, cnt FROM {rules} JOIN (SELECT kmer, sum(cnt)::BIGINT AS cnt FROM {k1} GROUP BY kmer) ON kmer = codon")
def wobble_join(t: Tables) -> DataFrame:
    """How each codon that occurs is read, and how often it occurs."""
    used = sequences.kmer_totals(t.rows, 1).select(F.col("kmer").alias("codon"), F.col("n").alias("cnt"))
    return used.join(F.broadcast(t.rules), "codon").select("codon", "aa", "anticodon", "decoding_type", "copies", "cnt")


@query("SELECT codon, sum(cnt)::BIGINT AS cnt, round(tai, 6) AS tai, round(wtai, 6) AS wtai FROM {k1} JOIN {tai} ON codon = kmer GROUP BY codon, tai, wtai")
def tai_weights(t: Tables) -> DataFrame:
    """The weights of the codons that occur, and how often they do."""
    used = sequences.kmer_totals(t.rows, 1).select(F.col("kmer").alias("codon"), F.col("n").alias("cnt"))
    return used.join(F.broadcast(t.tai), "codon").select("codon", "cnt", F.round("tai", 6).alias("tai"), F.round("wtai", 6).alias("wtai"))


@query("SELECT gene, round(v, 6) + 0.0 AS wtai FROM {geom}")
def gene_tai(t: Tables) -> DataFrame:
    return weights.geometric(frequency.codon_counts(t.cds, t.symbols), t.tai, "wtai", "wtai").withColumn("wtai", r6("wtai"))


def _by_species(species: str) -> None:
    """The optimality of genes and their transitions by the rules and copies of a species."""

    def gene_tai_of(t: Tables) -> DataFrame:
        return weights.geometric(frequency.codon_counts(t.cds, t.symbols), t.tai_of(species), "wtai", "wtai").withColumn("wtai", r6("wtai"))

    def transitions_of(t: Tables) -> DataFrame:
        return ordered.pair_counts(t.rows, t.fast_of(species))

    def used_weights_of(t: Tables) -> DataFrame:
        used = sequences.kmer_totals(t.rows, 1).select(F.col("kmer").alias("codon"), F.col("n").alias("cnt"))
        return used.join(F.broadcast(t.tai_of(species)), "codon").select("codon", "cnt", F.round("tai", 6).alias("tai"), F.round("wtai", 6).alias("wtai"))

    gene_tai_of.__name__, transitions_of.__name__, used_weights_of.__name__ = f"gene_tai_{species}", f"transitions_{species}", f"used_weights_{species}"
    query(f"SELECT gene, round(v, 6) + 0.0 AS wtai FROM {{geom_{species}}}")(gene_tai_of)
    query(f"SELECT gene, ff, fs, sf, ss FROM {{trans_{species}}}")(transitions_of)
    query(f"SELECT codon, sum(cnt)::BIGINT AS cnt, round(tai, 6) AS tai, round(wtai, 6) AS wtai FROM {{k1}} JOIN {{tai_{species}}} ON codon = kmer GROUP BY codon, tai, wtai")(used_weights_of)


for _species in ("human", "mouse"):
    _by_species(_species)


_CAIW = "SELECT codon, aa, CASE WHEN n_syn = 1 THEN 1.0 ELSE greatest(cnt / max(cnt) OVER (PARTITION BY aa), 0.01) END::DOUBLE AS weight FROM (SELECT codon, aa, n_syn, sum(cnt)::DOUBLE AS cnt FROM {cc} SEMI JOIN (SELECT gene FROM (SELECT gene, row_number() OVER (ORDER BY tpm DESC, gene) AS k, count(*) OVER () AS n FROM {expr}) WHERE k <= greatest(10, floor(n * 0.05))) USING (gene) GROUP BY ALL)"


@query(f"SELECT codon, aa, round(weight, 6) AS weight FROM ({_CAIW})")
def cai_weights(t: Tables) -> DataFrame:
    return weights.cai_weights(frequency.codon_counts(t.cds, t.symbols), t.expression).withColumn("weight", F.round("weight", 6))


_CAI = f"SELECT gene, coalesce(exp(sum(cnt * ln(weight)) / sum(cnt) FILTER (WHERE weight IS NOT NULL)), 0) AS cai FROM {{cc}} LEFT JOIN ({_CAIW}) USING (codon) WHERE n_syn > 1 GROUP BY gene"


def _cai(t: Tables) -> DataFrame:
    counts = frequency.codon_counts(t.cds, t.symbols)
    return weights.geometric(counts.where("n_syn > 1"), weights.cai_weights(counts, t.expression), "weight", "cai")


PARTS["cai"] = _CAI


@query("SELECT gene, round(cai, 6) + 0.0 AS cai FROM {cai}")
def cai(t: Tables) -> DataFrame:
    return _cai(t).withColumn("cai", r6("cai"))


@query("WITH x AS (SELECT * FROM {cai}), s AS (SELECT avg(cai) AS mean, median(cai) AS median FROM x SEMI JOIN {seta} USING (gene)) SELECT round(mean, 6) AS mean, round(median, 6) AS median, round(100 * avg(CASE WHEN cai <= mean THEN 1.0 ELSE 0.0 END), 4) AS percentile FROM x, s GROUP BY mean, median")
def cai_summary(t: Tables) -> DataFrame:
    scores = _cai(t)
    s = scores.join(t.set_a, "gene", "left_semi").agg(F.avg("cai").alias("mean"), F.median("cai").alias("median"))
    return scores.join(F.broadcast(s)).groupBy("mean", "median").agg(F.round(100 * F.avg((F.col("cai") <= F.col("mean")).cast("double")), 4).alias("percentile")).select(F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "percentile")


@query("SELECT gene, round(tpm, 6) AS tpm FROM {expr}")
def counts_to_tpm(t: Tables) -> DataFrame:
    return t.expression.withColumn("tpm", F.round("tpm", 6))


_DEM = "SELECT kmer, round(sum(w * freq) / total, 6) + 0.0 AS demand FROM {f1} JOIN %s USING (gene), (SELECT sum(w) AS total FROM %s) GROUP BY kmer, total"


@query(_DEM % (("(SELECT * FROM {w} WHERE w > 0)",) * 2))
def demand_vector(t: Tables) -> DataFrame:
    return weights.demand(t.cds, t.expression).withColumn("demand", r6("demand"))


@query(_DEM % (("(SELECT * FROM {w} WHERE w > 0 ORDER BY w DESC, gene LIMIT 100)",) * 2))
def demand_topn(t: Tables) -> DataFrame:
    return weights.demand(t.cds, t.expression, top=100).withColumn("demand", r6("demand"))


@query("SELECT gene, round(w, 5) AS weight, round(w / sum(w) OVER (), 9) AS share FROM {w}")
def demand_rank(t: Tables) -> DataFrame:
    return weights.demand_rank(t.cds, t.expression).select("gene", F.round("weight", 5).alias("weight"), F.round("share", 9).alias("share"))


@query("SELECT gene, len, round(gc, 9) AS gc FROM {stats}, (SELECT min(len) * 0.8 AS l0, max(len) * 1.2 AS l1, min(gc) - 0.05 AS g0, max(gc) + 0.05 AS g1 FROM {stats} SEMI JOIN {setb} USING (gene)) WHERE len BETWEEN l0 AND l1 AND gc BETWEEN g0 AND g1")
def matched_background(t: Tables) -> DataFrame:
    s = t.rows.select("gene", F.length("seq").cast("long").alias("len"), sequences.gc(F.col("seq")).alias("gc"))
    return frequency.matched_pool(s, t.set_b).withColumn("gc", F.round("gc", 9))


@query("SELECT gene, ff, fs, sf, ss FROM {trans}")
def transitions(t: Tables) -> DataFrame:
    return ordered.pair_counts(t.rows, t.fast)


_PROP = "SELECT sum(ff + fs + sf + ss) AS total, sum(ff) / sum(ff + fs + sf + ss) AS ff, sum(fs) / sum(ff + fs + sf + ss) AS fs, sum(sf) / sum(ff + fs + sf + ss) AS sf, sum(ss) / sum(ff + fs + sf + ss) AS ss FROM {trans}"


_CHI = "a.total * ((a.ff - b.ff) ** 2 / b.ff + (a.fs - b.fs) ** 2 / b.fs + (a.sf - b.sf) ** 2 / b.sf + (a.ss - b.ss) ** 2 / b.ss)"


@query(f"SELECT round(fs_enrichment, 6) AS fs_enrichment, round(fs_sf_set, 6) AS fs_sf_set, round(fs_sf_all, 6) AS fs_sf_all, round(f1, 6) AS fold_ff, round(f2, 6) AS fold_fs, round(f3, 6) AS fold_sf, round(f4, 6) AS fold_ss, round(chi2, 4) AS chi2, round({P_SQL} + sqrt(2 * chi2 / pi()) * exp(-chi2 / 2), 6) AS p_value FROM (SELECT *, least(6.5, sqrt(chi2 / 2)) AS x FROM (SELECT a.fs / b.fs AS fs_enrichment, a.fs / a.sf AS fs_sf_set, b.fs / b.sf AS fs_sf_all, a.ff / b.ff AS f1, a.fs / b.fs AS f2, a.sf / b.sf AS f3, a.ss / b.ss AS f4, {_CHI} AS chi2 FROM ({_PROP} SEMI JOIN {{seta}} USING (gene)) a, ({_PROP}) b))")
def transition_ratios(t: Tables) -> DataFrame:
    counts = ordered.pair_counts(t.rows, t.fast)
    c = ordered.compared(frequency.members(counts, t.set_a), counts)
    return c.select([F.round(x, 4 if x == "chi2" else 6).alias(x) for x in c.columns if x != "df"])


@query("SELECT gene, round(fs / (ff + fs + sf + ss), 6) + 0.0 AS fs_share FROM {trans}")
def per_gene_fs(t: Tables) -> DataFrame:
    return ordered.pair_counts(t.rows, t.fast).select("gene", r6(F.expr("fs / (ff + fs + sf + ss)")).alias("fs_share"))


@query("SELECT least(pos * 10 // (n - 1), 9)::INT AS bin, count(*) AS n FROM {nxt} WHERE c2 IS NOT NULL AND codon IN (SELECT codon FROM {fast}) AND c2 NOT IN (SELECT codon FROM {fast}) GROUP BY bin")
def fs_positions(t: Tables) -> DataFrame:
    return ordered.fs_deciles(t.rows, t.fast)


_FS = "SELECT codon || c2 AS kmer, count(*) AS n FROM {nxt} %s WHERE codon IN (SELECT codon FROM {fast}) AND c2 IN (SELECT codon FROM {sym} WHERE codon NOT IN (SELECT codon FROM {fast})) GROUP BY ALL"


@query(f"WITH a AS ({_FS % 'SEMI JOIN {seta} USING (gene)'}), b AS ({_FS % ''}), j AS (SELECT kmer, coalesce(a.n, 0) AS n_set, b.n AS n_all, b.n * (SELECT sum(n) FROM a) / (SELECT sum(n) FROM b) AS e FROM b LEFT JOIN a USING (kmer)) SELECT kmer, n_set, n_all, round(n_set / e, 6) + 0.0 AS fold, round((n_set - e) / sqrt(e), 4) + 0.0 AS z FROM j")
def fs_dicodon(t: Tables) -> DataFrame:
    p = ordered.fs_pairs(t.rows, t.set_a, t.symbols, t.fast)
    return p.select("kmer", "n_set", "n_all", r6("fold").alias("fold"), (F.round("z_score", 4) + 0.0).alias("z"))


@query("SELECT gene, pos, n, round(smooth, 6) + 0.0 AS smooth FROM {smooth}")
def smooth_profile(t: Tables) -> DataFrame:
    track = ordered.scored(sequences.positions(t.cds), t.tai, "wtai")
    return ordered.smoothed(track).select("gene", F.col("pos").cast("long").alias("pos"), F.col("n").cast("long").alias("n"), r6("smooth").alias("smooth"))


@query("SELECT bin, round(avg(s.smooth + (coalesce(x.smooth, s.smooth) - s.smooth) * (bin * (s.n - 1.0)::DOUBLE / 99 - s.pos)), 5) AS profile FROM (SELECT *, unnest(range(100)) AS bin FROM (SELECT gene, max(n) AS len FROM {smooth} GROUP BY gene HAVING max(n) >= 30)) g JOIN {smooth} s ON s.gene = g.gene AND s.pos = floor(bin * (len - 1) / 99 + 1e-9) LEFT JOIN {smooth} x ON x.gene = s.gene AND x.pos = s.pos + 1 GROUP BY bin")
def metagene(t: Tables) -> DataFrame:
    track = ordered.scored(sequences.positions(t.cds), t.tai, "wtai")
    return ordered.metagene(ordered.smoothed(track)).select(F.col("bin"), F.round("profile", 5).alias("profile"))


@query("SELECT round(avg(ramp), 6) AS ramp, round(avg(body), 6) AS body, round(avg(ramp) - avg(body), 6) + 0.0 AS delta FROM (SELECT gene, avg(score) FILTER (WHERE pos < 50) AS ramp, avg(score) FILTER (WHERE pos >= 50) AS body FROM {track} WHERE n > 50 GROUP BY gene)")
def ramp_analysis(t: Tables) -> DataFrame:
    track = ordered.scored(sequences.positions(t.cds), t.tai, "wtai").where("n > 50")
    per = track.groupBy("gene").agg(F.avg(F.when(F.col("pos") < 50, F.col("score"))).alias("ramp"), F.avg(F.when(F.col("pos") >= 50, F.col("score"))).alias("body"))
    return per.agg(F.round(F.avg("ramp"), 6).alias("ramp"), F.round(F.avg("body"), 6).alias("body"), r6(F.avg("ramp") - F.avg("body")).alias("delta"))


@query("SELECT gene, count(*) AS n_runs, max(size) AS longest FROM (SELECT gene, g, count(*) AS size FROM (SELECT gene, pos - row_number() OVER (PARTITION BY gene ORDER BY pos) AS g FROM {codons} WHERE codon IN (SELECT codon FROM {fast})) GROUP BY gene, g HAVING count(*) >= 2) GROUP BY gene")
def codon_runs(t: Tables) -> DataFrame:
    return ordered.runs(sequences.positions(t.cds), F.col("codon").isin(t.fast))


@query("SELECT user_id, count(*) AS n_runs, max(size) AS longest FROM (SELECT user_id, g, count(*) AS size FROM (SELECT user_id, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM {ords} WHERE event_type IN ('click', 'view')) GROUP BY user_id, g HAVING count(*) >= 2) GROUP BY user_id")
def event_runs(t: Tables) -> DataFrame:
    rows = t.read("events").select(F.col("user_id").alias("gene"), "event_type", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("pos"))
    return ordered.runs(rows, F.col("event_type").isin("click", "view")).withColumnRenamed("gene", "user_id")


@query("SELECT gene, count(*) AS n_windows FROM (SELECT gene, pos, n, sum(t) OVER (PARTITION BY gene ORDER BY pos ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS k, sum(t) OVER (PARTITION BY gene) / n AS d FROM (SELECT *, CASE WHEN codon IN ('GAA', 'AGA') THEN 1 ELSE 0 END AS t FROM {codons})) WHERE pos <= n - 15 AND k >= 2 AND k / 15 > 2 * d GROUP BY gene")
def cluster_windows(t: Tables) -> DataFrame:
    return ordered.dense_windows(sequences.positions(t.cds), F.col("codon").isin("GAA", "AGA"))


@query("SELECT gene, bin, codon, round(freq, 6) AS freq FROM {pfreq}")
def positional_freq(t: Tables) -> DataFrame:
    return frequency.positional_freq(t.cds, t.symbols).withColumn("freq", F.round("freq", 6))


@query("SELECT bin, codon, round(observed, 6) + 0.0 AS observed, round(expected, 6) + 0.0 AS expected, round(z_score, 3) + 0.0 AS z_score FROM {pz}")
def positional_z(t: Tables) -> DataFrame:
    d = _positional(t)
    return d.select("bin", "codon", r6("observed").alias("observed"), r6("expected").alias("expected"), (F.round("z_score", 3) + 0.0).alias("z_score"))


def _positional(t: Tables) -> DataFrame:
    cells = frequency.positional_freq(frequency.marked(t.cds, t.set_a), t.symbols, 100, "inside").withColumn("cell", F.struct("bin", "codon"))
    return frequency.deviation(cells, "cell", "freq", None, _sizes(t)).select("cell.bin", "cell.codon", "observed", "expected", "z_score")


@query("SELECT kmer, direction, round(z, 3) + 0.0 AS z FROM (SELECT kmer, 'enriched' AS direction, hi AS z, row_number() OVER (ORDER BY round(hi, 6) DESC, kmer) AS k FROM (SELECT codon AS kmer, max(abs(z_score)) AS hi FROM {pz} GROUP BY codon) UNION ALL SELECT kmer, 'depleted', lo, row_number() OVER (ORDER BY round(lo, 6), kmer) FROM (SELECT codon AS kmer, min(z_score) AS lo FROM {pz} GROUP BY codon)) WHERE k <= 5")
def positional_top(t: Tables) -> DataFrame:
    """Five codons by their largest absolute score in any bin, and five by their least score."""
    per = _positional(t).groupBy(F.col("codon").alias("kmer")).agg(F.max(F.abs("z_score")).alias("hi"), F.min("z_score").alias("lo"))
    up = per.orderBy(F.round("hi", 6).desc(), "kmer").limit(5).select("kmer", F.lit("enriched").alias("direction"), F.col("hi").alias("z"))
    low = per.orderBy(F.round("lo", 6), "kmer").limit(5).select("kmer", F.lit("depleted").alias("direction"), F.col("lo").alias("z"))
    return up.unionByName(low).withColumn("z", F.round("z", 3) + 0.0)


@query("SELECT kmer, round(2 * sum(k * freq) / (count(*) * sum(freq)) - (count(*) + 1) / count(*), 6) + 0.0 AS gini FROM (SELECT *, row_number() OVER (PARTITION BY kmer ORDER BY freq, gene) AS k FROM {f1} SEMI JOIN {seta} USING (gene)) GROUP BY kmer")
def gini(t: Tables) -> DataFrame:
    inside = frequency.members(sequences.kmer_freq(t.cds, 1), t.set_a)
    return stats.gini(inside, "kmer", "freq", "gene").withColumn("gini", r6("gini"))


_MW = "SELECT kmer, c.gene IS NOT NULL AS in_a, coalesce(freq, 0) AS freq, a.gene FROM (SELECT DISTINCT codon AS kmer FROM {sym}) CROSS JOIN (SELECT gene FROM {cds} JOIN ((SELECT gene FROM {seta}) UNION (SELECT gene FROM {setb})) USING (gene)) a LEFT JOIN {f1} f USING (kmer, gene) LEFT JOIN {seta} c ON c.gene = a.gene"


@query(f"SELECT kmer, n_a, n_b, u, round(1 - 2 * u / (n_a * n_b), 6) + 0.0 AS rank_biserial, round(CASE WHEN sd > 0 THEN greatest(abs(u - n_a * n_b / 2) - 0.5, 0) / sd * sign(u - n_a * n_b / 2) ELSE 0 END, 4) + 0.0 AS z, round({P_SQL}, 6) AS p_value FROM (SELECT *, greatest(1e-12, least(6.5, CASE WHEN sd > 0 THEN greatest(abs(u - n_a * n_b / 2) - 0.5, 0) / sd / sqrt(2) ELSE 0 END)) AS x FROM (SELECT kmer, n_a, n - n_a AS n_b, ra - n_a * (n_a + 1) / 2 AS u, sqrt(n_a * (n - n_a) / 12 * (n + 1 - ties / (n * (n - 1)))) AS sd FROM (SELECT kmer, sum(CASE WHEN in_a THEN 1 ELSE 0 END)::BIGINT AS n_a, count(*) AS n, sum(CASE WHEN in_a THEN k ELSE 0 END) AS ra, sum(c * c - 1)::DOUBLE AS ties FROM (SELECT kmer, in_a, rank() OVER (PARTITION BY kmer ORDER BY freq) + (count(*) OVER (PARTITION BY kmer, freq) - 1) / 2 AS k, count(*) OVER (PARTITION BY kmer, freq) AS c FROM (SELECT kmer, in_a, round(freq, 12) AS freq FROM ({_MW}))) GROUP BY kmer)))")
def mann_whitney(t: Tables) -> DataFrame:
    """Set a against set b for each codon; genes without it count as zero."""
    return _rank_tests(t).select("kmer", "n_a", "n_b", "u", r6("rank_biserial").alias("rank_biserial"), (F.round("z", 4) + 0.0).alias("z"), F.round("p_value", 6).alias("p_value"))


_EXACT = f"""WITH RECURSIVE v AS (SELECT c_nationkey || '-' || c_mktsegment AS cell, c_custkey % 3 = 0 AS in_a, c_acctbal AS x FROM customer),
ranked AS (SELECT cell, in_a, rank() OVER (PARTITION BY cell ORDER BY x) + (count(*) OVER (PARTITION BY cell, x) - 1) / 2 AS k, count(*) OVER (PARTITION BY cell, x) AS c FROM v),
s AS (SELECT cell, count(*) FILTER (WHERE in_a) AS n_a, count(*) FILTER (WHERE NOT in_a) AS n_b, count(*) AS n, coalesce(sum(k) FILTER (WHERE in_a), 0) AS ra, sum(c * c - 1)::DOUBLE AS ties FROM ranked GROUP BY cell),
t AS (SELECT *, ra - n_a * (n_a + 1) / 2 AS u FROM s WHERE n_a > 0 AND n_b > 0),
w(n, k, total, ways) AS (SELECT 0, 0, 0, 1::DOUBLE UNION ALL SELECT n + 1, k + b, total + b * (n + 1), sum(ways) FROM w, (VALUES (0), (1)) AS o(b) WHERE n < (SELECT max(n) FROM t WHERE least(n_a, n_b) <= 8) AND k + b <= 8 GROUP BY 1, 2, 3),
e AS (SELECT cell, sum(ways) FILTER (WHERE total - k * (k + 1) / 2 <= least(u, n_a * n_b - u)) / sum(ways) AS tail FROM t JOIN w ON w.n = t.n AND w.k = least(n_a, n_b) WHERE ties = 0 GROUP BY cell),
z AS (SELECT *, n_a * n_b AS pairs, sqrt(n_a * n_b / 12 * (n + 1 - ties / (n * (n - 1)))) AS sd FROM t)
SELECT cell, n_a, n_b, u, round(CASE WHEN tail IS NOT NULL THEN least(1, 2 * tail) ELSE {P_SQL} END, 9) AS p_value FROM (SELECT *, greatest(1e-12, least(6.5, greatest(abs(u - pairs / 2) - 0.5, 0) / sd / sqrt(2))) AS x FROM z) LEFT JOIN e USING (cell)"""


@query(_EXACT)
def rank_sum_exact(t: Tables) -> DataFrame:
    """Balances of two kinds of customers within each nation and segment: small samples, most of them without ties."""
    rows = t.read("customer").select(F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("cell"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 3 == 0).alias("in_a"))
    return stats.mann_whitney(rows, "x", "in_a", "cell").select("cell", "n_a", "n_b", "u", F.round("p_value", 9).alias("p_value"))


def _rank_tests(t: Tables) -> DataFrame:
    sides = t.set_a.withColumn("in_a", F.lit(True)).unionByName(t.set_b.join(t.set_a, "gene", "left_anti").withColumn("in_a", F.lit(False)))
    genes = t.cds.select("gene").join(sides, "gene")
    freq = sequences.kmer_freq(t.cds, 1).join(genes, "gene")
    present = freq.groupBy("kmer").agg(F.sum(F.col("in_a").cast("long")).alias("pa"), F.count("*").alias("pn"))
    total = genes.agg(F.sum(F.col("in_a").cast("long")).alias("na"), F.count("*").alias("nn"))
    # zeros are known by number: one weighted row for each codon and side stands for them
    zero = F.broadcast(t.symbols.select(F.col("codon").alias("kmer"))).join(present, "kmer", "left").join(F.broadcast(total))
    zeros = zero.select("kmer", F.lit(0.0).alias("freq"), (F.col("na") - F.coalesce("pa", F.lit(0))).alias("a"), (F.col("nn") - F.coalesce("pn", F.lit(0))).alias("t")).where("t > 0")
    seen = freq.groupBy("kmer", F.round("freq", 12).alias("freq")).agg(F.sum(F.col("in_a").cast("long")).alias("a"), F.count("*").alias("t"))
    return stats.mann_whitney_counts(seen.unionByName(zeros), "freq", "kmer")


@query("SELECT n_a, n_all, round(d, 6) AS d, round(CASE WHEN lam < 0.2 THEN 1 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101), lambda k: (-1) ** (k - 1) * exp(-2 * k * k * lam * lam))))) END::DOUBLE, 6) AS p_value FROM (SELECT *, d * sqrt(n_a * n_all / (n_a + n_all)) AS lam FROM (SELECT max(na) AS n_a, max(nt) AS n_all, max(abs(ca / na - ct / nt)) AS d FROM (SELECT sum(a) OVER (ORDER BY len) AS ca, sum(t) OVER (ORDER BY len) AS ct, sum(a) OVER () AS na, sum(t) OVER () AS nt FROM (SELECT len, sum(CASE WHEN s.gene IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS a, count(*) AS t FROM {stats} x LEFT JOIN {seta} s ON s.gene = x.gene GROUP BY len))))")
def ks_stat(t: Tables) -> DataFrame:
    lengths = t.rows.select("gene", F.length("seq").alias("len")).join(t.set_a.withColumn("in_a", F.lit(True)), "gene", "left").withColumn("in_a", F.coalesce("in_a", F.lit(False)))
    return stats.ks(lengths, "len", "in_a").select("n_a", "n_all", F.round("d", 6).alias("d"), F.round("p_value", 6).alias("p_value"))


@query("SELECT gene, round(mean_z, 4) + 0.0 AS mean_z, round(min_z, 4) + 0.0 AS min_z, round(max_z, 4) + 0.0 AS max_z, round(sum_freq, 6) + 0.0 AS sum_freq FROM {tz}")
def reverse_lookup(t: Tables) -> DataFrame:
    return _reverse(t).select("gene", *[(F.round(c, 4) + 0.0).alias(c) for c in ("mean_z", "min_z", "max_z")], r6("sum_freq").alias("sum_freq"))


def _reverse(t: Tables) -> DataFrame:
    return frequency.target_z(t.rows, ["GAA", "AGA"])


@query("SELECT gene, round(mean_z, 4) + 0.0 AS mean_z FROM {tz} ORDER BY round(mean_z, 9) DESC, gene LIMIT 50")
def reverse_topn(t: Tables) -> DataFrame:
    return _reverse(t).orderBy(F.round("mean_z", 9).desc(), "gene").limit(50).select("gene", (F.round("mean_z", 4) + 0.0).alias("mean_z"))


@query("WITH z AS (SELECT * FROM {tz}) SELECT gene, round(mean_z, 4) + 0.0 AS mean_z FROM z WHERE mean_z >= (SELECT quantile_cont(mean_z, 0.95) FROM z) - 1e-9")
def reverse_pctl(t: Tables) -> DataFrame:
    z = _reverse(t)
    cut = z.agg(F.expr("percentile(mean_z, 0.95)").alias("cut"))
    return z.join(F.broadcast(cut), F.col("mean_z") >= F.col("cut") - 1e-9).select("gene", (F.round("mean_z", 4) + 0.0).alias("mean_z"))


_PAIRS = "SELECT a.gene AS g1, b.gene AS g2, a.k AS pair FROM (SELECT gene, row_number() OVER (ORDER BY gene) AS k FROM {cds} WHERE lang = 'fr') a JOIN (SELECT gene, row_number() OVER (ORDER BY gene) AS k FROM {cds} WHERE lang = 'de') b ON a.k = b.k"


def _pairs(t: Tables) -> DataFrame:
    """Orthologous genes by rank within two groups."""
    def ranked(lang: str, name: str) -> DataFrame:
        genes = t.read("documents").where(F.col("lang") == lang).select(F.col("doc_id").alias(name))
        return stats.running(genes, [], name, []).select(name, F.col("rank").alias("pair"))

    return ranked("fr", "g1").join(ranked("de", "g2"), "pair")


@query(_PAIRS)
def ortholog_pairs(t: Tables) -> DataFrame:
    return _pairs(t).select("g1", "g2", "pair")


def _rscu_pairs(t: Tables) -> DataFrame:
    """(pair, g1, g2, codon, aa, x, y). The pairs are written once, and only genes of a pair are counted."""
    pairs = shared.written(_pairs(t), "pairs")
    inside = frequency.members(t.cds, pairs.select(F.explode(F.array("g1", "g2")).alias("gene")))
    dense = shared.written(frequency.rscu_dense(inside, frequency.codon_counts(inside, t.symbols), t.symbols), "rscu")  # read from both sides
    left = pairs.join(dense.select(F.col("gene").alias("g1"), "codon", "aa", F.col("rscu").alias("x")), "g1")
    return left.join(dense.select(F.col("gene").alias("g2"), "codon", F.col("rscu").alias("y")), ["g2", "codon"])


PARTS["rpairs"] = f"SELECT pair, p.g1, d1.codon, d1.aa, d1.rscu AS x, d2.rscu AS y FROM ({_PAIRS}) p JOIN {{dense}} d1 ON d1.gene = p.g1 JOIN {{dense}} d2 ON d2.gene = p.g2 AND d2.codon = d1.codon"


@query("SELECT pair, codon, aa, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM {rpairs}")
def rscu_scatter(t: Tables) -> DataFrame:
    return _rscu_pairs(t).select("pair", "codon", "aa", r6("x").alias("x"), r6("y").alias("y"))


PARTS["corrs"] = "SELECT pair, g1, count(*) AS n, CASE WHEN count(*) >= 5 AND stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12 THEN corr(x, y) END AS r FROM {rpairs} GROUP BY pair, g1"


def _correlations(t: Tables) -> DataFrame:
    return _correlated(_rscu_pairs(t))


def _correlated(rows: DataFrame) -> DataFrame:
    ok = (F.count("*") >= 5) & (F.stddev_pop("x") > 1e-12) & (F.stddev_pop("y") > 1e-12)
    return rows.groupBy("pair", "g1").agg(F.count("*").alias("n"), F.when(ok, F.corr("x", "y")).alias("r"))


@query("SELECT pair, n, round(r, 6) + 0.0 AS r FROM {corrs}")
def rscu_corr(t: Tables) -> DataFrame:
    return _correlations(t).select("pair", "n", r6("r").alias("r"))


_BOOT = """h AS (SELECT rep, i, (rep::BIGINT * 1103515245 + i::BIGINT * 12345 + 42) % 2147483647 AS h0 FROM range(10000) r(rep), (SELECT count(*) AS m FROM a), range(m) s(i)),
h1 AS (SELECT rep, ((h0 * h0) % 2147483647 * 48271 + 11) % 2147483647 AS h FROM h), h2 AS (SELECT rep, ((h * h) % 2147483647 * 48271 + 11) % 2147483647 AS h FROM h1), h3 AS (SELECT rep, ((h * h) % 2147483647 * 48271 + 11) % 2147483647 AS h FROM h2),
b AS (SELECT stddev_samp(x) AS sd_b FROM (SELECT rep, avg(r) AS x FROM h3, (SELECT count(*) AS n FROM v) JOIN v ON idx = h % n GROUP BY rep))"""


@query(f"WITH v AS (SELECT row_number() OVER (ORDER BY pair) - 1 AS idx, r, g1 FROM {{corrs}} WHERE r IS NOT NULL), a AS (SELECT * FROM v SEMI JOIN {{seta}} ON g1 = gene), {_BOOT} SELECT (SELECT count(*) FROM a) AS n, (SELECT count(*) FROM v) AS n_all, (SELECT round(avg(r), 6) FROM a) AS mean_r, (SELECT round(median(r), 6) FROM a) AS median_r, (SELECT round(stddev_samp(r), 6) FROM a) AS sd_r, (SELECT round(avg(r), 6) FROM v) AS mean_all, round(((SELECT avg(r) FROM a) - (SELECT avg(r) FROM v)) / sd_b, 4) + 0.0 AS z_score FROM b")
def compare_summary(t: Tables) -> DataFrame:
    """Correlations of the pairs of a set against all pairs: resampled means give the standard error, the mean of all the centre."""
    corr = _correlations(t).where("r is not null").persist()  # a row for each pair, ranked and then read several times
    ranked = stats.running(corr, [], "pair", []).select((F.col("rank") - 1).alias("idx"), F.col("r").alias("value"), "g1").persist()
    inside = ranked.join(t.set_a.withColumnRenamed("gene", "g1"), "g1", "left_semi")
    z = resample.bootstrap_mean(ranked.select("idx", "value"), inside.agg(F.avg("value").alias("observed")), inside.agg(F.count("*").alias("m")), 10_000, 42)
    own = inside.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_r"), F.round(F.median("value"), 6).alias("median_r"), F.round(F.stddev_samp("value"), 6).alias("sd_r"))
    whole = ranked.agg(F.count("*").alias("n_all"), F.avg("value").alias("centre"))
    return own.join(F.broadcast(whole)).join(F.broadcast(z)).select("n", "n_all", "mean_r", "median_r", "sd_r", F.round("centre", 6).alias("mean_all"), (F.round((F.col("observed") - F.col("centre")) / F.col("sd_b"), 4) + 0.0).alias("z_score"))


@query("WITH c AS (SELECT * FROM {corrs}), p AS (SELECT * FROM {rpairs}), d AS (SELECT pair FROM c WHERE r <= (SELECT quantile_cont(r, 0.25) FROM c) + 1e-12), b AS (SELECT pair, aa, first(codon ORDER BY round(x, 9) DESC, codon) AS c1, first(codon ORDER BY round(y, 9) DESC, codon) AS c2 FROM p SEMI JOIN d USING (pair) GROUP BY pair, aa) SELECT pair, count(*) FILTER (WHERE c1 <> c2) AS n_differ FROM b GROUP BY pair")
def divergent_pairs(t: Tables) -> DataFrame:
    rows = _rscu_pairs(t)
    corr = shared.written(_correlated(rows), "correlations")  # read for the quantile and for the pairs below it
    cut = corr.agg(F.expr("percentile(r, 0.25)").alias("cut"))
    low = corr.join(F.broadcast(cut), F.col("r") <= F.col("cut") + 1e-12).select("pair")
    best = rows.join(low, "pair", "left_semi").groupBy("pair", "aa").agg(F.min(F.struct(-F.round("x", 9), "codon"))["codon"].alias("c1"), F.min(F.struct(-F.round("y", 9), "codon"))["codon"].alias("c2"))
    return best.groupBy("pair").agg(F.count_if(F.col("c1") != F.col("c2")).alias("n_differ"))


def _drivers(t: Tables) -> DataFrame:
    return frequency.drivers(t.cds, t.set_a, ["GAA", "AGA", "CTG"])


@query("SELECT kmer, gene, round(contribution, 6) + 0.0 AS contribution, rank, by_size, round(cum, 5) AS cum FROM {drv}")
def driver_genes(t: Tables) -> DataFrame:
    return _drivers(t).select("kmer", "gene", r6("contribution").alias("contribution"), "rank", "by_size", F.round("cum", 5).alias("cum"))


@query("SELECT kmer, count(*) AS n_genes, min(by_size) FILTER (WHERE cum >= 0.5 - 1e-9) AS n50, min(by_size) FILTER (WHERE cum >= 0.8 - 1e-9) AS n80, round(2 * sum((count_all + 1 - by_size) * size) / (count(*) * sum(size)) - (count(*) + 1) / count(*), 6) + 0.0 AS gini, arg_min(gene, rank) AS top_driver, round(arg_min(contribution, rank), 6) + 0.0 AS top_contribution FROM (SELECT *, count(*) OVER (PARTITION BY kmer) AS count_all FROM {drv}) GROUP BY kmer")
def driver_summary(t: Tables) -> DataFrame:
    d = frequency.driver_summary(_drivers(t))
    return d.select("kmer", "n_genes", "n50", "n80", r6("gini").alias("gini"), "top_driver", r6("top_contribution").alias("top_contribution"))


@query("SELECT avg(len) AS mean_length, round(avg(gc), 6) AS mean_gc, round(avg(len) FILTER (WHERE s.gene IS NOT NULL), 6) AS set_length, round(avg(gc) FILTER (WHERE s.gene IS NOT NULL), 6) AS set_gc FROM {stats} x LEFT JOIN {seta} s ON s.gene = x.gene")
def gene_summary(t: Tables) -> DataFrame:
    rows = t.rows.select("gene", F.length("seq").alias("len"), sequences.gc(F.col("seq")).alias("gc")).join(t.set_a.withColumn("i", F.lit(1)), "gene", "left")
    return rows.agg(F.avg("len").alias("mean_length"), F.round(F.avg("gc"), 6).alias("mean_gc"), F.round(F.avg(F.when(F.col("i") == 1, F.col("len"))), 6).alias("set_length"), F.round(F.avg(F.when(F.col("i") == 1, F.col("gc"))), 6).alias("set_gc"))


_SIG = "SELECT kmer, z_score, row_number() OVER (PARTITION BY z_score > 0 ORDER BY round(abs(z_score), 6) DESC, kmer) AS k FROM {bhcomp1} WHERE adjusted_p < 0.05 AND z_score <> 0"


@query(f"SELECT count(*) FILTER (WHERE z_score > 0) AS enriched, count(*) FILTER (WHERE z_score < 0) AS depleted, (SELECT count(*) FROM {{bhcomp1}}) AS tested, coalesce(string_agg(kmer, ',' ORDER BY k) FILTER (WHERE z_score > 0 AND k <= 5), '') AS top_enriched, coalesce(string_agg(kmer, ',' ORDER BY k) FILTER (WHERE z_score < 0 AND k <= 5), '') AS top_depleted FROM ({_SIG})")
def exec_summary(t: Tables) -> DataFrame:
    """Significant codons in each direction, and the five strongest of each. As many rows meet as there are codons."""
    c = _tested(frequency.composition(t.cds, t.set_a, 1), "kmer").withColumn("sig", F.col("adjusted_p") < frequency.ALPHA)

    def top(side: Column) -> Column:
        named = F.sort_array(F.collect_list(F.when(F.col("sig") & side, F.struct((-F.round(F.abs("z_score"), 6)).alias("z"), "kmer"))))
        return F.array_join(F.transform(F.slice(named, 1, 5), lambda x: x["kmer"]), ",")

    up, low = F.col("z_score") > 0, F.col("z_score") < 0
    return c.agg(F.count_if(F.col("sig") & up).alias("enriched"), F.count_if(F.col("sig") & low).alias("depleted"), F.count("*").alias("tested"), top(up).alias("top_enriched"), top(low).alias("top_depleted"))


@query("SELECT n_set, list_filter([CASE WHEN n_set < 10 THEN 'k1' END, CASE WHEN n_set < 30 THEN 'k2' END, CASE WHEN n_set < 100 THEN 'k3' END], lambda x: x IS NOT NULL)::VARCHAR AS warnings FROM (SELECT m AS n_set FROM {nb})")
def power_check(t: Tables) -> DataFrame:
    n = frequency.members(t.cds, t.set_b).agg(F.count("*").alias("n_set"))
    warn = F.array_compact(F.array(F.when(F.col("n_set") < 10, "k1"), F.when(F.col("n_set") < 30, "k2"), F.when(F.col("n_set") < 100, "k3")))
    return n.select("n_set", F.concat(F.lit("["), F.array_join(warn, ", "), F.lit("]")).alias("warnings"))


@query("WITH v AS (SELECT row_number() OVER (ORDER BY gene) - 1 AS idx, gc3 AS value, gene FROM {stats}), h AS (SELECT rep, i, (rep::BIGINT * 1103515245 + i::BIGINT * 12345 + 42) % 2147483647 AS h0 FROM range(200) r(rep), {nb}, range(m) s(i)), h1 AS (SELECT rep, ((h0 * h0) % 2147483647 * 48271 + 11) % 2147483647 AS h FROM h), h2 AS (SELECT rep, ((h * h) % 2147483647 * 48271 + 11) % 2147483647 AS h FROM h1), h3 AS (SELECT rep, ((h * h) % 2147483647 * 48271 + 11) % 2147483647 AS h FROM h2), m AS (SELECT rep, avg(value) AS x FROM h3, {ng} JOIN v ON v.idx = h % n GROUP BY rep), o AS (SELECT avg(value) AS observed FROM v SEMI JOIN {setb} USING (gene)) SELECT round(observed, 6) AS observed, round(avg(x), 6) AS mean_b, round(stddev_samp(x), 6) AS sd_b, round((observed - avg(x)) / stddev_samp(x), 4) AS z_score FROM m, o GROUP BY observed")
def bootstrap_z(t: Tables) -> DataFrame:
    rows = t.cds.select("gene", sequences.gc3(F.col("seq")).alias("value"))
    values = stats.running(rows, [], "gene", []).select((F.col("rank") - 1).alias("idx"), "value")
    inside = rows.join(t.set_b, "gene", "left_semi")
    z = resample.bootstrap_mean(values, inside.agg(F.avg("value").alias("observed")), inside.agg(F.count("*").alias("m")), 200, 42)
    return z.select(F.round("observed", 6).alias("observed"), F.round("mean_b", 6).alias("mean_b"), F.round("sd_b", 6).alias("sd_b"), F.round("z_score", 4).alias("z_score"))
