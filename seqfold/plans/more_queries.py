"""Queries over identifiers and sources, and the composite analyses that need more than SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqfold.functions import dims, stats
from seqfold.operators import frequency, glm, ids, names, ordered, resample, sequences, weights
from seqfold.plans.queries import _reverse
from seqfold.plans.registry import Tables, query, r6, tested
from seqfold.sources import readers


@query("SELECT gene::VARCHAR AS gene, length(seq) AS n, md5(seq) AS digest FROM {cds} WHERE seq <> ''")
def scan_fasta(t: Tables) -> DataFrame:
    """Sequences written as wrapped records and read back by the FASTA parser."""
    body = F.array_join(F.transform(F.regexp_extract_all("seq", F.lit(".{1,60}"), F.lit(0)), lambda x: x), "\n")
    records = t.cds.where("seq <> ''").select(F.concat(F.lit(">"), F.col("gene").cast("string"), F.lit(" lang="), "lang", F.lit("\n"), body).alias("value"))
    return readers.fasta_records(records).select("gene", F.length("seq").cast("long").alias("n"), F.md5(F.col("seq").cast("binary")).alias("digest"))


@query("SELECT l_suppkey, l_linestatus AS sample, round(sum(l_quantity), 4) AS tpm FROM lineitem GROUP BY ALL")
def scan_wide_expression(t: Tables) -> DataFrame:
    """A wide table (a column for each status) melted into rows."""
    wide = t.read("lineitem").groupBy("l_suppkey").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))
    return readers.wide_expression(wide.na.drop(subset=["F", "O"], how="all"), ["l_suppkey"]).where("tpm > 0").withColumn("tpm", F.round("tpm", 4))


@query("SELECT item_id, token FROM (SELECT item_id, unnest(string_split_regex(trim(translate(line, ',' || chr(9), '  ')), '\\s+')) AS token FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')) WHERE token <> ''")
def gene_list_parse(t: Tables) -> DataFrame:
    lines = t.read("benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("value"))
    return readers.gene_list(lines)


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, value DESC, event_id) = 1")
def best_per_group(t: Tables) -> DataFrame:
    """Per user the canonical kind of row first, else the largest."""
    e = t.read("events").select("user_id", "event_id", "event_type", "value")
    return ids.first_per(e, ["user_id"], [(F.col("event_type") == "purchase").desc(), F.desc("value"), F.col("event_id")])


@query("WITH a AS (SELECT p_partkey AS gene, p_name AS symbol, unnest(string_split(p_name || '|' || p_brand, '|')) AS alias, 0 AS rank FROM part UNION ALL SELECT p_partkey, p_name, unnest(string_split(p_type || '|' || p_brand, '|')), 1 FROM part) SELECT upper(trim(alias)) AS alias, gene, CASE WHEN rank = 0 THEN 'previous' ELSE 'alias' END AS kind FROM a WHERE trim(alias) <> '' AND upper(trim(alias)) <> upper(symbol) QUALIFY row_number() OVER (PARTITION BY upper(trim(alias)) ORDER BY rank, gene) = 1")
def alias_explode(t: Tables) -> DataFrame:
    p = t.read("part")
    names = p.select(F.col("p_partkey").alias("gene"), F.col("p_name").alias("symbol"), F.concat_ws("|", "p_name", "p_brand").alias("previous"), F.concat_ws("|", "p_type", "p_brand").alias("aliases"))
    return ids.exploded_aliases(names, p.select(F.col("p_partkey").alias("gene")))


_ALIAS = "SELECT upper(c_name) AS key_upper, 'gene_symbol' AS id_type, c_custkey AS gene, 0 AS priority FROM customer UNION ALL SELECT upper('ENSG' || lpad(c_custkey::VARCHAR, 11, '0')), 'ensg', c_custkey, 0 FROM customer UNION ALL SELECT (10000 + c_custkey)::VARCHAR, 'entrez', c_custkey, 0 FROM customer"
_INPUT = "SELECT unnest([lower(c_name), 'ENSG' || lpad(c_custkey::VARCHAR, 11, '0') || '.7', (10000 + c_custkey)::VARCHAR, c_name || 'x']) AS input_id FROM customer"


@query(f"WITH a AS ({_ALIAS}), i AS ({_INPUT}) SELECT input_id, coalesce(x.gene, y.gene) AS gene, coalesce(x.id_type, y.id_type) AS matched FROM i LEFT JOIN a x ON x.key_upper = upper(input_id) LEFT JOIN a y ON y.key_upper = split_part(upper(input_id), '.', 1)")
def resolve_ids(t: Tables) -> DataFrame:
    c = t.read("customer")
    ensg = F.concat(F.lit("ENSG"), F.lpad(F.col("c_custkey").cast("string"), 11, "0"))
    entrez = (F.col("c_custkey") + 10000).cast("string")
    alias = F.explode(F.array(*[F.struct(k.alias("key_upper"), F.lit(n).alias("id_type")) for k, n in ((F.upper("c_name"), "gene_symbol"), (ensg, "ensg"), (entrez, "entrez"))]))
    aliases = c.select(F.col("c_custkey").alias("gene"), alias.alias("a")).select("a.key_upper", "a.id_type", "gene", F.lit(0).alias("priority"))
    inputs = c.select(F.explode(F.array(F.lower("c_name"), F.concat(ensg, F.lit(".7")), entrez, F.concat("c_name", F.lit("x")))).alias("input_id"))
    return ids.resolve(inputs, aliases)


@query("SELECT l.doc_id AS gene, md5(seq) AS digest, seq IS NULL OR seq = '' AS missing FROM (SELECT DISTINCT doc_id FROM labels) l LEFT JOIN {cds} ON gene = l.doc_id")
def get_sequences(t: Tables) -> DataFrame:
    """Sequences of the labelled ids, with the ids that have none."""
    wanted = t.read("labels").select(F.col("doc_id").alias("gene")).distinct()
    return wanted.join(t.cds.select("gene", "seq"), "gene", "left").select("gene", F.md5(F.col("seq").cast("binary")).alias("digest"), (F.col("seq").isNull() | (F.col("seq") == "")).alias("missing"))


@query("SELECT o_orderkey, coalesce(nullif(c_name, ''), o_custkey::VARCHAR) AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def common_names(t: Tables) -> DataFrame:
    named = t.read("orders").select("o_orderkey", "o_custkey").join(t.read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left")
    return named.select("o_orderkey", F.coalesce(F.nullif("c_name", F.lit("")), F.col("o_custkey").cast("string")).alias("name"))


@query("SELECT c_custkey AS gene1, s_suppkey AS gene2 FROM (SELECT c_custkey, s_suppkey, 0 AS rank FROM customer, supplier WHERE c_custkey = 1 AND s_suppkey = 2 UNION ALL SELECT c_custkey, s_suppkey, 1 FROM customer JOIN supplier ON regexp_extract(c_name, '[0-9]+') = regexp_extract(s_name, '[0-9]+') AND c_custkey <> 3) QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY rank, c_custkey) = 1")
def ortholog_name_match(t: Tables) -> DataFrame:
    left = t.read("customer").select(F.col("c_custkey").alias("gene"), F.regexp_extract("c_name", "[0-9]+", 0).alias("name"))
    right = t.read("supplier").select(F.col("s_suppkey").alias("gene"), F.regexp_extract("s_name", "[0-9]+", 0).alias("name"))
    pick = left.where("gene = 1").select(F.col("name").alias("name1")).join(F.broadcast(right.where("gene = 2").select(F.col("name").alias("name2"))))
    return ids.name_matched(left, right, pick, left.where("gene = 3").select("name"))


@query("SELECT DISTINCT o_custkey AS gene1, o_orderkey AS gene2 FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'")
def ortholog_filter(t: Tables) -> DataFrame:
    rows = t.read("orders").select(F.when(F.col("o_orderstatus") == "F", "ortholog_one2one").otherwise("other").alias("homology_type"), F.lit("x").alias("homology_species"), F.when(F.col("o_orderpriority") == "5-LOW", "0").otherwise("1").alias("is_high_confidence"), F.col("o_custkey").alias("gene_stable_id"), F.col("o_orderkey").alias("homology_gene_stable_id"))
    return readers.orthologs(rows, "x")


@query("SELECT p_partkey, CASE WHEN p_size <= 5 THEN 3000.0 WHEN p_name LIKE '%1%' THEN 50.0 WHEN p_retailprice < 950 THEN 0.5 ELSE 15.0 END::DOUBLE AS tpm FROM part")
def expression_estimate(t: Tables) -> DataFrame:
    """An abundance by the first rule that holds, else the typical one."""
    tpm = F.when(F.col("p_size") <= 5, 3000.0).when(F.col("p_name").like("%1%"), 50.0).when(F.col("p_retailprice") < 950, 0.5).otherwise(15.0)
    return t.read("part").select("p_partkey", tpm.alias("tpm"))


@query("SELECT l_partkey AS gene, round(median(q), 6) AS tpm FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY l_partkey")
def cross_tissue_median(t: Tables) -> DataFrame:
    per = t.read("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return per.groupBy(F.col("l_partkey").alias("gene")).agg(F.round(F.median("q"), 6).alias("tpm"))


@query("SELECT n_nationkey, n_name FROM nation WHERE instr(lower(n_name), '1') > 0 QUALIFY row_number() OVER (ORDER BY CASE WHEN lower(n_name) = '1' THEN 0 ELSE 1 END, n_nationkey) = 1")
def tissue_match(t: Tables) -> DataFrame:
    """The name equal to the query, else the first in file order that contains it."""
    name = F.translate(F.lower("n_name"), "_-", "  ")
    hits = t.read("nation").where(F.instr(name, "1") > 0)
    return hits.orderBy((name != "1").cast("int"), "n_nationkey").limit(1).select("n_nationkey", "n_name")


@query("SELECT c_custkey, upper(translate(c_name, ' -():#', '')) AS line FROM customer WHERE contains(upper(translate(c_name, ' -():#', '')), '0000012')")
def cell_line_match(t: Tables) -> DataFrame:
    line = F.translate(ids.normalised_line(F.col("c_name")), "#", "")
    return t.read("customer").where(line.contains("0000012")).select("c_custkey", line.alias("line"))


_ASKED = "CASE p_partkey % 5 WHEN 0 THEN 'customer-#' || lpad(p_partkey::VARCHAR, 9, '0') WHEN 1 THEN '#' || lpad((p_partkey // 10)::VARCHAR, 8, '0') WHEN 2 THEN 'my Customer#' || lpad(p_partkey::VARCHAR, 9, '0') || ' (cell)' WHEN 3 THEN p_partkey::VARCHAR ELSE 'hela' || p_partkey END"
_LINES = "upper(translate({}, ' -():', ''))"


@query(f"""WITH n AS (SELECT {_LINES.format("c_name")} AS n, min(c_custkey) AS place, arg_max(c_name, c_custkey) AS name FROM customer GROUP BY 1),
p(line, tissue, place) AS (VALUES {", ".join(f"('{a}', '{b}', {i})" for i, (a, b) in enumerate(dims.LINE_TISSUES))}),
a AS (SELECT DISTINCT ask, {_LINES.format("ask")} AS a FROM (SELECT {_ASKED} AS ask FROM part)),
m AS (SELECT ask, name, CASE WHEN a = n THEN 'exact' ELSE 'substring' END AS how, (a <> n)::INT AS rank, place FROM a JOIN n ON contains(n, a) OR contains(a, n)
UNION ALL SELECT ask, tissue, 'proxy', 2 + (a <> line)::INT, place FROM a JOIN p ON contains(line, a) OR contains(a, line))
SELECT ask, name, how FROM a LEFT JOIN m USING (ask) QUALIFY row_number() OVER (PARTITION BY ask ORDER BY rank, place) = 1""")
def cell_line_choice(t: Tables) -> DataFrame:
    """A line for each of many asked names: equal, holding or held, else the tissue that stands for it."""
    k = F.col("p_partkey")
    ask = F.when(k % 5 == 0, F.concat(F.lit("customer-#"), F.lpad(k.cast("string"), 9, "0"))).when(k % 5 == 1, F.concat(F.lit("#"), F.lpad(F.expr("p_partkey div 10").cast("string"), 8, "0")))
    ask = ask.when(k % 5 == 2, F.concat(F.lit("my Customer#"), F.lpad(k.cast("string"), 9, "0"), F.lit(" (cell)"))).when(k % 5 == 3, k.cast("string")).otherwise(F.concat(F.lit("hela"), k.cast("string")))
    return names.cell_lines(t.read("part").select(ask.alias("ask")), t.read("customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("place")))


@query("""WITH n AS (SELECT translate(lower(p_type), '_-', '  ') AS n, min(p_partkey) AS place, arg_max(p_type, p_partkey) AS name FROM part GROUP BY 1),
a AS (SELECT DISTINCT c_mktsegment AS ask, translate(lower(c_mktsegment), '_-', '  ') AS a FROM customer UNION SELECT DISTINCT substr(p_type, 2, 4 + p_partkey % 3), translate(lower(substr(p_type, 2, 4 + p_partkey % 3)), '_-', '  ') FROM part)
SELECT ask, name, CASE WHEN a = n THEN 'exact' WHEN name IS NOT NULL THEN 'substring' END AS how FROM a LEFT JOIN n ON contains(n, a) QUALIFY row_number() OVER (PARTITION BY ask ORDER BY (a <> n)::INT, place) = 1""")
def tissue_choice(t: Tables) -> DataFrame:
    """A tissue for each of many asked names: equal, else the first that holds it."""
    p = t.read("part")
    asked = t.read("customer").select(F.col("c_mktsegment").alias("ask")).unionByName(p.select(F.expr("substring(p_type, 2, 4 + int(p_partkey % 3))").alias("ask")))
    return names.tissues(asked, p.select(F.col("p_type").alias("name"), F.col("p_partkey").alias("place")))


@query("SELECT i::INT AS bin, count(*) AS n FROM (SELECT least(floor(gc * 39), 38) AS i FROM {stats}) GROUP BY i")
def histogram(t: Tables) -> DataFrame:
    """39 equal bins on [0, 1], the last one closed."""
    rows = t.rows.select(F.least(F.floor(sequences.gc(F.col("seq")) * 39), F.lit(38)).cast("int").alias("bin"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT gene, codon AS kmer, count(*) AS cnt FROM {codons} WHERE pos BETWEEN 1 AND 50 GROUP BY ALL), b AS (SELECT gene, codon AS kmer, count(*) AS cnt FROM {codons} WHERE pos > 50 GROUP BY ALL), rl AS (SELECT gene, least(n - 1, 50) AS k FROM {codons} WHERE pos = 0 AND n >= 4), bl AS (SELECT gene, n - 51 AS k FROM {codons} WHERE pos = 0 AND n >= 54), rf AS (SELECT kmer, sum(cnt / k) / (SELECT count(*) FROM rl) AS f FROM r JOIN rl USING (gene) GROUP BY kmer), bf AS (SELECT kmer, sum(cnt / k) / (SELECT count(*) FROM bl) AS f FROM b JOIN bl USING (gene) GROUP BY kmer) SELECT kmer, round(rf.f, 6) AS ramp, round(bf.f, 6) AS body, round(rf.f - bf.f, 6) + 0.0 AS delta FROM rf JOIN bf USING (kmer) SEMI JOIN (SELECT codon AS kmer FROM {sym}) USING (kmer)")
def region_bias(t: Tables) -> DataFrame:
    """Mean frequencies in the ramp (codons 1 to 50) and behind it."""
    ramp = frequency.geneset_mean(sequences.region(t.cds, 1, 51, 3), 1).withColumnRenamed("observed", "ramp")
    body = frequency.geneset_mean(sequences.region(t.cds, 51, None, 3), 1).withColumnRenamed("observed", "body")
    return ramp.join(body, "kmer").select("kmer", r6("ramp").alias("ramp"), r6("body").alias("body"), r6(F.col("ramp") - F.col("body")).alias("delta"))


@query("SELECT a.kmer, round(coalesce(x.o, 0), 6) + 0.0 AS mean_a, round(coalesce(y.o, 0), 6) + 0.0 AS mean_b, round((coalesce(x.o, 0) + 1e-9) / (coalesce(y.o, 0) + 1e-9), 4) AS fold FROM (SELECT codon AS kmer FROM {sym}) a LEFT JOIN (SELECT kmer, sum(freq) / m AS o FROM {f1} SEMI JOIN {seta} USING (gene), {na} GROUP BY kmer, m) x USING (kmer) LEFT JOIN (SELECT kmer, sum(freq) / m AS o FROM {f1} SEMI JOIN {setb} USING (gene), {nb} GROUP BY kmer, m) y USING (kmer)")
def differential(t: Tables) -> DataFrame:
    """Two sets against each other: means and fold change of each codon."""
    a = frequency.geneset_mean(frequency.members(t.cds, t.set_a), 1).withColumnRenamed("observed", "a")
    b = frequency.geneset_mean(frequency.members(t.cds, t.set_b), 1).withColumnRenamed("observed", "b")
    both = F.broadcast(t.symbols.select(F.col("codon").alias("kmer"))).join(a, "kmer", "left").join(b, "kmer", "left").na.fill(0.0, ["a", "b"])
    return both.select("kmer", r6("a").alias("mean_a"), r6("b").alias("mean_b"), F.round((F.col("a") + 1e-9) / (F.col("b") + 1e-9), 4).alias("fold"))


@query("SELECT count(*) AS n_genes, round(avg(coalesce(k, 0)), 6) AS mean_runs, max(coalesce(longest, 0)) AS longest, round(avg(CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_with FROM {cds} SEMI JOIN {setb} USING (gene) LEFT JOIN (SELECT gene, count(*) AS k, max(size) AS longest FROM (SELECT gene, g, count(*) AS size FROM (SELECT gene, pos - row_number() OVER (PARTITION BY gene ORDER BY pos) AS g FROM {codons} WHERE codon IN ('GAA', 'AGA')) GROUP BY gene, g HAVING count(*) >= 2) GROUP BY gene) USING (gene)")
def cluster_scan(t: Tables) -> DataFrame:
    inside = frequency.members(t.cds, t.set_b)
    found = inside.select("gene").join(ordered.runs(sequences.positions(inside), F.col("codon").isin("GAA", "AGA")), "gene", "left").na.fill(0, ["n_runs", "longest"])
    return found.agg(F.count("*").alias("n_genes"), F.round(F.avg("n_runs"), 6).alias("mean_runs"), F.max("longest").alias("longest"), F.round(F.avg((F.col("n_runs") > 0).cast("double")), 6).alias("share_with"))


@query("SELECT gene, codon, aa, cnt, round(cnt / sum(cnt) OVER (PARTITION BY gene, aa), 6) AS share, round(2.0 * cnt / sum(cnt) OVER (PARTITION BY gene, aa), 6) AS rscu FROM (SELECT gene, aa, codon, cnt::DOUBLE AS cnt FROM {li})")
def category_shares(t: Tables) -> DataFrame:
    """The family operators over pre-counted categories: suppliers, return flags and line statuses."""
    counts = t.read("lineitem").groupBy(F.col("l_suppkey").alias("gene"), F.col("l_returnflag").alias("aa"), F.col("l_linestatus").alias("codon")).agg(F.count("*").cast("double").alias("cnt"))
    share = F.col("cnt") / F.sum("cnt").over(Window.partitionBy("gene", "aa"))
    rscu = frequency.rscu(counts.withColumn("n_syn", F.lit(2)))
    return counts.select("gene", "codon", "aa", "cnt", F.round(share, 6).alias("share")).join(rscu.select("gene", "codon", "aa", F.round("rscu", 6).alias("rscu")), ["gene", "codon", "aa"])


@query("SELECT user_id, count(*) FILTER (WHERE a AND b) AS ff, count(*) FILTER (WHERE a AND NOT b) AS fs, count(*) FILTER (WHERE NOT a AND b) AS sf, count(*) FILTER (WHERE NOT a AND NOT b) AS ss FROM (SELECT user_id, event_type IN ('click', 'view') AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY pos) IN ('click', 'view') AS b FROM {ords}) WHERE b IS NOT NULL GROUP BY user_id")
def event_transitions(t: Tables) -> DataFrame:
    """Adjacent pairs of events of a user, by window."""
    quick = F.col("event_type").isin("click", "view")
    rows = t.read("events").withColumn("b", F.lead(quick).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).withColumn("a", quick).where("b is not null")
    return rows.groupBy("user_id").agg(F.count_if(F.col("a") & F.col("b")).alias("ff"), F.count_if(F.col("a") & ~F.col("b")).alias("fs"), F.count_if(~F.col("a") & F.col("b")).alias("sf"), F.count_if(~F.col("a") & ~F.col("b")).alias("ss"))


@query()
def glm_gc3(t: Tables) -> DataFrame:
    """Per codon the set's effect in a binomial regression that holds GC3; tested against plain Newton steps."""
    fitted = glm.by_codon(glm.shares(t.cds, t.set_a, t.symbols)).withColumn("p_value", stats.normal_p("z_score"))
    return stats.bh(fitted, "p_value", "codon")


@query()
def composition_bootstrap(t: Tables) -> DataFrame:
    """Set against all by resampling whole genes; converges to analytic_z."""
    inside = frequency.members(t.cds, t.set_a)
    return resample.bootstrap_kmers(sequences.kmer_freq(t.cds, 1), t.cds.select("gene"), frequency.geneset_mean(inside, 1), inside.count(), reps=10_000)


@query()
def demand_bootstrap(t: Tables) -> DataFrame:
    """Demand of the set against resampled, weighted genes."""
    w = weights.demand_rank(t.cds, t.expression).where("weight > 0").select("gene", "weight")
    inside = frequency.members(t.cds, t.set_a)
    observed = weights.demand(inside, t.expression).select("kmer", F.col("demand").alias("observed"))
    return resample.bootstrap_kmers(sequences.kmer_freq(t.cds, 1), w, observed, inside.count(), reps=10_000, weight="weight")


@query()
def run_permutations(t: Tables) -> DataFrame:
    """Runs of a set's target codons against synonymous shuffles."""
    return resample.shuffled_runs(t.members(t.set_b), dims.FAMILY, ["GAA", "AGA"], permutations=1000)


_CHK = "SELECT kmer, sum(freq) / n AS expected, coalesce(sum(freq) FILTER (WHERE g.gene IS NOT NULL), 0) / m AS observed, sqrt(greatest((sum(freq * freq) - sum(freq) * sum(freq) / n) / (n - 1), 0)) AS sd, m FROM {f1} f LEFT JOIN (SELECT gene FROM {tz} WHERE mean_z >= 2) g ON g.gene = f.gene, {ng}, (SELECT count(*) AS m FROM {tz} WHERE mean_z >= 2) GROUP BY kmer, n, m"


@query("SELECT kmer, round(observed, 6) + 0.0 AS observed, round(expected, 6) + 0.0 AS expected, round(z_score, 4) + 0.0 AS z_score, round(adjusted_p, 6) AS adjusted_p FROM (" + tested(f"(SELECT *, CASE WHEN sd > 1e-12 THEN (observed - expected) / (sd / sqrt(m)) ELSE 0 END AS z_score FROM ({_CHK}))", "kmer") + ")")
def reverse_check(t: Tables) -> DataFrame:
    """The genes that a reverse lookup finds at z of two or more, checked as a set of their own."""
    found = _reverse(t).where("mean_z >= 2").select("gene")
    c = frequency.composition(t.cds, found, 1).withColumn("p_value", stats.normal_p("z_score"))
    return stats.bh(c, "p_value", "kmer").select("kmer", r6("observed").alias("observed"), r6("expected").alias("expected"), (F.round("z_score", 4) + 0.0).alias("z_score"), F.round("adjusted_p", 6).alias("adjusted_p"))
