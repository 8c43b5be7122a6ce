"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from seqfold.llm import divergence_rules, importance, license_index, secrets
from seqfold.llm.queries import URL_RULES


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _secret_scan() -> str:
    parts = []
    for n, r in enumerate(secrets.RULES):
        p = _quoted(r.pattern)
        parts.append(f"SELECT doc_id, {n} AS rank, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, {p}) AS f, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}, {r.group}) AS part FROM d WHERE regexp_matches(t, {p})")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    names = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
e AS (SELECT doc_id, rank, kind, least, f, g, part, unnest(range(1, len(f) + 1)) AS i FROM m),
s AS (SELECT doc_id, rank, kind, length(part[i]) >= least AS ok, length(f[i]) AS size, CAST(sum(length(g[i]) + length(f[i])) OVER (PARTITION BY doc_id, rank ORDER BY i) AS BIGINT) AS stop FROM e),
a AS (SELECT doc_id, {counts}, string_agg(kind || ':' || (stop - size) || ':' || stop, ',' ORDER BY stop - size, rank) AS spans, string_agg(kind || ':' || (stop - size) || ':' || stop, ',' ORDER BY stop - size, rank) FILTER (WHERE rank < {len(secrets.BASE)}) AS base FROM s WHERE ok GROUP BY doc_id)
SELECT d.doc_id, {names}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


def _url_filter() -> str:
    rules = ", ".join(f"({_quoted(h)}, {_quoted(p)}, {_quoted(v)})" for h, p, v in URL_RULES)
    return f"""WITH r(rhost, rpath, verdict) AS (VALUES {rules}),
u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{license_index.UPPER}', '{license_index.LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS (SELECT host, path, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY host, path ORDER BY length(rhost || rpath) DESC, rhost || rpath DESC) AS k
      FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, u.host, u.path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM j WHERE k = 1) b ON u.host = b.host AND u.path = b.path"""


def _license_scan() -> str:
    li = license_index
    places, templates = [], []
    for phrase, label in li.PHRASES.items():
        words = phrase.split()
        joins = "".join(f" JOIN w w{k} ON w{k}.doc_id = w0.doc_id AND w{k}.i = w0.i + {k} AND w{k}.w = '{x}'" for k, x in enumerate(words) if k)
        places.append(f"SELECT w0.doc_id, w0.i, '{label}' AS label FROM w w0{joins} WHERE w0.w = '{words[0]}'")
    for n, (label, text, key) in enumerate(li.TEMPLATES):
        words = text.split()
        at = next(k for k in range(len(words)) if words[k : k + len(key.split())] == key.split())
        templates += [f"({n}, '{label}', {len(words)}, {p}, '{w}', {int(at <= p < at + len(key.split()))}, {len(key.split())})" for p, w in enumerate(words)]
    return rf"""WITH l AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{li.UPPER}', '{li.LOWER}'), '{li.SEPARATORS}'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM l),
b AS ({" UNION ALL ".join(places)}),
t(n, label, size, p, w, key, keys) AS (VALUES {", ".join(templates)}),
c AS (SELECT doc_id, label, CAST(count(*) AS DOUBLE) / size AS share FROM w JOIN t USING (w) GROUP BY doc_id, n, label, size, keys, i - p HAVING count(*) >= {li.LEAST} * size AND sum(key) = keys),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION ALL SELECT doc_id, label FROM c) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS score FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM l LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)"""


def _preference() -> str:
    def side(conv: str) -> tuple[str, str]:
        text = f"(SELECT coalesce(string_agg(shown, '' ORDER BY i), '') FROM n WHERE conv_id = {conv} AND i > pre)"
        span = f"(SELECT coalesce(string_agg((cum - size + length(role) + 5 - coalesce((SELECT cum FROM n z WHERE z.conv_id = {conv} AND z.i = pre), 0)) || ':' || (cum - 1 - coalesce((SELECT cum FROM n z WHERE z.conv_id = {conv} AND z.i = pre), 0)), ',' ORDER BY i), '') FROM n WHERE conv_id = {conv} AND i > pre AND role = 'assistant')"
        return text, span

    chosen, rejected = side("chosen_id"), side("rejected_id")
    return f"""WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, role, txt, length(role) + length(txt) + 6 AS size, '<|' || role || '|>' || chr(10) || txt || chr(10) AS shown, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, txt) AS i FROM t),
n AS (SELECT *, CAST(sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS BIGINT) AS cum FROM o),
f AS (SELECT conv_id, role || chr(1) || txt AS first FROM n WHERE i = 1),
g AS (SELECT first, min(conv_id) AS chosen_id, count(*) AS k FROM f GROUP BY first),
p AS (SELECT chosen_id, CASE WHEN k > 1 THEN conv_id END AS rejected_id FROM f JOIN g USING (first) WHERE k = 1 OR conv_id <> chosen_id),
s AS (SELECT conv_id, max(i) AS size FROM n GROUP BY conv_id),
x AS (SELECT chosen_id, rejected_id, min(a.i) AS miss FROM p JOIN n a ON a.conv_id = chosen_id LEFT JOIN n b ON b.conv_id = rejected_id AND b.i = a.i AND b.role = a.role AND b.txt = a.txt WHERE b.i IS NULL GROUP BY chosen_id, rejected_id),
l AS (SELECT p.chosen_id, p.rejected_id, CAST(CASE WHEN p.rejected_id IS NULL THEN size - 1 ELSE coalesce(miss - 1, size) END AS BIGINT) AS pre
      FROM p JOIN s ON s.conv_id = p.chosen_id LEFT JOIN x ON x.chosen_id = p.chosen_id AND x.rejected_id = p.rejected_id)
SELECT chosen_id, rejected_id, pre AS prefix_turns, (SELECT coalesce(string_agg(shown, '' ORDER BY i), '') FROM n WHERE conv_id = chosen_id AND i <= pre) AS prompt,
{chosen[0]} AS chosen, {chosen[1]} AS chosen_mask, {rejected[0]} AS rejected, {rejected[1]} AS rejected_mask FROM l"""


def _maxscore() -> str:
    return """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q, v WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


def _quality_rules() -> str:
    d = divergence_rules
    space = r"[\x20\x09-\x0D]"
    kinds = [f"length(regexp_replace(coalesce(text, ''), {_quoted(p)}, '', 'g'))" for p in ("[^a-z]+", r"[^\x20\x09-\x0D]+")]
    kinds += [f"length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), {_quoted(p)}, '', 'g'))" for p in d.CLASSES]
    js = "sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)))"
    limits = " AND ".join(f"coalesce({c}, 0) <= {a} + {b} / sqrt(n_words)" for c, (a, b) in d.LIMITS.items())
    return rf"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, list_filter(string_split_regex(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS w, [{", ".join(kinds)}] AS c6 FROM documents),
u AS MATERIALIZED (SELECT *, len(w) AS n, list_append(c6, length(text) - list_sum(c6)::BIGINT) AS c, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM t),
heavy AS (SELECT text FROM u GROUP BY text HAVING count(*) > 1 AND count(*) * {d.HEAVY} > (SELECT count(*) FROM u)),
f AS MATERIALIZED (SELECT * FROM u WHERE length(text) >= {d.MIN_CHARS} AND text NOT IN (SELECT text FROM heavy)),
langs AS (SELECT lang, sum(n)::BIGINT AS total FROM f GROUP BY lang HAVING sum(n) >= {d.MIN_REFERENCE}),
qc AS (SELECT lang, i, s / sum(s) OVER (PARTITION BY lang) AS q FROM (SELECT lang, i, sum(v)::DOUBLE AS s FROM (SELECT lang, unnest(range(7)) AS i, unnest(c) AS v FROM f SEMI JOIN langs USING (lang)) GROUP BY lang, i)),
qw AS (SELECT lang, w, m / total AS q FROM (SELECT lang, w, m, row_number() OVER (PARTITION BY lang ORDER BY m DESC, w) AS k FROM (SELECT lang, lower(unnest(w)) AS w, count(*)::DOUBLE AS m FROM f GROUP BY lang, 2) WHERE NOT regexp_matches(w, '{d.NOT_LETTERS}')) JOIN langs USING (lang) WHERE k <= {d.COMMON}),
cd AS (SELECT r, {js} AS char_distance FROM (SELECT r, v / length(text) AS p, q FROM (SELECT r, lang, text, unnest(range(7)) AS i, unnest(c) AS v FROM u WHERE n >= {d.MIN_WORDS}) JOIN qc USING (lang, i)) GROUP BY r),
own AS (SELECT r, lower(unnest(w)) AS w, count(*) AS m FROM u WHERE n >= {d.MIN_WORDS} GROUP BY r, 2),
pw AS (SELECT u.r, coalesce(own.m, 0) / u.n AS p, qw.q FROM u JOIN qw ON qw.lang = u.lang LEFT JOIN own ON own.r = u.r AND own.w = qw.w WHERE u.n >= {d.MIN_WORDS}),
wd AS (SELECT r, {js} AS word_distance FROM (SELECT r, p, q FROM pw UNION ALL SELECT r, 1 - sum(p), 1 - sum(q) FROM pw GROUP BY r) GROUP BY r),
x AS (SELECT r, unnest(range(n - 2)) AS i, unnest(list_transform(range(n - 2), lambda i: concat_ws(' ', w[i + 1], w[i + 2], w[i + 3]))) AS run FROM u WHERE n >= 4),
again AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT r, i FROM x QUALIFY count(*) OVER (PARTITION BY r, run) > 1), range(3) AS o(k) GROUP BY r),
a AS (SELECT doc_id, n AS n_words, length(text) - c[2] AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, char_distance, word_distance
      FROM u LEFT JOIN again USING (r) LEFT JOIN cd USING (r) LEFT JOIN wd USING (r)),
b AS (SELECT *, n_words < {d.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {limits} AS kept, round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance FROM b"""


def _importance() -> str:
    m, li = importance, license_index
    words = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{li.UPPER}', '{li.LOWER}'), '{li.SEPARATORS}'), lambda x: x <> '')"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents),
b AS (SELECT unnest({words}) AS w FROM benchmark),
dw AS MATERIALIZED (SELECT r, unnest(words) AS w FROM d),
tab AS (SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce([n, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c >> s, 3988292384) ELSE c >> s END) AS c FROM range(256) AS o(n))),
v AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM b)),
bytes AS (SELECT w, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT) AS bs FROM v),
h AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % {m.BUCKETS} AS k FROM bytes, tab),
s AS (SELECT k, count(*) AS s FROM dw JOIN h USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM b JOIN h USING (w) GROUP BY k),
n AS (SELECT (SELECT count(*) FROM dw) + {m.BUCKETS} AS ns, (SELECT count(*) FROM b) + {m.BUCKETS} AS nt),
g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ns / ((s + 1)::DOUBLE * nt)))::BIGINT AS g FROM s LEFT JOIN t USING (k), n),
f AS (SELECT r, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN h USING (w) JOIN g USING (k) GROUP BY r),
x AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('{m.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN f USING (r)),
y AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))))::BIGINT AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {m.MIN_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER (PARTITION BY n_features >= {m.MIN_WORDS}) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {m.MIN_WORDS} AND k <= {m.PERCENT} * n // 100 THEN k END AS rank FROM z"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": _secret_scan(), "op5_preference": _preference(), "op6_url_filter": _url_filter(), "op7_license_scan": _license_scan(), "op9_maxscore": _maxscore(), "op11_quality_rules": _quality_rules(), "op12_importance": _importance()}
