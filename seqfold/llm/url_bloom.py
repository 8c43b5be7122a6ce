"""URL filters: a blocked Bloom filter of the listed canonical URLs, then an exact hash join.

The list holds rules, canonical URL prefixes (host, path, verdict). A URL is looked up under every suffix
of its host and prefix of its path of the sizes that the list has. A blocked Bloom filter with 512 bits to
a block, built and probed with SQL functions, lets possible hits pass; the exact join on the key drops
the false ones; the longest rule that fits wins.

Canonical form: the host, up to "/", "?" or "#" after the first "://", with A-Z lower-cased, and the path up to
"?" or "#". Null URLs and those without "://" have neither, fit no rule and get the default verdict.
Repeated rows are each judged; other input columns are ignored; an empty table gives an empty result; without
rules every URL gets the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
WORDS = 8  # 64-bit words of a block; a key sets a bit in each
BROADCAST_BLOCKS = 100_000  # filters up to this many blocks (8 MB) are broadcast, larger ones are joined by block
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and the bit that it sets in each word."""
    spread = F.xxhash64(key, F.lit("bits"))
    return F.pmod(F.xxhash64(key), F.lit(blocks)), [F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", spread, F.lit(6 * w)).bitwiseAND(63).cast("int")) for w in range(WORDS)]


def build(keys: DataFrame, key: str = "key") -> tuple[DataFrame, int]:
    """The filter's non-empty blocks (block, w0..w7), and the number of blocks."""
    n = keys.count()
    blocks = max(1, -(-n * BITS_PER_KEY // (64 * WORDS)))
    block, bits = _bits(F.col(key), blocks)
    rows = keys.select(block.alias("block"), *[b.alias(f"w{w}") for w, b in enumerate(bits)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)]), blocks


def possible(probes: DataFrame, bloom: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """The probes whose key may be in the filter."""
    block, bits = _bits(F.col(key), blocks)
    side = F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom
    joined = probes.withColumn("block", block).join(side, "block")
    for w, b in enumerate(bits):
        joined = joined.where(F.col(f"w{w}").bitwiseAND(b) != 0)
    return joined.select(probes.columns)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages.

    rules: (host, path, verdict), distinct by host and path. The sizes of the listed hosts (labels) and
    paths (characters) are gathered on the driver: they are bounded by the longest URL, not by the list."""
    listed = rules.select("host", "path", "verdict", F.concat_ws("\u0001", "host", "path").alias("key"))
    sizes = rules.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    host, path = canonical(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not sizes.labels:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    shapes = urls.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    hosts = F.filter(F.array(*[F.when(F.size(labels) >= n, F.substring_index("host", ".", -n)) for n in sorted(sizes.labels)]), lambda h: h.isNotNull())
    paths = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(sizes.lengths)]), lambda p: p.isNotNull())
    probes = shapes.select("host", "path", F.explode(F.array_distinct(hosts)).alias("h"), paths.alias("p")).select("host", "path", "h", F.explode(F.array_distinct("p")).alias("p"))
    probes = probes.select("host", "path", F.concat_ws("\u0001", "h", "p").alias("key"))
    bloom, blocks = build(listed)
    exact = possible(probes, bloom, blocks).join(listed.select("key", "verdict", F.concat("host", "path").alias("rule")), "key")
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best")).select("host", "path", "best.rule", "best.verdict")
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
