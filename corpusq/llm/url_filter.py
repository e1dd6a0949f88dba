"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LANES = 4  # 64-bit words in a block; a key sets one bit in each
BITS_PER_KEY = 16

#: The rules of the registered query: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def canonical(url: str) -> tuple[Column, Column]:
    """Host and path of a url column; both empty for a null url or one without ``://``."""
    c = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.locate("://", c)
    rest = F.when(at > 0, F.substring(c, at + 3, F.length(c))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _with_bits(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """Adds the key's block number and its bit in each lane of the block."""
    h = F.xxhash64(F.lit(7), F.col(key))
    bit = lambda i: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_h, {6 * i}) & 63 as int))")
    df = df.withColumn("_h", h)
    return df.select(*df.columns, F.pmod(F.xxhash64(key), F.lit(blocks).cast("long")).alias("_block"), *(bit(i).alias(f"_b{i}") for i in range(LANES))).drop("_h")


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """Blocked Bloom filter as a table: a row for each non-empty block of 256 bits, in four longs."""
    return _with_bits(keys.select(key), key, blocks).groupBy("_block").agg(*(F.bit_or(f"_b{i}").alias(f"_w{i}") for i in range(LANES)))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as a table of literals, which no Python worker has to read."""
    rows = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(r, ("host", "path", "verdict")))) for r in rules))
    return spark.range(1).select(F.inline(rows))


def judge_urls(urls: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Verdict for every row of ``urls``, by ``rules(host, path, verdict)`` and exact ``listed(host, path)`` URLs.

    A rule fits its host and all subdomains where the url's path starts with the rule's path; the longest
    ``host||path`` wins (of equal ones the longer host). Without a rule, a listed canonical URL is blocked and
    any other allowed. Returns (id, host, path, rule, verdict), one row for each input row.

    Every candidate key of a distinct (host, path) is probed in the Bloom filter of listed keys; only possible
    hits go on to the hash join that removes false positives: shuffled by key, with a table of each partition's
    listed keys, however many there are. The listed keys are written once. The filter is broadcast up to
    ``broadcast_bytes`` (its size is known), else joined by block. Null urls, and those without ``://``, have
    empty host and path and match nothing; repeated and null ids keep their rows; empty tables, rules and
    lists are fine; other columns are ignored.
    """
    host, path = canonical(url_col)
    rows = urls.select(F.col(id_col), host.alias("host"), path.alias("path"))
    entries = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        F.concat(F.lit("r"), "host", "path").alias("entry"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("plen"),
        F.concat("host", "path").alias("rule"), "verdict", (F.length("host") + F.length("path")).alias("long"), F.length("host").alias("hlen"),
    )
    exact = listed.where(F.col("host") != "").select(
        F.concat(F.lit("u"), "host", "path").alias("entry"), F.lit(0).alias("labels"), F.lit(0).alias("plen"),
        F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), F.lit(-1).alias("long"), F.lit(-1).alias("hlen"),
    ).distinct()
    entries = written(entries.unionByName(exact), "url-entries")
    n = entries.count()
    shapes = [(r["labels"], r["plen"]) for r in entries.where("labels > 0").select("labels", "plen").distinct().collect()]  # label counts x path lengths, not rules
    blocks = max(1, -(-n * BITS_PER_KEY // (64 * LANES)))

    distinct = rows.where("host <> ''").select("host", "path").distinct()
    parts = distinct.withColumn("_p", F.split("host", r"\."))
    keys = [F.concat(F.lit("u"), "host", "path")]
    for labels, plen in sorted(shapes):
        fits = (F.size("_p") >= labels) & (F.length("path") >= plen)
        keys.append(F.when(fits, F.concat(F.lit("r"), F.array_join(F.slice("_p", -labels, labels), "."), F.substring("path", 1, plen))))
    probes = parts.select("host", "path", F.explode(F.array_compact(F.array(*keys))).alias("key"))
    probes = _with_bits(probes, "key", blocks)
    bloom = bloom_filter(entries, "entry", blocks)
    bloom = F.broadcast(bloom) if blocks * 8 * (LANES + 1) <= broadcast_bytes else bloom
    every = F.lit(True)
    for i in range(LANES):
        every = every & (F.col(f"_b{i}").bitwiseAND(F.col(f"_w{i}")) != 0)
    possible = probes.join(bloom, "_block").where(every).select("host", "path", "key")

    hits = possible.join(entries.hint("shuffle_hash"), possible["key"] == entries["entry"]).select("host", "path", "rule", "verdict", "long", "hlen")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct("long", "hlen", "rule", "verdict")).alias("b"))
    best = best.select("host", "path", "b.rule", "b.verdict")
    return rows.join(best, ["host", "path"], "left").select(id_col, "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for all pages by the fixed rules; canonical URLs that several pages share are the listed ones."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host, path = canonical("url")
    listed = pages.select(host.alias("host"), path.alias("path")).groupBy("host", "path").count().where("count > 1").drop("count")
    return judge_urls(pages, rule_table(spark, RULES), listed)


ORACLE = """
WITH r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
c AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
u AS (SELECT DISTINCT host, path FROM c),
f AS (SELECT u.host, u.path, r.host || r.path AS rule, r.verdict,
      row_number() OVER (PARTITION BY u.host, u.path ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC) AS n
      FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)),
l AS (SELECT host, path FROM c WHERE host <> '' GROUP BY host, path HAVING count(*) > 1)
SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.verdict, CASE WHEN l.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN f ON f.host = c.host AND f.path = c.path AND f.n = 1 LEFT JOIN l ON l.host = c.host AND l.path = c.path
"""
