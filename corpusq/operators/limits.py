"""Rate limits as analytics over request tables, and request validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusq.functions.text import prefixes
from corpusq.functions.time import epoch_seconds
from corpusq.registry import query, table

PERIODS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
TIERS = {"guest": 10, "user": 60, "admin": 1000}


def parse_rate_limit(spec: Column) -> Column:
    """``10/minute`` -> (limit 10, seconds 60); any other period is an error."""
    parts = F.split(spec, "/")
    seconds = F.create_map(*(F.lit(x) for kv in PERIODS.items() for x in kv))[F.lower(F.trim(parts[1]))]
    return F.struct(parts[0].cast("int").alias("limit"), F.coalesce(seconds, F.raise_error(F.concat(F.lit("unknown period in rate limit "), spec)).cast("int")).alias("seconds"))


def rate_limit_fixed_window(requests: DataFrame, key: str, limit: int | str, seconds: int, order: str = "event_id") -> DataFrame:
    """``allowed``, ``remaining`` and ``reset_at`` of each request: the n-th of its key in a window from the epoch on passes iff n <= limit.

    ``limit`` is a number or a column name. Denied requests count. The key and the window are shuffled together,
    so a key's rows spread over its windows.
    """
    top = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    bucket = F.floor(epoch_seconds("ts") / seconds).cast("long")
    r = requests.withColumn("_bucket", bucket)
    r = r.withColumn("n", F.row_number().over(W.partitionBy(key, "_bucket").orderBy("ts", order)))
    return r.withColumns({"allowed": F.col("n") <= top, "remaining": F.greatest(F.lit(0), top - F.col("n")), "reset_at": (F.col("_bucket") + 1) * seconds}).drop("_bucket")


def limit_rule_by_path(path: Column, guest: str = "10/minute", user: str = "60/minute", public: str = "/api/v1/public") -> Column:
    return F.when(F.startswith(path, F.lit(public)), guest).otherwise(user)


def limit_rules_by_path(requests: DataFrame, rules: DataFrame, path: str = "path", default: str = "60/minute") -> DataFrame:
    """Requests with ``rule``: that of the longest of ``rules(prefix, rule)`` their path begins with; of equal prefixes the first rule.

    Distinct paths are cut to the lengths that prefixes have and meet them by equality, however many rules there are.
    """
    one = rules.where("prefix is not null").groupBy(F.col("prefix").alias("_prefix")).agg(F.min("rule").alias("_rule"))
    lengths = one.agg(F.collect_set(F.length("_prefix")).alias("_lengths"))  # one row, of at most the longest prefix
    cut = prefixes(requests.select(F.col(path).alias("_path")).distinct().crossJoin(F.broadcast(lengths)), "_path", "_lengths", "_prefix")
    best = cut.join(one, "_prefix").groupBy("_path").agg(F.max_by("_rule", F.length("_prefix")).alias("_rule"))
    return requests.join(best, F.col(path) == F.col("_path"), "left").select(*requests.columns, F.coalesce("_rule", F.lit(default)).alias("rule"))


def client_key(forwarded: Column, real_ip: Column, peer: Column) -> Column:
    """First forwarded address, else the real one, else the peer, else ``unknown``."""
    empty = F.lit("")
    return F.coalesce(F.nullif(F.trim(F.split(forwarded, ",")[0]), empty), F.nullif(F.trim(real_ip), empty), F.nullif(F.trim(peer), empty), F.lit("unknown"))


def rate_limited_share(requests: DataFrame, key: str, tier: str, tiers: dict[str, int] = TIERS, seconds: int = 60) -> DataFrame:
    """Denied share of requests a tier."""
    r = requests.withColumn("_limit", F.create_map(*(F.lit(x) for kv in tiers.items() for x in kv))[F.col(tier)])
    r = rate_limit_fixed_window(r, key, "_limit", seconds)
    return r.groupBy(tier).agg(F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("allowed")).alias("denied"), F.round(F.count_if(~F.col("allowed")) / F.count(F.lit(1)), 6).alias("share"))


def valid_queries(df: DataFrame, text: str, language: str, languages: tuple[str, ...] = ("ka", "ru", "en"), default: str = "ru", most: int = 2000) -> DataFrame:
    """Rows with ``reason``: null for a valid query, else what is wrong; a null language counts as the default."""
    n = F.length(text)
    reason = F.when(F.col(text).isNull() | (n < 1), "empty").when(n > most, "too long").when(~F.coalesce(F.col(language), F.lit(default)).isin(*languages), "language")
    return df.withColumn("reason", reason)


def valid_crawl_requests(df: DataFrame, host: str) -> DataFrame:
    """Requests (url, max_depth, max_pages) with ``reason``: depth 1-5, pages 1-500, host part of the url."""
    reason = F.when(~F.col("max_depth").between(1, 5), "depth").when(~F.col("max_pages").between(1, 500), "pages").when(~F.coalesce(F.col("url").contains(host), F.lit(False)), "host")
    return df.withColumn("reason", reason)


@query("""WITH s AS (SELECT event_id, (user_id % 20 + 1) || '/' || CASE event_id % 4 WHEN 0 THEN 'second' WHEN 1 THEN 'minute' WHEN 2 THEN 'hour' ELSE 'day' END AS spec, user_id % 20 + 1 AS max_requests, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 ELSE 86400 END AS seconds FROM events) SELECT event_id, spec, CAST(max_requests AS INT) AS max_requests, seconds FROM s""")
def parse_rate_limit_events(spark, sf_dir):
    period = F.element_at(F.array(*map(F.lit, PERIODS)), (F.col("event_id") % 4 + 1).cast("int"))
    e = table(spark, sf_dir, "events", "event_id", "user_id").select("event_id", F.concat(F.col("user_id") % 20 + 1, F.lit("/"), period).alias("spec"))
    return e.withColumn("r", parse_rate_limit(F.col("spec"))).select("event_id", "spec", F.col("r.limit").alias("max_requests"), "r.seconds")


_K2 = "WITH k AS (SELECT event_id, user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS b, ts FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, b ORDER BY ts, event_id) AS n FROM k) "


@query(_K2 + "SELECT event_id, user_id, n, n <= 2 AS allowed, greatest(0, 2 - n) AS remaining, (b + 1) * 3600 AS reset_at FROM n")
def rate_limit_fixed_window_events(spark, sf_dir):
    return rate_limit_fixed_window(table(spark, sf_dir, "events", "event_id", "user_id", "ts"), "user_id", 2, 3600).select("event_id", "user_id", "n", "allowed", "remaining", "reset_at")


@query("SELECT page_id, CASE WHEN starts_with(p, '/en') THEN '10/minute' ELSE '60/minute' END AS rule FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)")
def limit_rule_by_path_pages(spark, sf_dir):
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", limit_rule_by_path(path, public="/en").alias("rule"))


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages),
r AS (SELECT DISTINCT p[1:4] AS prefix, (length(p) % 7 + 1) || '/second' AS rule FROM u WHERE page_id % 2 = 0 UNION SELECT p, '9/hour' FROM u WHERE page_id % 3 = 0), o AS (SELECT prefix, min(rule) AS rule FROM r GROUP BY prefix)
SELECT page_id, coalesce((SELECT max_by(o.rule, length(o.prefix)) FROM o WHERE starts_with(u.p, o.prefix)), '60/minute') AS rule FROM u""")
def limit_rules_by_path_pages(spark, sf_dir):
    """Rules of short prefixes and of whole paths, as many as there are pages."""
    u = table(spark, sf_dir, "pages", "page_id", "url").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    short = u.where("page_id % 2 = 0").select(F.substring("path", 1, 4).alias("prefix"), F.concat(F.length("path") % 7 + 1, F.lit("/second")).alias("rule"))
    rules = short.unionByName(u.where("page_id % 3 = 0").select(F.col("path").alias("prefix"), F.lit("9/hour").alias("rule")))
    return limit_rules_by_path(u, rules).select("page_id", "rule")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '10.0.0.' || user_id WHEN event_id % 3 = 0 THEN '10.1.0.' || user_id WHEN event_id % 2 = 0 THEN '10.2.0.' || user_id ELSE 'unknown' END AS client FROM events")
def client_key_events(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "user_id")
    ip = lambda n, k: F.when(F.col("event_id") % n == 0, F.concat(F.lit(k), "user_id"))
    return e.select("event_id", client_key(F.coalesce(F.concat(ip(4, " 10.0.0."), F.lit(", 1.1.1.1")), F.lit(" ,")), ip(3, "10.1.0."), ip(2, "10.2.0.")).alias("client"))


@query("""WITH k AS (SELECT event_id, user_id, CASE WHEN user_id % 10 = 0 THEN 'admin' WHEN user_id % 2 = 0 THEN 'user' ELSE 'guest' END AS tier, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS b, ts FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, b ORDER BY ts, event_id) AS n, CASE tier WHEN 'admin' THEN 20 WHEN 'user' THEN 3 ELSE 1 END AS m FROM k)
SELECT tier, count(*) AS requests, count(*) FILTER (n > m) AS denied, round(count(*) FILTER (n > m) / count(*), 6) AS share FROM n GROUP BY tier""")
def rate_limited_share_events(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts").withColumn("tier", F.when(F.col("user_id") % 10 == 0, "admin").when(F.col("user_id") % 2 == 0, "user").otherwise("guest"))
    return rate_limited_share(e, "user_id", "tier", {"guest": 1, "user": 3, "admin": 20}, 86400)


@query("SELECT conv_id, turn, CASE WHEN text IS NULL OR length(text) < 1 THEN 'empty' WHEN length(text) > 200 THEN 'too long' WHEN turn % 5 = 4 THEN 'language' END AS reason FROM conversations")
def valid_queries_conversations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("language", F.when(F.col("turn") % 5 == 4, "xx").when(F.col("turn") % 5 == 3, "en"))
    return valid_queries(c, "text", "language", most=200).select("conv_id", "turn", "reason")


@query("SELECT page_id, CASE WHEN page_id % 7 NOT BETWEEN 1 AND 5 THEN 'depth' WHEN page_id % 600 NOT BETWEEN 1 AND 500 THEN 'pages' WHEN NOT contains(url, 'example.org') THEN 'host' END AS reason FROM pages")
def valid_crawl_requests_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages", "page_id", "url").withColumns({"max_depth": F.col("page_id") % 7, "max_pages": F.col("page_id") % 600})
    return valid_crawl_requests(p, "example.org").select("page_id", "reason")
