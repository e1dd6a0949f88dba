"""Crawl frontier over a link table, and incremental crawl state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusq.functions.text import LINK_KEYWORDS
from corpusq.operators.extract import netloc, page_title
from corpusq.registry import query, table
from corpusq.sources.tables import kept


def crawl_frontier(links: DataFrame, start: DataFrame, max_depth: int = 2, max_pages: int = 100, per_page: int = 10, keywords: list[str] | None = None) -> DataFrame:
    """(url, depth) reached breadth-first from ``start(url)`` over ``links(src, dst)``.

    From a page the first ``per_page`` links (by url) that stay on its host, hold a keyword and have not been
    visited are followed; the depth is the shortest. ``max_pages`` keeps the first by depth and url. A level joins the links
    with its own pages before anything else is done to them, so only links of visited pages are tested and made distinct; the
    level is written, and levels are bounded by ``max_depth``. Null urls are left out.
    """
    words = LINK_KEYWORDS if keywords is None else keywords
    good = reduce(lambda a, b: a | b, [F.lower("dst").contains(k) for k in words], F.lit(not words))
    # written, so that its size is known and a small level is broadcast instead of shuffling all links
    level = kept(start.where("url is not null").select("url").distinct().withColumn("depth", F.lit(0)), "frontier-level")
    seen = level
    for depth in range(1, max_depth + 1):
        own = links.join(level.select(F.col("url").alias("src")), "src").where(good & (netloc(F.col("src")) == netloc(F.col("dst")))).select("src", "dst").distinct()
        new = own.join(seen.select(F.col("url").alias("dst")), "dst", "left_anti")
        first = new.withColumn("_n", F.row_number().over(W.partitionBy("src").orderBy("dst"))).where(F.col("_n") <= per_page)
        level = kept(first.select(F.col("dst").alias("url")).distinct().withColumn("depth", F.lit(depth)), "frontier-level")
        seen = seen.unionByName(level)
    return seen.orderBy("depth", "url").limit(max_pages)


def skip_visited(pages: DataFrame, visited: DataFrame, key: str = "url") -> DataFrame:
    return pages.join(visited.select(key), key, "left_anti")


def run_log(runs: DataFrame, keep: int = 30) -> DataFrame:
    """``runs(ts, documents, pages)`` with running totals, the last ``keep`` ones."""
    w = W.partitionBy(F.lit(0)).orderBy("ts")  # a row a run
    r = runs.withColumn("total_documents", F.sum("documents").over(w)).withColumn("total_pages", F.sum("pages").over(w))
    return r.orderBy(F.desc("ts")).limit(keep)


def crawl_summary(pages: DataFrame) -> DataFrame:
    """All pages of a crawl (page_id, title, url) of ``pages(page_id, title, url, text)``, each with the numbers of documents and pages of the whole."""
    total = pages.agg(F.count_if(F.length("text") >= 100).alias("documents_scraped"), F.count(F.lit(1)).alias("pages_visited"))
    return pages.select("page_id", "title", "url").join(F.broadcast(total))  # one row


def task_status_list(updates: DataFrame) -> DataFrame:
    """Latest status and number of updates of each task of ``updates(task_id, ts, event_id, status)``."""
    return updates.groupBy("task_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("updates"))


def _link_table(spark, sf_dir):
    """Order lines as links of pages: a page for each part, linked to the parts ordered with it."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    url = lambda c: F.concat(F.lit("http://h"), F.col("l_suppkey") % 2, F.lit("/p/"), c)
    return li.select(url(F.col("l_partkey")).alias("src"), F.concat(F.lit("http://h"), F.col("l_orderkey") % 2, F.lit("/p/"), F.col("l_orderkey") % 200).alias("dst"))


@query("""
WITH l AS (SELECT DISTINCT 'http://h' || l_suppkey % 2 || '/p/' || l_partkey AS src, 'http://h' || l_orderkey % 2 || '/p/' || l_orderkey % 200 AS dst FROM lineitem),
u AS (SELECT src, dst FROM l WHERE contains(dst, '1') AND src[:9] = dst[:9]),
l1 AS (SELECT DISTINCT dst AS url FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM u WHERE src IN ('http://h0/p/10', 'http://h1/p/11') AND dst NOT IN ('http://h0/p/10', 'http://h1/p/11')) WHERE n <= 10),
l2 AS (SELECT DISTINCT dst AS url FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM u WHERE src IN (SELECT url FROM l1) AND dst NOT IN (SELECT url FROM l1) AND dst NOT IN ('http://h0/p/10', 'http://h1/p/11')) WHERE n <= 10)
SELECT * FROM (SELECT 'http://h0/p/10' AS url, 0 AS depth UNION ALL SELECT 'http://h1/p/11', 0 UNION ALL SELECT url, 1 FROM l1 UNION ALL SELECT url, 2 FROM l2) ORDER BY depth, url LIMIT 100
""")
def crawl_frontier_lineitem(spark, sf_dir):
    start = spark.createDataFrame([("http://h0/p/10",), ("http://h1/p/11",)], "url string")
    return crawl_frontier(_link_table(spark, sf_dir), start, keywords=["1"])


@query("SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 4 = 0)")
def skip_visited_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages", "page_id", "url")
    return skip_visited(p, p.where("page_id % 4 = 0")).select("page_id", "url")


@query("""SELECT ts, documents, pages, CAST(sum(documents) OVER (ORDER BY ts) AS BIGINT) AS total_documents, CAST(sum(pages) OVER (ORDER BY ts) AS BIGINT) AS total_pages FROM
(SELECT date_trunc('day', ts) AS ts, count(*) FILTER (event_type = 'purchase') AS documents, count(*) AS pages FROM events GROUP BY 1) ORDER BY ts DESC LIMIT 30""")
def run_log_events(spark, sf_dir):
    e = table(spark, sf_dir, "events", "ts", "event_type")
    return run_log(e.groupBy(F.date_trunc("day", "ts").alias("ts")).agg(F.count_if(F.col("event_type") == "purchase").alias("documents"), F.count(F.lit(1)).alias("pages")))


@query("""SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)', 1)), ''), nullif(trim(regexp_extract(html, '<title[^>]*>([^<]*)', 1)), ''), 'Untitled') AS title, url,
count(*) FILTER (length(html) >= 100) OVER () AS documents_scraped, count(*) OVER () AS pages_visited FROM pages""")
def crawl_summary_pages(spark, sf_dir):
    return crawl_summary(table(spark, sf_dir, "pages").select("page_id", "url", page_title(F.col("html")).alias("title"), F.col("html").alias("text")))


@query("SELECT user_id AS task_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS updates FROM events GROUP BY user_id")
def task_status_list_events(spark, sf_dir):
    return task_status_list(table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), "ts", "event_id", F.col("event_type").alias("status")))
