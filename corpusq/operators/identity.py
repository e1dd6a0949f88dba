"""Content hashes, de-duplication, change detection against a stored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusq.functions.text import TITLE_SUFFIX, markdown_title_backfill
from corpusq.registry import query, table


def content_hash_md5(c: Column) -> Column:
    return F.md5(c)


def content_hash_sha256(parts: Column) -> Column:
    """Hash of list content: its parts joined with a space."""
    return F.sha2(F.array_join(parts, " "), 256)


def dedup_by_url(df: DataFrame, url: str, order: str) -> DataFrame:
    """The first row (by ``order``) of each url."""
    w = W.partitionBy(url).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert_changes(incoming: DataFrame, stored: DataFrame, key: str = "url", digest: str = "hash") -> DataFrame:
    """Incoming rows with ``change``: new (not stored), updated (another hash) or unchanged; discovery items are left out."""
    i = incoming.where(F.coalesce(F.col("type"), F.lit("")) != "discovery") if "type" in incoming.columns else incoming
    s = stored.select(F.col(key).alias("_k"), F.col(digest).alias("_h"))
    change = F.when(F.col("_k").isNull(), "new").when(F.col("_h") != F.col(digest), "updated").otherwise("unchanged")
    return i.join(s, F.col(key) == F.col("_k"), "left").withColumn("change", change).drop("_k", "_h")


def upsert_table(incoming: DataFrame, stored: DataFrame, key: str = "url", digest: str = "hash") -> DataFrame:
    """The stored table after the upsert: new and updated rows from ``incoming``, all others as they are."""
    changed = upsert_changes(incoming, stored, key, digest).where("change <> 'unchanged'").select(*stored.columns)
    return stored.join(changed.select(key), key, "left_anti").select(*stored.columns).unionByName(changed)


def exact_duplicate_groups(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Contents that several rows share: hash, number, first key. Only (hash, key) is shuffled, and combined before."""
    g = df.select(F.md5(text).alias("hash"), key).groupBy("hash")
    return g.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id")).where("n > 1")


def title_backfill(docs: DataFrame, chunks: DataFrame, suffix: str = TITLE_SUFFIX) -> DataFrame:
    """Documents whose recomputed title differs, with the number of their chunks whose metadata change along."""
    new = docs.withColumn("new_title", markdown_title_backfill(F.col("text"), suffix)).where(~F.col("new_title").eqNullSafe(F.col("title")))
    n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_updates"))
    return new.join(n, "doc_id", "left").select("doc_id", "title", "new_title", F.coalesce("chunk_updates", F.lit(0)).alias("chunk_updates"))


@query("SELECT doc_id, md5(text) AS content_hash FROM documents")
def content_hash_md5_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", content_hash_md5(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, sha256(array_to_string(string_split(text, chr(10)), ' ')) AS content_hash FROM documents")
def content_hash_sha256_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", content_hash_sha256(F.split("text", "\n")).alias("content_hash"))


@query("SELECT page_id, url FROM (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS url, row_number() OVER (PARTITION BY regexp_extract(url, '^([^?#]*)', 1) ORDER BY page_id) AS n FROM pages) WHERE n = 1")
def dedup_by_url_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^([^?#]*)", 1).alias("url"))
    return dedup_by_url(pages, "url", "page_id")


def _split_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc/"), "doc_id").alias("url"), "text")
    stored = d.where("doc_id % 3 <> 0").select("url", F.md5("text").alias("hash"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text"))
    return d.select("doc_id", "url", F.md5(changed).alias("hash"), F.when(F.col("doc_id") % 7 == 0, "discovery").otherwise("document").alias("type")), stored


@query("""
WITH i AS (SELECT doc_id, 'doc/' || doc_id AS url, md5(CASE WHEN doc_id % 5 = 0 THEN text || ' (revised)' ELSE text END) AS hash FROM documents WHERE doc_id % 7 <> 0),
s AS (SELECT 'doc/' || doc_id AS url, md5(text) AS hash FROM documents WHERE doc_id % 3 <> 0)
SELECT i.doc_id, i.url, i.hash, CASE WHEN s.url IS NULL THEN 'new' WHEN s.hash <> i.hash THEN 'updated' ELSE 'unchanged' END AS change FROM i LEFT JOIN s ON s.url = i.url
""")
def upsert_changes_documents(spark, sf_dir):
    incoming, stored = _split_documents(spark, sf_dir)
    return upsert_changes(incoming, stored).drop("type")


@query("""
WITH i AS (SELECT 'doc/' || doc_id AS url, md5(CASE WHEN doc_id % 5 = 0 THEN text || ' (revised)' ELSE text END) AS hash FROM documents WHERE doc_id % 7 <> 0),
s AS (SELECT 'doc/' || doc_id AS url, md5(text) AS hash FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(i.url, s.url) AS url, coalesce(i.hash, s.hash) AS hash FROM s FULL JOIN i ON s.url = i.url
""")
def upsert_table_documents(spark, sf_dir):
    incoming, stored = _split_documents(spark, sf_dir)
    return upsert_table(incoming, stored)


@query("SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY md5(text) HAVING count(*) > 1")
def exact_duplicate_groups_documents(spark, sf_dir):
    return exact_duplicate_groups(table(spark, sf_dir, "documents").where("text is not null"))
