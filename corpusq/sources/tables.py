"""Readers and writers: documents, page snapshots (batch and stream), crawl state, JSON export."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.registry import query, table


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, or a temporary one in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusq-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    whole = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    whole = re.sub("^file:/+", "file:///", whole)
    return f"{whole.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new shared folder and read again: cuts lineage, survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_documents(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Only the named columns of a stored relation."""
    return spark.read.parquet(path).select(*columns)


def page_snapshots(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Page snapshots with content, as a table or as a stream of files; failed fetches (null or empty html) give no row."""
    reader = spark.readStream.schema("page_id long, url string, html string") if stream else spark.read
    return reader.parquet(path).where("html is not null and html <> ''")


def save_state(visited: DataFrame, path: str) -> None:
    """Append urls to the visited set."""
    visited.select("url").write.mode("append").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("url string").parquet(path).distinct()


def json_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def scan_documents_documents(spark, sf_dir):
    return scan_documents(spark, f"{sf_dir}/documents.parquet", "doc_id", "lang", "source", "n_chars")


@query("SELECT page_id, url, length(html) AS n FROM pages WHERE html IS NOT NULL AND html <> ''")
def page_snapshot_source_pages(spark, sf_dir):
    return page_snapshots(spark, f"{sf_dir}/pages.parquet").select("page_id", "url", F.length("html").cast("long").alias("n"))


@query("SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def state_sink_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages", "page_id", "url")
    path = work_dir(spark, "visited")
    save_state(p.where("page_id % 6 = 0"), path)
    save_state(p.where("page_id % 6 = 3"), path)
    return p.join(load_state(spark, path), "url", "left_anti").select("page_id", "url")


@query("SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, count(DISTINCT url) AS links FROM pages GROUP BY 1")
def json_export_pages(spark, sf_dir):
    path = work_dir(spark, "export")
    hosts = table(spark, sf_dir, "pages", "url").groupBy(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host")).agg(F.countDistinct("url").alias("links"))
    json_export(hosts, path)
    return spark.read.schema("host string, links long").json(path)
