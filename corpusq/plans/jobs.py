"""Whole jobs: ingest of pages, backlog, incremental re-embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.functions.text import clean_text, detect_language
from corpusq.operators.chunk import _window_sql, chunk_char_window
from corpusq.operators.extract import min_length_filter, page_main_text
from corpusq.operators.identity import dedup_by_url, upsert_changes
from corpusq.operators.vectors import embed_texts
from corpusq.registry import query, table


def page_documents(pages: DataFrame) -> DataFrame:
    """Pages -> documents (doc_id, url, title, language, hash, text): main text, length filter, language, hash. No shuffle."""
    text = page_main_text(pages.where("url is not null"), keep=("url",))
    kept = min_length_filter(text.withColumn("text", clean_text(F.col("text"))))
    return kept.select(F.col("page_id").alias("doc_id"), "url", "title", detect_language(F.col("text")).alias("language"), F.md5("text").alias("hash"), "text")


def ingest_pages(pages: DataFrame) -> DataFrame:
    """The documents of ``page_documents``, of each url the first by page; pages without a url are left out."""
    return dedup_by_url(page_documents(pages), "url", "doc_id")


def refresh_vectors(chunks: DataFrame, stored: DataFrame, encoder=None) -> DataFrame:
    """The vector table of ``chunks(doc_id, chunk_index, content)``, encoding only contents that their document had not before.

    ``stored(doc_id, hash, embedding)`` and more columns is the table so far. A chunk whose content's hash stands among its document's
    stored ones keeps that vector, wherever in the document it stands now; chunks that are gone are left out; every other
    content is encoded once, however many chunks share it. Stored rows without a vector count as not encoded.
    Returns (vector_id, doc_id, chunk_index, content, hash, embedding).
    """
    c = chunks.select("doc_id", "chunk_index", F.coalesce("content", F.lit("")).alias("content")).withColumn("hash", F.md5("content"))
    old = stored.where("embedding is not null").groupBy("doc_id", "hash").agg(F.first("embedding").alias("_old"))
    found = c.join(old, ["doc_id", "hash"], "left")
    new = found.where("_old is null").groupBy("hash").agg(F.first("content").alias("text"))
    made = embed_texts(new, "hash", encoder=encoder).withColumnRenamed("embedding", "_new")
    out = found.join(made, "hash", "left")
    return out.select(F.format_string("doc_%d_chunk_%d", "doc_id", "chunk_index").alias("vector_id"), "doc_id", "chunk_index", "content", "hash", F.coalesce("_old", "_new").alias("embedding"))


def processing_backlog(incoming: DataFrame, stored: DataFrame, vectors: DataFrame, everything: bool = False, encoder=None) -> DataFrame:
    """The vector table after the backlog of ``incoming(doc_id, url, hash, text)`` against ``stored(url, hash)``.

    New and updated documents (all with ``everything``) are cut to chunks and go through ``refresh_vectors``; rows of other
    documents in ``vectors`` stay as they are, and chunks that an updated document no longer has are gone.
    """
    due = incoming if everything else upsert_changes(incoming, stored).where("change <> 'unchanged'")
    chunks = chunk_char_window(due.select("doc_id", "text"))
    fresh = refresh_vectors(chunks, vectors.join(due.select("doc_id"), "doc_id", "left_semi"), encoder)
    rest = vectors.join(due.select("doc_id"), "doc_id", "left_anti").select(*fresh.columns)
    return rest.unionByName(fresh)


def reembed_missing(chunks: DataFrame, key: str = "vec_id", encoder=None) -> DataFrame:
    """Chunks (key, text, embedding) with an embedding each: contents of those without one are encoded, each once, and attached."""
    have, lack = chunks.where("embedding is not null"), chunks.where("embedding is null").withColumn("_hash", F.md5(F.coalesce("text", F.lit(""))))
    made = embed_texts(lack.groupBy("_hash").agg(F.first(F.coalesce("text", F.lit(""))).alias("text")), "_hash", encoder=encoder).withColumnRenamed("embedding", "_new")
    return have.unionByName(lack.join(made, "_hash", "left").withColumn("embedding", F.col("_new")).select(*chunks.columns))


def _stored_vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, the stored (url, hash) of two thirds of them with every fourth changed since, and the vectors of that time."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("url", F.concat(F.lit("doc/"), "doc_id"))
    then = d.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("An older beginning. "), "text")).otherwise(F.col("text")))
    none = table(spark, sf_dir, "documents", "doc_id").select("doc_id", F.lit("").alias("hash"), F.lit(None).cast("array<float>").alias("embedding")).limit(0)
    return d.withColumn("hash", F.md5("text")), then.select("url", F.md5("text").alias("hash")), refresh_vectors(chunk_char_window(then.select("doc_id", "text")), none)


@query()
def ingest_pages_pages(spark, sf_dir):
    return ingest_pages(table(spark, sf_dir, "pages")).drop("text")


@query(_window_sql(1024, 128, "SELECT 'doc_' || doc_id || '_chunk_' || chunk_index AS vector_id, doc_id, chunk_index, content, md5(content) AS hash, 64 AS width FROM k"))
def processing_backlog_documents(spark, sf_dir):
    """After the backlog the table has the chunks of every document as it is now."""
    out = processing_backlog(*_stored_vectors(spark, sf_dir))
    return out.select("vector_id", "doc_id", "chunk_index", "content", "hash", F.size("embedding").alias("width"))


@query()
def reembed_missing_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("doc_id", "vec_id")
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding").where("vec_id % 4 <> 0")
    return reembed_missing(d.join(e, "vec_id", "left")).select("vec_id", "embedding")
