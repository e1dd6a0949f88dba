"""Chunking: tokens, paragraphs, sentences, overlapping character windows, packed paragraphs, chunk records."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusq.functions.text import estimate_tokens, paragraphs, sentences
from corpusq.registry import query, table

CHUNKS = "doc_id long, chunk_index int, begin int, end int, content string"


WINDOW = pa.schema([("doc_id", pa.int64()), ("chunk_index", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("content", pa.string())])
PACKED = pa.schema([("doc_id", pa.int64()), ("chunk_index", pa.int32()), ("content", pa.string()), ("tokens_count", pa.int32())])


def pieces(batches: Iterable[pa.RecordBatch], cut: Callable[[int, str], Iterable[tuple]], schema: pa.Schema, content: int, chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows that ``cut`` makes of each id and text, handed on when their column ``content`` has ``chars`` characters; one text at a time leaves Arrow."""
    out, used = [], 0
    for b in batches:
        for d, t in zip(b.column(0), b.column(1)):
            for row in cut(d.as_py(), t.as_py()):
                out.append(row)
                used += len(row[content])
                if used >= chars:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), schema.types)], schema=schema)
                    out, used = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), schema.types)], schema=schema)


def windows(text: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """Character windows (begin, end, content) that end at the last stop mark in reach; contents are stripped, empty ones dropped.

    A text of ``size`` or fewer characters is one window as it is.
    """
    n = len(text)
    if n <= size:
        return [(0, n, text)]
    out, start = [], 0
    while start < n:
        end = start + size
        if end < n:
            last = max(map(text[start + overlap + 1 : end + 1].rfind, ".!?\n"))
            end = start + overlap + 2 + last if last >= 0 else end
        content = text[start:end].strip()
        if content:
            out.append((start, min(end, n), content))
        start = end - overlap
    return out


def chunk_char_window(docs: DataFrame, size: int = 1024, overlap: int = 128) -> DataFrame:
    """(doc_id, chunk_index, begin, end, content) of every text; null texts have no chunks."""
    overlap = overlap or 128
    if overlap >= size:
        raise ValueError("overlap must be less than size")

    cut = lambda d, t: ((d, i, *w) for i, w in enumerate(windows(t, size, overlap)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").mapInArrow(lambda batches: pieces(batches, cut, WINDOW, 4), CHUNKS)


def pack(text: str | None, size: int, overlap: int) -> list[tuple[str, int]]:
    """Greedy packing of paragraphs (of their sentences where they are too large) to chunks of about ``size`` tokens.

    A full chunk's last ``overlap`` characters start the next one. Returns (content, tokens before stripping).
    """
    if not text or not text.strip():
        return []
    tokens = lambda s: len(s) // 4
    units: list[tuple[str, str, bool]] = []  # piece, joint, does it first close the open chunk
    for para in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if not para:
            continue
        if tokens(para) > size:
            units += [(s, " ", i == 0) for i, s in enumerate(x.strip() for x in re.split(r"(?<=[.!?])\s+", para)) if s]
        else:
            units.append((para, "\n\n", False))
    out, now, used = [], "", 0
    for piece, joint, close in units:
        if close and now:
            out.append(now)
            now, used = "", 0
        if now and used + tokens(piece) > size:
            out.append(now)
            now = now[-overlap:] + " " + piece
            used = tokens(now)
        else:
            now = now + joint + piece if now else piece
            used += tokens(piece)
    if now.strip():
        out.append(now)
    return [(c.strip(), tokens(c)) for c in out]


def chunk_paragraph_tokens(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk_index, content, tokens_count) of packed paragraphs; ``overlap`` counts characters."""
    cut = lambda d, t: ((d, i, c, n) for i, (c, n) in enumerate(pack(t, size, overlap)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: pieces(batches, cut, PACKED, 2), "doc_id long, chunk_index int, content string, tokens_count int")


def chunk_records(chunks: DataFrame, docs: DataFrame, source: str = "corpus") -> DataFrame:
    """Chunks with position (their index), total, tokens, vector id and the metadata map of their document."""
    total = F.count(F.lit(1)).over(W.partitionBy("doc_id"))
    c = chunks.withColumn("total_chunks", total.cast("int")).withColumn("tokens_count", estimate_tokens(F.col("content")))
    c = c.withColumn("vector_id", F.format_string("doc_%d_chunk_%d", "doc_id", "chunk_index"))
    meta = F.create_map(
        F.lit("document_id"), F.col("doc_id").cast("string"), F.lit("chunk_id"), F.col("chunk_index").cast("string"), F.lit("title"), F.col("title"), F.lit("document_type"), F.col("document_type"),
        F.lit("language"), F.col("language"), F.lit("source_url"), F.col("source_url"), F.lit("chunk_index"), F.col("chunk_index").cast("string"), F.lit("total_chunks"), F.col("total_chunks").cast("string"), F.lit("source"), F.lit(source),
    )
    return c.join(docs.select("doc_id", "title", "document_type", "language", "source_url"), "doc_id").select(
        "vector_id", "doc_id", "chunk_index", F.col("chunk_index").alias("position"), "total_chunks", "tokens_count", "content", meta.alias("metadata")
    )


def parse_vector_id(c: Column) -> Column:
    """The number after the last underscore; null where there is none."""
    return F.element_at(F.split(c, "_"), -1).try_cast("long")


@query("SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def estimate_tokens_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


@query(r"""SELECT doc_id, i - 1 AS at, ps[i] AS paragraph FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), '\n\s*\n'),
lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents))""")
def split_paragraphs_documents(spark, sf_dir):
    text = F.replace("text", F.lit(". "), F.lit(".\n \n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(paragraphs(text)).alias("at", "paragraph")).withColumn("at", F.col("at").cast("long"))


@query(r"""SELECT doc_id, i - 1 AS at, ps[i] AS sentence FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents))""")
def split_sentences_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("at", "sentence")).withColumn("at", F.col("at").cast("long"))


def _window_sql(size: int, overlap: int, select: str) -> str:
    """Oracle of the windows: a step of a recursive query a window."""
    return rf"""
WITH RECURSIVE w AS (
SELECT doc_id, text, 0 AS s, CASE WHEN length(text) <= {size} THEN length(text) WHEN {size} < length(text) THEN coalesce(nullif(length(regexp_extract(substring(text, {overlap} + 2, {size} - {overlap}), '(?s)^.*[.!?\n]', 0)), 0) + {overlap} + 1, {size}) END AS e FROM documents WHERE text IS NOT NULL
UNION ALL
SELECT doc_id, text, s2, CASE WHEN s2 + {size} < length(text) THEN s2 + coalesce(nullif(length(regexp_extract(substring(text, s2 + {overlap} + 2, {size} - {overlap}), '(?s)^.*[.!?\n]', 0)), 0) + {overlap} + 1, {size}) ELSE s2 + {size} END
FROM (SELECT doc_id, text, e - {overlap} AS s2 FROM w WHERE length(text) > {size} AND e - {overlap} < length(text))),
c AS (SELECT doc_id, s, least(e, length(text)) AS e, CASE WHEN length(text) <= {size} THEN text ELSE regexp_replace(substring(text, s + 1, e - s), '^\s+|\s+$', '', 'g') END AS content, length(text) AS n FROM w),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, s AS begin, e AS "end", content FROM c WHERE content <> '' OR n <= {size})
{select}"""


@query(_window_sql(1024, 128, "SELECT doc_id, chunk_index, begin, \"end\", content FROM k"))
def chunk_char_window_documents(spark, sf_dir):
    return chunk_char_window(table(spark, sf_dir, "documents"))


@query(_window_sql(1000, 200, "SELECT doc_id, chunk_index, content FROM k"))
def chunk_char_window_1000_200_documents(spark, sf_dir):
    return chunk_char_window(table(spark, sf_dir, "documents"), 1000, 200).select("doc_id", "chunk_index", "content")


@query()
def chunk_paragraph_tokens_documents(spark, sf_dir):
    return chunk_paragraph_tokens(table(spark, sf_dir, "documents"))


#: Metadata keys and the columns that show them in the query.
META = {"title": "title", "language": "language", "document_id": "document_id", "chunk_id": "chunk_id", "document_type": "document_type", "source_url": "source_url", "chunk_index": "meta_index", "total_chunks": "meta_total", "source": "source"}


def records(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = docs.select("doc_id", F.concat(F.lit("Document "), "doc_id").alias("title"), F.col("source").alias("document_type"), F.col("lang").alias("language"), F.concat(F.lit("doc/"), "doc_id").alias("source_url"))
    return chunk_records(chunk_char_window(docs), named)


@query(_window_sql(1024, 128, """SELECT 'doc_' || k.doc_id || '_chunk_' || chunk_index AS vector_id, k.doc_id, chunk_index, chunk_index AS position,
count(*) OVER (PARTITION BY k.doc_id) AS total_chunks, length(content) // 4 AS tokens_count, content, 'Document ' || k.doc_id AS title, d.lang AS language, CAST(k.doc_id AS VARCHAR) AS document_id, CAST(chunk_index AS VARCHAR) AS chunk_id, d.source AS document_type, 'doc/' || k.doc_id AS source_url,
CAST(chunk_index AS VARCHAR) AS meta_index, CAST(count(*) OVER (PARTITION BY k.doc_id) AS VARCHAR) AS meta_total, 'corpus' AS source FROM k JOIN documents d ON d.doc_id = k.doc_id"""))
def chunk_records_documents(spark, sf_dir):
    return records(spark, sf_dir).select("vector_id", "doc_id", "chunk_index", "position", "total_chunks", "tokens_count", "content", *(F.col("metadata")[k].alias(n) for k, n in META.items()))


@query("SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE vec_id % 13 END AS chunk_key FROM embeddings WHERE vec_id % 7 <> 0")
def parse_vector_id_embeddings(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings", "vec_id").withColumn("id", F.when(F.col("vec_id") % 7 == 0, F.concat(F.lit("doc_x_"), F.hex("vec_id"), F.lit("z"))).otherwise(F.concat(F.lit("doc_"), "vec_id", F.lit("_chunk_"), F.col("vec_id") % 13)))
    return ids.select("vec_id", parse_vector_id(F.col("id")).alias("chunk_key")).where("chunk_key is not null")


@query(_window_sql(1024, 128, "SELECT doc_id, chunk_index, begin AS start_position, \"end\" AS end_position FROM k"))
def chunk_positions_documents(spark, sf_dir):
    return chunk_char_window(table(spark, sf_dir, "documents")).select("doc_id", "chunk_index", F.col("begin").alias("start_position"), F.col("end").alias("end_position"))
