"""Corpus catalogue: pages of documents, facets, chunk counts, relations, text search, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusq.operators.chunk import _window_sql, chunk_char_window
from corpusq.registry import query, table


def document_page(docs: DataFrame, page: int, page_size: int, key: str = "doc_id") -> DataFrame:
    """One page of the documents in key order, with the number of all.

    Ordered by a top-k of ``page * page_size`` rows, so the table is not sorted; the count is an aggregate beside it. For deep
    pages use ``document_page_after``, whose cost does not grow with the page.
    """
    first = docs.orderBy(key).limit(page * page_size)
    n = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(key))  # over the rows of the pages so far
    rows = first.withColumn("_n", n).where(F.col("_n") > (page - 1) * page_size).drop("_n")
    total = docs.agg(F.count(F.lit(1)).alias("total"))  # one row
    return rows.crossJoin(F.broadcast(total)).withColumns({"page": F.lit(page), "page_size": F.lit(page_size)})


def document_page_after(docs: DataFrame, after, page_size: int, key: str = "doc_id") -> DataFrame:
    """The ``page_size`` documents that follow the key ``after`` (None: the first ones), in key order: a filter that reaches the scan and a top-k of one page."""
    rows = docs if after is None else docs.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(page_size)


def document_facets(docs: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, value, n) for each facet column, from one pass with grouping sets."""
    sets = ", ".join(f"({f})" for f in facets)
    name = " ".join(f"WHEN grouping({f}) = 0 THEN '{f}'" for f in facets)
    value = " ".join(f"WHEN grouping({f}) = 0 THEN CAST({f} AS STRING)" for f in facets)
    return docs.sparkSession.sql(f"SELECT CASE {name} END AS facet, CASE {value} END AS value, count(*) AS n FROM {{d}} GROUP BY GROUPING SETS ({sets})", d=docs)


def document_chunk_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("chunks_count"))


def related_documents(edges: DataFrame) -> DataFrame:
    """(doc_id, related_id, relation_type, direction) over both directions of ``edges(source, target, relation_type)``."""
    out = edges.select(F.col("source").alias("doc_id"), F.col("target").alias("related_id"), "relation_type", F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("target").alias("doc_id"), F.col("source").alias("related_id"), "relation_type", F.lit("in").alias("direction")))


def term_table(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, term, tf) of the asked terms, which are words, in each text's lower-cased words.

    One pass finds the asked words alone, so only they are exploded; rows of one id are summed.
    """
    words = sorted(set(terms), key=lambda t: (-len(t), t))
    if not words:
        return docs.select("doc_id", F.lit("").alias("term"), F.lit(0).cast("long").alias("tf")).limit(0)
    pattern = r"(?<![\p{L}\p{N}])(?:" + "|".join(r"\Q" + w + r"\E" for w in words) + r")(?![\p{L}\p{N}])"
    low = F.lower("text")
    held = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    found = docs.where(held).select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(pattern), F.lit(0))).alias("term"))
    return found.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def fulltext_search(docs: DataFrame, terms: list[str], k: int = 10) -> DataFrame:
    """The ``k`` documents of highest sum of tf * ln((N + 1) / (df + 1)), ties by id, from one scan of the texts.

    For many searches, or the same table again and again, build the index of ``search_index`` instead.
    """
    tf = term_table(docs, terms)
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row a term
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    scored = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(n)).withColumn("s", F.col("tf") * F.log((F.col("n_docs") + 1) / (F.col("df") + 1)))
    return scored.groupBy("doc_id").agg(F.round(F.sum("s"), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def title_text_search(df: DataFrame, asked: str, title: str, text: str) -> DataFrame:
    """Rows whose title or text holds the asked words in any case, with a flag for each."""
    q = asked.lower()
    return df.withColumn("in_title", F.lower(title).contains(q)).withColumn("in_text", F.lower(text).contains(q)).where("in_title or in_text")


def _docs(spark, sf_dir, *columns):
    return table(spark, sf_dir, "documents", *columns)


@query("SELECT doc_id, lang, 3 AS page, 20 AS page_size, (SELECT count(*) FROM documents WHERE lang = 'en') AS total FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 20 OFFSET 40")
def document_page_documents(spark, sf_dir):
    return document_page(_docs(spark, sf_dir, "doc_id", "lang").where("lang = 'en'"), 3, 20)


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' AND doc_id > 100 ORDER BY doc_id LIMIT 20")
def document_page_after_documents(spark, sf_dir):
    return document_page_after(_docs(spark, sf_dir, "doc_id", "lang").where("lang = 'en'"), 100, 20)


@query("SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def document_facets_documents(spark, sf_dir):
    return document_facets(_docs(spark, sf_dir, "lang", "source"), ["lang", "source"])


@query(_window_sql(1024, 128, "SELECT d.doc_id, count(k.doc_id) AS chunks_count FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id"))
def document_chunk_counts_documents(spark, sf_dir):
    docs = _docs(spark, sf_dir, "doc_id", "text")
    return document_chunk_counts(docs, chunk_char_window(docs))


@query("""WITH e AS (SELECT doc_id AS s, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS t, CASE WHEN doc_id % 3 = 0 THEN 'amends' ELSE 'references' END AS relation_type FROM documents)
SELECT s AS doc_id, t AS related_id, relation_type, 'out' AS direction FROM e WHERE t IS NOT NULL UNION ALL SELECT t, s, relation_type, 'in' FROM e WHERE t IS NOT NULL""")
def related_documents_documents(spark, sf_dir):
    d = _docs(spark, sf_dir, "doc_id", "source")
    e = d.select(F.col("doc_id").alias("source"), F.lead("doc_id").over(W.partitionBy("source").orderBy("doc_id")).alias("target"), F.when(F.col("doc_id") % 3 == 0, "amends").otherwise("references").alias("relation_type"))
    return related_documents(e.where("target is not null"))


@query(r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN ('license', 'der', 'thend', 'para') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term) SELECT doc_id, round(sum(tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1))), 6) AS score FROM tf JOIN df USING (term) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""")
def fulltext_search_documents(spark, sf_dir):
    return fulltext_search(_docs(spark, sf_dir, "doc_id", "text"), ["license", "der", "thend", "para"])


@query("SELECT page_id, contains(lower(url), 'ther') AS in_title, contains(lower(html), 'ther') AS in_text FROM pages WHERE contains(lower(url), 'ther') OR contains(lower(html), 'ther')")
def title_text_search_pages(spark, sf_dir):
    return title_text_search(table(spark, sf_dir, "pages"), "Ther", "url", "html").select("page_id", "in_title", "in_text")


@query(_window_sql(1024, 128, """SELECT (SELECT count(*) FROM documents) AS total_documents, (SELECT count(*) FROM k) AS total_chunks, (SELECT count(*) FROM customer) AS total_users,
(SELECT count(DISTINCT conv_id) FROM conversations) AS total_conversations, (SELECT count(embedding) FROM embeddings) AS vector_store_count"""))
def system_stats_tables(spark, sf_dir):
    docs = _docs(spark, sf_dir, "doc_id", "text")
    counts = [
        docs.agg(F.count(F.lit(1)).alias("total_documents")), chunk_char_window(docs).agg(F.count(F.lit(1)).alias("total_chunks")), table(spark, sf_dir, "customer", "c_custkey").agg(F.count(F.lit(1)).alias("total_users")),
        table(spark, sf_dir, "conversations", "conv_id").agg(F.countDistinct("conv_id").alias("total_conversations")), table(spark, sf_dir, "embeddings", "embedding").agg(F.count("embedding").alias("vector_store_count")),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(F.broadcast(c))  # one row each
    return out


@query("SELECT (SELECT count(embedding) FROM embeddings) AS total_vectors, (SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) FROM documents) AS languages")
def public_stats_tables(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings", "embedding").agg(F.count("embedding").alias("total_vectors"))
    langs = _docs(spark, sf_dir, "lang").distinct().agg(F.array_join(F.sort_array(F.collect_list("lang")), ",").alias("languages"))
    return v.crossJoin(F.broadcast(langs))
