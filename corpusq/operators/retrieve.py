"""Retrieval and answer assembly for batches of questions: chunks, context, sources, prompts, caches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusq.functions.time import epoch_micros
from corpusq.operators.vectors import knn_join
from corpusq.registry import query, table
from corpusq.sources.tables import kept

LABEL, NO_CONTEXT, NO_TITLE = "Document", "No information is available.", "Unknown document"
SYSTEM = "Answer only from the context and name your sources.\n\nContext:\n"


def retrieved_chunks(near: DataFrame, chunks: DataFrame, key: str = "vec_id") -> DataFrame:
    """Neighbours with their chunk's columns; missing text and distance become empty and 0.0."""
    j = near.join(chunks, key, "left")
    return j.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("similarity", F.coalesce(1 - F.col("distance"), F.lit(0.0)))


def assemble_context(retrieved: DataFrame, queries: DataFrame, top: int = 5, label: str = LABEL, no_title: str = NO_TITLE, no_context: str = NO_CONTEXT) -> DataFrame:
    """(qid, context): the first ``top`` chunks by rank as numbered parts; a fixed sentence for a query without any."""
    part = F.concat(F.lit(f"[{label} "), "rank", F.lit(": "), F.coalesce("title", F.lit(no_title)), F.lit(" ("), F.coalesce("document_type", F.lit("")), F.lit(")]\n"), "content", F.lit("\n"))
    parts = retrieved.where(F.col("rank") <= top).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("p"))
    joined = parts.select("qid", F.array_join(F.transform("p", lambda x: x["part"]), "\n---\n").alias("context"))
    return queries.select("qid").join(joined, "qid", "left").select("qid", F.coalesce("context", F.lit(no_context)).alias("context"))


def _url(df: DataFrame) -> Column:
    return F.coalesce("source_url", F.lit("")) if "source_url" in df.columns else F.lit("")


def prepare_sources(retrieved: DataFrame, top: int = 5) -> DataFrame:
    """The best chunk of each document, in rank order, first ``top`` documents; chunks without a document or with an empty id are skipped."""
    d = retrieved.where("document_id is not null and cast(document_id as string) <> ''")
    best = d.withColumn("_n", F.row_number().over(W.partitionBy("qid", "document_id").orderBy("rank"))).where("_n = 1")
    best = best.withColumn("source_rank", F.row_number().over(W.partitionBy("qid").orderBy("rank"))).where(F.col("source_rank") <= top)
    return best.select("qid", "source_rank", "document_id", F.coalesce("title", F.lit(NO_TITLE)).alias("title"), F.coalesce("document_type", F.lit("")).alias("document_type"), _url(retrieved).alias("url"), "similarity")


def public_sources(sources: DataFrame) -> DataFrame:
    """Sources as they are shown: the first 200 characters of the title, relevance, and the metadata."""
    meta = F.struct(F.col("document_id").cast("string").alias("document_id"), "title", "document_type", F.col("url").alias("source_url"), F.col("similarity").alias("relevance"))
    return sources.select("qid", "source_rank", F.substring("title", 1, 200).alias("text"), F.col("similarity").alias("relevance"), meta.alias("metadata"))


def retrieved_count(retrieved: DataFrame, queries: DataFrame) -> DataFrame:
    n = retrieved.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return queries.select("qid").join(n, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("retrieved"))


def build_prompts(questions: DataFrame, system: str = SYSTEM) -> DataFrame:
    """``messages`` of (question, context, history array): system text, the history's user messages, the question."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    history = F.transform("history", lambda x: message("user", x))
    return questions.withColumn("messages", F.concat(F.array(message("system", F.concat(F.lit(system), "context"))), history, F.array(message("user", F.col("question")))))


def response_cache_hits(requests: DataFrame, ttl: int = 3600, most: int = 100_000) -> DataFrame:
    """(event_id, key, hit) of ``requests(event_id, key, ts)``: a hit if the last miss stored the key under ``ttl`` seconds ago.

    A hit does not lengthen the life, so the stored answer's age depends on all requests before it. Keys of up to
    ``most`` requests are walked in time order, batch by batch. The requests of a key with more are not brought together:
    ``misses_by_doubling`` finds their misses with joins over all tasks. Requests of one time go by event_id, which must be unique
    within a key; a null key is a key, null times are never stored and always miss.
    """
    r = requests.select("event_id", "key", epoch_micros("ts").alias("at"))
    sizes = r.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(F.col("key").alias("_key"))
    hot = kept(sizes, "cache-hot-keys")  # at most a row for each ``most`` requests
    if not hot.limit(1).count():
        return _walked(r, ttl)
    same = F.col("key").eqNullSafe(F.col("_key"))
    timed = kept(r.join(hot, same, "left_semi"), "cache-hot-requests")
    misses = misses_by_doubling(timed.where("at is not null"), ttl)
    m = misses.select(F.col("key").alias("_key"), F.col("event_id").alias("_event"))
    found = timed.join(m, same & (F.col("event_id") == F.col("_event")), "left").select("event_id", "key", (F.col("_event").isNull() & F.col("at").isNotNull()).alias("hit"))
    return _walked(r.join(hot, same, "left_anti"), ttl).unionByName(found)


def _walked(r: DataFrame, ttl: int) -> DataFrame:
    def run(batches):
        key, stored, begun = None, None, False
        for b in batches:
            hits = []
            for k, t, none in zip(b["key"].tolist(), b["at"].tolist(), b["at"].isna().tolist()):
                if not begun or k != key:
                    key, stored, begun = k, None, True
                hit = not none and stored is not None and t - stored < ttl * 1_000_000
                if not hit and not none:
                    stored = t
                hits.append(hit)
            yield pd.DataFrame({"event_id": b["event_id"], "key": b["key"], "hit": hits})

    return r.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInPandas(run, "event_id long, key string, hit boolean")


def misses_by_doubling(r: DataFrame, ttl: int, buckets: int = 60) -> DataFrame:
    """(key, event_id) of the misses of ``r(event_id, key, at)``: each key's first request, and of every miss the next one.

    The next miss after a miss is the first request at least ``ttl`` later. That successor is found for every request: in the
    bucket of time (a share of the ttl) that its earliest time falls in, else as the first request of the next bucket that has any.
    Then the requests reached from the first ones are doubled: a round joins the reached ones with pointers of twice the
    length. Rows of a key are spread by bucket and by request all along; only a row a key and bucket meets in a window of the key.
    """
    life = ttl * 1_000_000
    width = max(1, life // buckets)
    rows = r.select(F.coalesce("key", F.lit("")).alias("k"), F.col("key").isNull().alias("none"), "event_id", "at")
    me = F.struct("at", "event_id")
    rows = rows.select("k", "none", me.alias("me"), F.floor(F.col("at") / width).alias("bucket"))
    firsts = rows.groupBy("k", "none", "bucket").agg(F.min("me").alias("first"))
    after = W.partitionBy("k", "none").orderBy("bucket").rowsBetween(1, W.unboundedFollowing)
    starts = rows.groupBy("k", "none").agg(F.min("me").alias("me"))
    due = rows.select("k", "none", "me", (F.col("me.at") + life).alias("due")).withColumn("bucket", F.floor(F.col("due") / width))
    # within a bucket: the first request at or after the due time, both sides in one sorted window
    none = F.lit(None).cast(rows.schema["me"].dataType)
    both = due.select("k", "none", "bucket", F.col("due").alias("t"), F.lit(0).alias("side"), F.col("me").alias("asks"), none.alias("own"))
    both = both.unionByName(rows.select("k", "none", "bucket", F.col("me.at").alias("t"), F.lit(1).alias("side"), none.alias("asks"), F.col("me").alias("own")))
    ahead = W.partitionBy("k", "none", "bucket").orderBy(F.desc("t"), F.desc("side")).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = both.withColumn("next", F.min("own").over(ahead)).where("side = 0").select("k", "none", "bucket", F.col("asks").alias("me"), "next")
    # every asked bucket, whether it has requests or not, points to the first request of a later one
    marks = firsts.unionByName(inside.where("next is null").select("k", "none", "bucket").distinct().withColumn("first", none))
    marks = marks.groupBy("k", "none", "bucket").agg(F.min("first").alias("first")).withColumn("later", F.min("first").over(after)).select("k", "none", "bucket", "later")
    inside = kept(inside, "cache-inside")
    late = inside.where("next is null").drop("next").join(marks, ["k", "none", "bucket"]).select("k", "none", "me", F.col("later").alias("next"))
    jump = kept(inside.where("next is not null").select("k", "none", "me", "next").unionByName(late).where("next is not null"), "cache-pointers")
    reached, known = kept(starts, "cache-reached"), -1
    while (now := reached.count()) != known:
        known = now
        on = ["k", "none", "me"]
        step = reached.join(jump, on).select("k", "none", F.col("next").alias("me"))
        reached = kept(reached.unionByName(step).distinct(), "cache-reached")
        far = jump.select("k", "none", F.col("me").alias("next"), F.col("next").alias("far"))
        jump = kept(jump.join(far, ["k", "none", "next"]).select("k", "none", "me", F.col("far").alias("next")), "cache-pointers")
    return reached.select(F.when(~F.col("none"), F.col("k")).alias("key"), "me.event_id")


def cache_invalidate(entries: DataFrame, pattern: str) -> DataFrame:
    """Entries whose key does not match the glob (``*`` and ``?``)."""
    like = pattern.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")
    return entries.where(~F.col("key").like(like))


def rag_answer_table(vectors: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = 10, group: str = "language", top: int = 5, label: str = LABEL, no_title: str = NO_TITLE, no_context: str = NO_CONTEXT) -> DataFrame:
    """(qid, context, sources, retrieved) of a batch of query vectors: filtered neighbours, context, sources, count.

    The neighbours are ranked once; all three are built from the ``k`` rows of a query in one grouping.
    """
    got = retrieved_chunks(knn_join(vectors, queries, k, group=group), chunks)
    row = F.struct("rank", "document_id", F.coalesce("title", F.lit(no_title)).alias("title"), F.coalesce("document_type", F.lit("")).alias("document_type"), _url(got).alias("url"), F.round("similarity", 6).alias("relevance"), "content")
    rows = got.groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("rows"))  # k rows
    part = lambda x: F.concat(F.lit(f"[{label} "), x["rank"], F.lit(": "), x["title"], F.lit(" ("), x["document_type"], F.lit(")]\n"), x["content"], F.lit("\n"))
    context = F.array_join(F.transform(F.filter("rows", lambda x: x["rank"] <= top), part), "\n---\n")
    ids = F.transform("rows", lambda x: x["document_id"].cast("string"))
    first = F.filter("rows", lambda x, i: (x["document_id"].cast("string") != "") & (F.array_position(ids, x["document_id"].cast("string")) == i + 1))
    listed = F.transform(F.slice(first, 1, top), lambda x, i: F.struct((i + 1).alias("source_rank"), x["document_id"].alias("document_id"), x["title"].alias("title"), x["document_type"].alias("document_type"), x["url"].alias("url"), x["relevance"].alias("relevance")))
    done = rows.select("qid", context.alias("context"), listed.alias("sources"), F.size("rows").cast("long").alias("retrieved"))
    none = F.array().cast(done.schema["sources"].dataType)
    out = queries.select("qid").join(done, "qid", "left")
    return out.select("qid", F.coalesce("context", F.lit(no_context)).alias("context"), F.coalesce("sources", none).alias("sources"), F.coalesce("retrieved", F.lit(0)).alias("retrieved"))


def _corpus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"), F.concat(F.lit("Document "), "doc_id").alias("title"), F.col("source").alias("document_type"), F.col("lang").alias("language"), F.concat(F.lit("doc/"), "doc_id").alias("source_url"))
    vectors = table(spark, sf_dir, "embeddings").join(docs.select("vec_id", "language"), "vec_id")
    chunks = docs.join(table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("document_id")), "vec_id").drop("language")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding", "language")
    return vectors, queries, chunks


def _retrieved(spark, sf_dir):
    vectors, queries, chunks = _corpus(spark, sf_dir)
    return retrieved_chunks(knn_join(vectors, queries, 10, group="language"), chunks), queries


_RET = """WITH j AS (SELECT e.vec_id, e.label, e.embedding::DOUBLE[] AS e, d.text, d.lang, d.source FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
n AS (SELECT q.vec_id AS qid, v.vec_id, v.label, v.text, v.source, round(1 - list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))), 9) AS d FROM j q JOIN j v ON v.lang = q.lang WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank FROM n QUALIFY rank <= 10),
s AS (SELECT qid, label, rank, d, vec_id, source, row_number() OVER (PARTITION BY qid ORDER BY rank) AS source_rank FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY qid, label ORDER BY rank) = 1) QUALIFY source_rank <= 5),
c AS (SELECT qid, string_agg('[Document ' || rank || ': Document ' || vec_id || ' (' || source || ')]' || chr(10) || text || chr(10), chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 5 GROUP BY qid)
"""


@query(_RET + "SELECT qid, vec_id, rank, round(1 - d, 6) AS similarity, text AS content, label AS document_id FROM r")
def retrieved_chunks_embeddings(spark, sf_dir):
    return _retrieved(spark, sf_dir)[0].select("qid", "vec_id", "rank", F.round("similarity", 6).alias("similarity"), "content", "document_id")


@query(_RET + "SELECT qid, context FROM c")
def assemble_context_embeddings(spark, sf_dir):
    return assemble_context(*_retrieved(spark, sf_dir))


@query(_RET + "SELECT qid, source_rank, label AS document_id, 'Document ' || vec_id AS title, source AS document_type, 'doc/' || vec_id AS url, round(1 - d, 6) AS similarity FROM s")
def prepare_sources_embeddings(spark, sf_dir):
    return prepare_sources(_retrieved(spark, sf_dir)[0]).withColumn("similarity", F.round("similarity", 6))


@query(_RET + "SELECT qid, source_rank, 'Document ' || vec_id AS text, round(1 - d, 6) AS relevance, CAST(label AS VARCHAR) AS document_id, 'Document ' || vec_id AS title, source AS document_type, 'doc/' || vec_id AS source_url, round(1 - d, 6) AS meta_relevance FROM s")
def public_sources_embeddings(spark, sf_dir):
    p = public_sources(prepare_sources(_retrieved(spark, sf_dir)[0]))
    return p.select("qid", "source_rank", "text", F.round("relevance", 6).alias("relevance"), "metadata.document_id", "metadata.title", "metadata.document_type", "metadata.source_url", F.round("metadata.relevance", 6).alias("meta_relevance"))


@query(_RET + "SELECT qid, count(*) AS retrieved FROM r GROUP BY qid")
def retrieved_count_embeddings(spark, sf_dir):
    return retrieved_count(*_retrieved(spark, sf_dir))


@query("""
WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
q AS (SELECT conv_id, max(turn) AS turn FROM m WHERE role = 'user' GROUP BY conv_id),
h AS (SELECT m.conv_id, m.turn, m.text, m.role, row_number() OVER (PARTITION BY m.conv_id ORDER BY m.turn DESC) AS b FROM m JOIN q ON q.conv_id = m.conv_id AND m.turn < q.turn WHERE m.n <= 10),
u AS (SELECT conv_id, string_agg('user: ' || text, chr(10) ORDER BY turn) AS t, count(*) AS k FROM h WHERE b <= 5 AND role = 'user' GROUP BY conv_id)
SELECT q.conv_id, 2 + coalesce(u.k, 0) AS n_messages, 'system: Answer only from the context and name your sources.' || chr(10) || chr(10) || 'Context:' || chr(10) || 'ctx ' || q.conv_id || chr(10) || coalesce(u.t || chr(10), '') || 'user: ' || m.text AS prompt
FROM q JOIN m ON m.conv_id = q.conv_id AND m.turn = q.turn LEFT JOIN u ON u.conv_id = q.conv_id
""")
def build_prompts_conversations(spark, sf_dir):
    from corpusq.operators.convo import history_window

    c = table(spark, sf_dir, "conversations")
    last = c.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("before"), F.max_by("text", "turn").alias("question"))
    h = history_window(c, last).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("h"))
    asked = last.join(h, "conv_id", "left").select("conv_id", "question", F.concat(F.lit("ctx "), "conv_id").alias("context"), F.coalesce(F.transform("h", lambda x: x["text"]), F.array().cast("array<string>")).alias("history"))
    p = build_prompts(asked)
    return p.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n").alias("prompt"))


def _cache_requests(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws("|", "user_id", "event_type").alias("key"), "ts")


@query("""
WITH RECURSIVE e AS (SELECT event_id, user_id || '|' || event_type AS key, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT event_id, key, ts AS stored, n, false AS hit FROM e WHERE n = 1
UNION ALL SELECT e.event_id, e.key, CASE WHEN e.ts - w.stored < INTERVAL 3600 SECOND THEN w.stored ELSE e.ts END, e.n, e.ts - w.stored < INTERVAL 3600 SECOND FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1)
SELECT event_id, key, hit FROM w
""")
def response_cache_hits_events(spark, sf_dir):
    return response_cache_hits(_cache_requests(spark, sf_dir))


@query("SELECT user_id || '|' || event_type AS key, count(*) AS n FROM events WHERE NOT (user_id || '|' || event_type LIKE '1%|click') GROUP BY ALL")
def cache_invalidate_events(spark, sf_dir):
    entries = _cache_requests(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return cache_invalidate(entries, "1*|click")


@query(_RET + """SELECT c.qid, c.context, x.sources, x.k AS retrieved FROM c JOIN (SELECT r.qid, count(*) AS k, (SELECT string_agg(source_rank || ':' || label || ':' || 'Document ' || vec_id, ',' ORDER BY source_rank) FROM s WHERE s.qid = r.qid) AS sources FROM r GROUP BY r.qid) x ON x.qid = c.qid""")
def rag_answer_table_embeddings(spark, sf_dir):
    out = rag_answer_table(*_corpus(spark, sf_dir))
    return out.withColumn("sources", F.array_join(F.transform("sources", lambda x: F.concat_ws(":", x["source_rank"], x["document_id"], x["title"])), ","))
