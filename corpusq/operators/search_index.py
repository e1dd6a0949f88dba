"""A stored inverted index over texts, and batches of searches that read only the blocks which can matter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusq.registry import query, table
from corpusq.sources.tables import kept, work_dir

#: What separates words.
BREAK = r"[^\p{L}\p{N}]+"
#: Bytes of text of some documents whose postings are brought together at a time.
TEXTS = 1 << 24
POSTINGS = "term string, segment int, level int, n int, max_tf int, doc_id array<long>, tf array<int>, length array<int>, bucket int"
BLOCKS = "term string, segment int, level int, n long, max_tf int, bucket int"


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _pieces(batches):
    """Postings of the texts ``(doc_id, segment, words)``, words set apart by spaces: of some documents, a row a (term, segment, level) with arrays.

    The rows are in the order in which they are stored, so that the sort of a shuffled partition has long runs to merge.
    """
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("words")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXTS, side="right")))
            doc, segment = (batch.column(c).slice(at, stop - at).to_numpy(zero_copy_only=False) for c in ("doc_id", "segment"))
            part, at = pc.split_pattern(batch.column("words").slice(at, stop - at), " "), stop
            coded = part.flatten().dictionary_encode()
            order = pc.sort_indices(coded.dictionary)
            terms, number = coded.dictionary.take(order), np.empty(len(order), np.int64)
            number[order.to_numpy()] = np.arange(len(order))
            code = number[coded.indices.to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(len(part)), pc.list_value_length(part).to_numpy(zero_copy_only=False))
            if len(terms) and terms[0].as_py() == "":  # beside spaces at the ends
                code, row = code[code > 0], row[code > 0]
            if not len(code):
                continue
            length = np.bincount(row, minlength=len(part)).astype(np.int32)
            held, tf = np.unique(code << 32 | row, return_counts=True)
            code, row, level = held >> 32, held & 0xFFFFFFFF, np.frexp(tf)[1] - 1  # tf of 2 ** level and more, below twice that
            block = (31 - level.astype(np.int64)) << 58 | code << 24 | segment[row]
            order = np.argsort(block, kind="stable")
            block, row, tf = block[order], row[order], tf[order].astype(np.int32)
            start = np.r_[0, np.flatnonzero(np.diff(block)) + 1]
            ends_at, block = np.r_[start, len(block)], block[start]
            columns = [terms.take(pa.array(block >> 24 & (1 << 34) - 1)), block & 0xFFFFFF, 31 - (block >> 58), np.diff(ends_at), np.maximum.reduceat(tf, start)]
            columns = [columns[0], *(pa.array(c.astype(np.int32)) for c in columns[1:]), *(pa.ListArray.from_arrays(pa.array(ends_at.astype(np.int32)), pa.array(c)) for c in (doc[row], tf, length[row]))]
            out = pa.RecordBatch.from_arrays(columns, names=["term", "segment", "level", "n", "max_tf", "doc_id", "tf", "length"])
            yield from (out.slice(low, 1 << 15) for low in range(0, out.num_rows, 1 << 15))


def build_index(docs: DataFrame, path: str, buckets: int = 64, segments: int = 32) -> None:
    """Write the inverted index of ``docs(doc_id, text)`` to a new folder.

    ``postings``: arrays of a term's documents (id, tf, number of the document's words), in a folder for each bucket of term hashes,
    sorted by falling level and term. A level holds the tf of one power of two, a segment a share of the documents by hash of their id;
    so (term, segment, level) is a block whose largest tf, kept in ``blocks`` with its number of documents, bounds what it can add
    to a score, and what a document of the segment can get from other terms is bounded by their blocks there. ``documents``
    has the count of rows.
    Texts are dealt by segment, and what some 16 MB of texts there have of a block is one row of ``postings``; these rows
    are shuffled, once, and not one for each word of a text. A term that most documents hold is spread over files, as its bucket is rebalanced by size.
    Rows that share a doc_id are one document (of the longest one's length), so their words alone are brought together by term and id;
    null texts have no words, rows without an id are counted but can't be found.
    """
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    segment = F.pmod(F.xxhash64("doc_id"), F.lit(segments)).cast("int").alias("segment")
    twice = kept(docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "text-index-ids")
    again = twice.limit(1).count() > 0
    once = texts.join(twice, "doc_id", "left_anti") if again else texts
    columns = [x for x in POSTINGS.split(", ") if not x.startswith("bucket")]
    dealt = once.select("doc_id", segment, "text").hint("rebalance", "segment").sortWithinPartitions("segment")
    rows = dealt.select("doc_id", "segment", F.regexp_replace(F.lower("text"), BREAK, " ").alias("words")).mapInArrow(_pieces, ", ".join(columns))
    if again:
        words = texts.join(twice, "doc_id", "left_semi").select("doc_id", F.filter(F.split(F.lower("text"), BREAK), lambda w: w != "").alias("w"))
        each = words.select("doc_id", F.size("w").alias("length"), F.explode("w").alias("term"))
        tf = each.groupBy("term", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.max("length").alias("length"))
        level = F.floor(F.log2(F.col("tf").cast("double") + 0.5)).cast("int")
        alone = tf.select("term", segment, level.alias("level"), F.lit(1).alias("n"), F.col("tf").alias("max_tf"), *(F.array(c).alias(c) for c in ("doc_id", "tf", "length")))
        rows = rows.unionByName(alone)
    rows = rows.withColumn("bucket", _bucket(F.col("term"), buckets))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", F.desc("level"), "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    blocks = spark.read.schema(POSTINGS).parquet(f"{path}/postings").groupBy("term", "segment", "level", "bucket").agg(F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"))
    blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/blocks")
    docs.agg(F.count(F.lit(1)).alias("n_docs"), F.lit(buckets).alias("buckets")).write.parquet(f"{path}/documents")


def asked_blocks(spark: SparkSession, path: str, searches: DataFrame, k: int) -> DataFrame:
    """Blocks that the ``k`` best documents of ``searches(search_id, terms)`` can stand in: (search_id, term, segment, level, bucket, idf, n).

    The blocks that can add most and together hold a few times ``k`` documents of a search give a least k-th score. Then a
    block is left out if its largest tf, with the largest of the search's other terms in its segment, stays below that score.
    """
    n_docs, buckets = spark.read.parquet(f"{path}/documents").first()
    asked = searches.select("search_id", F.explode("terms").alias("term")).where("term is not null").distinct().withColumn("bucket", _bucket(F.col("term"), buckets))
    wanted = [r[0] for r in asked.select("bucket").distinct().collect()]  # at most ``buckets``
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where(F.col("bucket").isin(wanted))
    found = asked.join(blocks, ["bucket", "term"])
    by_term, by_search = W.partitionBy("search_id", "term"), W.partitionBy("search_id")
    here, here_all = W.partitionBy("search_id", "segment", "term"), W.partitionBy("search_id", "segment")
    found = found.withColumn("idf", F.log((F.lit(n_docs) + 1) / (F.sum("n").over(by_term) + 1))).withColumn("most", F.col("max_tf") * F.col("idf"))
    found = found.withColumn("term_most", F.max("most").over(here)).withColumn("first", F.when(F.row_number().over(here.orderBy(F.desc("level"))) == 1, F.col("term_most")))
    found = found.withColumn("bound", F.sum("first").over(here_all) - F.col("term_most") + F.col("most"))
    before = F.coalesce(F.sum("n").over(by_search.orderBy(F.desc("most"), "term", "segment", "level").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = kept(found.withColumn("seed", before < 4 * k).select("search_id", "term", "segment", "level", "bucket", "idf", "n", "bound", "seed"), "search-blocks")
    some = scores(spark, path, found.where("seed"))
    least = some.withColumn("_n", F.row_number().over(by_search.orderBy(F.desc("score")))).where(F.col("_n") <= k)
    least = least.groupBy("search_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    return found.join(least, "search_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-5)).drop("least", "bound", "seed")


def scores(spark: SparkSession, path: str, blocks: DataFrame) -> DataFrame:
    """(search_id, doc_id, score) from the postings of ``blocks`` alone: only their buckets and levels are read."""
    read = blocks.groupBy("bucket").agg(F.min("level").alias("level")).collect()  # a row a bucket
    rows = spark.read.schema(POSTINGS).parquet(f"{path}/postings").select("bucket", "term", "segment", "level", "doc_id", "tf")
    rows = rows.where(F.col("bucket").isin([r[0] for r in read]) & (F.col("level") >= min((r[1] for r in read), default=0)))
    keys = ["bucket", "term", "segment", "level"]
    hits = rows.join(blocks.select(*keys, "search_id", "idf"), keys).select("search_id", "idf", F.inline(F.arrays_zip("doc_id", "tf")))
    return hits.groupBy("search_id", "doc_id").agg(F.round(F.sum(F.col("tf") * F.col("idf")), 6).alias("score"))


def search_index(spark: SparkSession, path: str, searches: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` documents of highest sum of tf * ln((N + 1) / (df + 1)) of each search: (search_id, doc_id, score, rank), ties by id.

    ``searches(search_id, terms array)`` is a table of any size; repeated and null terms of a search count once and not at
    all. No text is read, and of the postings only the blocks of ``asked_blocks``.
    """
    blocks = kept(asked_blocks(spark, path, searches, k), "search-needed")
    order = W.partitionBy("search_id").orderBy(F.desc("score"), "doc_id")
    return scores(spark, path, blocks).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searches(spark, sf_dir):
    """The first four words of each benchmark item as a search."""
    words = F.filter(F.split(F.lower("text"), BREAK), lambda w: w != "")
    return table(spark, sf_dir, "benchmark", "item_id", "text").select(F.col("item_id").alias("search_id"), F.slice(words, 1, 4).alias("terms"))


@query(r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL),
df AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id AS search_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')[1:4]) AS term FROM benchmark),
s AS (SELECT search_id, doc_id, round(sum(tf * idf), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) GROUP BY ALL)
SELECT search_id, doc_id, score, row_number() OVER (PARTITION BY search_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def fulltext_index_documents(spark, sf_dir):
    path = work_dir(spark, "text-index")
    build_index(table(spark, sf_dir, "documents", "doc_id", "text"), path, buckets=16)
    return search_index(spark, path, _searches(spark, sf_dir))
