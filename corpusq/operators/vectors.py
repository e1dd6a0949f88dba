"""Embedding, the vector table, exact and approximate nearest neighbours."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusq.functions.vector import cosine_distance, similarity_band, squared_l2
from corpusq.operators.vector_index import VectorIndex
from corpusq.registry import query, table
from corpusq.sources.tables import work_dir


class HashedTerms:
    """The default encoder: hashed term frequencies of unit length. Any object with ``encode(texts)`` will do instead."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for row, t in zip(out, texts):
            for w in t.lower().split():
                row[zlib.crc32(w.encode("utf-8")) % self.size] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def embed_texts(df: DataFrame, key: str, text: str = "text", encoder=None, batch: int = 256) -> DataFrame:
    """(key, embedding) of every row. Texts that the encoder fails on get zeros, as does a null text."""
    encoder = encoder or HashedTerms()
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts, out = [t or "" for t in b[text]], []
            for at in range(0, len(texts), batch):
                try:
                    out += list(np.asarray(encoder.encode(texts[at : at + batch]), np.float32))
                except ImportError:
                    raise
                except Exception:  # whatever else the encoder raises
                    out += [np.zeros(encoder.size, np.float32)] * len(texts[at : at + batch])
            yield pd.DataFrame({key: b[key], "embedding": out})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def vectors_add(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The table with the rows of ``new`` whose id it does not have."""
    return stored.unionByName(new.join(stored.select(key), key, "left_anti").select(*stored.columns))


def vectors_attach(chunks: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Chunks with the embeddings of ``new`` where it has one; ids it alone has are left out."""
    n = new.select(key, F.col("embedding").alias("_e"))
    return chunks.join(n, key, "left").withColumn("embedding", F.coalesce("_e", "embedding")).drop("_e")


def vectors_unknown(chunks: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Ids of ``new`` that no chunk has."""
    return new.join(chunks.select(key), key, "left_anti").select(key)


def vectors_delete(stored: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return stored.join(ids.select(key), key, "left_anti")


def vectors_clear(stored: DataFrame) -> DataFrame:
    return stored.withColumn("embedding", F.lit(None).cast(stored.schema["embedding"].dataType))


def knn(vectors: DataFrame, vector: list[float], k: int, metric: str = "cosine", key: str = "vec_id", where=None) -> DataFrame:
    """The ``k`` nearest vectors to one, by distance (9 places) and id: (key, distance, similarity). Null vectors are left out.

    ``where`` filters before the ranking. Each task keeps k rows, so no sort of the table is needed.
    """
    v = vectors.where("embedding is not null")
    v = v.where(where) if where is not None else v
    q = F.lit([float(x) for x in vector])
    d = cosine_distance(F.col("embedding"), q) if metric == "cosine" else squared_l2(F.col("embedding"), q)
    d = F.round(d, 9)
    return v.select(key, d.alias("distance"), (1 - d).alias("similarity")).orderBy(F.col("distance").asc_nulls_last(), key).limit(k)


def nearest_of(batches, qids: list, asked: np.ndarray, groups: np.ndarray | None, k: int, metric: str, group: str | None, tile: int = 1024) -> pd.DataFrame:
    """The ``k`` nearest rows of ``batches`` to each query, (qid, vec_id, distance); distances stand in tiles of 512 queries by ``tile`` rows."""
    best: dict[int, list[tuple]] = {}
    worst = np.full(len(qids), np.nan)  # the k-th distance of queries that have as many
    for b in batches:
        for low in range(0, len(b), tile):
            rows = b.iloc[low : low + tile]
            x = np.array(rows["embedding"].tolist(), np.float64)
            ids = rows["vec_id"].to_numpy(np.int64)
            for at in range(0, len(qids), 512):
                q = asked[at : at + 512]
                if metric == "cosine":
                    norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]
                    with np.errstate(invalid="ignore", divide="ignore"):
                        d = np.where(norm > 0, 1 - q @ x.T / norm, np.inf)
                else:
                    d = np.stack([((x - y) ** 2).sum(1) for y in q])
                d = np.round(d, 9) + 0.0  # no negative zero
                if group:
                    d = np.where(groups[at : at + 512, None] == rows[group].to_numpy(object)[None, :], d, np.nan)
                for i in np.flatnonzero(~(np.fmin.reduce(d, axis=1) > worst[at : at + 512])).tolist():
                    order = np.lexsort((ids, d[i]))[:k]
                    order = order[~np.isnan(d[i, order])]
                    found = sorted([*best.get(at + i, []), *zip(d[i, order].tolist(), ids[order].tolist())])[:k]
                    best[at + i] = found
                    worst[at + i] = found[-1][0] if len(found) == k else np.nan
    rows = [(qids[q], i, None if d == np.inf else d) for q, found in best.items() for d, i in found]
    return pd.DataFrame(rows, columns=["qid", "vec_id", "distance"]).astype({"distance": float})


def knn_join(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", group: str | None = None, broadcast_rows: int = 20_000) -> DataFrame:
    """The ``k`` nearest of ``vectors(vec_id, embedding)`` to each of ``queries(qid, embedding)``, ranked by distance (9 places) and id.

    Up to ``broadcast_rows`` queries, which are counted first, are sent to all tasks, and each passes on k rows a
    query. More of them stay a table, and meet only those cells of a ``VectorIndex`` that their k-th distance can
    reach. With ``group`` (a column of both) only vectors of the query's group count. Vectors and queries without an
    embedding have no neighbours; a vector of no length comes last, with a null distance.
    """
    asked = queries.where("embedding is not null").select("qid", "embedding", *([group] if group else []))
    few = asked.limit(broadcast_rows + 1).collect()
    if len(few) > broadcast_rows:
        return VectorIndex.build(vectors, work_dir(vectors.sparkSession, "knn-join"), metric, group).nearest(queries, k)
    asking = ([r[0] for r in few], np.array([r[1] for r in few], np.float64), np.array([r[2] for r in few], object) if group else None)
    sent = queries.sparkSession.sparkContext.broadcast(asking)

    def run(batches):
        yield nearest_of(batches, *sent.value, k, metric, group)

    v = vectors.where("embedding is not null").select("vec_id", "embedding", *([group] if group else []))
    near = v.mapInPandas(run, "qid long, vec_id long, distance double")
    near = near.withColumn("distance", F.when(F.isnan("distance"), None).otherwise(F.col("distance")))
    w = W.partitionBy("qid").orderBy(F.col("distance").asc_nulls_last(), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "vec_id", "distance", (1 - F.col("distance")).alias("similarity"), "rank")


def knn_approx(vectors: DataFrame, queries: DataFrame, k: int, cells: int | None = None, probes: int | None = None, shortlist: int | None = None, sample: int = 20_000, path: str | None = None) -> DataFrame:
    """Approximate cosine neighbours: a ``VectorIndex`` built in ``path`` (a new shared folder by default) and searched by codes.

    The folder stays, so later searches can ``VectorIndex.load`` it.
    """
    index = VectorIndex.build(vectors, path or work_dir(vectors.sparkSession, "knn-approx"), cells=cells, sample=sample)
    return index.approximate(queries, k, probes, shortlist)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding", "label")


def _one(spark, sf_dir) -> list[float]:
    return _vectors(spark, sf_dir).where("vec_id = 0").select("embedding").first()[0]


_Q = "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL) "
_COS = "round(1 - list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))), 9)"


def _rounded():
    return ["vec_id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity")]


@query()
def embed_texts_documents(spark, sf_dir):
    return embed_texts(table(spark, sf_dir, "documents"), "doc_id")


@query()
def embed_queries_benchmark(spark, sf_dir):
    return embed_texts(table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text"), "query_id")


@query("SELECT vec_id, label FROM embeddings")
def vectors_add_embeddings(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("vec_id", "embedding", "label")
    return vectors_add(v.where("vec_id % 3 <> 0"), v.where("vec_id % 2 = 0 or vec_id % 3 = 0"), "vec_id").select("vec_id", "label")


def _attach(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    chunks = table(spark, sf_dir, "documents", "doc_id").select(F.col("doc_id").alias("vec_id"), F.lit(None).cast("array<float>").alias("embedding"))
    return chunks, v.where("vec_id % 4 <> 0").select("vec_id", "embedding")


@query("SELECT d.doc_id AS vec_id, e.vec_id IS NOT NULL AS attached, round(list_sum(e.embedding::DOUBLE[]), 6) AS total FROM documents d LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 4 <> 0) e ON e.vec_id = d.doc_id")
def vectors_attach_documents(spark, sf_dir):
    out = vectors_attach(*_attach(spark, sf_dir), "vec_id")
    return out.select("vec_id", F.col("embedding").isNotNull().alias("attached"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 4 <> 0 AND vec_id NOT IN (SELECT doc_id FROM documents)")
def vectors_unknown_documents(spark, sf_dir):
    return vectors_unknown(*_attach(spark, sf_dir), "vec_id")


@query(_Q + f"SELECT vec_id, round({_COS}, 6) AS distance, round(1 - {_COS}, 6) AS similarity FROM v, q ORDER BY {_COS}, vec_id LIMIT 10")
def knn_cosine_embeddings(spark, sf_dir):
    return knn(_vectors(spark, sf_dir), _one(spark, sf_dir), 10).select(*_rounded())


_L2 = "round(list_sum(list_transform(list_zip(v.e, q.e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 9)"


@query(_Q + f"SELECT vec_id, round({_L2}, 6) AS distance, round(1 - {_L2}, 6) AS similarity FROM v, q ORDER BY {_L2}, vec_id LIMIT 10")
def knn_l2_embeddings(spark, sf_dir):
    return knn(_vectors(spark, sf_dir), _one(spark, sf_dir), 10, "l2").select(*_rounded())


@query(_Q + f"SELECT vec_id, round({_COS}, 6) AS distance, round(1 - {_COS}, 6) AS similarity FROM v, q WHERE v.label = 3 ORDER BY {_COS}, vec_id LIMIT 10")
def knn_filtered_embeddings(spark, sf_dir):
    return knn(_vectors(spark, sf_dir), _one(spark, sf_dir), 10, where=F.col("label") == 3).select(*_rounded())


@query(_Q + f"SELECT * FROM (SELECT vec_id, round({_COS}, 6) AS distance, round(1 - {_COS}, 6) AS similarity FROM v, q ORDER BY {_COS}, vec_id LIMIT 50) WHERE similarity >= 0.2")
def knn_min_similarity_embeddings(spark, sf_dir):
    return knn(_vectors(spark, sf_dir), _one(spark, sf_dir), 50).select(*_rounded()).where("similarity >= 0.2")


_JOIN = f"""WITH q AS (SELECT vec_id AS qid, label AS ql, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT qid, vec_id, {_COS} AS d, row_number() OVER (PARTITION BY qid ORDER BY {_COS}, vec_id) AS rank FROM v, q) """


@query(_JOIN + "SELECT qid, vec_id, round(d, 6) + 0.0::DOUBLE AS distance, round(1 - d, 6) AS similarity, rank FROM n WHERE rank <= 10")
def knn_join_embeddings(spark, sf_dir):
    return knn_join(_vectors(spark, sf_dir), _queries(spark, sf_dir), 10).select("qid", *_rounded(), "rank")


@query(_JOIN.replace("WHERE vec_id % 100 = 0", "") + "SELECT qid, vec_id, round(d, 6) + 0.0::DOUBLE AS distance, round(1 - d, 6) AS similarity, rank FROM n WHERE rank <= 10")
def knn_cells_embeddings(spark, sf_dir):
    """All rows as queries, through the cells of a stored index."""
    index = VectorIndex.build(_vectors(spark, sf_dir), work_dir(spark, "cells"))
    return index.nearest(_vectors(spark, sf_dir).select(F.col("vec_id").alias("qid"), "embedding"), 10).select("qid", *_rounded(), "rank")


@query()
def knn_approx_embeddings(spark, sf_dir):
    return knn_approx(_vectors(spark, sf_dir), _queries(spark, sf_dir), 10)


@query("SELECT count(embedding) AS vectors, count(*) AS row_count FROM embeddings")
def vector_count_embeddings(spark, sf_dir):
    return _vectors(spark, sf_dir).agg(F.count("embedding").alias("vectors"), F.count(F.lit(1)).alias("row_count"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def vectors_delete_embeddings(spark, sf_dir):
    return vectors_delete(_vectors(spark, sf_dir), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id").select("vec_id", "label")


@query("SELECT vec_id, true AS cleared FROM embeddings")
def vectors_clear_embeddings(spark, sf_dir):
    return vectors_clear(_vectors(spark, sf_dir)).select("vec_id", F.col("embedding").isNull().alias("cleared"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL)")
def scan_chunks_missing_vectors(spark, sf_dir):
    have = _vectors(spark, sf_dir).where("embedding is not null").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf_dir, "documents", "doc_id").join(have, "doc_id", "left_anti")


_BAND = "CASE WHEN 1 - d >= 0.8 THEN 'excellent' WHEN 1 - d >= 0.6 THEN 'good' WHEN 1 - d >= 0.4 THEN 'fair' ELSE 'low' END"


@query(_JOIN + f"SELECT qid, {_BAND} AS band, count(*) AS n FROM n WHERE rank <= 50 GROUP BY qid, {_BAND}")
def similarity_band_embeddings(spark, sf_dir):
    near = knn_join(_vectors(spark, sf_dir), _queries(spark, sf_dir), 50)
    return near.groupBy("qid", similarity_band(F.col("similarity")).alias("band")).agg(F.count(F.lit(1)).alias("n"))
