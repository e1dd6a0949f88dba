"""A stored vector index: cells with distance bounds for exact neighbours, product-quantised codes for approximate ones."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusq.functions.vector import cosine_distance
from corpusq.sources.tables import kept

VECTORS = "vec_id long, grp string, e array<double>, code binary, far double, cell int"
CELLS = "cell int, n long, near double, far double"
NEAR = "qid long, vec_id long, distance double"


def _matrix(vectors, width: int) -> np.ndarray:
    vectors = list(vectors)
    if max(map(len, vectors), default=0) > width:
        raise ValueError(f"a vector has more than {width} coordinates, those of the longest one indexed")
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all rows of ``y``."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)


def centres_of(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """``k`` centres of the rows of ``x`` by Lloyd's rounds, begun with a seeded choice of rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        of = _apart(x, c).argmin(1)
        n = np.bincount(of, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _chain(centres: np.ndarray) -> list[int]:
    """The cells, each followed by the nearest one left, so that neighbours stand together."""
    left, order = list(range(1, len(centres))), [0] if len(centres) else []
    while left:
        order.append(left.pop(int(_apart(centres[order[-1:]], centres[left]).argmin())))
    return order


def _packed(order: list[int], sizes, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first group and its number of groups: small cells share one of about ``most`` rows, a large one has several."""
    first, parts, group, used = np.zeros(len(order), np.int64), np.ones(len(order), np.int64), 0, 0
    for c in order:
        n = int(sizes[c])
        if used and used + n > most:
            group, used = group + 1, 0
        first[c], parts[c] = group, max(1, -(-n // most))
        group, used = (group + int(parts[c]), 0) if parts[c] > 1 else (group, used + n)
    return first, parts


class VectorIndex:
    """Vectors dealt to cells around centres, each with its distance to the centre and a product-quantised code.

    ``build`` fits centres and codebooks on at most ``sample`` rows and stores all rows; ``load`` opens a stored index.
    Metric ``cosine`` indexes vectors brought to unit length (those of no length are stored apart, in cell -1), ``l2``
    vectors as they are. Vectors shorter than the longest are followed by zeros, longer queries are an error; null vectors and ids are left out.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        m = spark.read.parquet(f"{path}/model").first()
        self.metric, self.width, self.rows, self.group = m["metric"], m["width"], m["n"], m["grp"]
        self.centres = np.array(m["centres"], float).reshape(-1, self.width)
        self.books = [np.array(b, float) for b in m["books"]]
        told = {r[0]: r[1:] for r in spark.read.schema(CELLS).parquet(f"{path}/cells").collect()}  # a row a cell
        cells = range(len(self.centres))
        self.sizes = np.array([told.get(c, (0,))[0] for c in cells], np.int64)
        self.near, self.far = (np.array([told[c][i] if c in told else 0.0 for c in cells]) for i in (1, 2))
        self.most = min(max(256, math.isqrt(self.rows)), 32_768)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, metric: str = "cosine", group: str | None = None, cells: int | None = None, part: int = 4, codes: int = 256, sample: int = 20_000, seed: int = 7) -> VectorIndex:
        """Index ``vectors(vec_id, embedding)`` with an optional ``group`` column in a new folder.

        There are as many cells as half the square root of the rows, at most a sixteenth of ``sample``. Each ``part``
        coordinates of a vector's difference to its centre become one byte, the nearest of up to ``codes`` learned values.
        """
        spark = vectors.sparkSession
        grp = F.col(group).cast("string") if group else F.lit(None).cast("string")
        rows = vectors.where("embedding is not null and vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), grp.alias("grp"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
        long = rows.where(F.exists("e", lambda x: x != 0)) if metric == "cosine" else rows
        n, width = long.agg(F.count(F.lit(1)), F.max(F.size("e"))).first()
        width = width or 1
        some = _matrix((r[0] for r in long.select("e").orderBy(F.xxhash64("vec_id", F.lit(seed)), "e").limit(sample).collect()), width)
        unit = metric == "cosine"
        some = some / np.linalg.norm(some, axis=1, keepdims=True) if unit else some
        cells = cells or max(1, min(math.isqrt(n) // 2, sample // 16))
        centres = centres_of(some, cells, seed) if n else np.zeros((0, width))
        rest = some - centres[_apart(some, centres).argmin(1)] if n else some
        books = [centres_of(rest[:, at : at + part], min(codes, 256), seed + at) for at in range(0, width, part)] if n else []

        def assign(batches):
            for b in batches:
                x = _matrix(b["e"], width)
                if unit:
                    length = np.linalg.norm(x, axis=1, keepdims=True)
                    x = x / np.where(length > 0, length, 1)
                cell = _apart(x, centres).argmin(1) if len(centres) else np.zeros(len(b), int)
                d = x - centres[cell] if len(centres) else x
                code = np.stack([_apart(d[:, i * part : i * part + part], book).argmin(1) for i, book in enumerate(books)], 1).astype(np.uint8) if len(books) and len(b) else np.zeros((len(b), 0), np.uint8)
                none = (length[:, 0] == 0) if unit else np.zeros(len(b), bool)
                yield b.assign(code=[c.tobytes() for c in code], far=np.sqrt((d * d).sum(1)), cell=np.where(none, -1, cell).astype(np.int32))

        rows.mapInPandas(assign, VECTORS).write.parquet(f"{path}/vectors")
        stored = spark.read.schema(VECTORS).parquet(f"{path}/vectors")
        stored.where("cell >= 0").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("near"), F.max("far").alias("far")).write.parquet(f"{path}/cells")
        model = [(metric, width, n, group, centres.ravel().tolist(), [b.tolist() for b in books])]
        spark.createDataFrame(model, "metric string, width int, n long, grp string, centres array<double>, books array<array<array<double>>>").coalesce(1).write.parquet(f"{path}/model")
        return cls(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        return cls(spark, path)

    def _table(self, *columns: str) -> DataFrame:
        """The stored vectors with the number of blocks of their cell; the cells are of a fixed number."""
        blocks = self.spark.read.schema(CELLS).parquet(f"{self.path}/cells").select("cell", F.ceil(F.col("n") / self.most).cast("int").alias("of"))
        rows = self.spark.read.schema(VECTORS).parquet(f"{self.path}/vectors").select("cell", *columns).where("cell >= 0")
        return rows.join(F.broadcast(blocks), "cell")

    def _asked(self, queries: DataFrame) -> DataFrame:
        grp = F.col(self.group).cast("string") if self.group else F.lit(None).cast("string")
        return queries.where("embedding is not null").select(F.col("qid").cast("long").alias("qid"), grp.alias("grp"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))

    def _meet(self, rows: DataFrame, routed: DataFrame, look, schema: str, home: bool = False, part_rows: int = 4096) -> DataFrame:
        """Blocks of ``rows`` and the queries ``routed`` to their cells, block by block.

        The queries of a cell are dealt to parts of about ``part_rows``, and a cell's rows go to its own parts; cells that no query
        reaches are left out before the shuffle. With ``home`` a query meets one block of each of its cells, else all.
        """
        routed = kept(routed, "index-routed")
        asked = routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a cell
        dealt = lambda: F.broadcast(self.spark.createDataFrame([(r[0], -(-r[1] // part_rows)) for r in asked], "cell int, parts int"))
        own = F.pmod(F.xxhash64("qid"), F.col("of")).cast("int")
        block = F.array(own) if home else F.sequence(F.lit(0), F.col("of") - 1)
        sent = routed.join(dealt(), "cell").withColumn("block", F.explode(block)).withColumn("part", F.pmod(F.xxhash64(F.col("qid") + 1), F.col("parts")).cast("int")).drop("parts")
        rows = rows.join(dealt(), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("of")).cast("int"))
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        keys = ["cell", "block", "part"]
        return rows.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(look, schema)

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """The exact ``k`` nearest to each of ``queries(qid, embedding)``: (qid, vec_id, distance, similarity, rank).

        Each query is compared with one block of its nearest cell; the k-th distance found there is a reach that, by the
        triangle inequality, leaves out the cells whose ring around the centre lies beyond it. Then neighbouring cells are
        packed to shelves of rows, and to books of queries by their nearest cell; a query goes once to each shelf
        in reach, and a book meets a shelf in one task, cell by cell. So vectors are copied by shelves and books,
        not by cells, and a task holds one of each. Queries stay a table of any size; distances have 9 places, ties go by
        id. With a group column only vectors of the query's group count. Under cosine, vectors or queries of no length
        have a null distance, last.
        """
        centres, near, far, sizes, width, unit = self.centres, self.near, self.far, self.sizes, self.width, self.metric == "cosine"
        by_group = self.group is not None

        def distances(q, x):
            if not unit:
                return np.stack([((x - y) ** 2).sum(1) for y in q])
            norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]
            return 1 - q @ x.T / norm

        scale = 2 if unit else 1  # squared distances of unit vectors are twice those of cosine
        book_rows = min(max(256, (1 << 20) // width), max(1024, self.rows // 16))
        shelf_of, shelf_parts = _packed(chain := _chain(centres), sizes, 2 * book_rows)
        holds = np.zeros((len(centres), int((shelf_of + shelf_parts).max(initial=0))), np.float32)
        for c, (low, n) in enumerate(zip(shelf_of, shelf_parts)):
            holds[c, low : low + n] = sizes[c] > 0

        def units(x):
            return x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x

        def within(d, cap, cells):
            """Which of ``cells``, whose centres are ``d`` away, may hold a vector of a squared distance up to ``cap``."""
            reach = np.sqrt(cap) * (1 + 1e-6) + 1e-6
            return ~(np.maximum(d - far[None, cells], near[None, cells] - d) > reach[:, None])

        def slack(u, v):
            return 1e-8 + 1e-11 * ((u * u).sum(1) + (v * v).sum(1).max(initial=0))

        def caps(reach, u, v):
            t = reach.to_numpy(float)
            return np.where(np.isnan(t), np.inf, scale * t) + slack(u, v)  # no reach: every cell

        def at_home(batches):
            for b in batches:
                if len(b):
                    d = np.where(sizes > 0, _apart(units(_matrix(b["e"], width)), centres), np.inf)
                    yield b.assign(cell=d.argmin(1).astype(np.int32))

        def in_reach(batches):
            for b in batches:
                for at in range(0, len(b), 1024):
                    some = b.iloc[at : at + 1024]
                    u = units(_matrix(some["e"], width))
                    d = np.sqrt(_apart(u, centres))
                    live = within(d, caps(some["reach"], u, centres), slice(None)).astype(np.float32) @ holds > 0
                    yield some.assign(cell=np.where(sizes > 0, d, np.inf).argmin(1).astype(np.int32), shelves=[np.flatnonzero(x).astype(np.int32) for x in live])

        def exact(q, x):
            if not unit:
                return ((x - q) ** 2).sum(1)
            return 1 - (q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))

        def search(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            """A book of queries against a shelf of rows; only pairs that can be among the ``k`` best are compared in full."""
            out, tile = [], 2048
            if len(x) and len(q):
                x = x.sort_values(["cell", "vec_id"], kind="stable")
                v, ids, xg = _matrix(x["e"], width), x["vec_id"].to_numpy(), x["grp"].to_numpy(object)
                vu = units(v)
                cells, starts = np.unique(x["cell"].to_numpy(), return_index=True)
                ends = np.r_[starts[1:], len(x)]
                for at in range(0, len(q), 512):
                    some = q.iloc[at : at + 512]
                    y = _matrix(some["e"], width)
                    u, yg = units(y), some["grp"].to_numpy(object)
                    more, cap = slack(u, vu), caps(some["reach"], u, vu)
                    away = np.sqrt(_apart(u, centres[cells]))
                    who, d, of = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
                    for j, cell in enumerate(cells.tolist()):
                        for low in range(starts[j], ends[j], tile):
                            live = np.flatnonzero(within(away[:, j : j + 1], cap, [cell])[:, 0])
                            if not len(live):
                                break
                            rows = slice(low, min(low + tile, ends[j]))
                            rough = _apart(u[live], vu[rows])
                            if by_group:
                                rough[yg[live][:, None] != xg[rows][None, :]] = np.inf
                            near_by = rough <= np.minimum(cap[live], 1e300)[:, None]
                            if rough.shape[1] > k and np.count_nonzero(near_by) > 4 * k * len(live):
                                near_by &= rough <= (np.partition(rough, k - 1, axis=1)[:, k - 1] + more[live])[:, None]
                            a, z = np.nonzero(near_by)
                            if not len(a):
                                continue
                            a, z = live[a], z + low
                            new = np.concatenate([exact(y[a[i : i + 32_768]], v[z[i : i + 32_768]]) for i in range(0, len(a), 32_768)])
                            who, d, of = np.r_[who, a], np.r_[d, np.round(new, 9) + 0.0], np.r_[of, ids[z]]  # no negative zero
                            order = np.lexsort((of, d, who))
                            who = who[order]
                            place = np.arange(len(who)) - np.searchsorted(who, who)
                            best = place < k
                            who, d, of, place = who[best], d[order][best], of[order][best], place[best]
                            full = place == k - 1
                            cap[who[full]] = np.minimum(cap[who[full]], scale * d[full] + more[who[full]])
                    out.append(pd.DataFrame({"qid": some["qid"].to_numpy()[who], "vec_id": of, "distance": d}))
            return pd.concat(out) if out else pd.DataFrame({"qid": [], "vec_id": [], "distance": []})

        def look(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(x) and len(q):
                x = x.sort_values("vec_id", kind="stable")
                v, ids = _matrix(x["e"], width), x["vec_id"].to_numpy()
                for at in range(0, len(q), 512):
                    some = q.iloc[at : at + 512]
                    d = np.round(distances(_matrix(some["e"], width), v), 9) + 0.0  # no negative zero
                    if by_group:
                        d = np.where(some["grp"].to_numpy(object)[:, None] == x["grp"].to_numpy(object)[None, :], d, np.inf)
                    order = np.argsort(d, axis=1, kind="stable")[:, :k]
                    best = np.take_along_axis(d, order, 1)
                    who, place = np.nonzero(best < np.inf)
                    out.append(pd.DataFrame({"qid": some["qid"].to_numpy()[who], "vec_id": ids[order[who, place]], "distance": best[who, place]}))
            return pd.concat(out) if out else pd.DataFrame({"qid": [], "vec_id": [], "distance": []})

        asked = self._asked(queries)
        if not self.rows:  # no vector, or none that has a length
            found = self._without_length(asked, k) if unit else self.spark.createDataFrame([], NEAR)
            return self._ranked(found, k)
        long = kept(asked.where(F.exists("e", lambda x: x != 0)) if unit else asked, "nearest-asked")
        rows = self._table("vec_id", "grp", "e")
        blocks = F.broadcast(rows.select("cell", "of").distinct())  # a row a cell
        routed = long.mapInPandas(at_home, "qid long, grp string, e array<double>, cell int").join(blocks, "cell")
        begun = self._meet(rows, routed, look, NEAR, home=True)
        known = begun.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("reach"))
        kinds = "qid long, grp string, e array<double>, reach double, cell int, shelves array<int>"
        reached = kept(long.join(known, "qid", "left").select("qid", "grp", "e", "reach").mapInPandas(in_reach, kinds), "nearest-reach")
        asking = np.zeros(len(centres), np.int64)
        for r in reached.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a cell
            asking[r[0]] = r[1]

        def dealt(first, parts, key: str, name: str):
            group = F.col("first") + F.pmod(F.xxhash64(key), F.col("parts"))
            of = F.broadcast(self.spark.createDataFrame([(c, int(a), int(n)) for c, (a, n) in enumerate(zip(first, parts))], "cell int, first int, parts int"))
            return lambda df: df.join(of, "cell").withColumn(name, group.cast("int")).drop("first", "parts")

        sent = dealt(*_packed(chain, asking, book_rows), "qid", "book")(reached).withColumn("shelf", F.explode("shelves")).drop("shelves", "cell")
        books = sent.groupBy("shelf").agg(F.collect_set("book").alias("books"))  # a row a shelf
        held = dealt(shelf_of, shelf_parts, "vec_id", "shelf")(rows.drop("of")).join(F.broadcast(books), "shelf").withColumn("book", F.explode("books")).drop("books")
        found = held.groupBy("shelf", "book").cogroup(sent.groupBy("shelf", "book")).applyInPandas(search, NEAR)
        if unit:
            found = found.unionByName(self._without_length(asked, k))
        return self._ranked(found, k)

    @staticmethod
    def _ranked(found: DataFrame, k: int) -> DataFrame:
        order = W.partitionBy("qid").orderBy(F.col("distance").asc_nulls_last(), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("qid", "vec_id", "distance", (1 - F.col("distance")).alias("similarity"), "rank")

    def _without_length(self, asked: DataFrame, k: int) -> DataFrame:
        """The first ``k`` vectors of no length a group, for every query, and of all vectors, for queries of no length."""
        rows = self.spark.read.schema(VECTORS).parquet(f"{self.path}/vectors").select("vec_id", "grp", "cell")
        order = W.partitionBy("grp").orderBy("vec_id")

        def first(of: DataFrame) -> DataFrame:
            top = of.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k) if self.group else of.orderBy("vec_id").limit(k)
            return top.select("vec_id", "grp")

        none = F.lit(None).cast("double").alias("distance")
        on = (lambda q, v: q.join(v.withColumnRenamed("grp", "_g"), F.col("grp") == F.col("_g"))) if self.group else (lambda q, v: q.crossJoin(F.broadcast(v.drop("grp"))))  # k rows
        empty = ~F.exists("e", lambda x: x != 0)
        every = on(asked.where(~empty).select("qid", "grp"), first(rows.where("cell < 0")))
        return every.unionByName(on(asked.where(empty).select("qid", "grp"), first(rows))).select("qid", "vec_id", none)

    def approximate(self, queries: DataFrame, k: int, probes: int | None = None, shortlist: int | None = None) -> DataFrame:
        """``k`` near vectors by codes: (qid, vec_id, distance, rank).

        Of the ``probes`` nearest cells (nine tenths by default, as vectors without clusters need; far fewer do for clustered ones) only ids and codes are read; distances to codes come from tables
        of each query's parts. The ``shortlist`` best (10 times ``k`` by default) are joined with their full vectors and ranked
        exactly. Vectors and queries of no length are not found; the group column is ignored.
        """
        probes = min(probes or -(-9 * len(self.centres) // 10), max(1, len(self.centres)))
        shortlist = shortlist or 10 * k
        centres, books, sizes, width, unit = self.centres, self.books, self.sizes, self.width, self.metric == "cosine"
        starts = np.cumsum([0, *(b.shape[1] for b in books)])

        def route(batches):
            for b in batches:
                if not len(b):
                    continue
                q = _matrix(b["e"], width)
                q = q / np.linalg.norm(q, axis=1, keepdims=True) if unit else q
                d = np.where(sizes > 0, _apart(q, centres), np.inf)
                cell = np.argsort(d, axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pd.DataFrame({"qid": b["qid"].to_numpy(), "u": list(q), "cells": [c[x[c] < np.inf] for c, x in zip(cell, d)]})

        def look(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(x) and len(q):
                codes, ids = np.frombuffer(b"".join(x["code"]), np.uint8).reshape(len(x), -1), x["vec_id"].to_numpy()
                rest = _matrix(q["u"], width) - centres[q["cell"].iloc[0]]
                tables = [_apart(rest[:, a:z], book) for a, z, book in zip(starts[:-1], starts[1:], books)]
                for i, qid in enumerate(q["qid"].tolist()):
                    d = sum(t[i][codes[:, j]] for j, t in enumerate(tables))
                    best = np.argpartition(d, shortlist - 1)[:shortlist] if len(d) > shortlist else np.arange(len(d))
                    out.append(pd.DataFrame({"qid": qid, "vec_id": ids[best], "about": d[best], "cell": q["cell"].iloc[0]}))
            return pd.concat(out) if out else pd.DataFrame({"qid": [], "vec_id": [], "about": [], "cell": []})

        if not self.rows:
            return self.spark.createDataFrame([], NEAR + ", rank int")
        asked = self._asked(queries)
        asked = kept(asked.where(F.exists("e", lambda x: x != 0)) if unit else asked, "approximate-asked")
        rows = self._table("vec_id", "code")
        routed = asked.mapInPandas(route, "qid long, u array<double>, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells")
        near = self._meet(rows, routed.join(F.broadcast(rows.select("cell", "of").distinct()), "cell"), look, "qid long, vec_id long, about double, cell int")
        order = W.partitionBy("qid").orderBy("about", "vec_id")
        short = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= shortlist).select("qid", "vec_id", "cell")
        whole = self.spark.read.schema(VECTORS).parquet(f"{self.path}/vectors").select("cell", "vec_id", "e")
        pairs = short.join(whole, ["cell", "vec_id"]).join(asked.select("qid", F.col("e").alias("q")), "qid")
        exact = cosine_distance(F.col("e"), F.col("q")) if unit else F.aggregate(F.zip_with("e", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        ranked = pairs.select("qid", "vec_id", (F.round(exact, 9) + 0.0).alias("distance"))
        order = W.partitionBy("qid").orderBy("distance", "vec_id")
        return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
