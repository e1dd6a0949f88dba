"""Hard-negative mining: windows of inner products searched in cover trees over norm-augmented vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusq.llm.shared import written

#: Below and above every score.
LOW, HIGH = -(1 << 62), 1 << 62
ASKED = "anchor_id long, label long, v array<long>, win array<int>, lo array<long>, hi array<long>, floor array<long>"


def matrix(vectors, width: int) -> np.ndarray:
    """Vectors as rows of floats, which hold their integers exactly; shorter ones are followed by zeros."""
    vectors = list(vectors)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def augmented(x: np.ndarray, norm: float) -> np.ndarray:
    """``x`` with one more coordinate that gives every row the length ``norm``: inner products then fall as distances grow."""
    return np.column_stack([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))])


def net(x: np.ndarray, cover: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres over ``cover`` apart that cover all rows within it: (positions, each row's centre, its distance to it).

    The farthest row becomes the next centre, row 0 the first; ``most`` centres at most.
    """
    centres, of = [0], np.zeros(len(x), np.int64)
    near = np.sqrt(((x - x[0]) ** 2).sum(1))
    while near.max() > cover and (most is None or len(centres) < most):
        at = int(near.argmax())
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        closer = d < near
        of[closer], near[closer] = len(centres), d[closer]
        centres.append(at)
    return np.array(centres), of, near


def cover_tree(x: np.ndarray, leaf: int = 64, base: float = 1.1):
    """Levels of a cover tree over the rows of ``x``: for each a list of (centre, radius, parent, members or None).

    The children of a node form a net of its radius divided by ``base``; ``radius`` is the distance to the farthest row
    below. Nodes of up to ``leaf`` rows, or of equal rows, have members and no children.
    """
    radius = float(np.sqrt(((x - x[0]) ** 2).sum(1)).max())
    todo, levels = [(0, radius, -1, np.arange(len(x)))], []
    while todo:
        level, below = [], []
        for centre, radius, parent, rows in todo:
            if len(rows) <= leaf or radius == 0:
                level.append((centre, radius, parent, rows))
                continue
            own = len(level)
            level.append((centre, radius, parent, None))
            ordered = np.r_[centre, rows[rows != centre]]
            centres, of, near = net(x[ordered], radius / base)
            for c, at in enumerate(centres):
                mine = of == c
                below.append((int(ordered[at]), float(near[mine].max()), own, ordered[mine]))
        levels.append(level)
        todo = below
    return levels


def bounds(q: np.ndarray, centres: np.ndarray, radius: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``q`` with anything within ``radius`` of each (augmented) centre.

    All augmented vectors have length ``norm``, so a radius is an angle around the centre. Both bounds are widened by
    more than the rounding error.
    """
    size = np.sqrt((q * q).sum(1))[:, None] * norm
    cos = np.divide(q @ centres[:, :-1].T, size, out=np.zeros((len(q), len(centres))), where=size > 0)
    angle = np.arccos(np.clip(cos, -1, 1))
    wide = 2 * np.arcsin(np.clip(radius / (2 * norm), 0, 1))[None, :] if norm > 0 else np.zeros((1, len(centres)))
    spare = 1e-6 * size + 1
    return size * np.cos(np.minimum(angle + wide, math.pi)) - spare, size * np.cos(np.maximum(angle - wide, 0)) + spare


def search(x: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, asked: dict, same: bool, k: int, norm: float):
    """The first ``k`` rows in each window of each asked row: (asked position, window position, row position, score).

    ``asked`` has arrays id and label, and lo, hi, floor of shape (asked, windows). Rows must be in ascending order of
    ``ids``. The tree is descended level by level, leaving out nodes whose bounds miss every window or lie below its
    floor; leaves are then taken in the order of their bounds, and raised floors end the search.
    """
    n, lo, hi = len(x), asked["lo"], asked["hi"]
    if max((float(np.abs(m).sum(1).max()) if m.size else 0) for m in (x, q)) * max((float(np.abs(m).max()) if m.size else 0) for m in (x, q)) * n >= 2**62:
        raise OverflowError("vectors too long for exact scores")
    floor = np.maximum(asked["floor"], lo)
    whole = augmented(x, norm)
    levels = cover_tree(whole)
    leaves, upper = [], []
    alive = None
    for level in levels:
        low, high = bounds(q, whole[[c for c, *_ in level]], np.array([r for _, r, *_ in level]), norm)
        live = ((high[:, :, None] >= floor[:, None, :]) & (low[:, :, None] <= hi[:, None, :])).any(2)
        if alive is not None:
            live &= alive[:, [p for _, _, p, _ in level]]
        for i, (_, _, _, rows) in enumerate(level):
            if rows is not None:
                leaves.append(rows)
                upper.append(np.where(live[:, i], high[:, i], -np.inf))
        alive = live
    upper = np.array(upper).T.reshape(len(q), len(leaves))
    order = np.argsort(-upper, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(leaves))[None, :], 1)
    seen = np.zeros((len(q), n), bool)
    score = np.zeros((len(q), n), np.int64)
    other = (labels[None, :] == asked["label"][:, None]) == same
    if same:
        other &= ids[None, :] != asked["id"][:, None]
    back = np.arange(n - 1, -1, -1, dtype=np.int64)
    exact = np.float64 if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] < 2**53 else np.int64
    xs, qs = x.astype(exact), q.astype(exact)
    best: list[tuple] = [()] * lo.shape[1]
    done = 0
    while done < len(leaves):
        upto = max(done * 4, -(-len(leaves) // 4))
        turn = (place >= done) & (place < upto) & (upper >= floor.min(1)[:, None]) & (upper > -np.inf)
        done = upto
        if not turn.any():
            continue
        for i in np.flatnonzero(turn.any(0)):
            who, rows = np.flatnonzero(turn[:, i]), leaves[i]
            score[np.ix_(who, rows)] = (qs[who] @ xs[rows].T).astype(np.int64)
            seen[np.ix_(who, rows)] = True
        ok = seen & other
        for w in range(lo.shape[1]):
            who, at = np.nonzero(ok & (score >= floor[:, w : w + 1]) & (score <= hi[:, w : w + 1]))
            keys = score[who, at] * n + back[at]
            order = np.lexsort((-keys, who))
            who, at = who[order], at[order]
            begin = np.searchsorted(who, who)  # of each asked row's own
            first = np.arange(len(who)) - begin < k
            kth = np.arange(len(who)) - begin == k - 1
            best[w] = who[first], at[first]
            floor[who[kth], w] = score[who[kth], at[kth]]
    out = [(np.zeros(0, np.int64),) * 4]
    for w, found in enumerate(best):
        if found:
            who, at = found
            out.append((who, np.full(len(who), w), at, score[who, at]))
    return tuple(np.concatenate(c) for c in zip(*out))


class Index:
    """Rows dealt to the cells of a tree's top level, cells to blocks of bounded size; kept as a table.

    ``rows(vec_id long, label long, v array<long>)``, without nulls. The cells' centres are a net over at most ``sample``
    rows (chosen by a seeded hash); every row is in the cell of its nearest centre, and the cell's radius is that of all its rows.
    A block has about the square root of all rows, 256 at least and 32,768 at most.
    """

    def __init__(self, rows: DataFrame, sample: int = 4096, cells: int = 64, seed: int = 7):
        size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        count, width, square = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(size)).first()
        self.count, self.width, self.norm = count, width or 0, math.sqrt(square or 0)
        if not count:
            return
        some = rows.select("v").orderBy(F.xxhash64("vec_id", F.lit(seed)), "v").limit(sample).collect()
        some = augmented(matrix((r[0] for r in some), self.width), self.norm)
        self.centres = centres = some[net(some, 0.0, cells)[0]]
        width, norm = self.width, self.norm

        def assign(batches):
            for b in batches:
                if len(b):
                    x = augmented(matrix(b["v"], width), norm)
                    d = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
                    cell = d.argmin(1)
                    far = np.sqrt(((x - centres[cell]) ** 2).sum(1))
                    yield b.assign(cell=cell.astype(np.int32), far=far)

        self.table = written(rows.mapInPandas(assign, "vec_id long, label long, v array<long>, cell int, far double"), "negatives-index")
        self.most = min(max(256, math.isqrt(count)), 32_768)
        told = {r[0]: r[1:] for r in self.table.groupBy("cell").agg(F.count(F.lit(1)), F.max("far")).collect()}  # a row a cell
        self.blocks = [-(-told.get(c, (0, 0))[0] // self.most) for c in range(len(centres))]
        self.radius = np.array([told.get(c, (0, 0.0))[1] for c in range(len(centres))])

    def _of(self, cell: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.blocks)), cell)

    def search(self, asked: DataFrame, same: bool, k: int, home: bool, part_rows: int = 4096) -> DataFrame:
        """(anchor_id, win, vec_id, score): each block's first ``k`` rows of each window of ``asked`` (columns of ``ASKED``).

        With ``home`` each anchor goes to one block of its nearest cell, else to all other blocks of the cells that its windows
        and floors do not rule out. Anchors of a cell are dealt to parts of about ``part_rows``, and its rows go to these parts; cells
        that no anchor reaches are left out.
        """
        centres, radius, blocks, width, norm = self.centres, self.radius, np.array(self.blocks), self.width, self.norm

        def route(batches):
            for b in batches:
                if not len(b):
                    continue
                low, high = bounds(matrix(b["v"], width), centres, radius, norm)
                high[:, blocks == 0] = -np.inf
                first = high.argmax(1)
                if home:
                    yield b.assign(cell=first.astype(np.int32), near=True)
                    continue
                lo, hi, floor = (np.array(b[c].tolist(), np.int64).reshape(len(b), -1) for c in ("lo", "hi", "floor"))
                floor = np.maximum(lo, floor)
                live = ((high[:, :, None] >= floor[:, None, :]) & (low[:, :, None] <= hi[:, None, :]) & (lo <= hi)[:, None, :]).any(2)
                who, cell = np.nonzero(live & (blocks > 0)[None, :])
                yield b.iloc[who].assign(cell=cell.astype(np.int32), near=cell == first[who])

        sent = written(asked.mapInPandas(route, ASKED + ", cell int, near boolean"), "negatives-routed")
        told = {r[0]: -(-r[1] // part_rows) for r in sent.groupBy("cell").agg(F.count(F.lit(1))).collect()}  # a row a cell
        parts = F.get(F.array(*(F.lit(told.get(c, 0)) for c in range(len(blocks)))), F.col("cell"))
        sent = sent.withColumn("of", self._of(F.col("cell")))
        own = F.pmod(F.xxhash64("anchor_id"), F.col("of")).cast("int")
        if home:
            sent = sent.withColumn("block", own)
        else:
            every = F.sequence(F.lit(0), F.col("of") - 1)
            sent = sent.withColumn("block", F.explode(F.when(F.col("near"), F.filter(every, lambda i: i != own)).otherwise(F.filter(every, lambda i: i >= 0))))
        # the part does not depend on the home block, so both searches of an anchor leave out the same one
        sent = sent.withColumn("part", F.pmod(F.xxhash64(F.col("anchor_id") + 1), parts).cast("int")).drop("of", "near")
        rows = self.table.where(parts > 0).withColumn("block", F.pmod(F.xxhash64("vec_id"), self._of(F.col("cell"))).cast("int"))
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        kept = ["anchor_id", "win", "vec_id", "score"]

        def look(x: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
            out = [np.zeros((4, 0), np.int64)]
            if len(x) and len(a):
                x = x.sort_values("vec_id", kind="stable")
                v, ids, labels = matrix(x["v"], width), x["vec_id"].to_numpy(), x["label"].to_numpy()
                fresh = np.r_[True, (np.diff(ids) != 0) | (np.diff(labels) != 0) | (np.diff(v, axis=0) != 0).any(1)]
                v, ids, labels = v[fresh], ids[fresh], labels[fresh]
                for at in range(0, len(a), 512):
                    some = a.iloc[at : at + 512]
                    # anchors of fewer windows get empty ones
                    n = max(map(len, some["win"]))
                    ask = {c: np.array([[*w, *[fill] * (n - len(w))] for w in some[c]], np.int64).reshape(len(some), n) for c, fill in (("lo", 1), ("hi", 0), ("floor", HIGH), ("win", -1))}
                    ask |= {"id": some["anchor_id"].to_numpy(), "label": some["label"].to_numpy()}
                    if n:
                        who, w, row, score = search(v, ids, labels, matrix(some["v"], width), ask, same, k, norm)
                        out.append(np.array([ask["id"][who], ask["win"][who, w], ids[row], score]))
            return pd.DataFrame(np.concatenate(out, 1).T, columns=kept)

        keys = ["cell", "block", "part"]
        return rows.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(look, "anchor_id long, win int, vec_id long, score long")

    def first(self, anchors: DataFrame, windows: DataFrame, same: bool, k: int) -> DataFrame:
        """The first ``k`` rows, by falling score and then vec_id, of each of ``windows(anchor_id, win, lo, hi)``, with their ``rank``.

        The home block's k-th score is the floor of the search through all others.
        """

        def asked(floors: DataFrame | None) -> DataFrame:
            w = windows.withColumn("floor", F.col("lo")) if floors is None else windows.join(floors, ["anchor_id", "win"], "left").withColumn("floor", F.greatest("lo", "floor"))
            w = w.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("win", "lo", "hi", "floor"))).alias("w"))
            return anchors.join(w, "anchor_id").select("anchor_id", "label", "v", *(F.col(f"w.{c}").alias(c) for c in ("win", "lo", "hi", "floor")))

        near = written(self.search(asked(None), same, k, True), "negatives-home")
        floors = near.groupBy("anchor_id", "win").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        found = near.unionByName(self.search(asked(floors), same, k, False))
        order = W.partitionBy("anchor_id", "win").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), sample: int = 4096, cells: int = 64) -> DataFrame:
    """For each anchor's first ``positives`` rows of its label, the first ``negatives`` rows of other labels in the window below.

    ``rows(vec_id, label, v array<long>)`` are the candidates, ``anchors`` (same columns) the stated query set. Scores are
    exact integer inner products; higher come first, ties by smaller vec_id. A negative's score lies between
    ``share[0] / share[1]`` of the positive's and the positive's. Norms are evened out by one more coordinate, so that covering
    radii of the tree bound inner products; each anchor searches one block of its nearest cell first, and only what may
    still beat that elsewhere. Where vectors have no clusters, the bounds rule out little and all rows are compared.

    Returns (anchor_id, positive_id, rank, negative_id, positive_score, negative_score). Rows with a null in any column,
    or in the vector, take no part; a vector shorter than the longest counts as followed by zeros; repeated rows count once. Rows
    that share an id but differ count each, except as anchors, where the first by label and vector does. Copies and
    one label with most rows are dealt to blocks like all others. No anchor or no row: an empty table. Scores whose
    order needs more than 62 bits end the job with an error. Other columns are left out.
    """
    told = [F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v")]
    sound = "vec_id is not null and label is not null and v is not null and not exists(v, x -> x is null)"
    index = Index(rows.select(*told).where(sound), sample, cells)
    spark = rows.sparkSession
    if not index.count:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    one = anchors.select(*told).where(sound).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x"))
    one = written(one.select(F.col("vec_id").alias("anchor_id"), "x.label", "x.v"), "negatives-anchors")
    everything = one.select("anchor_id", F.lit(0).alias("win"), F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi"))
    pos = written(index.first(one, everything, True, positives), "negatives-positives")
    pos = pos.select("anchor_id", F.col("rank").alias("win"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    least = F.ceil(F.col("positive_score").cast("decimal(38,0)") * share[0] / F.lit(share[1])).cast("long")
    windows = pos.select("anchor_id", "win", least.alias("lo"), F.col("positive_score").alias("hi")).where("lo <= hi")
    neg = index.first(one, windows, False, negatives)
    return neg.join(pos, ["anchor_id", "win"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): each component x as floor(scale * x); null or not finite ones make the row's vector null."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return embeddings.select("vec_id", "label", F.when(~bad, whole).alias("v"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor row of ``embeddings``, against all rows."""
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_hard_negatives(rows, rows.where("vec_id % 100 = 0"))


ORACLE = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score FROM r a JOIN r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id))::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) <= 5"""
