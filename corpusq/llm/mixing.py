"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks to shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusq.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], most: float) -> DataFrame:
    """``(source, size)`` rows -> (source, sid, source_size, target), a row for each source.

    Sources in code point order, null last, get ``weights`` in turn and share the sum of all sizes by weight; a
    target stops at ``most`` times its source's size and the excess is shared again by weight.
    """
    s = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    every = W.partitionBy(F.lit(0))  # one row for each source from here on
    s = s.withColumn("sid", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("total", F.sum("source_size").over(every).cast("double"))
    before = every.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return s.select("source", F.col("sid").cast("int").alias("sid"), "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def sainte_lague(df: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """Adds ``quota``: the ``seats`` of each group dealt one by one to the highest quotients votes / (2n + 1).

    All seats surely won are given at once: a share's seats differ from its exact part by no more than
    share * parties / 2 + 1/2, so only that many quotients a party are ranked. Ties go to the smaller ``key``.
    """
    g = W.partitionBy(*(group or [F.lit(0)]))
    d = df.withColumn("_v", F.col(votes).cast("double")).withColumn("_all", F.sum("_v").over(g)).withColumn("_n", F.sum(F.when(F.col("_v") > 0, 1).otherwise(0)).over(g))
    part = F.when(F.col("_all") > 0, F.col("_v") / F.col("_all")).otherwise(0.0)
    d = d.withColumn("_q", F.floor(part * F.col(seats))).withColumn("_slack", (F.ceil(part * F.col("_n") / 2) + 1).cast("long"))
    d = d.withColumn("_base", F.when(F.col("_v") > 0, F.greatest(F.lit(0).cast("long"), F.col("_q") - F.col("_slack"))).otherwise(F.lit(0).cast("long")))
    d = d.withColumn("_left", F.col(seats) - F.sum("_base").over(g))
    bids = d.where("_v > 0").select(*group, key, "_v", "_left", F.explode(F.sequence("_base", F.col("_q") + F.col("_slack"))).alias("_j"))
    rank = F.row_number().over(g.orderBy((F.col("_v") / (2 * F.col("_j") + 1)).desc(), key, "_j"))
    won = bids.withColumn("_r", rank).where("_r <= _left").groupBy(*group, key).agg(F.count(F.lit(1)).alias("_won"))
    return d.join(won, [*group, key], "left").select(*df.columns, (F.col("_base") + F.coalesce("_won", F.lit(0))).alias("quota"))


GROUP = 1024  # shards of a source that are ranked together


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block_words: int = 64, shard_docs: int = 2_000, shard_words: int = 2_048, seed: str = "mix-1", keep: tuple[str, ...] = ()) -> DataFrame:
    """Words that a mix by source weights takes of every document.

    ``docs(doc_id, source, text)`` -> (doc_id, size, source_size, target, taken, *keep), a row for each row.
    Documents are dealt by a seeded hash to shards of their source, of ``shard_docs`` rows or ``shard_words`` words
    or more (a source of less is one shard). Blocks of ``block_words`` words are apportioned to sources by target,
    and within a source by size to groups of 1,024 shards and to the shards of a group (Sainte-Lague each time).
    A shard repeats its words as often as its quota needs, up to ``most`` times, and fills the rest with the first
    blocks of a seeded order of its documents; words of a quota above that go to the other shards of its group, so
    a source misses its target by about a block, and one whose target is ``most`` times its size by a block a group.
    Null texts have size 0 and take nothing; null sources are a source of their own; null ids are drawn by their
    text; repeated rows are kept, ordered by id, size and text; an empty table gives an empty one.
    A hot source is cut by its shards; only counts a source and shard are gathered.
    """
    whole = F.xxhash64(F.col("text").cast("string"))
    sized = docs.select("doc_id", "source", *[c for c in keep if c not in ("doc_id", "source")], word_count().alias("size"), whole.alias("_t"))
    sized = written(sized, "mix-sizes")
    n = sized.count()
    fine = 1 << max(3, (-(-n // shard_docs) - 1).bit_length())  # a power of two, so that fewer shards are unions of these
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("/"), F.col("_t").cast("string")))
    draw = F.md5(F.concat(F.lit(seed), ident))
    rows = sized.withColumn("_o", draw).withColumn("_fine", (F.conv(F.substring("_o", 1, 8), 16, 10).cast("long") % fine).cast("int"))

    units = rows.groupBy("source", "_fine").agg(F.sum("size").alias("_unit"), F.count(F.lit(1)).alias("_rows"))
    units = written(units, "mix-units")
    targets = source_targets(units.select("source", F.col("_unit").alias("size")), list(weights), most)
    total = F.sum("target").over(W.partitionBy(F.lit(0)))
    targets = targets.withColumn("blocks", F.round(total / block_words).cast("long"))
    targets = sainte_lague(targets, [], "sid", "target", "blocks").select(F.col("source").alias("_s"), "sid", "source_size", "target", F.col("quota").alias("_blocks"))
    counts = units.groupBy("source").agg(F.sum("_rows").alias("_rows"))
    targets = targets.join(counts, targets["_s"].eqNullSafe(counts["source"])).drop("source")
    wanted = F.greatest(F.lit(1).cast("long"), F.expr(f"source_size div {shard_words}"), F.expr(f"_rows div {shard_docs}"))
    targets = targets.withColumn("_shards", wanted)
    targets = targets.withColumn("_shards", F.least(F.lit(fine).cast("long"), F.expr("shiftleft(1L, length(bin(_shards)) - 1)")))
    placed = units.join(targets.drop("_rows"), units["source"].eqNullSafe(targets["_s"])).withColumn("_shard", F.col("_fine") % F.col("_shards"))

    shards = placed.groupBy("sid", "_shard").agg(F.sum("_unit").alias("_unit"), F.first("_blocks").alias("_blocks")).withColumn("_group", F.expr(f"_shard div {GROUP}"))
    groups = shards.groupBy("sid", "_group").agg(F.sum("_unit").alias("_unit"), F.first("_blocks").alias("_blocks"))
    groups = sainte_lague(groups, ["sid"], "_group", "_unit", "_blocks").select("sid", "_group", F.col("quota").alias("_seats"))
    dealt = sainte_lague(shards.join(groups, ["sid", "_group"]), ["sid", "_group"], "_shard", "_unit", "_seats")
    dealt = dealt.withColumn("_room", F.col("_unit") * most).withColumn("_words", F.least(F.col("quota") * block_words, F.col("_room")))
    dealt = dealt.withColumn("_room", F.col("_room") - F.col("_words")).withColumn("_over", F.col("quota") * block_words - F.col("_words"))
    # words above a shard's capacity go to the group's other shards in proportion to their room, whole words by the differences of the floors
    own = W.partitionBy("sid", "_group")
    upto = own.orderBy("_shard").rowsBetween(W.unboundedPreceding, W.currentRow)
    dealt = dealt.withColumn("_all", F.sum("_room").over(own)).withColumn("_more", F.least(F.sum("_over").over(own), F.col("_all"))).withColumn("_upto", F.sum("_room").over(upto))
    share = lambda c: F.when(F.col("_all") > 0, F.expr(f"cast(_more as decimal(19, 0)) * cast({c} as decimal(19, 0)) div cast(_all as decimal(19, 0))")).otherwise(F.lit(0).cast("long"))
    dealt = dealt.select("sid", "_shard", F.col("_unit").alias("_size"), (F.col("_words") + share("_upto") - share("(_upto - _room)")).alias("_words"))
    dealt = placed.join(dealt, ["sid", "_shard"]).select("_s", F.col("_fine").alias("_f"), "sid", "_shard", "source_size", "target", "_size", "_words")
    dealt = written(dealt, "mix-quotas")

    joined = rows.join(dealt, rows["source"].eqNullSafe(dealt["_s"]) & (rows["_fine"] == dealt["_f"]))
    before = W.partitionBy("sid", "_shard").orderBy("_o", "doc_id", "size", "_t").rowsBetween(W.unboundedPreceding, -1)
    joined = joined.withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    times = F.when(F.col("_size") > 0, F.expr("_words div _size")).otherwise(F.lit(0).cast("long"))
    rest = F.col("_words") - times * F.col("_size")
    taken = times * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("_before")))
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *keep)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of all documents by the mix of sources weighing 5, 2, 1 in turn."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
n AS (SELECT CAST(1 AS BIGINT) << greatest(3, CAST(ceil(log2(greatest(1, ceil(count(*) / 2000.0)))) AS BIGINT)) AS fine FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
s1 AS (SELECT s0.*, CAST([5, 2, 1][CAST(sid % 3 + 1 AS INT)] AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap, least(fine, CAST(1 AS BIGINT) << (length(bin(greatest(1, source_size // 2048, docs // 2000))) - 1)) AS shards FROM s0, n),
s2 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level FROM s1 WINDOW w AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, least(cap, max(level) OVER () * weight) AS target FROM s2),
r AS (SELECT d.*, s3.sid, CAST(('0x' || o[1:8]) AS BIGINT) % shards AS shard FROM d JOIN s3 ON s3.source IS NOT DISTINCT FROM d.source),
t AS (SELECT CAST(round(sum(target) / 64) AS BIGINT) AS blocks FROM s3),
q AS (SELECT sid, count(*) AS quota FROM (SELECT sid, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, sid, j) AS k, blocks FROM s3, t, LATERAL (SELECT unnest(range(0, CAST(ceil(3 * target / 64) AS BIGINT) + 2)) AS j) WHERE target > 0) WHERE k <= blocks GROUP BY sid),
u AS (SELECT sid, shard, shard // 1024 AS grp, CAST(sum(size) AS BIGINT) AS unit FROM r GROUP BY ALL),
v AS (SELECT sid, grp, CAST(sum(unit) AS BIGINT) AS unit FROM u GROUP BY ALL),
w AS (SELECT sid, grp, count(*) AS quota FROM (SELECT v.sid, v.grp, q.quota, row_number() OVER (PARTITION BY v.sid ORDER BY CAST(unit AS DOUBLE) / (2 * j + 1) DESC, v.grp, j) AS k
FROM v JOIN q ON q.sid = v.sid, LATERAL (SELECT unnest(range(0, CAST(ceil(6 * unit / 64) AS BIGINT) + 3)) AS j) WHERE unit > 0) WHERE k <= quota GROUP BY sid, grp),
b AS (SELECT sid, shard, count(*) AS quota FROM (SELECT u.sid, u.shard, w.quota, row_number() OVER (PARTITION BY u.sid, u.grp ORDER BY CAST(unit AS DOUBLE) / (2 * j + 1) DESC, u.shard, j) AS k
FROM u JOIN w ON w.sid = u.sid AND w.grp = u.grp, LATERAL (SELECT unnest(range(0, CAST(ceil(6 * unit / 64) AS BIGINT) + 3)) AS j) WHERE unit > 0) WHERE k <= quota GROUP BY sid, shard),
c0 AS (SELECT u.*, least(coalesce(b.quota, 0) * 64, 3 * unit) AS words, coalesce(b.quota, 0) * 64 AS dealt FROM u LEFT JOIN b ON b.sid = u.sid AND b.shard = u.shard),
c1 AS (SELECT *, sum(3 * unit - words) OVER g AS allroom, least(sum(dealt - words) OVER g, sum(3 * unit - words) OVER g) AS more, 3 * unit - words AS room, sum(3 * unit - words) OVER (PARTITION BY sid, grp ORDER BY shard) AS upto FROM c0 WINDOW g AS (PARTITION BY sid, grp)),
c AS (SELECT sid, shard, unit, words + CASE WHEN allroom > 0 THEN more * upto // allroom - more * (upto - room) // allroom ELSE 0 END AS words FROM c1),
x AS (SELECT r.doc_id, r.size, s3.source_size, s3.target, c.unit, c.words, coalesce(sum(r.size) OVER (PARTITION BY r.sid, r.shard ORDER BY r.o, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM r JOIN s3 ON s3.sid = r.sid JOIN c ON c.sid = r.sid AND c.shard = r.shard)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN unit > 0 THEN words // unit ELSE 0 END * size + greatest(0, least(size, words - CASE WHEN unit > 0 THEN words // unit ELSE 0 END * unit - before)) AS BIGINT) AS taken FROM x
"""
