"""Connected components as rounds of joins over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.shared import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(src long, dst long)`` -> ``(node long, root long)``, root = smallest node reachable.

    Alternates the large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
    Beyond") until the edges are stars around the roots. Each round shuffles edges only, is written to the
    shared folder, and nothing but two numbers reaches the driver. Nulls and self-loops are ignored; nodes
    without an edge are not returned. An empty table gives an empty one.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u > v").distinct()
    e = written(e, "components")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u > v").distinct()
        e = written(small, "components")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    star = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
