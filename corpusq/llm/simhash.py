"""SimHash fingerprints and near-duplicate groups by a generalised pigeonhole search."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusq.llm.components import connected_components
from corpusq.llm.shared import near_pairs, split_hot, whole_groups, written

BITS = 64


def simhash64(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Fingerprint of a whole text: majority of the XXH64 bits of its word shingles; 0 without words.

    A-Z are lower-cased, words are runs of bytes other than ASCII white space, repeated shingles count.
    """
    found = (text or "").encode("utf-8").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found)) + 1
    end = np.cumsum(size) - 1
    begin = end - size + 1
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], seed) for a, b in zip(begin[: len(found) - k + 1].tolist(), end[k - 1 :].tolist())], np.uint64)
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 4096):
        count += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def simhash_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in texts:
        yield pd.Series(np.array([simhash64(t) for t in text], np.uint64).view(np.int64))


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 table of how many have both bits set, over all of them."""

    def partial(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = np.unpackbits(np.ascontiguousarray(b["fp"].to_numpy(np.int64)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
            n += len(x)
        yield pd.DataFrame({"row": np.arange(BITS + 1), "values": [*total, np.array([float(n)])]})

    rows = prints.select("fp").mapInPandas(partial, "row int, values array<double>")
    rows = rows.select("row", F.posexplode("values").alias("at", "value")).groupBy("row", "at").agg(F.sum("value").alias("value")).collect()  # 64 * 64 + 1 numbers
    table, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r["row"] == BITS:
            n = int(r["value"])
        else:
            table[r["row"], r["at"]] = r["value"]
    return n, table


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deal 64 bits to ``parts`` groups, the most correlated ones together."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    rho = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, groups = set(range(BITS)), []
    for i in range(parts):
        size = BITS // parts + (i < BITS % parts)
        rest = sorted(left)
        sub = rho[np.ix_(rest, rest)] - 2 * np.eye(len(rest))
        own = [rest[int(sub.max(axis=1).argmax())]]
        left.discard(own[0])
        while len(own) < size:
            nxt = max(sorted(left), key=lambda b: rho[b, own].sum())
            own.append(nxt)
            left.discard(nxt)
        groups.append(sorted(own))
    return groups


def allocate(cost: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum ``budget`` of least total cost; ``cost[i][t + 1]``. Dynamic programming over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, t) in best.items():
            for at, more in enumerate(row):
                now = (c + more, [*t, at - 1])
                if used + at - 1 not in step or now < step[used + at - 1]:
                    step[used + at - 1] = now
        best = step
    return best[budget]


def plan_search(n: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """Partitions of the bits and their thresholds, cheapest by the estimated number of probes and candidates.

    Any two fingerprints within ``distance`` differ in at most t_i bits of some partition i, as the t_i add up
    to distance - parts + 1. Candidates are estimated from the bits' frequencies over all fingerprints.
    """
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    found: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(2, distance + 2):
        groups = group_bits(n, both, parts)
        cost = []
        for g in groups:
            chance = np.array([1.0])
            for b in g:
                chance = np.convolve(chance, [1 - differ[b], differ[b]])
            row = [0.0]
            for t in range(distance - parts + 2 + parts):
                probes = 1 + sum(comb(len(g), e) for e in range(1, t + 1)) / 2 if t <= len(g) else float("inf")
                row.append(30.0 * n * probes + float(n) * n * chance[: t + 1].sum())
            cost.append(row[: distance + 2])
        c, t = allocate(cost, distance - parts + 1)
        if found is None or c < found[0]:
            found = (c, [(g, x) for g, x in zip(groups, t) if x >= 0])
    return found[1]


def near_links(prints: DataFrame, distance: int = 4, most: int = 8192) -> DataFrame:
    """Links between distinct fingerprints ``prints(fp long)`` at ``distance`` or fewer differing bits.

    Returns ``(src, dst)`` fingerprints: enough of the links to connect all that are connected, at most one
    for each signature row. Every candidate is verified. Groups of over ``most`` rows are split to blocks.
    """
    n, both = bit_statistics(prints)
    plan = plan_search(n, both, distance)

    def signatures(batches):
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            for i, (bits, t) in enumerate(plan):
                mask = np.int64(np.uint64(sum(1 << x for x in bits)).view(np.int64))
                value = fp & mask
                yield pd.DataFrame({"part": np.int8(i), "value": value, "fp": fp, "own": True})
                for e in range(1, t + 1):
                    for flip in combinations(bits, e):
                        other = value ^ np.int64(np.uint64(sum(1 << x for x in flip)).view(np.int64))
                        up = other > value  # the pair's other side need not probe as well
                        if up.any():
                            yield pd.DataFrame({"part": np.int8(i), "value": other[up], "fp": fp[up], "own": False})

    def probe(batches):
        for b in whole_groups(batches, ["part", "value", "block"]):
            fp, own = b["fp"].to_numpy(np.int64), b["own"].to_numpy(bool)
            key = np.cumsum(np.r_[0, (np.diff(b["value"].to_numpy(np.int64)) != 0) | (np.diff(b["part"].to_numpy()) != 0) | (np.diff(b["block"].to_numpy()) != 0)])

            def linked(i, j):
                return (own[i] | own[j]) & (np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= distance) & (fp[i] != fp[j])

            i, j = near_pairs(key, linked)
            yield pd.DataFrame({"src": fp[i], "dst": fp[j]})

    rows = prints.select("fp").mapInPandas(signatures, "part byte, value long, fp long, own boolean")
    keys = ["part", "value"]
    rows = split_hot(written(rows, "simhash-signatures"), keys, "fp", most)
    rows = rows.repartition(*keys, "block").sortWithinPartitions(*keys, "block", F.desc("own"))
    return rows.mapInPandas(probe, "src long, dst long")


def grouped_prints(docs: DataFrame, distance: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp, root, component_id, *keep)``: as simhash_groups, with ``root``, a fingerprint that names the group."""
    prints = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), simhash_udf(F.col("text").cast("string")).alias("fp"), *keep), "simhash-prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = connected_components(near_links(nodes, distance))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(least, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "root", "component_id", *keep)


def simhash_groups(docs: DataFrame, distance: int = 4) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fingerprint, component_id)``, a row for each row of ``docs``.

    Two documents link when their fingerprints differ in ``distance`` or fewer bits; ``component_id`` is the
    smallest doc_id reachable. Equal fingerprints are collapsed first, so copies never form pairs. Null and
    blank texts have fingerprint zero and link like any other; rows with a null doc_id are kept (their
    component_id is null if no member has an id); an empty table gives an empty one; other columns are ignored.
    """
    return grouped_prints(docs, distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents at 4 or fewer differing bits."""
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
