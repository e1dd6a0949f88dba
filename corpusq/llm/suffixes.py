"""Suffix-array style removal of repeated byte strings by buckets refined with fingerprints at later offsets.

All starts of ``length``-byte strings are put to buckets, and buckets are refined by the identifiers at later
offsets until each holds equal strings, after Schuermann and Stoye's bucket-pointer refinement, but without its
recursive update: identifiers are fixed 64-bit fingerprints of q-grams, computed from the text in each step, and
no refined bucket's identifier replaces them. Buckets of one member need no refinement and are dropped at once:

1. Initial buckets are q-grams. Of the q-grams inside a string, the one of least identifier stands for it, so
   neighbouring starts share a bucket member (a run of starts around one q-gram) and only one row in about 35
   bytes is shuffled. Sorted on the identifiers of all later q-grams of the run, equal runs are told apart:
   every one but the first is a repeat as a whole, and what is left of buckets with unlike runs is refined.
2. Runs are cut to blocks of a few starts, bucketed by the identifiers at the later offsets of their common core.
3. In the blocks left, single starts are bucketed by the identifiers at four later offsets, which cover the string.

The q-gram identifiers are made by doubling: those of 2k bytes from the ones of k bytes at offsets 0 and k.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpusq.llm.shared import written

Q = 32  # bytes of an initial bucket
BLOCK = 9  # starts in a block of the second step
LAST = (1 << 63) - 1  # stands for a null doc_id, after all others
ODD = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_ids(data: bytes) -> np.ndarray:
    """Identifier of the Q bytes from each position on (bytes past the end count as zero)."""
    h = np.frombuffer(data + bytes(Q), np.uint8).astype(np.uint64) + np.uint64(1)
    k, p = 1, ODD
    while k < Q:
        h = h[:-k] * np.uint64(p) + h[k:]
        k, p = 2 * k, p * p & (1 << 64) - 1
    return _mixed(h[: len(data)])


def _combined(ids: np.ndarray, at: np.ndarray, offsets: list[int], seed: int) -> np.ndarray:
    """One identifier from those at several later offsets."""
    out = np.full(len(at), seed, np.uint64)
    for o in offsets:
        out = _mixed(out * np.uint64(ODD) + ids[at + o])
    return out


class Buffer:
    """Some documents in one buffer, and what the steps ask of their positions."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        sizes = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.ids = gram_ids(b"".join(texts))

    def runs(self) -> tuple[np.ndarray, ...]:
        """Runs of starts that share their least q-gram: document number, q-gram position, first and last start, in the buffer."""
        width = self.length - Q + 1
        n = len(self.ids) - width + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            return none, none, none, none
        low = (self.ids & np.uint64(~0xFFFFFF & (1 << 64) - 1)) | np.arange(len(self.ids), dtype=np.uint64)  # ties: the leftmost
        k = 1
        while 2 * k <= width:
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        if k < width:
            low = np.minimum(low[: len(low) - (width - k)], low[width - k :])
        gram = (low[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
        doc = np.searchsorted(self.end, np.arange(n), side="right")
        whole = np.arange(n) + self.length <= self.end[doc]
        cut = np.r_[True, (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])]
        first = np.flatnonzero(cut)
        last = np.r_[first[1:], n] - 1
        keep = whole[first]
        first, last = first[keep], last[keep]
        return doc[first], gram[first], first, last

    def run_ids(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Identifier of all q-grams from ``first`` to the end of the string that starts at ``last``."""
        power = np.full(len(self.ids) + 1, ODD, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        total = np.r_[np.uint64(0), np.add.accumulate(self.ids * power[:-1])]
        back = np.full(len(self.ids) + 1, pow(ODD, -1, 1 << 64), np.uint64)
        back[0] = 1
        back = np.multiply.accumulate(back)
        stop = last + self.length - Q + 1
        return _mixed((total[stop] - total[first]) * back[first] + (stop - first).astype(np.uint64))


def _batches(frame: pd.DataFrame, most: int = 4 << 20):
    """Slices of a batch with their documents' bytes; a document of over 16 MB would not fit the position bits."""
    at, data = 0, [zstandard.ZstdDecompressor().decompress(x) for x in frame["packed"]] if "packed" in frame else [(t or "").encode("utf-8") for t in frame["text"]]
    while at < len(data):
        k, used = at, 0
        while k < len(data) and (k == at or used + len(data[k]) <= most):
            used += len(data[k])
            k += 1
        yield frame.iloc[at:k], data[at:k]
        at = k


def _long_pieces(frame: pd.DataFrame, data: list[bytes], length: int, most: int = 8 << 20):
    """Cuts documents of over ``most`` bytes into pieces that overlap by ``length - 1``, so that each start is in one."""
    doc, tie, base, parts = [], [], [], []
    for d, t, x in zip(frame["doc"].tolist(), frame["tie"].tolist(), data):
        for at in range(0, max(1, len(x) - length + 1), most):
            doc.append(d)
            tie.append(t)
            base.append(at)
            parts.append(x[at : at + most + length - 1])
    groups, now, used = [], [], 0
    for i, p in enumerate(parts):
        if now and used + len(p) > most:
            groups.append(now)
            now, used = [], 0
        now.append(i)
        used += len(p)
    for g in [*groups, now] if parts else []:
        yield np.array(doc, np.int64)[g], np.array(tie, np.int32)[g], np.array(base, np.int64)[g], [parts[i] for i in g]


MEMBERS = "kind byte, h long, g long, doc long, tie int, at long, first long, last long"
RUNS = "kind byte, h long, doc long, tie int, at long, first long, last long"


def _first_members(x: pd.DataFrame, length: int) -> pd.DataFrame:
    """Of members with equal (h, g) only the first stays; the others turn to covered runs (kind 1) right away."""
    x = x.sort_values(["h", "g", "doc", "tie", "first"], kind="stable", ignore_index=True)
    h, g = x["h"].to_numpy(), x["g"].to_numpy()
    again = np.r_[False, (h[1:] == h[:-1]) & (g[1:] == g[:-1])]
    return pd.concat([x[~again], _covered(x[again], length)], ignore_index=True)


def _covered(x: pd.DataFrame, length: int) -> pd.DataFrame:
    """Rows of kind 1 for the bytes of repeated starts, touching ones joined; dealt by document, not by bucket."""
    x = x.sort_values(["doc", "tie", "first"], ignore_index=True)
    doc, tie, first = x["doc"].to_numpy(), x["tie"].to_numpy(), x["first"].to_numpy()
    end = x["last"].to_numpy() + length
    if not len(x):
        return x.assign(kind=np.int8(1))
    new = np.r_[True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (first[1:] > end[:-1])]
    at = np.flatnonzero(new)
    out = pd.DataFrame({"kind": np.int8(1), "h": _mixed(doc[at].astype(np.uint64)).view(np.int64), "doc": doc[at], "tie": tie[at], "at": np.int64(0), "first": first[at], "last": np.maximum.reduceat(end, at)})
    return out.assign(g=np.int64(0)) if "g" in x else out


def _meet(members: DataFrame, length: int, whole: bool) -> DataFrame:
    """Bring equal buckets together in one shuffle and sort.

    Rows of kind 1 pass. With ``whole``, members with an equal identifier g in the bucket h are equal: all but
    the first become covered runs (kind 1), and first members of buckets that hold unlike ones go on (kind 0).
    Otherwise members that share (h, g) with another go on. Groups are streamed, none is held as a whole.
    """

    def run(batches):
        held, seen = None, None  # the last row, while it is not known whether it has company; its bucket and identifier
        for b in batches:
            passed = b[b["kind"] == 1]
            if len(passed):
                yield passed[["kind", "h", "doc", "tie", "at", "first", "last"]]
            x = b[b["kind"] == 0].reset_index(drop=True)
            if not len(x):
                continue
            h, g = x["h"].to_numpy(np.int64), x["g"].to_numpy(np.int64)
            before_h, before_g = np.r_[seen[0] if seen else ~h[0], h[:-1]], np.r_[seen[1] if seen else 0, g[:-1]]
            like = h == before_h
            same = like & (g == before_g)
            if whole:
                again = same
                follows = like & ~same  # unlike the member before it in its bucket
                lead = np.r_[True, ~like[1:]]  # first row of its bucket in this batch
                group = np.cumsum(lead) - 1
                mixed = np.bincount(group, follows, minlength=group[-1] + 1) > 0
                if seen and like[0] and held is None:
                    mixed[0] = True  # known from earlier batches
                if held is not None:
                    if like[0] and mixed[0]:
                        yield held
                    elif not like[0]:
                        held = None
                    if like[0] and mixed[0]:
                        held = None
                on = mixed[group] & ~again
                out = [x[on], _covered(x[again], length)]
                tail = group == group[-1]
                if not mixed[-1] and not (like[0] and group[-1] == 0):
                    held = x[tail & ~again].iloc[:1][["kind", "h", "doc", "tie", "at", "first", "last"]]
                elif mixed[-1]:
                    held = None
                yield pd.concat(out, ignore_index=True)[["kind", "h", "doc", "tie", "at", "first", "last"]]
            else:
                after = np.r_[same[1:], False]
                if held is not None and same[0]:
                    yield held
                yield x[same | after][["kind", "h", "doc", "tie", "at", "first", "last"]]
                held = None if same[-1] or after[-1] else x.iloc[-1:][["kind", "h", "doc", "tie", "at", "first", "last"]]
            seen = (int(h[-1]), int(g[-1]))

    rows = members.repartition("h").sortWithinPartitions("h", "g", "doc", "tie", "first")
    return rows.mapInPandas(run, RUNS)


def repeated_runs(texts: DataFrame, length: int) -> DataFrame:
    """``texts(doc, tie, text)`` -> covered byte ranges ``(doc, tie, begin, end)`` of strings that also start earlier."""

    def anchors(batches):
        for b in batches:
            rows = []
            for part, data in _batches(b):
                for doc, tie, base, pieces in _long_pieces(part, data, length):
                    buf = Buffer(pieces, length)
                    d, gram, first, last = buf.runs()
                    if len(d):
                        shift = base[d] - buf.start[d]
                        rows.append(pd.DataFrame({"kind": np.int8(0), "h": buf.ids[gram].view(np.int64), "g": buf.run_ids(first, last).view(np.int64), "doc": doc[d], "tie": tie[d], "at": gram + shift, "first": first + shift, "last": last + shift}))
            if rows:
                yield _first_members(pd.concat(rows, ignore_index=True), length)

    def asked_texts(runs: DataFrame) -> DataFrame:
        asked = runs.groupBy("doc", "tie").agg(F.flatten(F.collect_list(F.array("at", "first", "last"))).alias("asked"))  # the runs of one document
        return texts.select("doc", "tie", packed(F.col("text")).alias("packed")).join(asked, ["doc", "tie"])

    def asked_runs(batch):
        """Of the documents of each slice: identifiers of all positions, and its runs with their documents, in the slice's positions."""
        for part, data in _batches(batch):
            size = np.array([len(x) for x in data], np.int64)
            runs = [np.asarray(x, np.int64).reshape(-1, 3) for x in part["asked"]]
            which = np.repeat(np.arange(len(runs)), [len(x) for x in runs])
            base = (np.cumsum(size) - size)[which]
            at, first, last = (np.concatenate(runs) + base[:, None]).T
            yield gram_ids(b"".join(data)), part["doc"].to_numpy(np.int64)[which], part["tie"].to_numpy(np.int32)[which], base, at, first, last

    def cores(batches):
        for b in batches:
            for ids, doc, tie, base, at, first, last in asked_runs(b):
                low, high = (at - last) // BLOCK, (at - first) // BLOCK
                n = high - low + 1
                i = np.repeat(np.arange(len(at)), n)
                block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[i]
                near, far = block * BLOCK, np.minimum(block * BLOCK + BLOCK - 1, length - Q)
                core = length - (far - near)
                start = at[i] - near
                g = _combined(ids, start, [0, Q], 2)
                g = _mixed(g * np.uint64(ODD) + ids[start + core - Q] + block.astype(np.uint64))
                h = _mixed(ids[at[i]] + block.astype(np.uint64))
                back = base[i]
                yield pd.DataFrame({"kind": np.int8(0), "h": h.view(np.int64), "g": g.view(np.int64), "doc": doc[i], "tie": tie[i], "at": at[i] - back, "first": np.maximum(first[i], at[i] - far) - back, "last": np.minimum(last[i], start) - back})

    def starts(batches):
        offsets = [*range(0, length - Q, Q), length - Q]
        for b in batches:
            for ids, doc, tie, base, _, first, last in asked_runs(b):
                n = last - first + 1
                i = np.repeat(np.arange(len(first)), n)
                s = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[i]
                h, g, own = _combined(ids, s, offsets, 3), _combined(ids, s, offsets[::-1], 5), s - base[i]
                x = pd.DataFrame({"kind": np.int8(0), "h": h.view(np.int64), "g": g.view(np.int64), "doc": doc[i], "tie": tie[i], "at": own, "first": own, "last": own})
                yield _first_members(x, length)

    step1 = written(_meet(texts.mapInPandas(anchors, MEMBERS), length, True), "suffix-grams")
    step2 = written(_meet(asked_texts(step1.where("kind = 0")).mapInPandas(cores, MEMBERS), length, False), "suffix-cores")
    step3 = written(_meet(asked_texts(step2).mapInPandas(starts, MEMBERS), length, True).where("kind = 1"), "suffix-starts")
    found = step1.where("kind = 1").unionByName(step3)
    return found.select("doc", "tie", F.col("first").alias("begin"), F.col("last").alias("end"))


def refined_buckets(texts: DataFrame, length: int, q: int = 4) -> DataFrame:
    """The same covered ranges by bucket pointers alone, with a row for each byte: (doc, tie, begin, end).

    Buckets are numbered by sorting: first the q-grams, then, in each pass, the pairs of the identifiers at a start and at the
    offset that the last pass has refined up to. The new numbers are written back and are what the next pass takes at
    both offsets, so the refined depth doubles until ``length`` bytes are told apart; buckets hold equal strings then, without
    fingerprints. Every pass sorts and joins a row a byte, which is beyond what ``repeated_runs`` may cost (README has
    the figures); it serves as the check of that shorter way.
    """

    def grams(batches):
        for b in batches:
            for doc, tie, text in zip(b["doc"].tolist(), b["tie"].tolist(), b["text"]):
                raw = np.frombuffer((text or "").encode("utf-8") + bytes(q), np.uint8).astype(np.int64)
                n = len(raw) - q
                value = np.zeros(n, np.int64)
                for k in range(q):
                    value = value << 8 | raw[k : k + n]
                for low in range(0, n if n >= length else 0, 1 << 18):
                    some = slice(low, min(n, low + (1 << 18)))
                    yield pd.DataFrame({"doc": doc, "tie": tie, "at": np.arange(n)[some], "a": value[some], "b": np.int64(0)})

    def numbered(rows: DataFrame) -> DataFrame:
        """(doc, tie, at, id): equal (a, b) get one number, numbers in their order within a range of it."""

        def run(batches):
            base, before, number = TaskContext.get().partitionId() << 40, None, -1
            for x in batches:
                a, b = x["a"].to_numpy(), x["b"].to_numpy()
                if len(a):
                    fresh = np.r_[before != (a[0], b[0]), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
                    ids = number + np.cumsum(fresh)
                    before, number = (a[-1], b[-1]), int(ids[-1])
                    yield x[["doc", "tie", "at"]].assign(id=base + ids)

        ready = rows.repartitionByRange("a", "b").sortWithinPartitions("a", "b")
        return written(ready.mapInPandas(run, "doc long, tie int, at long, id long"), "suffix-pointers")

    ids, depth = numbered(texts.mapInPandas(grams, "doc long, tie int, at long, a long, b long")), q
    while depth < length:
        step = min(depth, length - depth)
        later = ids.select("doc", "tie", (F.col("at") - step).alias("at"), F.col("id").alias("b"))
        ids, depth = numbered(ids.withColumnRenamed("id", "a").join(later, ["doc", "tie", "at"])), depth + step
    # every start of a bucket but the first repeats an earlier one; strings past a text's end have met no later identifier or hold its padding
    sizes = texts.select("doc", "tie", F.octet_length(F.coalesce("text", F.lit(""))).alias("n"))
    whole = ids.join(sizes, ["doc", "tie"]).where(F.col("at") + length <= F.col("n"))
    first = whole.groupBy("id").agg(F.min(F.struct("doc", "tie", "at")).alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1")
    again = whole.join(first, "id").where(F.struct("doc", "tie", "at") != F.col("first"))
    return again.select("doc", "tie", F.col("at").alias("begin"), (F.col("at") + length).alias("end"))


@F.pandas_udf(T.BinaryType())
def packed(texts: pd.Series) -> pd.Series:
    """Texts compressed, so that a shuffle of them is half as large."""
    tool = zstandard.ZstdCompressor(level=1)
    return pd.Series([tool.compress((t or "").encode("utf-8")) for t in texts], dtype=object)


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts earlier in the corpus.

    ``docs(doc_id, text)`` -> a row for each row: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept).
    Earlier is a smaller doc_id, or an earlier start in the same text; repeats are judged on the input and may
    overlap, and never cross documents. A null doc_id comes last; rows that share a doc_id are in the order of
    their texts' SHA-256, equal rows in any order. Null and short texts lose nothing, unless equal texts of
    ``length`` bytes or more. ``kept`` are the remaining bytes. An empty table gives an empty one; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    doc = F.coalesce("doc_id", F.lit(LAST)).alias("doc")
    heads = written(rows.select(doc, "sha").groupBy("doc", "sha").count(), "suffix-heads")
    heads = heads.withColumn("tie", (F.row_number().over(W.partitionBy("doc").orderBy("sha")) - 1).cast("int"))
    twice = heads.where("tie > 0 or count > 1").select("doc", "sha", "tie", "count")  # doc_ids that several rows share
    doubled = twice.limit(1).count() > 0
    if doubled:
        named = rows.select(doc, "text", "sha").join(twice.select("doc", "sha", "tie"), ["doc", "sha"], "left").select("doc", F.coalesce("tie", F.lit(0)).alias("tie"), "text")
        named = named.dropDuplicates(["doc", "tie"])
    else:
        named = rows.select(doc, F.lit(0).alias("tie"), "text")

    runs = repeated_runs(named, length).groupBy("doc", "tie").agg(F.collect_list(F.struct("begin", "end")).alias("runs"))

    def cut(batches):
        for b in batches:
            out = []
            for part, data in _batches(b):
                for raw, runs, again in zip(data, part["runs"], part["again"].tolist()):
                    n, keep, spans, removed, at = len(raw), [], 0, 0, 0
                    if again and n >= length:
                        runs = [{"begin": 0, "end": n}]
                    joined: list[list[int]] = []
                    for begin, end in sorted((r["begin"], r["end"]) for r in ([] if runs is None else runs)):
                        if joined and begin <= joined[-1][1]:
                            joined[-1][1] = max(joined[-1][1], end)
                        else:
                            joined.append([begin, end])
                    for begin, end in joined:
                        keep.append(raw[at:begin])
                        removed += end - begin
                        spans += 1
                        at = end
                    keep.append(raw[at:])
                    kept = b"".join(keep)
                    out.append((n, removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            x = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            yield x.assign(doc=b["doc"].to_numpy())

    full = rows.select(doc, "sha", packed(F.col("text")).alias("packed"))
    if doubled:
        order = F.row_number().over(W.partitionBy("doc", "sha").orderBy(F.lit(0)))
        full = full.join(heads.select("doc", "sha", "tie"), ["doc", "sha"]).withColumn("again", order > 1)
    else:
        full = full.withColumn("tie", F.lit(0)).withColumn("again", F.lit(False))
    full = full.join(runs, ["doc", "tie"], "left").select("doc", "packed", "runs", "again")
    out = full.mapInPandas(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(F.nullif("doc", F.lit(LAST)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings removed from all documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
