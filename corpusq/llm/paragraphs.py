"""Substring de-duplication of paragraphs: MinHash banding, exact verification, removal by components.

Units of comparison are lines and, so that passages inside otherwise different lines or over line ends are met too,
overlapping stretches of 49 words of the whole text: their shingles are runs of 20 words, their one band the least hash.
Colliding lines are verified by exact Jaccard similarity, colliding stretches by comparing words (edit distance zero).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm.components import connected_components
from corpusq.llm.shared import near_pairs, whole_groups, written

#: Five bands of two rows find a pair of similarity 0.8 with probability 1 - (1 - 0.8 ** 2) ** 5 = 0.994.
BANDS, ROWS = 5, 2
LAST = (1 << 63) - 1  # stands for a null doc_id, after all others
_DRAWS = np.random.default_rng(20240607)
_FLIP = _DRAWS.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
_TIMES = _DRAWS.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _DRAWS.integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(1 << max(16, (n - 1).bit_length()), b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _POWERS[base] = (out[0], out[1])
    return _POWERS[base]


def stretch_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A polynomial hash of values[start:end] for each stretch, whatever its place."""
    power, back = _powers(base, len(values) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(values * power[: len(values)])])
    return _mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


#: A repeated passage of SPAN + REACH - 1 words (49) or more has at least one of its SPAN-word runs chosen wherever it stands.
SPAN, REACH = 20, 30
#: It has one in its first and last REACH places and in any REACH between, so this many words on both sides of each reach its ends.
SIDE = REACH - 1
#: Places that a batch hands on in one row of arrays, and the names of these.
PIECE, PLACE = 1024, ("back", "open", "doc", "rid", "word", "length", "keeper")
#: Places with the same words beside them that are sorted as one row, and places that are settled at a time.
ALIKE, SETTLED = 128, 10_000
#: Places whose passages are brought together by document before they are shuffled.
GROWN = 1 << 18
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Words:
    """The words of several texts, A-Z lower-cased: a hash of each, and where lines and texts begin among them."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8") for t in texts]
        a = np.frombuffer((b"\n".join(raw) + b"\n").lower(), np.uint8)
        edge = np.diff((~_SPACE[a]).view(np.int8), prepend=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hashes = np.zeros(len(start), np.uint64)
        low = 0
        while low < len(start):  # some bytes at a time
            high = max(low + 1, int(np.searchsorted(start, start[low] + (1 << 18))))
            base = start[low]
            self.hashes[low:high] = stretch_hashes(_BYTE[a[base : end[high - 1]]], start[low:high] - base, end[low:high] - base, 0x9E3779B97F4A7C15)
            low = high
        lines = np.array([r.count(b"\n") + 1 for r in raw], np.int64)
        self.first_line = np.cumsum(lines) - lines  # of each text
        line = np.searchsorted(np.flatnonzero(a == 10), start)
        self.size = np.bincount(line, minlength=int(lines.sum()))  # words of each line
        self.start = np.cumsum(self.size) - self.size
        self.text = np.repeat(np.arange(len(texts)), lines)  # of each line
        self.first_word = np.r_[self.start, len(start)][np.r_[self.first_line, lines.sum()].astype(np.int64)]  # of each text, and the end

    def keys(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that name the words of each line."""
        start, end = self.start[lines], self.start[lines] + self.size[lines]
        return stretch_hashes(self.hashes, start, end, 0xD6E8FEB86659FD93), stretch_hashes(_mixed(self.hashes + np.uint64(1)), start, end, 0xA0761D6478BD642F)

    def shingles(self, lines: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles of these lines, and each line's first one; a line of fewer words than a shingle is one."""
        size = self.size[lines]
        count = np.maximum(size - words + 1, 1)
        first = np.cumsum(count) - count
        at = np.arange(count.sum()) - np.repeat(first - self.start[lines], count)
        end = np.minimum(at + words, np.repeat(self.start[lines] + size, count))
        return stretch_hashes(self.hashes, at, end, 0xD6E8FEB86659FD93), first

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The run of SPAN words of least hash among any REACH following ones of a text: text, first word in it, hash, and the text's line it stands in (-1: several)."""
        found, step = [np.zeros(0, np.int64)], 1 << 22
        stop = len(self.hashes) - SPAN + 1
        h = stretch_hashes(self.hashes, np.arange(max(0, stop)), np.arange(max(0, stop)) + SPAN, 0xD6E8FEB86659FD93) if stop > 0 else np.zeros(0, np.uint64)
        for base in range(0, len(h), step):
            part = h[base : base + step + REACH]
            low = (part & np.uint64(~0xFFFFFF & (1 << 64) - 1)) | np.arange(len(part), dtype=np.uint64)  # ties: the leftmost
            n = len(part) - REACH + 1
            if n <= 0:
                continue
            k = 1
            while 2 * k <= REACH:
                low = np.minimum(low[:-k], low[k:])
                k *= 2
            if k < REACH:
                low = np.minimum(low[: len(low) - (REACH - k)], low[REACH - k :])
            begin = np.arange(base, base + n)
            own = np.searchsorted(self.first_word, begin, side="right") - 1
            whole = begin + SPAN + REACH - 1 <= self.first_word[own + 1]
            found.append((low[:n][whole] & np.uint64(0xFFFFFF)).astype(np.int64) + base)
        at = np.unique(np.concatenate(found))
        own = np.searchsorted(self.first_word, at, side="right") - 1
        line = np.searchsorted(self.start, at, side="right") - 1
        line = np.where(at + SPAN <= self.start[line] + self.size[line], line - self.first_line[own], -1)
        return own, at - self.first_word[own], h[at], line


def band_hashes(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(lines, BANDS) band values: pairs of minima under seeded permutations of the shingle hashes."""
    out = np.empty((len(first), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(first), b + 1, np.uint64)
        for i in range(b * ROWS, (b + 1) * ROWS):
            h = _mixed(h * np.uint64(31) + np.minimum.reduceat((shingles ^ _FLIP[i]) * _TIMES[i], first))
        out[:, b] = h
    return out.view(np.int64)


def split_text(text: str | None) -> list[bytes]:
    """Paragraphs are the lines of a text, as UTF-8."""
    return (text or "").encode("utf-8").split(b"\n")


def _slices(texts: list, most: int = 1 << 20):
    at = 0
    while at < len(texts):
        k, used = at, 0
        while k < len(texts) and (k == at or used < most):
            used += len(texts[k] or "")
            k += 1
        yield at, k
        at = k


def _parts(batches, rows: int = 500):
    """A few rows of the batches at a time, so that only their texts are Python objects."""
    for b in batches:
        yield from (b.slice(at, rows) for at in range(0, b.num_rows, rows))


def unit_table(docs: DataFrame, words: int, similarity: float, least_words: int, passages: bool) -> DataFrame:
    """Rows for every line of ``least_words`` words or more and for every chosen run of the texts ``docs(doc, rid, text)``.

    Lines have their number ``at``, their key (k1, k2), the number of shingles and band values; where so few shingles
    are linked only to equal sets, one band serves. Runs (``run`` is true) have their first word ``at``, hash k1, and the
    ``line`` they stand in (-1 if in several).
    """
    few = similarity / max(1 - similarity, 1e-9) - 1e-9

    def run(batches):
        for batch in _parts(batches):
            doc, rid = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "rid"))
            texts = batch.column("text").to_pylist()
            for low, high in _slices(texts):
                w = Words(texts[low:high])
                lines = np.flatnonzero(w.size >= max(1, least_words))
                if len(lines):
                    own, (k1, k2), (shingles, first) = w.text[lines], w.keys(lines), w.shingles(lines, words)
                    bands, count = band_hashes(shingles, first), np.diff(np.r_[first, len(shingles)])
                    small = count < few
                    of_band = [pa.array(bands[:, i], mask=small if i else None) for i in range(BANDS)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(lines), bool)), pa.array(doc[low + own]), pa.array(rid[low + own]), pa.array((lines - w.first_line[own]).astype(np.int32)),
                        pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(count.astype(np.int32)), pa.nulls(len(lines), pa.int32()), *of_band], names=names)
                own, word, h, line = w.runs() if passages else (np.zeros(0, np.int64),) * 4
                if len(own):
                    none = pa.nulls(len(own), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(own), bool)), pa.array(doc[low + own]), pa.array(rid[low + own]), pa.array(word.astype(np.int32)),
                        pa.array(h.view(np.int64)), none, pa.nulls(len(own), pa.int32()), pa.array(line.astype(np.int32)), *[none] * BANDS], names=names)

    names = ["run", "doc", "rid", "at", "k1", "k2", "shingles", "line", *(f"b{i}" for i in range(BANDS))]
    return docs.select("doc", "rid", "text").mapInArrow(run, "run boolean, doc long, rid long, at int, k1 long, k2 long, shingles int, line int, " + ", ".join(f"b{i} long" for i in range(BANDS)))


def dealt_blocks(df: DataFrame, chunks: Column, draw: Column) -> DataFrame:
    """Adds ``block``: rows of a group in ``chunks`` chunks are dealt so that any two of them meet in a block of two chunks."""
    c, own = F.col("_c"), F.col("_own")
    df = df.withColumn("_c", chunks.cast("long")).withColumn("_own", F.pmod(draw, c))
    others = F.sequence(F.lit(0).cast("long"), F.greatest(c, F.lit(1)) - 1)
    return df.select("*", F.explode(F.transform(others, lambda j: F.least(own, j) * c + F.greatest(own, j))).alias("block")).drop("_c", "_own")


def packed(rows: DataFrame) -> DataFrame:
    """(doc, rid, packed): texts compressed, so that a shuffle of them is half as large."""

    def run(batches):
        tool = zstandard.ZstdCompressor(level=1)
        for part in _parts(batches):
            data = [tool.compress((t or "").encode("utf-8")) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("rid"), pa.array(data, pa.binary())], names=["doc", "rid", "packed"])

    return rows.select("doc", "rid", "text").mapInArrow(run, "doc long, rid long, packed binary")


def _texts(batches):
    """The rows of the batches and their texts, so many at a time as have some bytes packed."""
    tool = zstandard.ZstdDecompressor()
    for b in batches:
        for low, high in _slices(b["packed"].tolist(), 1 << 18):
            part = b.iloc[low:high].reset_index(drop=True)
            yield part, [tool.decompress(x).decode("utf-8") for x in part["packed"]]


def longest_earlier(group: np.ndarray, rank: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many columns of ``side`` each row shares with a row of its group and lower rank, and the lowest rank that shares them."""
    n = len(group)
    length, keeper = np.full(n, -1, np.int64), rank.copy()
    at, own = np.arange(n), np.unique(group, return_inverse=True)[1].astype(np.int64)
    for k in range(side.shape[1] + 1):
        least = np.full(int(own.max()) + 1 if len(own) else 0, n, np.int64)
        np.minimum.at(least, own, rank[at])
        found = least[own] < rank[at]
        length[at[found]], keeper[at[found]] = k, least[own][found]
        if k == side.shape[1]:
            break
        stay = (np.bincount(own)[own] > 1) & (side[at, k] > 0)
        at, own = at[stay], own[stay]
        if not len(at):
            break
        own = np.unique(own << 32 | side[at, k].astype(np.int64), return_inverse=True)[1].astype(np.int64)
    return length, keeper


def _numbers(rows: list[bytes], most: int) -> np.ndarray:
    """(rows, most) numbers from 1 on of the words of each row, equal for equal words only; 0 beyond a row's end."""
    known: dict[bytes, int] = {}
    count = np.fromiter((r.count(b" ") + 1 if r else 0 for r in rows), np.int64, len(rows))
    out = np.zeros((len(rows), most), np.uint32)
    out[np.arange(most) < count[:, None]] = np.fromiter((known.setdefault(w, len(known) + 1) for r in rows for w in r.split()), np.uint32, int(count.sum()))
    return out


def _ranks(doc: np.ndarray, rid: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each place in order of document, row and word, equal places alike; and a row of each rank."""
    order = np.lexsort((word, rid, doc))
    fresh = np.r_[True, (np.diff(doc[order]) != 0) | (np.diff(rid[order]) != 0) | (np.diff(word[order]) != 0)][: len(doc)]
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    return rank, order[fresh]


def _rare_passages(places: DataFrame) -> DataFrame:
    """(doc, rid, low, high, keeper) of both sides of seeds whose places fit in one task."""

    def run(batches):
        for b in whole_groups(batches, ["h"]):
            doc, rid, word = (b[c].to_numpy(np.int64) for c in ("doc", "rid", "word"))
            known: dict[tuple, int] = {}
            group = np.array([known.setdefault(x, len(known)) for x in zip(b["h"].tolist(), b["run"])], np.int64)
            rank, of_rank = _ranks(doc, rid, word)
            left, right = (longest_earlier(group, rank, _numbers(b[c].tolist(), SIDE)) for c in ("left", "right"))
            yes = left[0] >= 0
            for low, high, keeper in ((word - left[0], word + SPAN, left[1]), (word, word + SPAN + right[0], right[1])):
                yield pd.DataFrame({"doc": doc, "rid": rid, "low": low, "high": high, "keeper": doc[of_rank[keeper]]})[yes]

    ready = places.select("doc", "rid", "word", "h", "run", "left", "right").repartition("h").sortWithinPartitions("h")
    return ready.mapInPandas(run, "doc long, rid long, low int, high int, keeper long")


def _common_passages(places: DataFrame) -> DataFrame:
    """(doc, rid, passages) of seeds of any number of places, in work and rows linear in it (times a sort); a document may have several rows.

    Places are sorted over all partitions by their run and the words to one side, so those that share some words stand
    together; of those that stand in one batch before the sort, up to ``ALIKE`` with all words of run and side alike are one row. A batch of the sorted rows settles what lies inside it; of the words shared with its first or last row,
    which may go on in other batches, it passes on only its least place, once for each number of words. What a batch has settled
    goes on as arrays of ``PIECE`` places, so that the least places of all batches are joined to a row of arrays, not to each place;
    and of some ``GROWN`` places a document has one row of all its passages, not one for each place.
    """
    place, order = ["doc", "rid", "word"], ["back", "run", "side", "first_doc", "first_rid", "first_word"]

    def pack(batches):
        for b in (x for x in batches if len(x)):
            b = b.sort_values(place)
            values = [b[c].to_numpy(np.int64) for c in place]
            for back, name in ((True, "left"), (False, "right")):
                rows = []
                for (run, side), at in b.groupby(["run", name], sort=False).indices.items():
                    for low in range(0, len(at), ALIKE):
                        some = [v[at[low : low + ALIKE]] for v in values]
                        rows.append((back, run, side + b" " if side else side, *(v[0] for v in some), *some))  # each word ends in a space
                yield pd.DataFrame(rows, columns=[*order, *place], dtype=object)

    kinds = "back boolean, run binary, side binary, first_doc long, first_rid long, first_word int, doc array<long>, rid array<long>, word array<int>"
    alike = written(places.select(*place, "run", "left", "right").mapInPandas(pack, kinds), "paragraph-alike")
    ready = alike.repartitionByRange(*order).sortWithinPartitions(*order)

    def blocks(batches):
        """Sorted rows, so many at a time as have some places."""
        for b in batches:
            ends = np.cumsum([len(x) for x in b["doc"]])
            at = 0
            while at < len(b):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SETTLED, side="right")))
                yield b.iloc[at:stop]
                at = stop

    def run(batches):
        part = TaskContext.get().partitionId()
        for number, b in enumerate(blocks(batches)):
            block, own = part << 32 | number, np.repeat(np.arange(len(b)), [len(x) for x in b["doc"]])
            n = len(own)
            doc, rid, word = (np.concatenate(b[c].tolist()).astype(np.int64) for c in place)
            texts, back, runs = b["side"].tolist(), b["back"].tolist(), b["run"].tolist()
            known: dict[tuple, int] = {}
            group = np.array([known.setdefault(x, len(known)) for x in zip(back, runs)], np.int64)[own]
            side = _numbers([x[:-1] for x in texts], SIDE)[own]
            rank, of_rank = _ranks(doc, rid, word)
            length, keeper = longest_earlier(group, rank, side)
            shared, nodes = [], []
            for last, e in enumerate((0, n - 1)):
                alike = np.where(group == group[e], np.cumprod((side == side[e]) & (side > 0), axis=1).sum(axis=1), -1)
                shared.append(alike)
                words = texts[own[e]].split()
                for k in range(len(words) + 1):
                    i = of_rank[rank[alike >= k].min()]
                    nodes.append((block, bool(last), back[own[e]], k, runs[own[e]] + b" " + b" ".join(words[:k]), doc[i], rid[i], word[i]))
            last, reach = shared[1] > shared[0], np.maximum(*shared)
            columns = [np.array(back, bool)[own], reach.astype(np.int32), doc, rid, word.astype(np.int32), length.astype(np.int32), doc[of_rank[keeper]]]
            rows = []
            for end in (False, True):
                of_end = np.flatnonzero(last == end)
                for low in range(0, len(of_end), PIECE):
                    some = of_end[low : low + PIECE]
                    rows.append((block, end, *(c[some] for c in columns)))
            yield pd.DataFrame(rows, columns=["block", "last", *PLACE], dtype=object).assign(**dict.fromkeys(least_of))
            yield pd.DataFrame(nodes, columns=["block", "last", *least_of]).assign(**dict.fromkeys(PLACE))

    least_of = ("side", "k", "node", "least_doc", "least_rid", "least_word")
    kinds = "block long, last boolean, back array<boolean>, open array<int>, doc array<long>, rid array<long>, word array<int>, length array<int>, keeper array<long>, side boolean, k int, node binary, least_doc long, least_rid long, least_word int"
    settled = written(ready.mapInPandas(run, kinds), "paragraph-places")
    least = F.struct(F.col("least_doc").alias("doc"), F.col("least_rid").alias("rid"), F.col("least_word").alias("word"))
    nodes = settled.where("node is not null").select("block", "last", "side", "node", "k", least.alias("least"))
    least = nodes.groupBy("side", "node").agg(F.min("least").alias("least"))
    ends = nodes.drop("least").join(least, ["side", "node"]).groupBy("block", "last").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "least"))), lambda x: x["least"]).alias("least"))  # SIDE + 1 at most
    ends = written(ends, "paragraph-ends")
    ends = ends.select("block", "last", *(F.col(f"least.{c}").alias(f"least_{c}") for c in place))
    if ends.count() <= 8192:  # two rows a batch, some 2 KB each
        ends = F.broadcast(ends)
    rows = settled.where("node is null").select("block", "last", *PLACE).join(ends, ["block", "last"])

    def by_document(some):
        doc, rid, low, high, keeper = (np.concatenate(x) for x in zip(*some))
        order = np.lexsort((rid, doc))
        doc, rid = doc[order], rid[order]
        start = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(rid) != 0)][: len(doc)])
        cut = [np.split(x[order], start[1:]) if len(start) else [] for x in (low, high, keeper)]
        return pd.DataFrame(dict(zip(("doc", "rid", "low", "high", "keeper"), (doc[start], rid[start], *cut))))

    def grow(batches):
        """The arrays of places, many at a time, to one row a document."""
        some, held = [], 0
        for b in batches:
            for *columns, first_doc, first_rid, first_word in zip(*(b[c] for c in (*PLACE, "least_doc", "least_rid", "least_word"))):
                back, reach, doc, rid, word, length, keeper = columns
                d, r, w = doc[:, None], rid[:, None], word[:, None]
                before = (first_doc < d) | (first_doc == d) & ((first_rid < r) | (first_rid == r) & (first_word < w))
                beyond = (before & (np.arange(len(first_doc)) <= reach[:, None])).sum(axis=1) - 1  # longer shares have later least places
                grown = np.maximum(length, beyond)
                keeper = np.where(grown <= reach, first_doc[np.clip(grown, 0, len(first_doc) - 1)], keeper)
                yes = grown >= 0
                low, high = np.where(back, word - grown, word), word + SPAN + np.where(back, 0, grown)
                some.append([x[yes] for x in (doc, rid, low.astype(np.int32), high.astype(np.int32), keeper)])
                held += len(doc)
                if held >= GROWN:
                    yield by_document(some)
                    some, held = [], 0
        if some:
            yield by_document(some)

    found = rows.select(*PLACE, "least_doc", "least_rid", "least_word").mapInPandas(grow, "doc long, rid long, low array<int>, high array<int>, keeper array<long>")
    return found.select("doc", "rid", F.arrays_zip("low", "high", "keeper").alias("passages"))


def grown_passages(places: DataFrame, most: int) -> DataFrame:
    """(doc, rid, passages) of ``places(doc, rid, word, h, n, run, left, right)``: (low, high, keeper) of every seed that an earlier place holds too.

    Seeds of equal hash ``h`` in ``n`` places are told apart by the words of their runs. To each side a seed grows, word by
    word, to the end of the longest passage through it that some earlier place holds, so it does not matter which of the
    earlier places that is. Hashes of ``most`` places or fewer meet in one task, those of more are sorted over all of them.
    """
    rare = _rare_passages(places.where(F.col("n") <= most)).select("doc", "rid", F.struct("low", "high", "keeper").alias("passage"))
    grown = rare.unionByName(_common_passages(places.where(F.col("n") > most)), allowMissingColumns=True)
    both = F.concat(F.collect_set("passage"), F.flatten(F.collect_list("passages")))  # nulls are left out
    return grown.groupBy("doc", "rid").agg(both.alias("passages"))  # of one document


def _open(raw: bytes, start: np.ndarray, gone: np.ndarray | None, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Around each of ``word`` the stretch of words that no line of ``gone`` stands in: its first word and its end (-1 if the word itself goes)."""
    if gone is None or not len(gone):
        return np.zeros(len(word), np.int64), np.full(len(word), len(start), np.int64)
    line = np.searchsorted(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), start)
    away = np.flatnonzero(np.isin(line, gone))
    place = np.searchsorted(away, word)
    bounds = np.r_[-1, away, len(start)]
    itself = bounds[place + 1] == word
    return bounds[place] + 1, np.where(itself, -1, bounds[place + 1])


def without_passages(lines: list[bytes], drop: set[int], passages: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The lines but those of ``drop``, without the words of the passages (first word, end, counted over all lines); and the stretches cut.

    A word goes with the white space after it in its line; a line whose words all go goes too.
    """
    count = np.array([len(x.split()) for x in lines], np.int64)
    first = np.cumsum(count) - count
    cut = np.zeros(int(count.sum()) + 1, bool)
    for a, b in passages:
        cut[a:b] = True
    for i in drop:
        cut[first[i] : first[i] + count[i]] = False
    out = []
    for i, line in enumerate(lines):
        if i in drop:
            continue
        own = cut[first[i] : first[i] + count[i]]
        if len(own) and own.all():
            continue
        if own.any():
            start = [m.start() for m in _WORD.finditer(line)] + [len(line)]
            line = line[: start[0]] + b"".join(line[start[k] : start[k + 1]] for k in np.flatnonzero(~own))
        out.append(line)
    return b"\n".join(out), int((cut[1:] & ~cut[:-1]).sum()) + int(cut[0])


def _jaccard_links(values: list[np.ndarray], similarity: float):
    """Exact test of pairs by their shingle sets, after the size and bitmap bounds have ruled out what they can."""
    size = np.array([len(v) for v in values], np.int64)
    first = np.cumsum(size) - size
    flat = np.unique(np.concatenate(values), return_inverse=True)[1] if len(values) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(values)), size)
    bits = np.zeros((len(values), 4), np.uint64)
    np.bitwise_or.at(bits, (owner, (flat >> 6) & 3), np.uint64(1) << (flat & 63).astype(np.uint64))
    top = int(flat.max()) + 1 if len(flat) else 1

    def exact(i, j):
        pair = np.arange(len(i))
        parts = []
        for side in (i, j):
            n = size[side]
            pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[side], n)
            parts.append(np.repeat(pair, n) * top + flat[pos])
        code = np.sort(np.concatenate(parts))
        both = np.bincount(code[1:][code[1:] == code[:-1]] // top, minlength=len(i))
        return both >= similarity * (size[i] + size[j] - both) - 1e-9

    def linked(i, j):
        ok = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
        lost = np.bitwise_count(bits[i] & ~bits[j]).sum(axis=1).astype(np.int64)
        most = size[i] - lost
        ok &= most >= similarity * (size[i] + size[j] - most) - 1e-9
        at = np.flatnonzero(ok)
        for low in range(0, len(at), 4096):
            part = at[low : low + 4096]
            ok[part] = exact(i[part], j[part])
        return ok

    return linked


def dedup_paragraphs(docs: DataFrame, words: int = 5, similarity: float = 0.8, least_words: int = 1, most: int = 4096, passages: bool = True, texts: bool = True) -> DataFrame:
    """Remove paragraphs that nearly repeat an earlier one, in the same or another document.

    ``docs(doc_id, text)`` -> a row for each row of docs: (doc_id, n_bytes, n_removed bytes, n_spans paragraphs
    removed, kept_sha256 and, with ``texts``, kept_text of what stays, n_paragraphs, classes, kept_in). Paragraphs (lines)
    of ``least_words`` or more words link at a Jaccard similarity of ``similarity`` or more of their sets of
    ``words``-word shingles; of every component the first paragraph, by document and place, stays. ``classes``
    are the components this document has a paragraph in that another paragraph shares, ``kept_in`` the
    doc_ids where the paragraphs removed here are kept.

    With ``passages``, a passage of 49 words or more that an earlier place of this or another document holds too goes from
    its first to its last word, wherever it stands, inside paragraphs and across line ends (n_spans counts each stretch);
    of shorter ones those of 20 words or more in which a run is chosen go, also from end to end. Words are compared one by
    one; no other word goes. Lines that go as whole paragraphs neither lose nor keep a passage: a stretch ends where one begins, so
    every word that goes with a passage has an equal place in a line that stays.

    Equal paragraphs are one class from the start, so copies form no pairs. Band values that only one class has are
    dropped by counts; colliding classes are verified exactly, in blocks of about ``2 * most`` classes and a million
    shingles at most; only links between parts not yet connected are kept.
    Null texts are empty; a null doc_id comes after the others; rows that repeat a doc_id stay separate rows
    (told apart by a hash of their texts, whose order decides among them; rows equal in both are one); an empty table gives an empty one; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text")
    twice = written(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc", F.lit(True).alias("twice")), "paragraph-ids")
    if twice.limit(1).count():  # rows that share an id are told apart by their text
        rows = rows.join(twice, "doc", "left").select("doc", F.when(F.col("twice"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("rid"), "text")
    else:
        rows = rows.select("doc", F.lit(0).cast("long").alias("rid"), "text")
    units = written(unit_table(rows, words, similarity, least_words, passages), "paragraph-units")
    placed = units.where("not run")
    classes = placed.groupBy("k1", "k2").agg(F.min(F.struct("doc", "rid", "at")).alias("first"), F.count(F.lit(1)).alias("n"), F.max("shingles").alias("shingles"), *(F.max(f"b{i}").alias(f"b{i}") for i in range(BANDS)))
    classes = written(classes, "paragraph-classes")

    bands = classes.select("k1", "k2", "shingles", F.explode(F.array(*(f"b{i}" for i in range(BANDS)))).alias("value")).where("value is not null")
    shared = written(bands.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("weight")).where("n > 1"), "paragraph-bands")
    chunks = F.ceil(F.greatest(F.col("n") / most, F.col("weight") / (1 << 20)))
    colliding = dealt_blocks(bands.join(shared, "value"), chunks, F.xxhash64("k1", "k2")).select("value", "block", "k1", "k2")

    def collide(batches):
        for b in whole_groups(batches, ["value", "block"]):
            value, block, k1, k2 = (b[c].to_numpy(np.int64) for c in ("value", "block", "k1", "k2"))
            start = np.r_[0, np.flatnonzero((np.diff(value) != 0) | (np.diff(block) != 0)) + 1]
            n = np.diff(np.r_[start, len(b)])
            same = np.add.reduceat(_mixed(k1.view(np.uint64) + _mixed(k2.view(np.uint64))), start).view(np.int64)  # one name for equal groups of any band
            keep = np.repeat(n > 1, n)
            yield pd.DataFrame({"bucket": np.repeat(same, n)[keep], "k1": k1[keep], "k2": k2[keep]})

    met = colliding.repartition("value", "block").sortWithinPartitions("value", "block").mapInPandas(collide, "bucket long, k1 long, k2 long")
    met = written(met.distinct(), "paragraph-buckets")

    wanted = met.select("k1", "k2", F.lit(True).alias("met")).distinct()
    known = classes.select("k1", "k2", "first", "n").join(wanted, ["k1", "k2"], "left").where("n > 1 or met")
    known = written(known, "paragraph-known")  # classes of several lines, or that may link to others
    members = written(placed.select("k1", "k2", "doc", "rid", "at").join(known.select("k1", "k2"), ["k1", "k2"]), "paragraph-members")
    asked = known.where("met").select("first.doc", "first.rid", F.struct("first.at", "k1", "k2").alias("x")).groupBy("doc", "rid").agg(F.collect_list("x").alias("x"))  # lines of one document, here and below
    asked = asked.select("doc", "rid", F.col("x.at").alias("asked"), F.col("x.k1").alias("k1"), F.col("x.k2").alias("k2"))

    def fetch(batches):
        for part, texts in _texts(batches):
            w = Words(texts)
            lines = np.concatenate([w.first_line[i] + np.asarray(x, np.int64) for i, x in enumerate(part["asked"])])
            h, first = w.shingles(lines, words)
            k1, k2 = (np.concatenate([np.asarray(x, np.int64) for x in part[c]]) for c in ("k1", "k2"))
            yield pd.DataFrame({"k1": k1, "k2": k2, "shingles": [np.unique(x).view(np.int64) for x in np.split(h, first[1:])]})

    sent = packed(rows)
    shingles = sent.join(asked, ["doc", "rid"]).dropDuplicates(["doc", "rid"]).mapInPandas(fetch, "k1 long, k2 long, shingles array<long>")

    def verify(batches):
        for b in whole_groups(batches, ["bucket"]):
            bucket, names = b["bucket"].to_numpy(np.int64), b["key"].to_numpy()
            i, j = near_pairs(bucket, _jaccard_links(b["shingles"].tolist(), similarity))
            yield pd.DataFrame({"src": names[i], "dst": names[j]})

    key = F.concat_ws("/", "k1", "k2")
    links = met.join(shingles, ["k1", "k2"]).select("bucket", key.alias("key"), "shingles").repartition("bucket").sortWithinPartitions("bucket").mapInPandas(verify, "src string, dst string")
    roots = connected_components(links)
    named = known.select("k1", "k2", "first", "n", key.alias("key"))
    named = named.join(roots, named["key"] == roots["node"], "left").select("k1", "k2", "first", "n", F.coalesce("root", "key").alias("class"))
    groups = named.groupBy("class").agg(F.min("first").alias("keeper"), F.sum("n").alias("n")).where("n > 1")
    named = named.select("k1", "k2", "class").join(groups, "class").select("k1", "k2", "class", "keeper")
    gone = (F.col("doc") != F.col("keeper.doc")) | (F.col("rid") != F.col("keeper.rid")) | (F.col("at") != F.col("keeper.at"))
    lines = members.select("k1", "k2", "doc", "rid", "at").join(named, ["k1", "k2"]).select("doc", "rid", "at", "class", F.col("keeper.doc").alias("kept"), gone.alias("gone"))
    lines = written(lines, "paragraph-hits")
    hits = lines.groupBy("doc", "rid").agg(
        F.sort_array(F.collect_set(F.when(F.col("gone"), F.col("at")))).alias("gone"), F.sort_array(F.collect_set("class")).alias("classes"),
        F.sort_array(F.collect_set(F.when(F.col("gone"), F.nullif("kept", F.lit(LAST))))).alias("kept_in"),
    )

    digests = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_paragraphs long" + (", kept_text string" if texts else "")
    columns = [x.split()[0] for x in digests.split(", ")]

    def digest(text: str, drop: set[int], found: list[tuple[int, int]]) -> tuple:
        raw, spans = text.encode("utf-8"), 0
        lines = raw.split(b"\n")
        kept = b"\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else raw
        if found:
            kept, spans = without_passages(lines, drop, found)
        row = (len(raw), len(raw) - len(kept), len(drop) + spans, hashlib.sha256(kept).hexdigest(), len(lines))
        return (*row, kept.decode("utf-8")) if texts else row

    def cut(batches):
        """Without the lines that go; and, of the seeds, the words around them, of a long text in several rows (all but the first without digests)."""
        names = ["doc", "rid", "gone", "classes", "kept_in", *columns, "word", "h", "n", "run", "left", "right", "packed"]
        for b, texts in _texts(batches):
            rows, held = [], 0
            for doc, rid, gone, classes, kept_in, word, h, n, pack, text in zip(*(b[c] for c in ("doc", "rid", "gone", "classes", "kept_in", "word", "h", "n", "packed")), texts):
                head = (gone, classes, kept_in, *digest(text, set() if gone is None else set(gone.tolist()), []))
                if word is None:
                    rows.append((doc, rid, *head, *(None,) * 7))
                    continue
                raw = text.encode("utf-8").lower()
                edge = np.diff((~_SPACE[np.frombuffer(raw, np.uint8)]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
                start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                between = lambda x, y: raw[start[x] : end[y - 1]].split() if x < y else []  # noqa: E731, B023
                low, high = _open(raw, start, gone, word)
                whole = np.flatnonzero(high >= word + SPAN)
                for k in range(0, max(1, len(whole)), 1024):
                    some = whole[k : k + 1024]
                    at = list(zip(word[some].tolist(), low[some].tolist(), high[some].tolist()))
                    sides = [b" ".join(between(x, x + SPAN)) for x, _, _ in at], [b" ".join(between(max(a, x - SIDE), x)[::-1]) for x, a, _ in at], [b" ".join(between(x + SPAN, min(x + SPAN + SIDE, z))) for x, _, z in at]
                    rows.append((doc, rid, *((None,) * len(head) if k else head), [x for x, _, _ in at], h[some].tolist(), n[some].tolist(), *sides, None if k else pack))
                    held += len(at)
                    if held >= 4096:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=names, dtype=object)

    def cut_passages(batches):
        for b, texts in _texts(batches):
            out = [digest(text, set() if gone is None else set(gone.tolist()), [] if low is None else list(zip(low.tolist(), high.tolist()))) for text, gone, low, high in zip(texts, b["gone"], b["low"], b["high"])]
            yield pd.concat([b[["doc", "classes", "kept_in"]], pd.DataFrame(out, columns=columns)], axis=1)

    found = hits
    if passages:
        runs = units.where("run").select("doc", "rid", "line", F.col("at").alias("word"), F.col("k1").alias("h"))
        again = written(runs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "paragraph-runs")
        away = lines.where("gone").select("doc", "rid", F.col("at").alias("line"))  # a run inside a line that goes finds nothing more
        seeds = written(runs.join(again, "h").join(away, ["doc", "rid", "line"], "left_anti").select("doc", "rid", "word", "h"), "paragraph-seeds")
        again = written(seeds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "paragraph-runs")
        seeds = seeds.join(again, "h").groupBy("doc", "rid").agg(F.collect_list(F.struct("word", "h", "n")).alias("x"))
        found = hits.join(seeds.select("doc", "rid", F.col("x.word").alias("word"), F.col("x.h").alias("h"), F.col("x.n").alias("n")), ["doc", "rid"], "full")
    else:
        found = hits.selectExpr("*", "cast(null as array<int>) word", "cast(null as array<bigint>) h", "cast(null as array<bigint>) n")
    kinds = "doc long, rid long, gone array<int>, classes array<string>, kept_in array<long>, " + digests
    full = sent.join(found, ["doc", "rid"], "left").select("doc", "rid", "packed", "gone", "classes", "kept_in", "word", "h", "n")
    first = full.mapInPandas(cut, kinds + ", word array<int>, h array<long>, n array<long>, run array<binary>, left array<binary>, right array<binary>, packed binary")
    out = first
    if passages:
        first = written(first, "paragraph-lines")
        sides = first.where("word is not null").select("doc", "rid", F.inline(F.arrays_zip("word", "h", "n", "run", "left", "right")))
        inner = grown_passages(sides, 4 * most)
        held = F.transform(F.coalesce("passages.keeper", F.array().cast("array<bigint>")), lambda x: F.nullif(x, F.lit(LAST)))
        kept_in = F.sort_array(F.array_compact(F.array_union(F.coalesce("kept_in", F.array().cast("array<bigint>")), held))).alias("kept_in")
        rest = first.where("packed is not null").join(inner, ["doc", "rid"], "left").select("doc", "packed", "gone", "classes", kept_in, F.col("passages.low").alias("low"), F.col("passages.high").alias("high"))
        rest = rest.mapInPandas(cut_passages, "doc long, classes array<string>, kept_in array<long>, " + digests)
        out = first.where("word is null").select(*rest.columns).unionByName(rest)
    columns_out = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if texts else []), "n_paragraphs", "classes", "kept_in"]
    return out.select(F.nullif("doc", F.lit(LAST)).alias("doc_id"), *columns_out)


def op2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph de-duplication of all documents, of every paragraph that has a word."""
    return dedup_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet"), least_words=1, texts=False)
