"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in whole documents."""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm.shared import put_in_place, shared_dir, written

#: Bytes that belong to words: digits, letters and everything outside ASCII; A-Z are lower-cased, others are gaps.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 32 for b in range(256))
TABLE_BITS = 20  # of the shift tables, which are indexed by a hash of a block


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(WORD_BYTES).split()


def windows_of(words: list[bytes], size: int) -> set[tuple[bytes, int]]:
    """Windows of ``size`` words, framed by spaces; the whole sequence if it is shorter and not empty."""
    n = min(size, len(words))
    return {(b" " + b" ".join(words[i : i + n]) + b" ", n) for i in range(len(words) - n + 1)} if n else set()


class WuManber:
    """Shift and suffix-bucket tables over byte patterns; scans a buffer in many lanes at a time.

    Blocks are 8 bytes (3 for short patterns): many patterns share every short block, which would leave no shifts.
    """

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.least = m = min(map(len, patterns))
        self.width = w = 8 if m >= 16 else 3
        rows = self.blocks(b"".join(p[:m] for p in patterns))
        base = np.arange(len(patterns)) * m
        self.shift = np.full(1 << TABLE_BITS, m - w + 1, np.int32)
        for end in range(w - 1, m):  # ever smaller shifts
            self.shift[self.hashed(rows[base + end - w + 1])] = m - 1 - end
        suffix = self.hashed(rows[base + m - w])
        self.order = np.argsort(suffix, kind="stable")
        self.count = np.bincount(suffix, minlength=1 << TABLE_BITS).astype(np.int32)
        self.first = (np.cumsum(self.count) - self.count).astype(np.int32)

    @staticmethod
    def blocks(buffer: bytes) -> np.ndarray:
        """The eight bytes from each position on, as one number each."""
        return np.ndarray((len(buffer),), "<u8", buffer + bytes(8), strides=(1,))

    def hashed(self, block: np.ndarray) -> np.ndarray:
        kept = block & np.uint64((1 << 8 * self.width) - 1)
        return (kept * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def scan(self, buffer: bytes, lane: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and pattern numbers of all occurrences."""
        t, m, back = self.blocks(buffer), self.least, self.width - 1
        none = np.zeros(0, np.int64)
        if len(t) < m:
            return none, none
        at = np.arange(m - 1, len(t), lane)
        stop = np.minimum(at + lane, len(t))
        found = []
        while len(at):
            step = self.shift[self.hashed(t[at - back])]
            hit = step == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not found:
            return none, none
        end = np.sort(np.concatenate(found))
        suffix = self.hashed(t[end - back])
        starts, which = [], []
        for low in range(0, len(end), 1 << 16):
            e, s = end[low : low + (1 << 16)], suffix[low : low + (1 << 16)]
            many = self.count[s].astype(np.int64)
            at = np.repeat(e - m + 1, many)
            p = self.order[np.repeat(self.first[s] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            ok = [i for i, (x, y) in enumerate(zip(at.tolist(), p.tolist())) if buffer.startswith(self.patterns[y], x)]
            starts.append(at[ok])
            which.append(p[ok])
        return np.concatenate(starts), np.concatenate(which)


class Items:
    """The windows of a block of benchmark items and the tables to find them; patterns of like length share tables."""

    def __init__(self, items: list[tuple[str | None, str]], size: int):
        owners: dict[tuple[bytes, int], set[str]] = {}
        for name, text in items:
            for w in windows_of(words_of(text), size):
                owners.setdefault(w, set()).update([] if name is None else [name])
        groups: dict[int, list[tuple[bytes, int]]] = {}
        for w in owners:
            groups.setdefault(min(len(w[0]).bit_length(), 7), []).append(w)
        self.groups = [(WuManber([w for w, _ in g]), np.array([n for _, n in g]), [owners[w] for w in g]) for g in groups.values()]


class Chunk:
    """A few documents in one buffer: their words hit and the items found, as block after block is looked for."""

    def __init__(self, texts: list[str | None]):
        words = [words_of(t) for t in texts]
        self.counts = [len(w) for w in words]
        self.buffer = b"".join(b" " + b" ".join(w) + b" \n" for w in words)
        self.gaps = np.flatnonzero(np.frombuffer(self.buffer, np.uint8) == 32)
        self.first = np.cumsum([0] + [max(n, 1) + 1 for n in self.counts])  # each document's first gap; an empty one has two
        self.cover = np.zeros(len(self.gaps) + 1, np.int32)
        self.items: list[set[str]] = [set() for _ in texts]

    def look_for(self, block: Items) -> None:
        for tables, width, owners in block.groups:
            start, which = tables.scan(self.buffer)
            gap = np.searchsorted(self.gaps, start)
            np.add.at(self.cover, gap, 1)
            np.add.at(self.cover, gap + width[which], -1)
            doc = np.searchsorted(self.first, gap, side="right") - 1
            for d, p in set(zip(doc.tolist(), which.tolist())):
                self.items[d] |= owners[p]

    def hits(self) -> list[int]:
        hit = np.concatenate([[0], np.cumsum(np.cumsum(self.cover) > 0)])
        return (hit[self.first[1:]] - hit[self.first[:-1]]).tolist()


def write_blocks(benchmark: DataFrame, window: int, block_bytes: int, path: str) -> list[int]:
    """Deal the items of a benchmark to blocks of about ``block_bytes`` of text and write each one's tables; their numbers.

    Spark deals the items by hash and builds a block a task; the driver sees the sum of sizes and the numbers alone.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))

    def build(key, rows):
        fs, base = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(base)
        final = f"{base}/block-{int(key[0]):06d}.bin"
        temp = f"{final}.try-{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(temp) as out:
            out.write(pickle.dumps(Items(list(zip(rows["item"].where(rows["item"].notna(), None), rows["text"])), window)))
        put_in_place(fs, temp, final)
        return pd.DataFrame({"block": [key[0]]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks).cast("long")))
    return sorted(r["block"] for r in written(dealt.groupBy("block").applyInPandas(build, "block long"), "benchmark-blocks").collect())


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 2 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """Occurrences of benchmark windows in every whole document.

    ``docs(doc_id, text)`` -> (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, *keep), a row for
    each row. A window is ``window`` consecutive words of an item, or all of a shorter item's; a document word
    inside any occurrence is hit. The benchmark is the stated query set: Spark deals it to blocks of about
    ``block_bytes`` of text whose tables are written to the shared folder, and a task holds the tables of one block
    at a time, so memory does not grow with the benchmark; the documents are read once and not shuffled.
    Null and empty texts have no words; items without words find nothing; an item without id marks words but is not
    counted; repeated ids count once; repeated rows and null doc_ids are kept; an empty benchmark finds nothing, an
    empty table gives an empty one; other columns are ignored.
    """
    path = shared_dir(docs.sparkSession, "benchmark-tables")
    blocks = write_blocks(benchmark, window, block_bytes, path)

    def run(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(path)
        loaded: dict[int, Items] = {}

        def block(i: int) -> Items:
            if i not in loaded:
                loaded.clear()
                with fs.open_input_stream(f"{base}/block-{i:06d}.bin") as data:
                    loaded[i] = pickle.loads(data.read())
            return loaded[i]

        def scanned(held):
            order = blocks if not blocks or blocks[0] in loaded else blocks[::-1]  # begin with the block at hand
            for i in order:
                tables = block(i)
                for _, chunks in held:
                    for c in chunks:
                        c.look_for(tables)
            for batch, chunks in held:
                counts, hits, items = ([x for c in chunks for x in part(c)] for part in (lambda c: c.counts, Chunk.hits, lambda c: c.items))
                names = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
                new = [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(names, pa.string()), pa.array([h > 0 for h in hits], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *keep)), *new], names=["doc_id", *keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

        held, size = [], 0
        for batch in batches:
            chunks, texts, used = [], [], 0
            for text in batch.column("text").to_pylist():
                texts.append(text)
                used += len(text or "")
                if used > 4 << 20:
                    chunks.append(Chunk(texts))
                    size += used
                    texts, used = [], 0
            chunks.append(Chunk(texts))
            held.append((batch, chunks))
            size += used
            if size > 32 << 20:  # enough to scan for the loading of a block
                yield from scanned(held)
                held, size = [], 0
        yield from scanned(held)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    columns = ["doc_id", *keep, "text"] if "text" not in keep else ["doc_id", *keep]
    extra = "".join(f", `{c}` {kinds[c]}" for c in keep)
    return docs.select(*columns).mapInArrow(run, f"doc_id {kinds['doc_id']}{extra}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in all documents."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = """
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
o AS (SELECT dw.doc_id, dw.n, dw.i, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM o)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
