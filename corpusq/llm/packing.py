"""Harmonic packing of tokenised documents into sequences of one capacity."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm.token_records import _tool

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.lru_cache(maxsize=1 << 16)
def rest_pieces(n: int, capacity: int, classes: int, slack: float) -> tuple[tuple[int, int], ...]:
    """(length, class) of the pieces of the ``n < capacity`` ids beyond a document's full sequences.

    Class k holds lengths up to capacity / k, k pieces a sequence. A rest that leaves at most the share ``slack`` of its
    place empty stays whole; a longer one gives off a piece that fills a place of the next class exactly. What is no longer
    than capacity / classes is of the last class, 0.
    """
    out = []
    while n:
        k = capacity // n
        if k >= classes:
            out.append((n, 0))
            break
        place = capacity // k
        if place - n <= slack * place:
            out.append((n, k))
            break
        out.append((capacity // (k + 1), k + 1))
        n -= capacity // (k + 1)
    return tuple(out)


class Bins:
    """The open sequences of one task: one a class, closed at its fixed number of pieces. Pieces are [document, start, ids]."""

    def __init__(self, capacity: int, classes: int, slack: float, close):
        self.capacity, self.classes, self.slack, self.close = capacity, classes, slack, close
        self.open: list[list] = [[] for _ in range(classes + 1)]
        self.chain: list = []
        self.room = capacity

    def add(self, doc, ids: np.ndarray) -> None:
        at = 0
        while len(ids) - at >= self.capacity:
            self.close([[doc, at, ids[at : at + self.capacity]]])
            at += self.capacity
        for n, k in rest_pieces(len(ids) - at, self.capacity, self.classes, self.slack):
            piece = [doc, at, ids[at : at + n]]
            at += n
            if k:
                self.open[k].append(piece)
                if len(self.open[k]) == k:
                    self.close(self.open[k])
                    self.open[k] = []
            else:
                self.chained(piece)

    def chained(self, piece) -> None:
        """Next fit of the last class: a piece that does not fit is cut, so these sequences are full."""
        doc, at, ids = piece
        while len(ids) >= self.room:
            self.close([*self.chain, [doc, at, ids[: self.room]]])
            at, ids = at + self.room, ids[self.room :]
            self.chain, self.room = [], self.capacity
        if len(ids):
            self.chain.append([doc, at, ids])
            self.room -= len(ids)

    def finish(self) -> None:
        """Pieces of open sequences are chained; what then remains is cut to lengths that are powers of two."""
        left, self.open = [p for pieces in self.open for p in pieces], [[] for _ in range(self.classes + 1)]
        for p in left:
            self.chained(p)
        rest, total = self.chain, self.capacity - self.room
        self.chain, self.room = [], self.capacity
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            own: list = []
            while size:
                doc, at, ids = rest[0]
                own.append([doc, at, ids[:size]])
                if len(ids) > size:
                    rest[0] = [doc, at + size, ids[size:]]
                else:
                    rest = rest[1:]
                size -= len(own[-1][2])
            self.close(own)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, classes: int = 64, slack: float = 0.02, ids: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """Pack the ids of every whole text of ``docs(doc_id, text)``, each followed by ``end_id``, into sequences.

    Every task packs the documents of its input partition by itself, so nothing is shuffled: a document's full sequences
    go out at once, its rest is cut to pieces of reciprocal classes (``rest_pieces``), and a class's sequence is closed at
    its fixed number of pieces. A task holds at most one open sequence a class; at its end those that are not full
    are chained, and the last ids go into sequences whose lengths are powers of two, which need no padding.

    Returns a row a piece: doc_id, start (the document's ids before it), length, ids_crc32 (of little-endian unsigned 32-bit
    ids), doc_tokens (all ids of the document), sequence_id, offset (in the sequence), and with ``ids`` the ids
    themselves. A null text is empty and so has the end id alone; null and repeated ids are kept, each row is a document;
    other columns are left out; an empty table gives an empty one. Sequence numbers hold the partition's number, so a
    repeated task gives the same rows if its input does (scans and sorted tables do).
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        tool, rows, number = None, [], part << 40

        def close(pieces):
            nonlocal number
            offset = 0
            for (doc, total), at, x in pieces:
                raw = x.tobytes()
                rows.append((doc, at, len(x), zlib.crc32(raw), total, number, offset, raw))
                offset += len(x)
            number += 1

        def out():
            columns = list(zip(*rows))[: len(schema)]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        bins = Bins(capacity, classes, slack, close)
        for b in batches:
            tool = tool or _tool(tokenizer)
            keys, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            low = used = 0
            for high, t in enumerate(texts):
                used += len(t)
                if used < batch_bytes and high + 1 < len(texts):
                    continue
                for doc, found in zip(keys[low : high + 1], tool.encode(texts[low : high + 1])):
                    whole = np.append(np.frombuffer(found, tool.dtype).astype("<u4"), np.array([end_id], "<u4"))
                    bins.add((doc, len(whole)), whole)
                    if len(rows) >= 4096:
                        yield out()
                low, used = high + 1, 0
        bins.finish()
        if rows:
            yield out()

    kinds = {"long": pa.int64(), "binary": pa.binary()}
    said = PIECES + (", ids binary" if ids else "")
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in said.split(", ")])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, said)


def sequences(pieces: DataFrame, capacity: int = 4096, pad_id: int = 0) -> DataFrame:
    """The packed sequences: (sequence_id, tokens, ids, segments), padded to ``capacity`` ids unless ``tokens`` is a power of two.

    ``ids`` are little-endian unsigned 32-bit integers; ``segments`` has (doc_id, start, offset, length) of each piece, for
    attention masks and positions. A group has ``capacity`` ids at most.
    """
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    whole = pieces.groupBy("sequence_id").agg(own.alias("s"), F.sum("length").alias("tokens"))
    raw = F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    padded = F.rpad(raw, 4 * capacity, F.lit(pad_id.to_bytes(4, "little")))
    ids = F.when(F.bit_count("tokens") == 1, raw).otherwise(padded)
    return whole.select("sequence_id", "tokens", ids.alias("ids"), F.transform("s", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("segments"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 ids, a row a piece."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), ids=False)
