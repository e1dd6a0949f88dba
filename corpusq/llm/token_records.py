"""Token ids in length-delimited binary records with masked checksums and a separate offset index."""

from __future__ import annotations

import itertools
import json
import os
import struct
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusq.llm.shared import put_in_place, shared_dir, written

INDEX = np.dtype([("doc_id", "<i8"), ("null_id", "u1"), ("offset", "<u8"), ("bytes", "<u4"), ("tokens", "<u4")])
HEAD, CRC = "<Q", "<I"

#: What a tokenizer file has to declare for its words to be encoded one by one (word_bpe_49k.json does).
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: The declared pieces of many words at a time, one word a line.
PIECES = regex.compile(r"\n|" + SPLIT["pattern"]["Regex"].replace(r"\s", r"\x09-\x0D\x20\x85\xA0"))
#: Characters for which Python and the tokenizer agree on case, classes and white space; other texts are encoded whole.
PLAIN = regex.compile(r"[\x00-\x1B\x20-ɏ‐-‧‰-⁞€]*")
#: Byte-level alphabet: bytes that print stand for themselves, the others are numbered from 256.
_PRINT = {*range(33, 127), *range(161, 173), *range(174, 256)}
LETTERS = {b: b if b in _PRINT else 256 + sum(x not in _PRINT for x in range(b)) for b in range(256)}
_TOOLS: dict[tuple[str, int], "WordTokenizer"] = {}


def masked(data: bytes) -> int:
    """CRC-32 rotated and offset, so that a checksum stored in checked data does no harm."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


class Spans:
    """Token ids of numbered strings, end to end in one array."""

    def __init__(self, dtype: np.dtype):
        self.number: dict[str, int] = {}
        self.start, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat, self.used = np.zeros(1 << 14, dtype), 0

    def add(self, names: list[str], flat: np.ndarray, count: np.ndarray) -> None:
        n = len(self.number)
        while n + len(names) > len(self.start):
            self.start, self.count = np.r_[self.start, self.start], np.r_[self.count, self.count]
        while self.used + len(flat) > len(self.flat):
            self.flat = np.r_[self.flat, self.flat]
        self.start[n : n + len(names)] = self.used + np.cumsum(count) - count
        self.count[n : n + len(names)] = count
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.number.update(zip(names, range(n, n + len(names))))

    def numbers(self, names: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.get, names, itertools.repeat(-1)), np.int64, len(names))

    def ids(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these strings in order, and how many each has."""
        count = self.count[which]
        step = np.repeat(self.start[which] - np.cumsum(count) + count, count)
        return self.flat[step + np.arange(len(step))], count


class WordTokenizer:
    """The tokenizers library, with the ids of words seen before remembered.

    Words are encoded one by one only where the file declares pieces that end at white space and are encoded
    independently of each other; with any other file each text goes through the library whole. ``most`` bounds the memory.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tool.get_vocab_size() <= 1 << 16 else "<u4")
        told = json.loads(self.tool.to_str())
        told = [(told[k] or {}).get(of) for k, of in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))] + [told["post_processor"]]
        self.by_word = told == [NORMALIZER, [SPLIT, BYTES], None]
        self.most = most
        self.words, self.pieces = Spans(self.dtype), Spans(self.dtype)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_pieces(self, pieces: list[str]) -> None:
        tokenize = self.tool.model.tokenize
        found = [[x.id for x in tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(LETTERS))] for p in pieces]
        count = np.fromiter(map(len, found), np.int64, len(found))
        self.pieces.add(pieces, np.fromiter(itertools.chain.from_iterable(found), self.dtype, int(count.sum())), count)

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, from those of their pieces."""
        coded = pa.array([*PIECES.findall("\n".join(words)), "\n"]).dictionary_encode()
        names, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if "\n" not in self.pieces.number:
            self.pieces.add(["\n"], np.zeros(0, self.dtype), np.zeros(1, np.int64))
        number = self.pieces.numbers(names)
        new = np.flatnonzero(number < 0)
        self._learn_pieces([names[i] for i in new])
        number[new] = np.arange(len(self.pieces.number) - len(new), len(self.pieces.number))
        flat, count = self.pieces.ids(number[which])
        total = np.cumsum(count)[which == names.index("\n")]
        self.words.add(words, flat, np.diff(total, prepend=0))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned integers."""
        if not self.by_word:
            return self._whole(texts)
        out: list[bytes] = [b""] * len(texts)
        found, lowered = [], []
        for i, t in enumerate(texts):
            plain = not any(c in t for c in "\x1c\x1d\x1e\x1f") if t.isascii() else PLAIN.fullmatch(t)
            if not plain or ("<|" in t and any(s in t for s in self.special)):
                out[i] = self._whole([t])[0]
            elif t:
                found.append(i)
                lowered.append((t if t.isascii() else unicodedata.normalize("NFC", t)).lower())
        if not found:
            return out
        if len(self.words.number) > self.most or len(self.pieces.number) > self.most:
            self.words, self.pieces = Spans(self.dtype), Spans(self.dtype)
        split = pc.utf8_split_whitespace(pa.array(lowered, pa.large_string()))
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        number = self.words.numbers(names)
        new = np.flatnonzero(number < 0)
        if len(new):
            self._learn([names[i] for i in new])
            number[new] = np.arange(len(self.words.number) - len(new), len(self.words.number))
        flat, count = self.words.ids(number[coded.indices.to_numpy()])
        end = np.r_[0, np.cumsum(count)][split.offsets.to_numpy()] * self.dtype.itemsize
        raw = flat.tobytes()
        for i, a, b in zip(found, end[:-1].tolist(), end[1:].tolist()):
            out[i] = raw[a:b]
        return out


def _tool(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker, which serves several tasks in turn."""
    key = (path, os.getpid())
    if key not in _TOOLS:
        _TOOLS[key] = WordTokenizer(path)
    return _TOOLS[key]


def _open(uri: str):
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return fs, path


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, batch_bytes: int = 2 << 20) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write records in ascending doc_id order under ``path``.

    Each range of ids becomes one data file of records (length, its masked checksum, a payload of id width,
    doc_id and token ids, the payload's masked checksum) and one index file of fixed-width entries. Files are
    written under a name of the attempt and then renamed, so a repeated task leaves whole files. Null texts are
    empty, so they hold the end id alone; null ids come first; equal ids are ordered by a hash of their text and then by
    text, repeated rows are kept. Rows without an id, and those of one id, are dealt to as many tasks as their number asks for.
    An empty table writes no file and gives an empty manifest; other columns are ignored.
    Returns the manifest (part, docs, tokens, bytes), one row a file.
    """

    def run(batches):
        task = TaskContext.get()
        part = task.partitionId()
        fs, base = _open(path)
        fs.create_dir(base)
        temp = f"{base}/.try-{part}-{task.taskAttemptId()}"
        tool, tail = None, None
        entries, offset, tokens, docs_done = [], 0, 0, 0
        data = index = None
        for b in batches:
            if tool is None:
                tool = _tool(tokenizer)
                tail = np.array([end_id], tool.dtype).tobytes()
                data, index = fs.open_output_stream(temp + ".rec"), fs.open_output_stream(temp + ".idx")
            last = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // batch_bytes
            cuts = [0, *(np.flatnonzero(np.diff(last)) + 1).tolist(), len(b)]
            for low, high in itertools.pairwise(cuts):  # only these texts leave Arrow
                some = b.slice(low, high - low)
                ids, nulls = some.column("doc_id").to_pylist(), some.column("null_id").to_pylist()
                for i, seq in enumerate(tool.encode([t or "" for t in some.column("text").to_pylist()])):
                    payload = struct.pack("<BBq", tool.dtype.itemsize, nulls[i], ids[i]) + seq + tail
                    head = struct.pack(HEAD, len(payload))
                    data.write(head + struct.pack(CRC, masked(head)) + payload + struct.pack(CRC, masked(payload)))
                    n = len(seq) // tool.dtype.itemsize + 1
                    entries.append((ids[i], nulls[i], offset, len(payload), n))
                    offset += len(payload) + 16
                    tokens += n
                index.write(np.array(entries, INDEX).tobytes())
                docs_done += len(entries)
                entries = []
        if data is not None:
            data.close()
            index.close()
            for kind in ("rec", "idx"):
                put_in_place(fs, f"{temp}.{kind}", f"{base}/part-{part:06d}.{kind}")
            pa.default_memory_pool().release_unused()  # the worker goes on to other tasks
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": [docs_done], "tokens": [tokens], "bytes": [offset]})

    order = docs.select(F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().cast("int").alias("null_id"), F.col("text").cast("string").alias("text"))
    # equal rows are told apart by their place in the input, whose order among them does not show
    keys = [F.desc("null_id"), "doc_id", "h"]
    order = order.withColumn("h", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = order.repartitionByRange(*keys, "place").sortWithinPartitions(*keys, "text").drop("h", "place")
    return written(order.mapInArrow(run, "part int, docs long, tokens long, bytes long"), "token-manifest")


def _records(fs, file: str, entries: np.ndarray, most: int = 4 << 20):
    """(entry, ids) of index entries in any order, each read by its offset; neighbours in the file come in one read.

    Lengths and checksums are tested, and ids are returned as little-endian unsigned 32-bit integers.
    """
    offset, size = entries["offset"].astype(np.int64), entries["bytes"].astype(np.int64) + 16
    with fs.open_input_file(file) as data:
        at = 0
        while at < len(entries):
            k, used = at + 1, int(size[at])
            while k < len(entries) and offset[k] == offset[k - 1] + size[k - 1] and used + size[k] <= most:
                used += int(size[k])
                k += 1
            block, low = data.read_at(used, int(offset[at])), 0
            for e in entries[at:k].tolist():
                raw = block[low : low + e[3] + 16]
                low += e[3] + 16
                head, payload = raw[:8], raw[12:-4]
                if len(raw) != e[3] + 16 or struct.unpack(HEAD, head)[0] != e[3] or struct.unpack(CRC, raw[8:12])[0] != masked(head) or struct.unpack(CRC, raw[-4:])[0] != masked(payload):
                    raise OSError(f"damaged record of document {e[0]} in {file}")
                yield e, np.frombuffer(payload, np.dtype(f"<u{payload[0]}"), offset=10).astype("<u4").tobytes()
            at = k


def _rows(out: list[tuple], columns: list[str]) -> pd.DataFrame:
    x = pd.DataFrame(out, columns=columns)
    return x.assign(doc_id=x["doc_id"].astype("Int64"))


def read_records(manifest: DataFrame, path: str, rows: int = 2000) -> DataFrame:
    """Read the record files back through their index, checking every length and checksum.

    Returns (doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents before it in the corpus;
    ``ids`` are little-endian unsigned 32-bit integers. An empty manifest gives an empty table.
    """
    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a file
    n = max(1, manifest.count())

    def run(batches):
        fs, base = _open(path)
        for b in batches:
            for part, start in zip(b["part"].tolist(), b["base"].tolist()):
                with fs.open_input_stream(f"{base}/part-{part:06d}.idx") as index:
                    while chunk := index.read(INDEX.itemsize * rows):
                        out = []
                        for e, ids in _records(fs, f"{base}/part-{part:06d}.rec", np.frombuffer(chunk, INDEX)):
                            out.append((None if e[1] else e[0], start, e[4], ids))
                            start += e[4]
                        yield _rows(out, ["doc_id", "start", "n_tokens", "ids"])

    return files.select("part", "base").repartition(n).mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")


def read_shuffled(manifest: DataFrame, path: str, seed: str = "epoch-1", partitions: int | None = None) -> DataFrame:
    """All records in a seeded random order, each read by the offset that the index gives.

    Only index entries are shuffled: every entry gets a draw of the seed and its place, partitions take ranges of
    draws by hash, and a task reads its records' ranges. Returns (doc_id, n_tokens, ids) in the drawn order within
    each of ``partitions`` (one for each file by default) partitions; the same seed gives the same order. Null ids come back as
    null; an empty manifest gives an empty table.
    """
    n = partitions or max(1, manifest.count())

    def entries(batches):
        fs, base = _open(path)
        for b in batches:
            for part in b["part"].tolist():
                with fs.open_input_stream(f"{base}/part-{part:06d}.idx") as index:
                    while chunk := index.read(INDEX.itemsize * 10_000):
                        yield pd.DataFrame(np.frombuffer(chunk, INDEX)).astype("int64").assign(part=part)

    def fetch(batches):
        fs, base = _open(path)
        for b in batches:
            for low in range(0, len(b), 500):
                some = b.iloc[low : low + 500].reset_index(drop=True)
                got: dict[int, tuple] = {}
                for part, g in some.sort_values(["part", "offset"]).groupby("part"):
                    wanted = np.zeros(len(g), INDEX)
                    for c in INDEX.names:
                        wanted[c] = g[c].to_numpy()
                    for i, (e, ids) in zip(g.index, _records(fs, f"{base}/part-{part:06d}.rec", wanted)):
                        got[i] = (None if e[1] else e[0], e[4], ids)
                yield _rows([got[i] for i in range(len(some))], ["doc_id", "n_tokens", "ids"])

    kinds = "doc_id long, null_id long, offset long, bytes long, tokens long, part int"
    index = manifest.select("part").repartition(max(1, manifest.count())).mapInPandas(entries, kinds)
    drawn = index.withColumn("draw", F.md5(F.concat_ws("/", F.lit(seed), "part", "offset")))
    return drawn.repartition(n, "draw").sortWithinPartitions("draw").drop("draw").mapInPandas(fetch, "doc_id long, n_tokens long, ids binary")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token records of all documents, written and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = shared_dir(spark, "token-records")
    manifest = write_records(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return read_records(manifest, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
