"""Media columns: archives of audio members and a data source that reads them by byte ranges of their directories."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusq.llm.shared import put_in_place, shared_dir, written

ENTRY = np.dtype([("doc_id", "<i8"), ("null_id", "u1"), ("offset", "<u8"), ("stored", "<u4"), ("media", "<u4"), ("n_bytes", "<u8"), ("crc", "<u4")])
UNIT, RATE = 192, 8000
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
MEMBER_SCHEMA = "doc_id long, n_bytes long, media binary"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with blanks up to a positive multiple of 192, and the number of bytes without them."""
    raw = (text or "").encode("utf-8")
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" "), len(raw)


def wav(samples: bytes) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    return HEADER.pack(b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples


def samples_of(media: bytes) -> bytes:
    found = HEADER.unpack_from(media)
    if found[0] != b"RIFF" or found[11] != b"data" or found[12] != len(media) - HEADER.size:
        raise ValueError("not a WAV file of this kind")
    return media[HEADER.size :]


def write_archives(docs: DataFrame, path: str, level: int = 3) -> DataFrame:
    """Store each text of ``docs(doc_id, text)`` as a WAV member of an archive under ``path``, without a shuffle.

    Each task writes one archive of compressed members and its directory of fixed-width entries, under a
    name of the attempt and then renamed. Null texts are empty ones; null ids are kept as such; repeated rows are members of
    their own; other columns are left out; an empty table gives an empty manifest. Returns (part, members), a row an archive.
    """

    def run(batches):
        task = TaskContext.get()
        part = task.partitionId()
        fs, base = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(base)
        temp = f"{base}/.try-{part}-{task.taskAttemptId()}"
        tool = zstandard.ZstdCompressor(level=level)
        offset = n = 0
        with fs.open_output_stream(temp + ".arc") as data, fs.open_output_stream(temp + ".dir") as index:
            for b in batches:
                entries = np.zeros(len(b), ENTRY)
                for i, (doc, null, text) in enumerate(zip(b["doc_id"].tolist(), b["null_id"].tolist(), b["text"])):
                    payload, size = payload_of(text)
                    media = wav(payload)
                    stored = tool.compress(media)
                    data.write(stored)
                    entries[i] = (doc, null, offset, len(stored), len(media), size, zlib.crc32(stored))
                    offset += len(stored)
                index.write(entries.tobytes())
                n += len(b)
        for kind in ("arc", "dir"):
            put_in_place(fs, f"{temp}.{kind}", f"{base}/archive-{part:06d}.{kind}")
        yield pd.DataFrame({"part": [part], "members": [n]})

    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().cast("int").alias("null_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInPandas(run, "part int, members long"), "media-manifest")


class DirectoryRange(InputPartition):
    """Bytes ``begin`` to ``end`` of an archive's directory."""

    def __init__(self, archive: str, begin: int, end: int):
        super().__init__((archive, begin, end))


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.entries = int(options.get("entries", 2000))
        self.tries = int(options.get("tries", 3))
        self.batch_bytes = int(options.get("batchBytes", 4 << 20))

    def partitions(self):
        """Ranges of whole entries; only the directories' names and sizes are looked at."""
        fs, base = pyarrow.fs.FileSystem.from_uri(self.path)
        step = self.entries * ENTRY.itemsize
        found = fs.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.base_name.startswith("archive-") and f.base_name.endswith(".dir"))
        return [DirectoryRange(p[:-4], at, min(at + step, size)) for p, size in files for at in range(0, size, step)] or [DirectoryRange("", 0, 0)]

    def member(self, fs, archive: str, entry) -> bytes:
        """One member, by its offset; it alone is read again when it comes damaged or not at all."""
        for left in reversed(range(self.tries)):
            try:
                with fs.open_input_file(archive) as data:
                    return self.checked(data.read_at(int(entry["stored"]), int(entry["offset"])), entry)
            except (OSError, zstandard.ZstdError):
                if not left:
                    raise
        raise AssertionError

    @staticmethod
    def checked(stored: bytes, entry) -> bytes:
        if len(stored) != entry["stored"] or zlib.crc32(stored) != entry["crc"]:
            raise OSError(f"damaged member at offset {entry['offset']}")
        return zstandard.ZstdDecompressor().decompress(stored, max_output_size=int(entry["media"]))

    def read(self, partition):
        archive, begin, end = partition.value
        if begin == end:
            return
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        with fs.open_input_file(archive + ".dir") as index:
            entries = np.frombuffer(index.read_at(end - begin, begin), ENTRY)
        rows, used = [], 0
        with fs.open_input_file(archive + ".arc") as data:
            for e in entries:
                try:
                    media = self.checked(data.read_at(int(e["stored"]), int(e["offset"])), e)
                except (OSError, zstandard.ZstdError):
                    media = self.member(fs, archive + ".arc", e)
                rows.append((None if e["null_id"] else int(e["doc_id"]), int(e["n_bytes"]), media))
                used += len(media)
                if used >= self.batch_bytes:
                    yield self.batch(rows)
                    rows, used = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows) -> pa.RecordBatch:
        ids, sizes, media = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(folder)``: members of all archives of a folder."""

    @classmethod
    def name(cls):
        return "media_archives"

    def schema(self):
        return MEMBER_SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options)


def media_features(members: DataFrame) -> DataFrame:
    """Lengths, checksums and a feature (sum, sum of squares, mid-line crossings of the samples) of each member.

    ``media_bytes`` and ``media_sha256`` are of the WAV member as read back, not of its compressed form in the archive. One row a
    member, with null ids and repeats as stored; other columns are left out; no member, no row.
    """

    def run(batches):
        for b in batches:
            out = []
            for media in b["media"]:
                x = samples_of(media)
                s = np.frombuffer(x, np.uint8).astype(np.int64)
                feature = f"{s.sum()}:{(s * s).sum()}:{int(np.count_nonzero(np.diff(s >= 96)))}"
                out.append((len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            new = pd.DataFrame(out, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            yield pd.concat([b[["doc_id", "n_bytes"]].astype({"doc_id": "Int64"}).reset_index(drop=True), new], axis=1)

    return members.mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as audio members, read back through the data source, with features."""
    path = shared_dir(spark, "media")
    write_archives(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    spark.dataSource.register(MediaArchives)
    return media_features(spark.read.format("media_archives").load(path))
