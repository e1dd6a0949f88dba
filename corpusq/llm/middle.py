"""Fill-in-middle transformation: unit boundaries found eight bytes at a time in the texts' UTF-8."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HIGH, LOW7 = np.uint64(0x8080808080808080), np.uint64(0x7F7F7F7F7F7F7F7F)
ONE, EIGHT, TOP = np.uint64(1), np.uint64(8), np.uint64(56)
SENTINELS = ("<P>", "<S>", "<M>")


def _equal(words: np.ndarray, byte: int) -> np.ndarray:
    """The high bit of each byte of ``words`` that equals ``byte``; exact, as no carry leaves a byte."""
    x = words ^ np.uint64(byte * 0x0101010101010101)
    return ~(((x & LOW7) + LOW7) | x) & HIGH


def _continued(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that continues a character (10xxxxxx)."""
    return words & ~(words << ONE) & HIGH


class Marks:
    """Rank and select over the marked bytes of a buffer, a mark being the high bit of its byte."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.count = np.bitwise_count(words).astype(np.int64)
        self.upto = np.cumsum(self.count)

    def before(self, at: np.ndarray) -> np.ndarray:
        """Marks before each byte offset."""
        word, bits = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return self.upto[word] - self.count[word] + np.bitwise_count(self.words[word] & ((ONE << bits) - ONE))

    def place(self, rank: np.ndarray) -> np.ndarray:
        """Byte offset of the mark with each rank, counted from 1: its word by binary search, its byte by dropping lower marks."""
        word = np.searchsorted(self.upto, rank)
        left = rank - (self.upto[word] - self.count[word])
        x = self.words[word]
        for step in range(1, 8):
            x = np.where(left > step, x & (x - ONE), x)
        return (word << 3) + (np.bitwise_count((x & (~x + ONE)) - ONE) >> 3)


def cut_texts(data: np.ndarray, offsets: np.ndarray, draws: tuple[np.ndarray, np.ndarray], unit: str = "line"):
    """Byte offsets of prefix and middle ends of the texts ``data[offsets[i]:offsets[i+1]]``, from two draws a text.

    Returns (units, prefix end, middle end, characters of the prefix, characters of the middle).
    """
    low, high = offsets[:-1], offsets[1:]
    words = np.zeros((len(data) >> 3) + 2, "<u8")
    words.view(np.uint8)[: len(data)] = data
    goes_on = _continued(words)
    if unit == "line":
        ends = _equal(words, 10)
        last = high[high > low] - 1
        np.bitwise_or.at(ends, last >> 3, np.uint64(128) << ((last & 7) << 3).astype(np.uint64))
    else:
        ends = ~(goes_on >> EIGHT | np.r_[goes_on[1:], np.zeros(1, "<u8")] << TOP) & HIGH
    ends, goes_on = Marks(ends), Marks(goes_on)
    first = ends.before(low)
    n = ends.before(high) - first
    a, b = draws[0] % (n + 1), draws[1] % (n + 1)

    def end(k):
        return np.where(k > 0, ends.place(np.maximum(first + k, 1)) + 1, low)

    p, m = end(np.minimum(a, b)), end(np.maximum(a, b))
    more = [goes_on.before(x) for x in (low, p, m)]
    return n, p, m, p - low - (more[1] - more[0]), m - p - (more[2] - more[1])


def _slices(lengths: np.ndarray, most: int):
    """(first, last + 1) of runs of rows with about ``most`` bytes."""
    low = used = 0
    for i, n in enumerate(lengths.tolist()):
        used += n
        if used >= most:
            yield low, i + 1
            low, used = i + 1, 0
    if low < len(lengths):
        yield low, len(lengths)


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = 7, percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS, keep: tuple[str, ...] = (), batch_bytes: int = 8 << 20) -> DataFrame:
    """Rearrange each whole text of ``docs(doc_id, text)`` for infilling; no row leaves its partition.

    Units are lines with their line feed, or characters (``unit="char"``). Four draws, the first 32-bit groups of
    sha256 of ``seed:doc_id``, give the two cuts, whether the text is rearranged (``percent``) and the form: psm
    (prefix, suffix, middle) or spm (suffix, prefix, middle; ``spm_percent``). Texts that are empty or hold a sentinel
    stay plain. The sentinels must differ, and none may hold another's first character except in front, so that
    ``restored`` is unambiguous.

    Returns (doc_id, n, form, prefix_chars, middle_chars, output) and the columns of ``keep``; the counts are null where
    the form is plain. A null text is empty; a null id draws like an empty one; equal ids draw alike; repeated rows are
    kept; an empty table gives an empty one; columns not named are left out.
    """
    if unit not in ("line", "char"):
        raise ValueError(f"unknown unit {unit!r}")
    heads = {s[:1] for s in sentinels}
    if len(set(sentinels)) < 3 or "" in heads or any(h in s[1:] for s in sentinels for h in heads):
        raise ValueError("sentinels must differ and hold no first character of a sentinel further on")
    pre, suf, mid = (s.encode() for s in sentinels)

    def run(batches):
        for b in batches:
            texts = b.column("_text").cast(pa.large_binary())
            whole = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            buffer = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            held = [pc.match_substring(texts, s).to_numpy(zero_copy_only=False) for s in (pre, suf, mid)]
            h = [b.column(f"_h{i}").to_numpy() for i in range(4)]
            plain = held[0] | held[1] | held[2] | (np.diff(whole) == 0) | (h[2] % 100 >= percent)
            spm = h[3] % 100 < spm_percent
            for i, j in _slices(np.diff(whole), batch_bytes):
                base = whole[i]
                data, at = buffer[base : whole[j]], whole[i : j + 1] - base
                n, p, m, p_chars, m_chars = cut_texts(data, at, (h[0][i:j], h[1][i:j]), unit)
                raw, out = memoryview(data), []
                for a, x, y, z, flat, turned in zip(at[:-1].tolist(), p.tolist(), m.tolist(), at[1:].tolist(), plain[i:j].tolist(), spm[i:j].tolist()):
                    if flat:
                        out.append(bytes(raw[a:z]))
                    elif turned:
                        out.append(b"".join((suf, raw[y:z], pre, raw[a:x], mid, raw[x:y])))
                    else:
                        out.append(b"".join((pre, raw[a:x], suf, raw[y:z], mid, raw[x:y])))
                form = np.where(plain[i:j], "plain", np.where(spm[i:j], "spm", "psm"))
                made = [pa.array(n), pa.array(form.tolist(), pa.string()), *(pa.array(c, mask=plain[i:j]) for c in (p_chars, m_chars)), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(1 + len(keep))), *made], names)

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i}") for i in range(4)]
    rows = docs.select(F.col("doc_id"), *(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"), *draws)
    kinds = [rows.schema[i].dataType.simpleString() for i in range(1 + len(keep))]
    names = ["doc_id", *(f"_k{i}" for i in range(len(keep))), "n", "form", "prefix_chars", "middle_chars", "output"]
    schema = ", ".join(f"{c} {k}" for c, k in zip(names, [*kinds, "long", "string", "long", "long", "string"]))
    made = rows.mapInArrow(run, schema)
    return made.select("doc_id", *names[1 + len(keep) :], *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The original text, from a rearranged one and its form alone."""
    parts = F.split(output, "|".join(r"\Q" + s + r"\E" for s in sentinels), -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut by lines, rearranged, and the digests of what was made and of what is restored from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
k AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c"""
