"""Language identification: script ranges, per-word scores, and Viterbi spans with a switching penalty."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusq.llm.shared import put_in_place, shared_dir, written

#: Code point ranges of scripts (fixed values); letters outside them are script 0.
SCRIPTS = [
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"), (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1E00, 0x1EFF, "Latin"), (0x3040, 0x30FF, "Kana"), (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
]
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, and the number of its script."""
    if not _TABLES:
        names = list(dict.fromkeys(n for _, _, n in SCRIPTS))
        script = np.zeros(sys.maxunicode + 1, np.uint8)
        for low, high, name in SCRIPTS:
            script[low : high + 1] = names.index(name) + 1
        _TABLES["letter"] = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        _TABLES["script"] = script
    return _TABLES["letter"], _TABLES["script"]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the letters of all texts: trigram bucket and script; starts of words among them, and each word's text number.

    A word is a run of letters; a letter's trigram has its neighbours, with gaps at the word's ends.
    """
    letter, script = _tables()
    lowered = [t.lower() for t in texts]
    c = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[c]
    c = c * is_letter
    at = np.flatnonzero(is_letter)
    mixed = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)
    bucket = (mixed >> np.uint32(32 - BUCKET_BITS))[at - 1].astype(np.int64)
    starts = np.flatnonzero(~is_letter[at - 1])
    ends = np.cumsum([len(t) + 1 for t in lowered])  # of each text in c
    return bucket, script[c[at]], starts, np.searchsorted(ends, at[starts] - 1, side="right")


class LanguageModel:
    """log P(trigram | language) by bucket, and which languages are written in which script, in blocks of languages.

    A block is a pair of arrays, or the name of a file in the shared folder that holds them; files are loaded one at a time.
    A script of no language of any block (``unseen``) says nothing.
    """

    def __init__(self, langs: list[str], blocks: list, unseen: np.ndarray):
        self.langs, self.blocks, self.unseen = langs, blocks, unseen

    def parts(self):
        """(logp, allowed) of one block of languages after the other."""
        for b in self.blocks:
            logp, allowed = _loaded(b) if isinstance(b, str) else b
            yield logp, allowed | self.unseen[:, None]

    @property
    def logp(self) -> np.ndarray:
        return np.concatenate([x for x, _ in self.parts()], axis=1)

    @property
    def allowed(self) -> np.ndarray:
        return np.concatenate([x for _, x in self.parts()], axis=1)

    def word_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of scores for each word, and the words' text numbers."""
        bucket, script, starts, text = trigrams(texts)
        if not len(starts) or not self.langs:
            return np.zeros((len(starts), len(self.langs)), np.float32), text
        scores, allowed = [], []
        for logp, fits in self.parts():
            scores.append(np.add.reduceat(logp[bucket], starts, axis=0))
            allowed.append(fits[script[starts]])
        scores, allowed = (x[0] if len(x) == 1 else np.concatenate(x, axis=1) for x in (scores, allowed))
        return np.where(allowed, scores, scores.min(axis=1, keepdims=True) - 50), text


def _loaded(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """A block's arrays: BUCKETS rows of float32, then 256 of 0 or 1."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        table = np.frombuffer(f.read(), "<f4").reshape(BUCKETS + 256, -1)
    return table[:BUCKETS], table[BUCKETS:] > 0


def one_language(scores: np.ndarray, penalty: float) -> int | None:
    """The single best language if no path with a switch can beat it, else None.

    A path of k switches has a first and a last stretch and k - 1 between. Over the single best language they gain the
    best prefix, the best suffix and k - 1 times the best stretch at most, so that the penalties outweigh all gains
    where the best stretch, and the best prefix and suffix together, gain no more than one penalty.
    """
    total = scores.sum(axis=0, dtype=np.float64)
    main = int(total.argmax())
    gain = np.cumsum(scores - scores[:, main : main + 1], axis=0, dtype=np.float64)
    low = np.minimum.accumulate(gain, axis=0)
    stretch = max(float((gain[1:] - low[:-1]).max(initial=0.0)), float(gain.max()))
    if stretch > penalty:
        return None
    suffix = float((gain[-1] - np.minimum(low[-1], 0.0)).max())
    return main if max(0.0, float(gain.max())) + max(0.0, suffix) <= penalty else None


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word: the sum of scores less ``penalty`` for each switch is greatest.

    The steps are taken only where a bound does not show that one language throughout is best.
    """
    n = len(scores)
    main = one_language(scores, penalty)
    if main is not None:
        return np.full(n, main, np.int32)
    rows = scores.tolist()
    v, seen = rows[0], []
    for row in rows[1:]:
        floor = max(v) - penalty
        seen.append(v)
        v = [(x if x >= floor else floor) + s for x, s in zip(v, row)]
    path = np.empty(n, np.int32)
    at = v.index(max(v))
    for t in range(n - 1, 0, -1):
        path[t] = at
        v = seen[t - 1]
        best = max(v)
        if v[at] < best - penalty:
            at = v.index(best)
    path[0] = at
    return path


def fit_languages(docs: DataFrame, least_share: float = 0.02, model_bytes: int = 128 << 20, block_bytes: int = 16 << 20) -> LanguageModel:
    """Trigram counts of all given rows with a lang, added up by Spark and made to blocks of languages by its tasks.

    Every language is learned from all its rows, however many there are. A block has as many languages as make ``block_bytes``
    (128) and is a file in the shared folder. Up to ``model_bytes`` (1,024 languages) the driver reads the blocks, and they are
    broadcast; beyond that tasks load them in turn for each slice of texts, with the same results. Null and empty texts and
    null langs add nothing; an empty table gives a model without languages; other columns are ignored.
    """

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, g in b.groupby("lang"):
                table = seen.setdefault(lang, np.zeros(BUCKETS + 256, np.int64))
                texts = g["text"].tolist()
                while texts:
                    used = k = 0
                    while k < len(texts) and (k == 0 or used < 1 << 20):
                        used += len(texts[k])
                        k += 1
                    bucket, script, _, _ = trigrams(texts[:k])
                    table[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    table[BUCKETS:] += np.bincount(script, minlength=256)
                    texts = texts[k:]
        for lang, table in seen.items():
            at = np.flatnonzero(table)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": table[at]})

    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = written(rows.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-counts")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())  # the names of languages
    each = max(1, block_bytes // (4 * BUCKETS))
    path = shared_dir(docs.sparkSession, "language-model")

    def build(key, g: pd.DataFrame) -> pd.DataFrame:
        """One file of a block: columns of languages in order of their names."""
        g = g.sort_values("lang")
        full = np.zeros((BUCKETS + 256, len(g)))
        for i, (bucket, n) in enumerate(zip(g["bucket"], g["n"])):
            full[np.asarray(bucket, np.int64), i] = n
        grams, scripts = full[:BUCKETS], full[BUCKETS:]
        logp = np.log((grams + 0.1) / (grams.sum(axis=0) + 0.1 * BUCKETS))
        allowed = scripts >= least_share * np.maximum(scripts.sum(axis=0), 1)
        uri = f"{path}/block-{key[0]:06d}.f4"
        fs, final = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(final.rpartition("/")[0])
        temp = f"{final}.{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(temp) as f:
            f.write(np.concatenate([logp, allowed]).astype("<f4").tobytes())
        put_in_place(fs, temp, final)
        return pd.DataFrame({"block": [key[0]], "uri": [uri], "scripts": [allowed.any(axis=1).astype(np.uint8).tobytes()]})

    order = W.partitionBy(F.lit(0)).orderBy("lang")  # a row a language
    numbered = counts.select("lang").distinct().withColumn("block", F.floor((F.row_number().over(order) - 1) / each).cast("int"))
    rows = counts.join(numbered, "lang").groupBy("block", "lang").agg(F.collect_list(F.struct("bucket", "n")).alias("x"))  # at most a number a bucket
    rows = rows.select("block", "lang", F.col("x.bucket").alias("bucket"), F.col("x.n").alias("n"))
    made = written(rows.groupBy("block").applyInPandas(build, "block int, uri string, scripts binary"), "language-blocks").orderBy("block").collect()  # a row a block
    unseen = ~np.array([np.frombuffer(r["scripts"], np.uint8) for r in made], bool).reshape(-1, 256).any(axis=0)
    blocks = [r["uri"] for r in made]
    return LanguageModel(langs, [_loaded(b) for b in blocks] if len(langs) * BUCKETS * 4 <= model_bytes else blocks, unseen)


SPANS = "array<struct<lang:string,first_word:int,last_word:int>>"


def label_languages(docs: DataFrame, model: LanguageModel, penalty: float = 12.0, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Language spans of every whole text.

    Adds ``lang_pred`` (language of most words; ``und`` for a null text, one without a letter, or a model
    without languages), ``score`` (its share of the words, 0 for und) and ``spans`` (runs of words of one
    language). Ties go to the language first in order. Rows are kept one to one, also those that repeat one or have a null
    id; an empty table gives an empty one; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit_languages

    def label(texts: list[str]) -> list[tuple[str, float, list]]:
        m = sent.value
        scores, text = m.word_scores(texts)
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if a == b or not m.langs:
                out.append(("und", 0.0, []))
                continue
            path = viterbi(scores[a:b], penalty)
            count = np.bincount(path, minlength=len(m.langs))
            top = int(count.argmax())
            cut = np.flatnonzero(np.diff(path)) + 1
            first, last = np.r_[0, cut], np.r_[cut, len(path)] - 1
            out.append((m.langs[top], float(count[top] / len(path)), [{"lang": m.langs[path[f]], "first_word": f, "last_word": z} for f, z in zip(first.tolist(), last.tolist())]))
        return out

    def run(batches):
        size = max(1 << 16, (4 << 20) // max(1, len(sent.value.langs)))
        for b in batches:
            texts, found = [t or "" for t in b.column("_text").to_pylist()], []
            at = 0
            while at < len(texts):
                k, used = at, 0
                while k < len(texts) and (k == at or used < size):
                    used += len(texts[k])
                    k += 1
                found += label(texts[at:k])
                at = k
            lang, score, spans = zip(*found) if found else ((), (), ())
            kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32())]))
            new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *new], names=[*keep, "lang_pred", "score", "spans"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for c in keep for f in docs.schema.fields if f.name == c)
    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(run, f"{kinds}, lang_pred string, score double, spans {SPANS}")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_languages(docs.where(~held_out()).select("text", "lang"))
    return label_languages(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
