"""Quality classifier: how much better a good or a bad dictionary compresses a text."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 2048  # bytes compressed at a time, so that the dictionary keeps its weight in long texts


@dataclass
class QualityModel:
    """Two zstandard dictionaries and the calibration; ``good`` is None where there was nothing to learn."""

    good: bytes | None
    bad: bytes | None
    weights: tuple[float, ...]
    level: int = 3

    def scorer(self):
        if self.good is None:
            prior = self.weights[0]
            return lambda texts: np.full(len(texts), prior)
        tools = [zstandard.ZstdCompressor(level=self.level, dict_data=_load(d, self.level), write_content_size=False, write_dict_id=False) for d in (self.good, self.bad)]
        w = np.array(self.weights)
        return lambda texts: 1 / (1 + np.exp(-np.clip(np.array([features(t, *tools) for t in texts]).reshape(-1, len(w)) @ w, -30, 30)))


def _load(data: bytes, level: int) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=level)
    return d


def features(text: str | None, good, bad) -> tuple[float, float]:
    """Constant, and the normalised difference of the two compressed sizes over the whole text (0 for an empty one)."""
    raw = (text or "").encode("utf-8")
    g = b = 0
    for at in range(0, len(raw), PIECE):
        piece = raw[at : at + PIECE]
        g += len(good.compress(piece))
        b += len(bad.compress(piece))
    return 1.0, 10 * (b - g) / max(b + g, 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = 2000, longest: int = 20_000, dict_bytes: int = 48 << 10, seed: str = "q1") -> QualityModel:
    """Fit on a bounded sample of labelled rows.

    At most ``rows`` documents of each label, of up to ``longest`` characters, chosen by a seeded hash of the
    doc_id; two thirds train the dictionaries, the rest the calibration. The sample is all that reaches the driver.
    Labels other than 0 and 1 and null ids are ignored; with one label only, or none, the score is a constant.
    """
    order = F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string")))
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    ids = usable.where("quality = 0").orderBy(order).limit(rows).unionByName(usable.where("quality = 1").orderBy(order).limit(rows))
    ids = ids.select(F.col("doc_id").alias("_id"), "quality")
    text = docs.where(F.length("text").between(1, longest)).select("doc_id", "text")
    sample = text.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("quality", "text", order.alias("o")).orderBy("o", "text").limit(2 * rows).toPandas()
    sides = {q: [t.encode("utf-8") for t in sample.loc[sample["quality"] == q, "text"]] for q in (0, 1)}
    if min(map(len, sides.values())) < 3:
        total = sum(map(len, sides.values()))
        return QualityModel(None, None, (len(sides[1]) / total if total else 0.5,))
    dicts, rest = {}, {}
    for q, texts in sides.items():
        cut = -(-2 * len(texts) // 3)
        pieces = [t[i : i + PIECE] for t in texts[:cut] for i in range(0, len(t), PIECE)]
        try:
            dicts[q] = zstandard.train_dictionary(dict_bytes, pieces, level=3).as_bytes()
        except zstandard.ZstdError:  # too little to train on: the content itself serves
            dicts[q] = b"".join(pieces)[-dict_bytes:].ljust(16, b" ")
        rest[q] = [t.decode("utf-8") for t in texts[cut:]]
    model = QualityModel(dicts[1], dicts[0], (0.0, 0.0))
    tools = [zstandard.ZstdCompressor(level=model.level, dict_data=_load(d, model.level), write_content_size=False, write_dict_id=False) for d in (dicts[1], dicts[0])]
    x = np.array([features(t, *tools) for q in (0, 1) for t in rest[q]])
    y = np.array([float(q) for q in (0, 1) for _ in rest[q]])
    model.weights = tuple(_logistic(x, y).tolist())
    return model


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.7, keep: tuple[str, ...] = ("doc_id",), batch_bytes: int = 2 << 20) -> DataFrame:
    """Adds ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` to the ``keep`` columns of every row.

    Whole texts count; null and empty texts get the calibrated score of a zero difference. No shuffle. Repeated rows and
    null ids are kept, an empty table gives an empty one, and columns that are not in ``keep`` are ignored. A worker
    scores and hands on ``batch_bytes`` of text at a time.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def run(batches):
        score = sent.value.scorer()
        for b in batches:
            last = np.cumsum(pc.fill_null(pc.binary_length(b.column("_text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // batch_bytes
            cuts = [0, *(np.flatnonzero(np.diff(last)) + 1).tolist(), len(b)]
            for low, high in itertools.pairwise(cuts):  # only these texts leave Arrow
                some = b.slice(low, high - low)
                s = score(some.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for c in keep for f in docs.schema.fields if f.name == c)
    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(run, f"{kinds}, score double, predicted int")


def held_out(of: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(of).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; labels of held-out rows are never learned from."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels.where(~held_out()))
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
