"""What the pipeline's stages keep, cut and write, recomputed row by row."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_stage_keeps_what_scores(spark, documents):
    """Documents of a score of 0.7 or more, by the two dictionaries alone, stay as they are; the others go."""
    import zstandard

    import corpus_pipeline
    from corpusq.llm.quality import fit_quality, held_out

    model = fit_quality(documents, spark.read.parquet(f"{SF}/labels.parquet").where(~held_out()))
    sides = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    want = []
    for r in documents.collect():
        raw = (r["text"] or "").encode()
        good, bad = (sum(len(z.compress(raw[i : i + 2048])) for i in range(0, len(raw), 2048)) for z in sides)
        z = model.weights[0] + model.weights[1] * 10 * (bad - good) / max(bad + good, 1)
        if 1 / (1 + np.exp(-z)) >= 0.7:
            want.append(tuple(r))
    got = [tuple(r) for r in corpus_pipeline.quality_stage(spark, documents, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and 0 < len(got) < documents.count()


def test_mixing_stage_copies_and_cuts(spark, documents):
    """Each document as often as its taken words hold it whole, and once more its first words."""
    import corpus_pipeline
    from corpusq.llm.mixing import mix

    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mix(documents).collect()}
    want = Counter()
    for r in documents.collect():
        words, (n, size) = WORD.findall(r["text"] or ""), taken[r["doc_id"]]
        assert size == len(words) and n <= 3 * size
        if size and n // size:
            want[(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])] += n // size
        if size and n % size:
            cut = " ".join(words[: n % size])
            want[(r["doc_id"], cut, r["lang"], r["source"], len(cut))] += 1
    got = Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in corpus_pipeline.mixing_stage(spark, documents, SF).collect())
    assert got == want and max(want.values()) > 1


def test_token_stage_encodes_every_row(spark, documents):
    """Ids of every row of the mix by the tokenizer itself, one after the other in order of doc_id."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mixed = corpus_pipeline.mixing_stage(spark, documents, SF)
    rows = mixed.select("doc_id", "text").collect()
    ids = [np.array([*e.ids, 1], "<u4") for e in tool.encode_batch([r["text"] for r in rows], add_special_tokens=False)]
    want = Counter((r["doc_id"], len(x), zlib.crc32(x.tobytes())) for r, x in zip(rows, ids))
    got = sorted(corpus_pipeline.token_stage(spark, mixed, SF).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for before, r in zip([None, *got], got):
        assert r["start"] == at and (before is None or before["doc_id"] <= r["doc_id"])
        at += r["n_tokens"]
