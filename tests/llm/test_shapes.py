"""Fill-in-middle, packing and hard negatives against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LONG = "Ein langer Text, der weiter geht \u10d0\u10d1. " * 9000
TEXTS = [None, "", "\n", "\n\n\n", "a", "no feed", "a\nb", "a\nb\n", "é\nü\n\n", "日本\n語\nテキスト", "x<S>y\nz", "<", "<P\n>", LONG, LONG.replace(". ", ".\n"), "same\ntwo", "same\ntwo", "\U0001f600\n" * 9, "\x80\n\ud7ff\n", "ends in <\n<"]


@pytest.fixture(scope="module")
def hostile(spark):
    rows = [(i, t, "p", 7, "psm", "o") for i, t in enumerate(TEXTS)]
    rows += [(15, "same\ntwo", None, None, None, None), (None, "no id\nat all", "x", 1, "y", "z"), (None, None, None, None, None, None), (15, "other\ntext\n", "x", 1, "y", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long, form string, output string")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def _middle(doc_id, text, unit="line", seed=7, percent=100, spm=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t) if unit == "line" else list(t)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, n, "plain", None, None, t
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["line", "char"])
@pytest.mark.parametrize("percent", [100, 40])
def test_middle(spark, hostile, documents, unit, percent):
    from corpusq.llm.middle import fill_in_middle, restored

    for seed in (7, 8, 9):
        for docs in (hostile, documents):
            made = fill_in_middle(docs, unit=unit, seed=seed, percent=percent, batch_bytes=5000).withColumn("back", restored(F.col("output"), F.col("form")))
            source = docs.select("doc_id", "text").collect()
            got = [tuple(r) for r in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()]
            assert sorted(got, key=str) == sorted((_middle(*r, unit, seed, percent) for r in source), key=str)
            assert sorted(r[0] for r in made.select("back").collect()) == sorted(r[1] or "" for r in source)


def test_middle_keeps_columns_and_rejects_sentinels(spark, hostile):
    from corpusq.llm.middle import fill_in_middle

    made = fill_in_middle(hostile.withColumnRenamed("n", "_h0"), keep=("source", "_h0"))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "source", "_h0"]
    assert sorted(map(str, (r[0] for r in made.select("source").collect()))) == sorted(map(str, (r[0] for r in hostile.select("source").collect())))
    assert fill_in_middle(hostile.limit(0)).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "cd")):
        with pytest.raises(ValueError):
            fill_in_middle(hostile, sentinels=bad)


def test_marks_select_every_byte():
    from corpusq.llm.middle import Marks, _continued, _equal

    rng = np.random.default_rng(1)
    data = rng.choice(np.array([9, 10, 11, 0x8A, 0x0A ^ 0x80, 0, 255, 138], np.uint8), 4096)
    words = data.view("<u8")
    marks = Marks(_equal(words, 10))
    at = np.flatnonzero(data == 10)
    assert (marks.place(np.arange(1, len(at) + 1)) == at).all()
    every = np.arange(4096)
    assert (marks.before(every) == np.r_[0, np.cumsum(data == 10)][:-1]).all()
    assert np.bitwise_count(_continued(words)).sum() == ((data & 0xC0) == 0x80).sum()


def _ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*e.ids, 2] for e in tool.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("capacity, classes, slack", [(4096, 64, 0.02), (100, 8, 0.0), (64, 64, 0.1), (7, 3, 0.02), (1, 1, 0.0)])
def test_packing(spark, hostile, documents, capacity, classes, slack):
    import public_tokenizers
    from corpusq.llm.packing import pack, sequences

    docs = hostile.select("doc_id", "text").unionByName(documents.select("doc_id", "text")).withColumn("length", F.lit(1)).repartition(3, "text")
    if capacity == 1:
        docs = docs.where("length(text) < 1000")
    source = docs.select("doc_id", "text").collect()
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity, classes=classes, slack=slack)
    rows = pieces.collect()
    want = sorted((str(i), tuple(x)) for (i, _), x in zip(source, _ids(t for _, t in source)))
    runs, packed = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
        runs[str(r.doc_id)].append((r.start, tuple(ids.tolist()), r.doc_tokens))
        packed[r.sequence_id].append((r.offset, r.length, r))
    for key, found in runs.items():
        own = [x for i, x in want if i == key]
        assert sum(map(len, own)) == sum(len(x) for _, x, _ in found)
        if len(own) == 1:
            whole = []
            for start, x, total in sorted(found):
                assert start == len(whole) and total == len(own[0])
                whole += x
            assert tuple(whole) == own[0]
    assert set(runs) == {i for i, _ in want}
    padding = 0
    for s in packed.values():
        at = 0
        for offset, n, _ in sorted(s, key=lambda x: x[0]):
            assert offset == at
            at += n
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    total = sum(len(x) for _, x in want)
    assert padding <= total * (0.02 if capacity > 1000 else 0.12)
    made = {r.sequence_id: r for r in sequences(pieces, capacity, pad_id=9).collect()}
    assert set(made) == set(packed)
    for k, s in packed.items():
        ids = [i for _, _, r in sorted(s, key=lambda x: x[0]) for i in np.frombuffer(r.ids, "<u4")]
        full = ids if len(ids) & (len(ids) - 1) == 0 else ids + [9] * (capacity - len(ids))
        assert np.frombuffer(made[k].ids, "<u4").tolist() == full and made[k].tokens == len(ids)
        assert [(x.doc_id, x.start, x.offset, x.length) for x in made[k].segments] == [(r.doc_id, r.start, r.offset, r.length) for _, _, r in sorted(s, key=lambda x: x[0])]


def test_packing_fills_classes(spark):
    """Full sequences of a class have its number of pieces; equal input gives equal rows; an empty table gives none."""
    import public_tokenizers
    from corpusq.llm.packing import pack, rest_pieces

    for n in range(1, 4096):
        pieces = rest_pieces(n, 4096, 64, 0.02)
        assert sum(m for m, _ in pieces) == n
        assert all(m <= 4096 // k and (m == 4096 // k or m >= 0.98 * (4096 // k)) if k else m <= 64 for m, k in pieces) and len(pieces) <= 6
    docs = spark.createDataFrame([(i, "word " * 1011) for i in range(9)], "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = pack(docs, path).collect()
    assert [r.length for r in rows if r.doc_id < 4] == [1012] * 4 and len({r.sequence_id for r in rows if r.doc_id < 4}) == 1
    assert sorted(rows, key=str) == sorted(pack(docs, path).collect(), key=str)
    assert pack(docs.limit(0), path).count() == 0


def _negatives(rows, anchors, positives=5, negatives=5, share=(80, 100)):
    rows = sorted({(r[0], r[1], tuple(r[2])) for r in rows if None not in r and None not in r[2]})
    picked = {}
    for r in sorted(anchors, key=str):
        if None not in r and None not in r[2]:
            picked[r[0]] = min(picked.get(r[0], (r[1], tuple(r[2]))), (r[1], tuple(r[2])))
    out = []
    for a, (label, v) in picked.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, m) for i, m, w in rows)
        for s, i, _ in [x for x in scored if x[2] == label and x[1] != a][:positives]:
            fits = [x for x in scored if x[2] != label and share[0] * -s <= share[1] * -x[0] <= share[1] * -s]
            out += [(a, i, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits[:negatives])]
    return out


def _rows(kind):
    rng = np.random.default_rng(5)
    if kind == "clusters":
        centres = rng.normal(0, 100, (12, 8))
        x = centres[rng.integers(0, 12, 900)] + rng.normal(0, 6, (900, 8))
    elif kind == "copies":
        x = np.repeat(rng.normal(0, 50, (30, 4)), 40, 0)[:1100]
        x[:500] = x[0]
    elif kind == "norms":
        x = rng.normal(0, 1, (800, 6)) * rng.lognormal(3, 2, (800, 1))
    elif kind == "ties":
        x = rng.integers(-2, 3, (700, 3))
    else:
        x = np.zeros((300, 5))
    x = np.floor(x).astype(int).tolist()
    return [(i, int(rng.integers(0, 4)) if i % 3 else 0, v) for i, v in enumerate(x)]


@pytest.mark.parametrize("kind", ["clusters", "copies", "norms", "ties", "zeros"])
def test_negatives(spark, kind):
    from corpusq.llm.negatives import mine_hard_negatives

    rows = _rows(kind)
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<long>").withColumn("score", F.lit(1)).repartition(3)
    got = mine_hard_negatives(df, df.where("vec_id % 20 = 0"), cells=6, sample=200)
    assert sorted(map(tuple, got.collect())) == sorted(_negatives(rows, [r for r in rows if r[0] % 20 == 0]))


def test_negatives_hostile(spark):
    from corpusq.llm.negatives import mine_hard_negatives, quantised

    rows = [(0, 1, [3, 4]), (0, 1, [3, 4]), (100, 1, [1]), (100, 0, [9, 9]), (1, 1, [3, 3]), (1, 1, [3, 3]), (2, 0, [3, 2]), (2, 0, [1, 1]), (3, None, [1, 1]), (4, 2, None), (5, 2, [1, None]), (None, 2, [3, 4]), (6, 2, []), (7, 2, [3, 3]), (8, 3, [3, 3]), (9, 1, [-5, -5])]
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<long>")
    got = mine_hard_negatives(df, df.where("vec_id % 100 = 0"), 3, 2)
    assert sorted(map(tuple, got.collect())) == sorted(_negatives(rows, [r for r in rows if r[0] is not None and r[0] % 100 == 0], 3, 2))
    none = df.limit(0)
    assert mine_hard_negatives(none, none).count() == 0 and mine_hard_negatives(df, none).count() == 0
    big = spark.createDataFrame([(0, 1, [1 << 40] * 4), (1, 1, [1 << 40] * 4)], "vec_id long, label long, v array<long>")
    with pytest.raises(Exception, match="too long for exact scores"):
        mine_hard_negatives(big, big).collect()
    floats = spark.createDataFrame([(0, 1, [0.5, -0.001]), (1, 1, [float("nan"), 1.0]), (2, 1, [float("inf"), 1.0]), (3, 1, None), (4, 1, [None, 1.0]), (5, 1, [])], "vec_id long, label int, embedding array<float>")
    assert [r.v for r in quantised(floats).orderBy("vec_id").collect()] == [[128, -1], None, None, None, None, []]


def test_tree_and_bounds_hold():
    """Every row is within its nodes' radii, every inner product within the bounds; clustered rows rule nodes out."""
    from corpusq.llm.negatives import augmented, bounds, cover_tree

    for kind in ("clusters", "copies", "norms"):
        x = np.array([v for _, _, v in _rows(kind)], float)
        norm = float(np.sqrt((x * x).sum(1)).max())
        whole = augmented(x, norm)
        levels = cover_tree(whole)
        assert sorted(np.concatenate([m for level in levels for *_, m in level if m is not None]).tolist()) == list(range(len(x)))
        out = 0
        for level in levels:
            for centre, radius, parent, rows in level:
                if rows is None:
                    continue
                assert (np.sqrt(((whole[rows] - whole[centre]) ** 2).sum(1)) <= radius + 1e-6).all()
                low, high = bounds(x[::50], whole[[centre]], np.array([radius]), norm)
                s = x[::50] @ x[rows].T
                assert (s >= low).all() and (s <= high).all()
                out += (high[:, 0] < (x[::50] @ x.T).max(1) * 0.5).sum()
        assert out > 0
