"""Stored indexes, versioned tables, automata, pointer doubling, sketches and exact streams against brute force."""

import json
import re
import tracemalloc
from collections import Counter
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusq.operators import catalog, chunk, extract, limits, many_searches, metrics, priority, retrieve, search_index, vector_index, vectors
from corpusq.operators.vector_index import VectorIndex
from corpusq.plans import jobs
from corpusq.sources.versioned import VersionedTable
from corpusq.streaming import stream

SF = "/root/testdata/sf0.01"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def gathered(spark, monkeypatch):
    """Numbers of rows that reach the driver."""
    seen, frame = [], type(spark.range(1))
    for name in ("collect", "toLocalIterator", "toPandas"):
        real = getattr(frame, name)

        def spy(self, *a, _real=real, **b):
            out = list(_real(self, *a, **b)) if _real.__name__ != "toPandas" else _real(self)
            seen.append(len(out))
            return out

        monkeypatch.setattr(frame, name, spy)
    return seen


def test_inverted_index(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(5001, None), (5002, ""), (None, "license license"), (5003, "Straße ΑΒΓ license" * 40), (1, "license again")], "doc_id long, text string")
    docs = docs.unionByName(odd)
    path = str(tmp_path / "index")
    search_index.build_index(docs, path, buckets=4)
    held = Counter(w for r in docs.collect() for w in set(re.split(r"[\W_]+", (r["text"] or "").lower())) if w)
    rare, common = sorted(held), [w for w, _ in held.most_common(150)]
    rng = np.random.default_rng(2)
    asked = [(i, [str(w) for w in rng.choice(common if i % 3 else rare, 1 + i % 4)]) for i in range(100)] + [(100, []), (101, ["nosuchwordatall"]), (102, ["license", None, "license"]), (103, ["αβγlicensestraße"])]
    q = spark.createDataFrame(asked, "search_id long, terms array<string>")
    got = {}
    found = search_index.search_index(spark, path, q, 10)
    for r in found.orderBy("search_id", "rank").collect():
        got.setdefault(r["search_id"], []).append((r["doc_id"], r["score"]))
    tf = {}
    for r in docs.where("doc_id is not null").collect():
        for w in re.split(r"[\W_]+", (r["text"] or "").lower()):
            if w:
                own = tf.setdefault(w, {})
                own[r["doc_id"]] = own.get(r["doc_id"], 0) + 1
    n = docs.count()
    for i, terms in asked:
        score = {}
        for t in {t for t in terms if t}:
            own = tf.get(t, {})
            for d, k in own.items():
                score[d] = score.get(d, 0) + k * np.log((n + 1) / (len(own) + 1))
        want = sorted(((d, round(s, 6)) for d, s in score.items()), key=lambda x: (-x[1], x[0]))[:10]
        assert [d for d, _ in got.get(i, [])] == [d for d, _ in want] and np.allclose([s for _, s in got.get(i, [])], [s for _, s in want], atol=2e-6)
    # blocks that can't reach the k-th score are left out, and no text is read
    left = search_index.asked_blocks(spark, path, q, 10).cache()
    needed = left.count()
    blocks = spark.read.parquet(f"{path}/blocks")
    every = q.select("search_id", F.explode("terms").alias("term")).distinct().join(blocks, "term").count()
    assert needed < 0.6 * every, (needed, every)
    postings = spark.read.parquet(f"{path}/postings").where("bucket is not null")
    read = left.select("search_id", "term", "segment", "level").join(postings, ["term", "segment", "level"]).count()
    assert read < 0.8 * q.select("search_id", F.explode("terms").alias("term")).distinct().join(postings, "term").count()
    scans = re.findall(r"ReadSchema: (\S+)", found._jdf.queryExecution().executedPlan().toString())
    assert scans and not any("text" in s for s in scans)
    assert search_index.search_index(spark, path, q.limit(0), 10).count() == 0
    empty = str(tmp_path / "empty")
    search_index.build_index(docs.limit(0), empty)
    assert search_index.search_index(spark, empty, q, 10).count() == 0


def test_index_keeps_blocks_as_arrays(spark, tmp_path, monkeypatch):
    """Postings are a row of arrays for what some texts have of a block, not a row a word of a text; repeated ids are one document; cuts between texts change nothing."""
    rows = [(d, " ".join(["One", "two two,", *["three"] * (d % 5), f"own{d}"])) for d in range(3000)] + [(7, "two -- \u00dcnder... one "), (7, "..."), (8, ""), (9, None), (None, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "index")
    search_index.build_index(docs, path, buckets=4, segments=8)
    want = Counter((w, d) for d, t in rows if d is not None for w in re.findall(r"\w+", (t or "").lower()))
    stored = spark.read.parquet(f"{path}/postings").collect()
    got = [((r["term"], d), tf) for r in stored for d, tf in zip(r["doc_id"], r["tf"], strict=True)]
    assert len(got) == len(want) and dict(got) == want
    own = [sum(k for (w, d), k in want.items() if d == i) for i in range(3000)]
    assert all(n == own[d] for r in stored for d, n in zip(r["doc_id"], r["length"], strict=True) if d != 7)
    assert all(r["n"] == len(r["tf"]) and r["max_tf"] == max(r["tf"]) and {tf.bit_length() - 1 for tf in r["tf"]} == {r["level"]} for r in stored)
    assert len({(d, r["segment"]) for r in stored for d in r["doc_id"]}) == 3000
    assert sum(r["term"] in ("one", "two", "three") for r in stored) < 300, "a row for each word of a text"
    blocks = {}
    for r in stored:
        n, tf = blocks.get(key := (r["term"], r["segment"], r["level"], r["bucket"]), (0, 0))
        blocks[key] = n + r["n"], max(tf, r["max_tf"])
    assert {tuple(r[c] for c in ("term", "segment", "level", "bucket")): (r["n"], r["max_tf"]) for r in spark.read.parquet(f"{path}/blocks").collect()} == blocks
    texts = pa.RecordBatch.from_pydict({"doc_id": pa.array([5, 6, 7, 8]), "segment": pa.array([0, 1, 1, 0], pa.int32()), "words": pa.array([" b a b ", "", " ", "b " * 9])})
    for most in (1, 20, 1 << 24):
        monkeypatch.setattr(search_index, "TEXTS", most)
        found = [r for b in search_index._pieces([texts]) for r in b.to_pylist()]
        assert sorted((r["term"], r["segment"], r["level"], *x) for r in found for x in zip(r["doc_id"], r["tf"], r["length"], strict=True)) == [("a", 0, 0, 5, 1, 3), ("b", 0, 1, 5, 2, 3), ("b", 0, 3, 8, 9, 9)]


def test_scan_search_equals_words(spark):
    rows = [(1, "Big bigger BIG, big-time big_x"), (2, None), (3, "nothing"), (4, "big"), (4, "a big one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["term"]): r["tf"] for r in catalog.term_table(docs, ["big", "one", "none"]).collect()} == {(1, "big"): 4, (4, "big"): 2, (4, "one"): 1}
    assert catalog.fulltext_search(docs, []).count() == 0


def _brute(x, q, k, metric, groups=None, own=None):
    out = {}
    for i, y in q.items():
        rows = []
        for j, v in x.items():
            if groups is not None and groups[j] != own[i]:
                continue
            if metric == "l2":
                d = round(float(((v - y) ** 2).sum()), 9)
            else:
                norm = np.linalg.norm(v) * np.linalg.norm(y)
                d = round(float(1 - v @ y / norm), 9) if norm > 0 else np.inf
            rows.append((d, j))
        out[i] = [(j, None if d == np.inf else d) for d, j in sorted(rows)[:k]]
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("grouped", [False, True])
def test_cells_find_exact_neighbours(spark, tmp_path, metric, grouped):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(30, 6)), 30, 0) + rng.normal(size=(900, 6)) * 0.05
    x[:40] = x[0]
    x[40:43] = 0
    x = x.round(4)
    rows = [(i, v, "g" if i % 3 else "h") for i, v in enumerate(x.tolist())] + [(2000, None, "g"), (None, [1.0] * 6, "g"), (2001, x[3].tolist(), None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, grp string")
    index = VectorIndex.build(df, str(tmp_path / "i"), metric, "grp" if grouped else None, cells=12)
    index = VectorIndex.load(spark, index.path)
    keep = {i: np.array(v) for i, v, _ in rows if i is not None and v is not None}
    q = {i: v for i, v in keep.items() if i % 7 == 0 or i in (40, 41)}
    asked = df.where("vec_id % 7 = 0 or vec_id in (40, 41)").withColumnRenamed("vec_id", "qid")
    groups = {i: g for i, _, g in rows}
    got = {}
    for r in index.nearest(asked, 8).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["vec_id"], r["distance"]))
    want = _brute(keep, q, 8, metric, groups if grouped else None, groups)
    for i in q:
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]] or np.allclose([d for _, d in got[i]], [d for _, d in want[i]], atol=2e-9), i


def test_cells_of_few_and_no_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "qid long, embedding array<double>")
    index = VectorIndex.build(df.withColumnRenamed("qid", "vec_id"), str(tmp_path / "a"))
    assert sorted((r["qid"], r["vec_id"], r["distance"]) for r in index.nearest(df, 5).collect()) == [(1, 1, 0.0), (1, 2, None), (2, 1, None), (2, 2, None)]
    none = VectorIndex.build(df.withColumnRenamed("qid", "vec_id").limit(0), str(tmp_path / "b"))
    assert none.nearest(df, 5).count() == 0 == none.approximate(df, 5).count() == index.nearest(df.limit(0), 5).count()


def test_many_queries_stay_a_table(spark, gathered, tmp_path):
    """Beyond the broadcast limit: all rows as queries, the same result, and neither side reaches the driver."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q = v.withColumnRenamed("vec_id", "qid")
    few = {(r["qid"], r["vec_id"], r["rank"]) for r in vectors.knn_join(v, q, 10).collect()}
    gathered.clear()
    out = VectorIndex.build(v, str(tmp_path / "i"), sample=500).nearest(q, 10)
    assert max(gathered) == 500  # the fitting sample
    assert {(r["qid"], r["vec_id"], r["rank"]) for r in out.collect()} == few
    assert {(r["qid"], r["vec_id"], r["rank"]) for r in vectors.knn_join(v, q, 10, broadcast_rows=100).collect()} == few


def test_queries_are_not_copied_by_cells(spark, tmp_path, monkeypatch):
    """Without clusters every cell is in reach of every query; what is stored on the way stays a row a query."""
    stored, real = [], vector_index.kept
    monkeypatch.setattr(vector_index, "kept", lambda df, name: stored.append(real(df, name)) or stored[-1])
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert VectorIndex.build(v, str(tmp_path / "i"), cells=8).nearest(v.withColumnRenamed("vec_id", "qid"), 10).count() == 10 * v.count()
    assert max(df.count() for df in stored if "e" in df.columns) == v.count()


def test_few_queries_need_little_memory():
    """10,000 rows in one batch against 1,024 queries: distances stand in tiles, and the result is that of a full sort."""
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(10_000, 8)).round(1), rng.normal(size=(1024, 8))
    b = pd.DataFrame({"vec_id": rng.permutation(10_000), "embedding": list(x)})
    tracemalloc.start()
    got = vectors.nearest_of([b], list(range(1024)), q, None, 5, "cosine", None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    d = np.round(1 - q @ x.T / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :], 9) + 0.0
    ids = b["vec_id"].to_numpy()
    assert [tuple(r) for r in got.sort_values(["qid", "distance", "vec_id"])[["qid", "vec_id"]].to_numpy().tolist()] == [(i, int(j)) for i, row in enumerate(d) for j in ids[np.lexsort((ids, row))[:5]]]


def test_chunks_are_handed_on_in_pieces():
    texts = ["One two. " * n for n in (0, 3000, 40_000, 1, 3000)]
    b = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, None, 5], "text": texts})
    cut = lambda d, t: ((d, i, *w) for i, w in enumerate(chunk.windows(t, 1024, 128)))
    got = list(chunk.pieces([b], cut, chunk.WINDOW, 4, chars=10_000))
    assert max(sum(map(len, g.column("content").to_pylist())) for g in got) < 11_024
    rows = [tuple(r.values()) for g in got for r in g.to_pylist()]
    assert rows == [(d, i, *w) for d, t in zip([1, 2, 3, None, 5], texts) for i, w in enumerate(chunk.windows(t, 1024, 128))]


def test_codes_find_near_neighbours(spark, tmp_path):
    """Recall of 0.9 with a tenth of the full vectors read, on vectors without clusters; the index is stored and loaded."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q = v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid")
    exact = {(r["qid"], r["vec_id"]) for r in vectors.knn_join(v, q, 10).collect()}
    path = VectorIndex.build(v, str(tmp_path / "i")).path
    index = VectorIndex.load(spark, path)
    found = {(r["qid"], r["vec_id"]) for r in index.approximate(q, 10, probes=len(index.centres), shortlist=200).collect()}
    assert len(exact & found) >= 0.9 * len(exact) and len(found) == len(exact)
    scan = [s for s in re.findall(r"ReadSchema: (\S+)", index.approximate(q, 10)._jdf.queryExecution().executedPlan().toString()) if "code" in s]
    assert scan and not any("e:array" in s for s in scan)  # codes alone are scanned for the short list


def test_five_thousand_searches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    words = sorted({w for t in texts.values() for w in t.split()})
    rng = np.random.default_rng(4)
    asked = [(f"n{i}", str(rng.choice(words))[: rng.integers(1, 9)] + (" " if i % 5 == 0 else "")) for i in range(5000)]
    asked += [("empty", ""), ("two", "no such thing at all"), ("two", asked[0][1]), ("null", None)]
    q = spark.createDataFrame(asked, "name string, q string")
    want = {}
    for name, s in asked:
        if s is not None:
            want.setdefault(name, set()).update(i for i, t in texts.items() if s in t)
    want = {k: v for k, v in want.items() if v}
    for block in (1 << 23, 20_000):
        got = {r["name"]: r["n"] for r in many_searches.search_hits(docs, q, block_chars=block).groupBy("name").agg(F.countDistinct("doc_id").alias("n")).collect()}
        assert got == {k: len(v) for k, v in want.items()}
    odd = spark.createDataFrame([(1, None, "T"), (2, "x", None), (None, "xy", "y")], "doc_id long, text string, title string")
    hits = many_searches.title_text_searches(odd, spark.createDataFrame([("a", "Y"), ("b", "t")], "name string, q string"), "title", "text", "doc_id").collect()
    assert sorted((r["name"], str(r["doc_id"]), r["in_title"], r["in_text"]) for r in hits) == [("a", "None", True, True), ("b", "1", True, False)]
    d = docs.withColumns({"title": F.concat(F.lit("t"), "doc_id"), "url": F.concat(F.lit("u"), "doc_id")})
    one = priority.key_search_summary(d, [("w", words[0])]).first()
    ids = sorted(i for i, t in texts.items() if words[0] in t)
    assert one["documents_found"] == len(ids) and [tuple(x) for x in one["documents"]] == [(f"t{i}", f"u{i}") for i in ids[:5]]


def _hits(rows, ttl=3600):
    out, stored = {}, {}
    for e, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        hit = k in stored and (t - stored[k]).total_seconds() < ttl
        if not hit:
            stored[k] = t
        out[e] = hit
    return out


def test_cache_by_doubling(spark):
    """One key with nearly all requests, and small ones, by pointers and by walking alike."""
    rng = np.random.default_rng(6)
    rows = [(i, "hot" if i % 10 else f"k{i % 30}", START + timedelta(seconds=int(rng.integers(0, 400_000)))) for i in range(3000)]
    rows += [(4000 + i, "same", START) for i in range(5)] + [(5000 + i, None, START + timedelta(seconds=3600 * i)) for i in range(4)]
    r = spark.createDataFrame(rows, "event_id long, key string, ts timestamp")
    want = _hits(rows)
    for most in (100_000, 500, 0):
        assert {x["event_id"]: x["hit"] for x in retrieve.response_cache_hits(r, most=most).collect()} == want
    hot = r.where("key = 'hot'").select("event_id", "key", F.unix_micros("ts").alias("at")).repartition(4)
    assert {x["event_id"] for x in retrieve.misses_by_doubling(hot, 3600, buckets=1).collect()} == {e for e, k, _ in rows if k == "hot" and not want[e]}
    assert retrieve.response_cache_hits(r.limit(0), most=0).count() == 0


def test_versions(spark, tmp_path):
    rows = [(f"u{i}", str(i)) for i in range(200)]
    t = VersionedTable(spark, str(tmp_path / "t"), buckets=8)
    assert t.versions() == [] and t.create(spark.createDataFrame(rows, "url string, hash string")) == 0
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    new = spark.createDataFrame([("u3", "changed"), ("u3", "z"), ("u4", "4"), ("n1", "1"), (None, "x")], "url string, hash string")
    assert t.upsert(new) == 1 and t.upsert(new.where("url = 'u4'")) == 1  # nothing new
    want = dict(rows) | {"u3": "changed", "n1": "1"}
    assert {r["url"]: r["hash"] for r in t.read().collect()} == want
    assert {r["url"]: r["hash"] for r in t.read(0).collect()} == dict(rows)
    assert all(p.stat().st_mtime_ns == m for p, m in files.items())
    first, second = t.manifest(0)["buckets"], t.manifest(1)["buckets"]
    assert 0 < sum(first.get(b) != f for b, f in second.items()) <= 2  # the buckets of u3 and n1 alone
    # a write that is killed before its commit leaves the old version readable
    t._write(t._bucket(spark.createDataFrame([("u1", "lost")], "url string, hash string")), None)
    again = VersionedTable(spark, t.path, buckets=8)
    assert again.versions() == [0, 1] and {r["url"]: r["hash"] for r in again.read().collect()} == want
    with pytest.raises(RuntimeError):
        t._commit(1, t.manifest(0))  # another writer was first
    assert not [p for p in (tmp_path / "t" / "versions").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    assert t.rollback(0) == 2 and {r["url"]: r["hash"] for r in t.read().collect()} == dict(rows)
    empty = VersionedTable(spark, str(tmp_path / "e"))
    empty.create(spark.createDataFrame([], "url string, hash string"))
    assert empty.read().count() == 0 and empty.upsert(new) == 1 and empty.read().count() == 3


def test_sketches_merge(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    minutes = metrics.metric_sketches(e, "1 minute", "event_type")
    merged = metrics.sketch_values(metrics.merged_sketches(minutes)).first()
    direct = metrics.sketch_values(metrics.merged_sketches(metrics.metric_sketches(e, "400 days"))).first()
    values = np.sort([r["value"] for r in e.select("value").collect()])
    for r in (merged, direct):
        for name, q in (("p50", 0.5), ("p95", 0.95)):
            assert abs(np.searchsorted(values, r[name]) / len(values) - q) < 0.02
        assert abs(r["users"] - e.select("user_id").distinct().count()) <= 0.05 * e.select("user_id").distinct().count() and r["n"] == len(values)
    assert metrics.sketch_values(metrics.merged_sketches(minutes.limit(0), "1 hour")).count() == 0


@pytest.mark.parametrize("ranges", [1, 7])
def test_active_requests_of_one_day(spark, ranges):
    rng = np.random.default_rng(7)
    rows = [(START + timedelta(seconds=int(rng.integers(0, 86_000))), float(rng.integers(0, 4000))) for _ in range(800)]
    e = spark.createDataFrame(rows, "ts timestamp, value double")
    steps = {}
    for t, v in rows:
        steps[t] = steps.get(t, 0) + 1
        end = t + timedelta(seconds=v)
        steps[end] = steps.get(end, 0) - 1
    now, want = 0, {}
    for t in sorted(steps):
        now += steps[t]
        hour = t.replace(minute=0, second=0, tzinfo=None)
        want[hour] = max(want.get(hour, -1), now)
    got = metrics.active_requests(e, ranges=ranges)
    assert {r["w"]: r["most"] for r in got.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("w"), "most").collect()} == {str(k): v for k, v in want.items()}


def test_a_host_with_many_rules(spark):
    rules = [("h", "*", f"/{i:05d}", i % 3 == 0, i) for i in range(100_000)] + [("h", "*", "/", False, 200_000), ("h", "*", "", True, 300_000), ("h", "*", "/00001", True, -1), ("g", "*", None, False, 0)]
    urls = [f"http://h/{i:05d}/x" for i in range(0, 100_000, 50)] + ["http://h/none", "http://h", "http://g/a", "nothing", None]
    p = spark.createDataFrame(rules, "host string, agent string, prefix string, allow boolean, seq int")
    got = {r["url"]: r["allowed"] for r in extract.url_policy_filter(spark.createDataFrame([(u,) for u in urls], "url string"), p).collect()}
    want = {f"http://h/{i:05d}/x": i % 3 == 0 for i in range(0, 100_000, 50)} | {"http://h/none": False, "http://h": True, "http://g/a": True, "nothing": True, None: True}
    assert got == want
    paths = spark.createDataFrame([("/a/b/c",), ("/a",), ("x",), (None,), ("",)], "path string")
    limit = spark.createDataFrame([("/a", "1/second"), ("/a/b", "2/second"), ("/a/b", "3/second"), ("/a/b/c/d", "4/second"), (None, "5/second")], "prefix string, rule string")
    assert {r["path"]: r["rule"] for r in limits.limit_rules_by_path(paths, limit).collect()} == {"/a/b/c": "2/second", "/a": "1/second", "x": "60/minute", None: "60/minute", "": "60/minute"}
    assert limits.limit_rules_by_path(paths, limit.limit(0)).where("rule = '60/minute'").count() == 5


def test_metadata_merge(spark):
    rows = [(0, '{"k": 1}'), (1, None), (2, "{bad"), (3, '{"source": "x", "n": null, "o": {"a": [1, 2]}}'), (4, "[1]"), (5, "5"), (6, '{"k": 1, "k": 2}'), (7, ""), (8, "{}")]
    df = spark.createDataFrame(rows, "id int, p string")
    got = {r["id"]: r["m"] for r in df.select("id", metrics.metadata_project(F.create_map(F.lit("source"), F.lit("own")), F.col("p")).alias("m")).collect()}
    own = {"source": "own"}
    assert got == {0: own | {"k": "1"}, 1: own, 2: own, 3: {"source": "x", "n": None, "o": '{"a":[1,2]}'}, 4: own, 5: own, 6: own | {"k": "2"}, 7: own, 8: own}
    assert df.where("id = 0").select(metrics.metadata_project(F.lit(None).cast("map<string,string>"), F.col("p"))).first()[0] == {"k": "1"}


def counting(folder):
    """An encoder whose calls can be counted over files, as tasks run in other processes; and what it was called with."""

    class Counting:
        size = 3

        def encode(self, texts):
            import uuid
            from pathlib import Path

            Path(folder, uuid.uuid4().hex).write_text("\n".join(json.dumps(t) for t in texts))
            return np.array([[len(t), t.count("e"), t.count(" ")] for t in texts], np.float32).reshape(len(texts), 3)

    return Counting(), lambda: sorted(json.loads(x) for f in folder.iterdir() for x in f.read_text().split("\n") if x)


def test_only_new_chunks_are_encoded(spark, tmp_path):
    folders = [tmp_path / str(i) for i in range(3)]
    for f in folders:
        f.mkdir()
    (first, calls), (second, more), (third, last) = map(counting, folders)
    code = lambda t: [float(len(t)), float(t.count("e")), float(t.count(" "))]
    old = spark.createDataFrame([(1, 0, "one here"), (1, 1, "two here"), (1, 2, "gone"), (2, 0, "one here"), (3, 0, "stays")], "doc_id long, chunk_index int, content string")
    none = spark.createDataFrame([], "doc_id long, hash string, embedding array<float>")
    stored = jobs.refresh_vectors(old, none, first)
    stored.write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    assert calls() == ["gone", "one here", "stays", "two here"]
    edited = spark.createDataFrame([(1, 0, "new start"), (1, 1, "one here"), (1, 2, "two here"), (2, 0, "two here"), (2, 1, "new start"), (2, 2, None)], "doc_id long, chunk_index int, content string")
    rows = jobs.refresh_vectors(edited, stored, second).collect()
    assert {r["vector_id"]: list(r["embedding"]) for r in rows} == {f"doc_{d}_chunk_{i}": code(t or "") for d, i, t in [tuple(x) for x in edited.collect()]}
    assert more() == ["", "new start", "two here"]  # "two here" is new to document 2
    chunks = spark.createDataFrame([(1, "a b", [9.0]), (2, "e", None), (3, "e", None), (4, None, None)], "vec_id long, text string, embedding array<float>")
    got = {r["vec_id"]: list(r["embedding"]) for r in jobs.reembed_missing(chunks, encoder=third).collect()}
    assert got == {1: [9.0], 2: code("e"), 3: code("e"), 4: code("")} and last() == ["", "e"]


def test_backlog_is_what_encoding_anew_gives(spark):
    sf = "/root/testdata/sf0.001"
    incoming, stored, vecs = jobs._stored_vectors(spark, sf)
    got = {r["vector_id"]: (r["content"], list(r["embedding"])) for r in jobs.processing_backlog(incoming, stored, vecs).collect()}
    encoder = vectors.HashedTerms()
    want = {}
    for r in incoming.collect():
        for i, (_, _, c) in enumerate(chunk.windows(r["text"] or "", 1024, 128)) if r["text"] else []:
            want[f"doc_{r['doc_id']}_chunk_{i}"] = c
    assert {k: c for k, (c, _) in got.items()} == want
    keys = sorted(got)
    assert np.allclose([got[k][1] for k in keys], encoder.encode([want[k] for k in keys]), atol=1e-6)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    e = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 4 <> 0").collect()}
    out = {r["vec_id"]: r["embedding"] for r in jobs.reembed_missing_documents(spark, sf).collect()}
    for r in d.collect():
        assert np.allclose(out[r["doc_id"]], e[r["doc_id"]] if r["doc_id"] in e else encoder.encode([r["text"] or ""])[0], atol=1e-6)
    assert len(out) == d.count()


def test_encoder_errors(spark):
    class Broken:
        size = 2

        def __init__(self, error):
            self.error = error

        def encode(self, texts):
            raise self.error

    df = spark.createDataFrame([(1, "a")], "id long, text string")
    for error in (KeyError("x"), RuntimeError("y"), MemoryError()):
        assert list(vectors.embed_texts(df, "id", encoder=Broken(error)).first()["embedding"]) == [0.0, 0.0]
    with pytest.raises(Exception, match="gone"):
        vectors.embed_texts(df, "id", encoder=Broken(ImportError("gone"))).collect()


def test_streams_do_not_depend_on_arrow_batches(spark, tmp_path):
    """One user, 25,000 requests in one micro-batch in falling order of time, in batches of 700 rows."""
    rows = spark.range(25_000).select(F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + (25_000 - F.col("id")) * 1_300_000).alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("k").alias("key"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)
    try:
        read = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        limited = stream._streamed(spark, stream.stream_rate_limit(read(), 10, 60), "limited")
        got = {(r["event_id"], r["n"], r["allowed"]) for r in limited.collect()}
        want = {(r["event_id"], r["n"], r["allowed"]) for r in limits.rate_limit_fixed_window(rows, "user_id", 10, 60).collect()}
        assert got == want and len(got) == 25_000
        cached = {(r["event_id"], r["hit"]) for r in stream._streamed(spark, stream.stream_response_cache(read(), 100), "cached").collect()}
        assert cached == {(r["event_id"], r["hit"]) for r in retrieve.response_cache_hits(rows, 100).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    fifteen = spark.createDataFrame([(i, START + timedelta(seconds=i), 7) for i in range(15)], "event_id long, ts timestamp, user_id long")
    fifteen.write.parquet(str(tmp_path / "15"))
    out = stream._streamed(spark, stream.stream_rate_limit(spark.readStream.schema(fifteen.schema).parquet(str(tmp_path / "15")), 10, 60), "fifteen")
    assert out.where("allowed").count() == 10 and out.where("not allowed").count() == 5


@pytest.mark.parametrize("make, out", [(lambda s: stream.stream_rate_limit(s, 2, 3600), "user_id"), (stream.stream_response_cache, "key")])
def test_state_goes_by_shares(spark, tmp_path, make, out):
    """The entries of the state store, timers among them, don't grow with the users or keys; null ones are kept apart from 0 and empty ones."""
    n = F.when(F.col("id") % 2000 != 7, F.col("id") % 2000)
    rows = spark.range(4000).select(F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id")).alias("ts"), n.alias("user_id"), F.nullif(n.cast("string"), F.lit("0")).alias("key"))
    rows.withColumn("key", F.when(F.col("user_id") == 0, "").otherwise(F.col("key"))).coalesce(1).write.parquet(str(tmp_path / "in"))
    with stream.state_store(spark):
        s = make(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 4 * 256
    got = spark.read.schema(s.schema).parquet(str(tmp_path / "out"))
    assert got.count() == 4000 and got.groupBy(out).count().where("count = 2").count() == 2000 and got.where(f"{out} is null").count() == 2
    if out == "key":
        assert got.where("not hit").count() == 2000
    else:
        assert {r[0] for r in got.select("n").distinct().collect()} == {1, 2}


def test_streams_read_files_by_rows(spark, monkeypatch):
    monkeypatch.setitem(stream.FILE_ROWS, "events", 300)
    assert len(spark.read.parquet(stream._folder(spark, "/root/testdata/sf0.001", "events", 1)).inputFiles()) == 4


def test_ingest_stream_commits_both_tables(spark, tmp_path):
    """A batch whose commit is lost, and one that was killed between its tables, give every row once after the replay."""
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.where("page_id < 25").coalesce(1).write.parquet(source)
    stream.stream_ingest(spark, source, target, check)
    shown = lambda: [sorted(map(str, stream.ingested(spark, target, n).drop("batch").collect())) for n in ("documents", "chunks")]
    once = shown()

    def lose():
        """As if the driver had been lost before it committed the batch."""
        for f in (tmp_path / "check" / "commits").iterdir():
            f.unlink()

    lose()
    stream.stream_ingest(spark, source, target, check)
    assert shown() == once and once[0] and once[1]
    import shutil

    shutil.copytree(tmp_path / "out" / "commits", tmp_path / "saved")
    shutil.rmtree(tmp_path / "out" / "commits" / "batch=0")  # killed before the third write
    (tmp_path / "out" / "commits" / "batch=99").mkdir()
    shutil.copy(next((tmp_path / "saved" / "batch=0").glob("*.parquet")), tmp_path / "out" / "commits" / "batch=99")
    assert shown() == [[], []]
    shutil.rmtree(tmp_path / "out" / "commits" / "batch=99")
    lose()
    stream.stream_ingest(spark, source, target, check)
    assert shown() == once
    # urls seen before come again with new pages, and are known from state
    more = pages.where("page_id >= 25").unionByName(pages.where("page_id < 25").withColumn("page_id", F.col("page_id") + 1000))
    more.coalesce(1).write.mode("append").parquet(source)
    stream.stream_ingest(spark, source, target, check)
    want = jobs.ingest_pages(pages)
    assert {(r["doc_id"], r["url"], r["hash"]) for r in stream.ingested(spark, target, "documents").collect()} == {(r["doc_id"], r["url"], r["hash"]) for r in want.collect()}
    docs = stream.ingested(spark, target, "documents").drop("batch")
    assert sorted((r["doc_id"], r["chunk_index"], r["content"]) for r in stream.ingested(spark, target, "chunks").collect()) == sorted((r["doc_id"], r["chunk_index"], r["content"]) for r in chunk.chunk_char_window(docs).collect())


def _pack(text, size, overlap):
    """Paragraphs packed as the survey states it: per-piece token floors, characters of overlap, sentences of long paragraphs."""
    tokens = lambda s: len(s) // 4
    out, now, total = [], "", 0
    for p in [p.strip() for p in re.split(r"\n\s*\n", text or "") if p.strip()]:
        if tokens(p) > size:
            if now:
                out.append(now)
                now, total = "", 0
            for s in [s.strip() for s in re.split(r"(?<=[.!?])\s+", p) if s.strip()]:
                if total + tokens(s) > size and now:
                    out.append(now)
                    now = now[-overlap:] + " " + s
                    total = tokens(now)
                else:
                    now = f"{now} {s}" if now else s
                    total += tokens(s)
        elif total + tokens(p) > size and now:
            out.append(now)
            now = now[-overlap:] + " " + p
            total = tokens(now)
        else:
            now = f"{now}\n\n{p}" if now else p
            total += tokens(p)
    if now.strip():
        out.append(now)
    return [(c.strip(), tokens(c)) for c in out]


def test_packing_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(400):
        text = "".join(rng.choice(list("ab  .!?\n") + ["\n\n", "\n \n", "word ", "საქ "], rng.integers(0, 120)))
        size, overlap = int(rng.integers(1, 20)), int(rng.integers(1, 12))
        assert chunk.pack(text, size, overlap) == _pack(text, size, overlap), (text, size, overlap)
    for text in [r for r in ["", None, " \n ", "One. " * 200, "x" * 400]]:
        assert chunk.pack(text, 8, 5) == _pack(text, 8, 5)


def test_page_text_brute_force(spark):
    """Main text and title of the given pages by a stack of open elements alone."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}

        def __init__(self):
            super().__init__()
            self.open, self.found = [], []

        def handle_starttag(self, tag, attrs):
            if tag not in self.void:
                self.open.append(tag)

        def handle_endtag(self, tag):
            if tag in self.open:
                while self.open.pop() != tag:
                    pass

        def handle_data(self, data):
            self.found.append((tuple(self.open), data))

    dropped = {"script", "style", "nav", "header", "footer", "aside"}
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = {r["page_id"]: r for r in extract.page_main_text_pages(spark, "/root/testdata/sf0.001").collect()}
    for i, html in pages.items():
        w = Words()
        w.feed(html or "")
        kept = [(o, d) for o, d in w.found if not dropped & set(o)]
        words = [x for o, d in kept if "article" in o for x in d.split()]
        if words:
            assert got[i]["text"].split() == words, i
        heads = [d.strip() for o, d in kept if "h1" in o and d.strip()]
        assert not heads or heads[0] in got[i]["title"]


def test_first_of_urls_takes_a_share_of_urls_at_a_time():
    """One call settles all urls of a share: one reading and one appending of state, the first of each new url by doc_id, over any batches."""
    import pandas as pd

    from corpusq.streaming.stream import FirstOfUrl

    class State:
        urls, calls = [("old",)], 0

        def exists(self):
            return True

        def get(self):
            self.calls += 1
            return iter(self.urls)

        def appendList(self, rows):
            self.calls += 1
            self.urls = [*self.urls, *rows]

    class Handle:
        state = State()

        def getListState(self, name, schema):
            return self.state

    of = FirstOfUrl()
    of.init(Handle())
    frame = lambda *rows: pd.DataFrame(rows, columns=["doc_id", "url"]).assign(title="t", language="l", hash="h", text="x")
    out = pd.concat(of.handleInputRows((1,), iter([frame((9, "a"), (3, "old"), (5, "b")), frame((4, "a"), (7, "b")), frame((1, "old"))]), None))
    assert sorted(zip(out["doc_id"], out["url"])) == [(4, "a"), (5, "b")] and Handle.state.calls == 2
    assert sorted(Handle.state.urls) == [("a",), ("b",), ("old",)]
    assert list(of.handleInputRows((1,), iter([frame((0, "a"))]), None)) == []
