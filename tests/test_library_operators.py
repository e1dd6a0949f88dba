"""Operators on small literal rows: the cases that are easy to get subtly wrong."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusq.functions import text as T
from corpusq.functions.vector import cosine_distance, squared_l2
from corpusq.operators import chunk, convo, extract, frontier, identity, limits, priority, retrieve, vectors
from corpusq.sources.tables import work_dir
from corpusq.streaming import stream


def one(spark, rows, schema, column, key="id"):
    return {r[key]: r["out"] for r in spark.createDataFrame(rows, schema).select(key, column.alias("out")).collect()}


def test_language(spark):
    rows = list(enumerate(["საქართველო", "закон", "закон და", "plain", "123", "", None]))
    assert one(spark, rows, "id int, t string", T.detect_language(F.col("t"))) == {0: "ka", 1: "ru", 2: "ka", 3: "en", 4: "en", 5: "en", 6: "en"}
    assert one(spark, rows, "id int, t string", T.detect_language_binary(F.col("t")))[1] == "en"


def test_dates(spark):
    rows = list(enumerate(["on 12.03.2024", "2024-01-15", "2024-1-5", "1/2/24", "none", "3.4.2020 then 5.6.2021", None]))
    assert one(spark, rows, "id int, t string", T.extract_date(F.col("t"))) == {0: "12.03.2024", 1: "24-01-15", 2: "2024-1-5", 3: "1/2/24", 4: None, 5: "3.4.2020", 6: None}


def test_categories(spark):
    rows = [(0, "x/tax/y", ""), (1, "x/vat/", ""), (2, "x/corporate/", ""), (3, "x", "საგადასახადო"), (4, "x", "НДС"), (5, "x", "Корпоративный"), (6, "x/vat/", "налог"), (7, "x", "none")]
    want = {0: "tax", 1: "vat", 2: "corporate", 3: "tax", 4: "vat", 5: "corporate", 6: "tax", 7: None}
    assert one(spark, rows, "id int, u string, t string", T.categorize(F.col("u"), F.col("t"))) == want


def test_markdown_titles(spark):
    s, stop = T.TITLE_SUFFIX, T.STOP_TITLE
    rows = list(enumerate([f"Law 5{s} more", f"{s}x\nplain line here", f"# {stop}\nA plain first line", f"# {stop}", "[link] first line\n!image line here\n# Head", "ten chars!\neleven char", "y" * 250, " \n ", "## \n## Second", None]))
    ingest = one(spark, rows, "id int, t string", T.markdown_title_ingest(F.col("t")))
    backfill = one(spark, rows, "id int, t string", T.markdown_title_backfill(F.col("t")))
    assert [ingest[i] for i in range(9)] == ["Law 5", "- example portalx", "A plain first line", stop, "Head", "eleven char", "y" * 200, "Untitled", "Second"]
    assert [backfill[i] for i in range(9)] == ["Law 5", "- example portalx", "A plain first line", "Untitled", "Head", "eleven char", "y" * 200, "Untitled", "Second"]
    assert ingest[9] == backfill[9] == "Untitled"


def test_links(spark):
    page = "https://h.org:8080/a/b/page.html?x=1"
    links = {"https://o.org/z": "https://o.org/z", "/root": "https://h.org:8080/root", "../x": "https://h.org:8080/a/x", "rel": "https://h.org:8080/a/b/rel", "?q": "https://h.org:8080/a/b/page.html?q", "#f": page + "#f", "mailto:a@b": "mailto:a@b", "//c.org/d": "https://c.org/d"}
    html = "".join(f'<a class=c href="{x}">t</a>' for x in links) + '<a href="rel">again</a>'
    got = extract.extract_links(spark.createDataFrame([(1, page, html), (2, page, None)], "page_id long, url string, html string")).collect()
    assert sorted(r["link"] for r in got) == sorted(links.values())
    own = extract.same_domain(spark.createDataFrame([(1, "http://h:1/a", "http://h:1/b"), (1, "http://h:1/a", "http://h/b")], "page_id long, url string, link string"))
    assert [r["link"] for r in own.collect()] == ["http://h:1/b"]


def test_page_text():
    html = "<html><head><title>T &amp; U</title><style>x</style></head><body><header><h1>gone</h1></header><nav>n</nav><article>\n<p>One<b>two</p><!-- c --> three </article><footer>f</footer></body>"
    assert extract.main_text(html) == ("T & U", "One\ntwo\nthree")
    assert extract.main_text("<body><div class='x content'>a<script>b</script></div>c</body>") == ("Untitled", "a")
    assert extract.main_text("<body>only</body>") == ("Untitled", "only") and extract.main_text(None) == ("Untitled", "")
    title, content, kind, meta = extract.structured('<div class="document-title">D</div><main>m</main><i class="type">law</i><b data-meta-key="no">7</b>')
    assert (title, content, kind, meta) == ("D", "m", "law", {"no": "7"})


def test_policy(spark):
    policy = [("h", "*", "/a/b", True, 1), ("h", "*", "/a", False, 2), ("h", "bot", "/c", False, 3), ("g", "*", "/", False, 1), ("g", "*", "/x", True, 2)]
    p = spark.createDataFrame(policy, "host string, agent string, prefix string, allow boolean, seq int")
    urls = {"http://h/a/b/1": True, "http://h/a/1": False, "http://h/c": True, "http://g/x": False, "http://none/a": True}
    got = extract.url_policy_filter(spark.createDataFrame([(u,) for u in urls], "url string"), p).collect()
    assert {r["url"]: r["allowed"] for r in got} == urls


def windows_brute(text, size, overlap):
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            stops = [i for i in range(end, start + overlap, -1) if text[i] in ".!?\n"]
            end = stops[0] + 1 if stops else end
        if text[start:end].strip():
            out.append(text[start:end].strip())
        start = end - overlap
    return out


def test_windows():
    rng = np.random.default_rng(4)
    for _ in range(300):
        text = "".join(rng.choice(list("ab .!?\n😀"), rng.integers(0, 90)))
        size = int(rng.integers(5, 30))
        overlap = int(rng.integers(1, size - 1))
        got = chunk.windows(text, size, overlap)
        assert [c for _, _, c in got] == windows_brute(text, size, overlap)
        assert all(e - b <= size + 1 for b, e, _ in got[:-1])
    with pytest.raises(ValueError):
        chunk.chunk_char_window(None, 10, 10)


def test_packing():
    text = "aaaa. bbbb\n \ncccc dddd\n\n\n" + "Sentence one is here. " * 4 + "\n\nshort"
    got = chunk.pack(text, 8, 5)
    assert got[0] == ("aaaa. bbbb\n\ncccc dddd", 5) and got[-1][0].endswith("short")
    assert chunk.pack(" \n ", 8, 5) == chunk.pack(None, 8, 5) == []
    assert chunk.pack("x" * 100, 8, 5) == [("x" * 100, 25)]  # one sentence over the limit stays whole


def test_vector_ids(spark):
    rows = [(0, "doc_1_chunk_7"), (1, "doc_a_chunk_b"), (2, "9"), (3, None), (4, "doc_1_")]
    assert one(spark, rows, "id int, v string", chunk.parse_vector_id(F.col("v"))) == {0: 7, 1: None, 2: 9, 3: None, 4: None}


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.0, 0.0], "a"), (4, None, "a"), (5, [-1.0, 0.0], "b"), (6, [0.5, 0.5], None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, lang string")
    got = [(r["vec_id"], r["distance"]) for r in vectors.knn(v, [1.0, 0.0], 10).collect()]
    assert [i for i, _ in got] == [1, 2, 6, 5, 3] and got[-1][1] is None
    q = v.where("vec_id in (1, 5)").select(F.col("vec_id").alias("qid"), "embedding", "lang")
    near = vectors.knn_join(v, q, 3).where("qid = 1").orderBy("rank").collect()
    assert [r["vec_id"] for r in near] == [1, 2, 6]
    own = vectors.knn_join(v, q, 9, group="lang").orderBy("qid", "rank").collect()
    assert [(r["qid"], r["vec_id"]) for r in own] == [(1, 1), (1, 2), (1, 3), (5, 5)] and own[2]["distance"] is None
    l2 = v.select("vec_id", squared_l2(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0))).alias("d"), cosine_distance(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0))).alias("c")).collect()
    assert {r["vec_id"]: r["d"] for r in l2} == {1: 0.0, 2: 0.0, 3: 1.0, 4: None, 5: 4.0, 6: 0.5}
    assert vectors.knn_join(v, q.limit(0), 3).count() == 0


def test_knn_approx_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    exact = {(r["qid"], r["vec_id"]) for r in vectors.knn_join(v, q, 10).collect()}
    found = {(r["qid"], r["vec_id"]) for r in vectors.knn_approx(v, q, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    assert {(r["qid"], r["vec_id"]) for r in vectors.knn_approx(v, q, 10, cells=20, probes=20, shortlist=2000).collect()} == exact  # every cell
    rng = np.random.default_rng(8)  # clustered vectors: a tenth of the cells is enough
    x = np.repeat(rng.normal(size=(40, 16)), 50, axis=0) + rng.normal(size=(2000, 16)) * 0.1
    near = spark.createDataFrame([(i, e) for i, e in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    some = near.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    exact = {(r["qid"], r["vec_id"]) for r in vectors.knn_join(near, some, 10).collect()}
    found = {(r["qid"], r["vec_id"]) for r in vectors.knn_approx(near, some, 10, cells=40, probes=4).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["distance"]) for r in vectors.knn_approx(odd, odd.withColumnRenamed("vec_id", "qid").limit(1), 10).orderBy("rank").collect()] == [(1, 0.0)]
    assert vectors.knn_approx(v.limit(0), q, 10).count() == 0 == vectors.knn_approx(v, q.limit(0), 10).count()


def test_failed_encoder_gives_zeros(spark):
    class Broken:
        size = 3

        def encode(self, texts):
            raise ValueError

    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    assert [list(r["embedding"]) for r in vectors.embed_texts(df, "id", encoder=Broken()).collect()] == [[0.0] * 3] * 2


def test_embedded_texts_brute_force(spark):
    """Hashed terms of whole texts counted word by word, for documents and for the benchmark's questions."""
    import zlib

    sf = "/root/testdata/sf0.001"
    for got, name, key, own in ((vectors.embed_texts_documents(spark, sf), "documents", "doc_id", "doc_id"), (vectors.embed_queries_benchmark(spark, sf), "benchmark", "item_id", "query_id")):
        texts = {str(r[key]): r["text"] for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()}
        rows = {str(r[own]): r["embedding"] for r in got.collect()}
        assert rows.keys() == texts.keys()
        for i, t in texts.items():
            count = [0] * 64
            for w in (t or "").lower().split():
                count[zlib.crc32(w.encode()) % 64] += 1
            length = sum(x * x for x in count) ** 0.5 or 1
            assert np.allclose(rows[i], [x / length for x in count], atol=1e-6)


def test_answers(spark):
    q = spark.createDataFrame([(1,), (2,)], "qid long")
    rows = [(1, i, "d1" if i % 2 else None, None if i == 1 else f"t{i}", None, f"c{i}", 0.1) for i in range(1, 8)]
    got = spark.createDataFrame(rows, "qid long, rank int, document_id string, title string, document_type string, content string, similarity double")
    context = {r["qid"]: r["context"] for r in retrieve.assemble_context(got, q).collect()}
    assert context[2] == retrieve.NO_CONTEXT and context[1].count("[Document ") == 5 and context[1].startswith("[Document 1: Unknown document ()]\nc1\n")
    assert "\n---\n" in context[1]
    assert [r["source_rank"] for r in retrieve.prepare_sources(got).collect()] == [1]
    assert {r["qid"]: r["retrieved"] for r in retrieve.retrieved_count(got, q).collect()} == {1: 7, 2: 0}


def test_cache(spark):
    at = lambda s: f"2024-01-01 00:00:00.000000" if s == 0 else f"2024-01-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    rows = [(1, "k", at(0)), (2, "k", at(3599)), (3, "k", at(3600)), (4, "k", at(7198)), (5, "k", at(7200)), (6, "j", at(10))]
    r = spark.createDataFrame(rows, "event_id long, key string, t string").select("event_id", "key", F.col("t").cast("timestamp").alias("ts"))
    want = {1: False, 2: True, 3: False, 4: True, 5: False, 6: False}
    assert {x["event_id"]: x["hit"] for x in retrieve.response_cache_hits(r).collect()} == want
    keys = spark.createDataFrame([("query:1",), ("query_1",), ("other",)], "key string")
    assert sorted(x["key"] for x in retrieve.cache_invalidate(keys, "query:*").collect()) == ["other", "query_1"]


def test_limits(spark):
    specs = list(enumerate(["10/minute", "1/second", "5/hour", "7/day"]))
    assert {k: tuple(v) for k, v in one(spark, specs, "id int, s string", limits.parse_rate_limit(F.col("s"))).items()} == {0: (10, 60), 1: (1, 1), 2: (5, 3600), 3: (7, 86400)}
    with pytest.raises(Exception, match="unknown period"):
        one(spark, [(0, "3/week")], "id int, s string", limits.parse_rate_limit(F.col("s")))
    rows = [(0, "a, b", "c", "d"), (1, "", "c", "d"), (2, None, "c", "d"), (3, None, None, "d"), (4, None, None, None)]
    assert one(spark, rows, "id int, f string, r string, p string", limits.client_key(F.col("f"), F.col("r"), F.col("p"))) == {0: "a", 1: "c", 2: "c", 3: "d", 4: "unknown"}
    rows = [(i, "k", f"2024-01-01 00:00:{s:02d}") for i, s in enumerate([0, 0, 59, 59])] + [(9, "k", "2024-01-01 00:01:00"), (10, "j", "2024-01-01 00:00:59")]
    r = spark.createDataFrame(rows, "event_id long, key string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    got = {x["event_id"]: (x["allowed"], x["remaining"]) for x in limits.rate_limit_fixed_window(r, "key", 3, 60).collect()}
    assert got == {0: (True, 2), 1: (True, 1), 2: (True, 0), 3: (False, 0), 9: (True, 2), 10: (True, 2)}


def test_validation(spark):
    rows = [(0, "", "ka"), (1, "x", "ka"), (2, "x" * 2000, None), (3, "x" * 2001, "en"), (4, "x", "fr"), (5, None, "en")]
    got = limits.valid_queries(spark.createDataFrame(rows, "id int, q string, l string"), "q", "l").collect()
    assert {r["id"]: r["reason"] for r in got} == {0: "empty", 1: None, 2: None, 3: "too long", 4: "language", 5: "empty"}


def test_upsert(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "url string, hash string")
    incoming = spark.createDataFrame([("a", "1", "document"), ("b", "9", None), ("d", "4", "document"), ("c", "8", "discovery")], "url string, hash string, type string")
    assert {r["url"]: r["change"] for r in identity.upsert_changes(incoming, stored).collect()} == {"a": "unchanged", "b": "updated", "d": "new"}
    assert {tuple(r) for r in identity.upsert_table(incoming, stored).collect()} == {("a", "1"), ("b", "9"), ("c", "3"), ("d", "4")}


def test_frontier(spark):
    edges = [("1", "2"), ("2", "3"), ("3", "4"), ("4", "1"), ("1", "5"), ("5", "4"), ("1", "1")] + [("2", f"c{i:02d}") for i in range(12)]
    u = lambda x: f"http://h/tax/{x}"
    links = spark.createDataFrame([(u(a), u(b)) for a, b in edges] + [(u("1"), "http://other/tax/9"), (u("1"), "http://h/none"), (None, u("1"))], "src string, dst string")
    got = {r["url"]: r["depth"] for r in frontier.crawl_frontier(links, spark.createDataFrame([(u("1"),)], "url string"), max_depth=2).collect()}
    assert got == {u("1"): 0, u("2"): 1, u("5"): 1, u("3"): 2, u("4"): 2, **{u(f"c{i:02d}"): 2 for i in range(9)}}
    assert frontier.crawl_frontier(links, spark.createDataFrame([(u("1"),)], "url string"), max_depth=3, max_pages=4).count() == 4


def test_priorities(spark):
    rows = [(0, 100), (1, 80), (2, 79), (3, 50), (4, 49)]
    assert list(one(spark, rows, "id int, w int", priority.priority_class(F.col("w"))).values()) == ["high", "high", "medium", "medium", "low"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*priority.DOCUMENT_TYPES, "other", None])], "id int, t string")
    got = {r["id"]: r["document_type"] for r in priority.map_document_type(df, "t").collect()}
    assert list(got[i] for i in range(19)) == list(priority.DOCUMENT_TYPES.values()) and got[19] == got[20] == "unknown"


def test_history(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(16)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    at = spark.createDataFrame([(1, 14)], "conv_id long, before long")
    assert [r["turn"] for r in convo.history_window(m, at).orderBy("turn").collect()] == [6, 8]
    assert [r["turn"] for r in convo.history_window(m, at, order="latest").orderBy("turn").collect()] == [10, 12]


def test_streams_equal_batch(spark):
    sf = "/root/testdata/sf0.001"
    batch = {tuple(r) for r in retrieve.response_cache_hits_events(spark, sf).collect()}
    assert {tuple(r) for r in stream.stream_response_cache_events(spark, sf).collect()} == batch
    limited = {(r["event_id"], r["allowed"]) for r in limits.rate_limit_fixed_window_events(spark, sf).collect()}
    assert {(r["event_id"], r["allowed"]) for r in stream.stream_rate_limit_events(spark, sf).collect()} == limited
    ingested = {r["url"] for r in stream.stream_ingest_pages(spark, sf).collect()}
    from corpusq.plans.jobs import ingest_pages_pages

    assert ingested == {r["url"] for r in ingest_pages_pages(spark, sf).collect()}


def test_work_dir_is_shared(spark):
    assert re.match(r"file:/", work_dir(spark, "x")) and work_dir(spark, "x") != work_dir(spark, "x")


def test_links_of_all_spellings(spark):
    """Every way to write an anchor, and references of any depth, as the standard library's parser and urljoin have them."""
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    class Anchors(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found = []

        def handle_starttag(self, tag, attrs):
            self.found += [v for k, v in attrs if tag == "a" and k == "href" and v]

    page = "https://h.org/a/b/c/d/e/f/page.html?x=1"
    deep = ["../" * n + "x" for n in range(1, 9)] + ["./y", "/r/../s", "../..", "a/./b/../c?q=../z", "https://o.org/a/../b", "..//t"]
    html = "".join(f'<a href="{x}">t</a>' for x in deep)
    html += "<a href='single'>t</a><A HREF=\"upper\">t</A><a\n\tclass=k href = \"spaced\">t</a><a href=bare>t</a><a href=\"?a=1&amp;b=2\">t</a><a data-href='no' href='yes'>t</a><abbr href='no2'>t</abbr><a name='n'>t</a>"
    want = Anchors()
    want.feed(html)
    got = extract.extract_links(spark.createDataFrame([(1, page, html)], "page_id long, url string, html string")).collect()
    assert sorted(r["link"] for r in got) == sorted({urljoin(page, x) for x in want.found})


def test_stream_state_goes_and_batches_are_stored_once(spark, tmp_path):
    """Counts and answers are gone once the watermark has passed them; a batch that runs again stores its rows once."""
    from datetime import datetime, timedelta, timezone

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for batch in range(3):
        rows = [(10 * batch + i, start + timedelta(hours=5 * batch, minutes=i), 1) for i in range(3)]
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").coalesce(1).write.mode("append").parquet(source)
        s = stream.stream_rate_limit(spark.readStream.schema("event_id long, ts timestamp, user_id long").parquet(source), 2, 3600)
        stream.run_available(s, target, check)
    got = {r["event_id"]: r["n"] for r in spark.read.parquet(target).collect()}
    assert got == {10 * b + i: i + 1 for b in range(3) for i in range(3)}
    state = spark.read.format("statestore").option("stateVarName", "windows").load(check)
    assert state.count() == 1  # of the last window only
    assert [list(r["value"]["n"]) for r in state.collect()] == [[3]]

    pages, docs, seen = (str(tmp_path / x) for x in ("pages", "docs", "seen"))
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    table.coalesce(1).write.parquet(pages)
    stream.stream_ingest(spark, pages, docs, seen)
    once = spark.read.parquet(f"{docs}/documents").count()
    for f in (tmp_path / "seen" / "commits").iterdir():
        f.unlink()  # as if the driver had been lost after the write
    stream.stream_ingest(spark, pages, docs, seen)
    assert spark.read.parquet(f"{docs}/documents").count() == once > 0
