"""Structured Streaming forms: ingest, de-duplication, metrics, rate limits, response cache, sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusq.functions.time import epoch_micros, epoch_seconds
from corpusq.operators.chunk import chunk_char_window, chunk_records
from corpusq.plans.jobs import page_documents
from corpusq.registry import query, table
from corpusq.sources.tables import page_snapshots, work_dir

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


#: Rows of a file that a stream reads, so that tasks share a large table and none holds much of it.
FILE_ROWS = {"events": 250_000, "pages": 5_000}
#: Fixed value: shares of the urls whose state is kept together; at 6 GB of pages a share has some megabytes of new texts.
URL_SHARES = 1024


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is and stop, to a Parquet folder."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


class FirstOfUrl(StatefulProcessor):
    """The first document of each url of a share of the urls, by doc_id within a micro-batch; urls seen before are known from state, not from the table.

    The state of a share is the list of its urls, to which a batch only appends; so the calls to the state store go by shares, not by
    urls. The new documents of a share in a micro-batch stand in memory together.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("seen", "url string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        seen = {u for (u,) in self.state.get()} if self.state.exists() else set()
        found = []
        for r in rows:
            r = r[~r["url"].isin(seen)]
            if len(r):
                found.append(r.sort_values("doc_id", kind="stable").drop_duplicates("url"))
        if found:
            first = pd.concat(found, ignore_index=True).sort_values("doc_id", kind="stable").drop_duplicates("url")
            self.state.appendList([(u,) for u in first["url"].tolist()])
            yield first[["doc_id", "url", "title", "language", "hash", "text"]]

    def close(self) -> None:
        pass


def stream_ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """New page files -> ``target/documents`` and ``target/chunks`` (chunk records), each url once.

    Seen urls are state, so no batch reads what is stored. A batch owns the partition of its number in both tables, overwrites it, and
    is committed by a row in ``target/commits`` that is written last; a batch that runs again therefore stores its rows once,
    and ``ingested`` shows only batches of which both tables are whole. Pages without a url or an id are left out.
    """

    def put(batch: DataFrame, number: int) -> None:
        where = f"{target}/documents/batch={number}"
        batch.write.mode("overwrite").parquet(where)
        docs = batch.sparkSession.read.schema(batch.schema).parquet(where)
        named = docs.select("doc_id", "title", F.lit("page").alias("document_type"), "language", F.col("url").alias("source_url"))
        chunk_records(chunk_char_window(docs), named).write.mode("overwrite").parquet(f"{target}/chunks/batch={number}")
        docs.agg(F.count(F.lit(1)).alias("documents")).write.mode("overwrite").parquet(f"{target}/commits/batch={number}")

    docs = page_documents(page_snapshots(spark, source, stream=True).where("page_id is not null"))
    shares = docs.withColumn("share", F.pmod(F.xxhash64("url"), F.lit(URL_SHARES)).cast("int"))
    once = shares.groupBy("share").transformWithStateInPandas(FirstOfUrl(), "doc_id long, url string, title string, language string, hash string, text string", "Append", "None")
    with state_store(spark):
        once.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingested(spark: SparkSession, target: str, name: str) -> DataFrame:
    """``documents`` or ``chunks`` of the committed batches."""
    done = spark.read.parquet(f"{target}/commits").select("batch")  # a row a batch
    return spark.read.parquet(f"{target}/{name}").join(F.broadcast(done), "batch", "left_semi")


def stream_dedup(stream: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def stream_metrics(stream: DataFrame, width: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes", labels: tuple[str, ...] = ()) -> DataFrame:
    """Counts, errors, hit ratio and rate a second in windows of ``width`` every ``slide`` (tumbling if equal), by ``labels``.

    Rows later than ``late`` are dropped; a window comes out once the watermark has passed its end.
    """
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), *labels)
    hits, misses = F.count_if(F.col("event_type") == "click"), F.count_if(F.col("event_type") == "view")
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    made = g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.when(hits + misses > 0, F.round(hits / (hits + misses), 6)).alias("ratio"))
    return made.select(F.col("w.start").alias("window_start"), *labels, "n", "errors", "ratio", F.round(F.col("n") / seconds, 6).alias("rate"))


def _gathered(rows: Iterator[pd.DataFrame], time: str, of: Callable[[pd.DataFrame], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times in microseconds, event ids and owners (numbers that ``of`` gives) of a share's rows in a micro-batch, by owner, time and id, whatever Arrow batches they come in."""
    times, events, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in rows:
        t = r[time]
        times.append(t.to_numpy("datetime64[us]").astype(np.int64) if str(t.dtype).startswith("datetime") else t.to_numpy(np.int64))
        events.append(r["event_id"].to_numpy(np.int64))
        owners.append(of(r))
    times, events, owners = np.concatenate(times), np.concatenate(events), np.concatenate(owners)
    order = np.lexsort((events, times, owners))
    return times[order], events[order], owners[order]


class _Numbers(dict):
    """Numbers of names in the order in which they come up."""

    def of(self, names: pd.Series) -> np.ndarray:
        codes, found = pd.factorize(names, use_na_sentinel=False)
        return np.array([self.setdefault(None if pd.isna(n) else n, len(self)) for n in found.tolist()], np.int64)[codes]


class FixedWindowLimiter(StatefulProcessor):
    """Numbers the requests of each user in windows from the epoch on, late ones too. Keys are (share of the users, run of windows).

    The state of a key is one value, the counts of its users' windows that the watermark has not passed; a timer clears it after the
    last one, so it does not grow. So the calls to the state store go by shares, not by users. The rows of a
    micro-batch are brought in order of user, time and id first, 24 bytes a request of that key, so results do not depend
    on Arrow batches.
    """

    def __init__(self, limit: int, seconds: int, rows: int = 10_000):
        self.limit, self.seconds, self.rows = limit, seconds, rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("windows", "user array<long>, bucket array<long>, n array<long>")

    def _open(self, passed: int) -> dict[tuple[int | None, int], int]:
        """Counts by user and window of the windows that end after the time ``passed`` in milliseconds."""
        known = zip(*self.state.get()) if self.state.exists() else ()
        return {(u, b): n for u, b, n in known if (b + 1) * self.seconds * 1000 > passed}

    def _put(self, counts: dict[tuple[int | None, int], int]) -> None:
        self.state.update(([u for u, _ in counts], [b for _, b in counts], list(counts.values())))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        users = _Numbers()
        times, events, owner = _gathered(rows, "ts", lambda r: users.of(r["user_id"].astype("Int64").where(r["known"])))
        names = list(users)
        counts = self._open(timers.getCurrentWatermarkInMs())
        last = max((b for _, b in counts), default=None)
        window = times // (self.seconds * 1_000_000)
        first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (window[1:] != window[:-1])]) if len(owner) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(owner)])
        groups = [(names[u], w) for u, w in zip(owner[first].tolist(), window[first].tolist())]
        had = np.array([counts.get(g, 0) for g in groups], np.int64)
        n = np.arange(1, len(times) + 1) - np.repeat(first - had, size)
        counts |= dict(zip(groups, (had + size).tolist()))
        self._put(counts)
        latest = max(b for _, b in counts)
        if last is None or latest > last:
            self.handle.registerTimer((latest + 1) * self.seconds * 1000)
        named = pd.Series(names, dtype="Int64")
        for at in range(0, len(events), self.rows):
            some = slice(at, at + self.rows)
            yield pd.DataFrame({"event_id": events[some], "user_id": named.take(owner[some]).to_numpy(object), "n": n[some], "allowed": n[some] <= self.limit}).astype({"user_id": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        left = self._open(expiredTimerInfo.getExpiryTimeInMs())
        self._put(left) if left else self.state.clear()
        yield pd.DataFrame({"event_id": [], "user_id": [], "n": [], "allowed": []}).astype({"event_id": "int64", "user_id": "int64", "n": "int64", "allowed": "bool"})

    def close(self) -> None:
        pass


class ResponseCache(StatefulProcessor):
    """The last stored answers of a share of the keys; a hit is a request less than ``ttl`` seconds after its key's.

    A stored answer goes once the watermark is ``ttl`` seconds past it, at the share's next batch or by a timer. The calls to the
    state store go by shares, not by keys. The requests of a share in a micro-batch are brought in order of key, time and id
    first, 24 bytes each, so results do not depend on Arrow batches.
    """

    def __init__(self, ttl: int, rows: int = 10_000):
        self.ttl, self.rows = ttl, rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("stored", "keys array<string>, at array<long>")

    def _live(self, passed: int) -> dict[str | None, int]:
        """Stored answers that the time ``passed`` in milliseconds has not outlived."""
        return {k: t for k, t in zip(*self.state.get()) if t // 1000 + self.ttl * 1000 >= passed} if self.state.exists() else {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        keys = _Numbers()
        times, events, owner = _gathered(rows, "at", lambda r: keys.of(r["key"]))
        names, live = np.array(list(keys), object), self._live(timers.getCurrentWatermarkInMs())
        hits, now, stored, ttl, latest = np.ones(len(times), bool), -1, None, self.ttl * 1_000_000, None
        for low in range(0, len(times), self.rows):
            for at, (k, t) in enumerate(zip(owner[low : low + self.rows].tolist(), times[low : low + self.rows].tolist()), low):
                if k != now:
                    now, stored = k, live.get(names[k])
                if stored is None or t - stored >= ttl:
                    hits[at], stored = False, t
                    live[names[k]], latest = t, t if latest is None else max(latest, t)
        if latest is not None:
            self.state.update((list(live), list(live.values())))
            self.handle.registerTimer(latest // 1000 + self.ttl * 1000 + 1)
        for low in range(0, len(events), self.rows):
            some = slice(low, low + self.rows)
            yield pd.DataFrame({"event_id": events[some], "key": names[owner[some]], "hit": hits[some]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        left = self._live(expiredTimerInfo.getExpiryTimeInMs())
        self.state.update((list(left), list(left.values()))) if left else self.state.clear()
        yield pd.DataFrame({"event_id": [], "key": [], "hit": []}).astype({"event_id": "int64", "key": "str", "hit": "bool"})

    def close(self) -> None:
        pass


def stream_rate_limit(stream: DataFrame, limit: int, seconds: int, late: str = "10 minutes", windows: int = 64, shares: int = 64) -> DataFrame:
    """Decisions for ``stream(event_id, user_id, ts)``; rows later than ``late`` are dropped.

    Requests are numbered as they arrive, those of a micro-batch by time and id; so a request that comes in a later micro-batch
    than a younger one counts after it. State is kept by share of the users (by hash) and run of ``windows`` windows, so a busy
    user's past is spread.
    """
    run = F.floor(epoch_seconds("ts") / (seconds * windows)).cast("long")
    s = stream.withWatermark("ts", late).select("event_id", F.coalesce("user_id", F.lit(0)).cast("long").alias("user_id"), F.col("user_id").isNotNull().alias("known"), "ts", F.pmod(F.xxhash64("user_id"), F.lit(shares)).alias("share"), run.alias("run"))
    return s.groupBy("share", "run").transformWithStateInPandas(FixedWindowLimiter(limit, seconds), "event_id long, user_id long, n long, allowed boolean", "Append", "EventTime")


def stream_response_cache(stream: DataFrame, ttl: int = 3600, late: str = "10 minutes", shares: int = 256) -> DataFrame:
    """Hits of ``stream(event_id, key, ts)`` on arrival; rows later than ``late`` are dropped. State is kept by share of the keys (by hash)."""
    s = stream.withWatermark("ts", late).select("event_id", "key", "ts", epoch_micros("ts").alias("at"), F.pmod(F.xxhash64("key"), F.lit(shares)).alias("share"))
    return s.groupBy("share").transformWithStateInPandas(ResponseCache(ttl), "event_id long, key string, hit boolean", "Append", "EventTime")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: runs of events with gaps below ``gap``. The same plan for a batch and a stream."""
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("session_start"), "n")


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(path)


@contextmanager
def state_store(spark: SparkSession):
    """The state store that keyed state needs, for the time of a stream; the session's setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _streamed(spark, frame: DataFrame, name: str, mode: str = "append", schema=None) -> DataFrame:
    target = work_dir(spark, name)
    with state_store(spark):
        run_available(frame, target, work_dir(spark, f"{name}-checkpoint"), mode)
    return spark.read.schema(schema or frame.schema).parquet(target)


def _folder(spark, sf_dir, name: str, parts: int) -> str:
    """The table as a folder of ``parts`` files, or of as many as its rows ask for, for a file stream."""
    path, df = work_dir(spark, f"{name}-files"), table(spark, sf_dir, name)
    parts = max(parts, -(-df.count() // FILE_ROWS[name]))
    df.repartitionByRange(parts, f"{name[:-1]}_id").write.parquet(path)
    return path


@query()
def stream_ingest_pages(spark, sf_dir):
    target = work_dir(spark, "ingested")
    stream_ingest(spark, _folder(spark, sf_dir, "pages", 2), target, work_dir(spark, "ingest-checkpoint"))
    return ingested(spark, target, "documents").select("doc_id", "url", "title", "language", "hash")


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def stream_dedup_events(spark, sf_dir):
    s = events_stream(spark, _folder(spark, sf_dir, "events", 2)).withColumn("key", F.concat_ws("|", "user_id", "event_type"))
    return _streamed(spark, stream_dedup(s, "key", "400 days").select("user_id", "event_type"), "deduped")


_RATIO = "round(count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type IN ('click', 'view')), 0), 6) AS ratio"


@query(f"""WITH w AS (SELECT unnest(range(0, 5)) AS k), e AS (SELECT date_trunc('minute', ts) - to_minutes(CAST(k AS INT)) AS window_start, event_type FROM events, w)
SELECT window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, {_RATIO}, round(count(*) / 300, 6) AS rate
FROM e WHERE window_start + INTERVAL 5 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1""")
def stream_metrics_events(spark, sf_dir):
    s = events_stream(spark, _folder(spark, sf_dir, "events", 1))
    return _streamed(spark, stream_metrics(s), "metrics")


@query(f"""SELECT date_trunc('minute', ts) AS window_start, event_type AS label, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, {_RATIO}, round(count(*) / 60, 6) AS rate
FROM events WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2""")
def stream_request_rate_events(spark, sf_dir):
    """Request rates by label in tumbling minutes."""
    s = events_stream(spark, _folder(spark, sf_dir, "events", 1)).withColumn("label", F.col("event_type"))
    return _streamed(spark, stream_metrics(s, "1 minute", "1 minute", labels=("label",)), "request-rates")


@query(f"""WITH w AS (SELECT unnest(range(0, 5)) AS k), e AS (SELECT date_trunc('minute', ts) - to_minutes(CAST(k AS INT)) AS window_start, event_type,
CASE user_id % 3 WHEN 0 THEN 'ka' WHEN 1 THEN 'ru' ELSE 'en' END AS language, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status FROM events, w)
SELECT window_start, language, status, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, {_RATIO}, round(count(*) / 300, 6) AS rate
FROM e WHERE window_start + INTERVAL 5 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2, 3""")
def stream_query_rate_events(spark, sf_dir):
    """Query rates by language and status in sliding five minutes."""
    s = events_stream(spark, _folder(spark, sf_dir, "events", 1))
    s = s.withColumn("language", F.when(F.col("user_id") % 3 == 0, "ka").when(F.col("user_id") % 3 == 1, "ru").otherwise("en")).withColumn("status", F.when(F.col("event_type") == "error", "500").otherwise("200"))
    return _streamed(spark, stream_metrics(s, labels=("language", "status")), "query-rates")


@query("WITH k AS (SELECT event_id, user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS b, ts FROM events) SELECT event_id, user_id, n, n <= 2 AS allowed FROM (SELECT *, row_number() OVER (PARTITION BY user_id, b ORDER BY ts, event_id) AS n FROM k)")
def stream_rate_limit_events(spark, sf_dir):
    s = events_stream(spark, _folder(spark, sf_dir, "events", 1)).select("event_id", "user_id", "ts")
    return _streamed(spark, stream_rate_limit(s, 2, 3600), "limited")


@query("""
WITH RECURSIVE e AS (SELECT event_id, user_id || '|' || event_type AS key, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT event_id, key, ts AS stored, n, false AS hit FROM e WHERE n = 1
UNION ALL SELECT e.event_id, e.key, CASE WHEN e.ts - w.stored < INTERVAL 3600 SECOND THEN w.stored ELSE e.ts END, e.n, e.ts - w.stored < INTERVAL 3600 SECOND FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1)
SELECT event_id, key, hit FROM w
""")
def stream_response_cache_events(spark, sf_dir):
    s = events_stream(spark, _folder(spark, sf_dir, "events", 1)).select("event_id", F.concat_ws("|", "user_id", "event_type").alias("key"), "ts")
    return _streamed(spark, stream_response_cache(s), "cached")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, g
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_sessions_events(spark, sf_dir):
    """Sessions that the stream has closed: those that end before the watermark."""
    s = events_stream(spark, _folder(spark, sf_dir, "events", 1)).select("user_id", "ts").withWatermark("ts", "10 minutes")
    return _streamed(spark, sessions(s), "sessions")
