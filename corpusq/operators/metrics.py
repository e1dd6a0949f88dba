"""Operational metrics over an event table: rates, latency quantiles, ratios, gauges, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusq.registry import query, table
from corpusq.sources.tables import kept

#: Upper bounds of the latency buckets, in the unit of ``value``.
BUCKETS = [1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


def rate(events: DataFrame, width: str, *labels: str) -> DataFrame:
    """Events a window and label combination."""
    return events.groupBy(F.window("ts", width).alias("w"), *labels).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *labels, "n")


def latency_exact(events: DataFrame, width: str, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Exact quantiles of ``value`` a window."""
    g = events.groupBy(F.window("ts", width).alias("w")).agg(F.percentile("value", F.array(*map(F.lit, quantiles))).alias("q"))
    return g.select(F.col("w.start").alias("window_start"), *(F.round(F.col("q")[i], 6).alias(f"p{round(100 * q)}") for i, q in enumerate(quantiles)))


def latency_histogram(events: DataFrame, width: str, quantile: float = 0.95, bounds: list[float] = BUCKETS) -> DataFrame:
    """A quantile from cumulative buckets by linear interpolation, a row a window; beyond the last bound, that bound."""
    start = F.col("w.start").alias("window_start")
    counts = events.groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)))
    rank = F.col("total") * quantile
    out = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low = F.lit(bounds[i - 1] if i else 0.0)
        below = F.col(f"b{i - 1}") if i else F.lit(0)
        inside = F.col(f"b{i}") - below
        out = F.when(F.col(f"b{i}") >= rank, low + (bounds[i] - low) * (rank - below) / inside).otherwise(out)
    return counts.select(start, F.round(out, 6).alias("quantile"))


def latency_approx(events: DataFrame, width: str, quantile: float = 0.95, accuracy: int = 1000) -> DataFrame:
    """An approximate quantile a window, with a rank error of 1 / ``accuracy`` at most."""
    g = events.groupBy(F.window("ts", width).alias("w")).agg(F.percentile_approx("value", quantile, accuracy).alias("quantile"))
    return g.select(F.col("w.start").alias("window_start"), "quantile")


def hit_ratio(events: DataFrame, width: str, hit: Column, miss: Column) -> DataFrame:
    """Hits / (hits + misses) a window; null without either."""
    g = events.groupBy(F.window("ts", width).alias("w")).agg(F.count_if(hit).alias("hits"), F.count_if(miss).alias("misses"))
    total = F.col("hits") + F.col("misses")
    return g.select(F.col("w.start").alias("window_start"), "hits", "misses", F.round(F.when(total > 0, F.col("hits") / total), 6).alias("ratio"))


def active_requests(events: DataFrame, width: str = "1 hour", ranges: int | None = None) -> DataFrame:
    """Most requests at a time, a window: each adds 1 at ``ts`` and takes 1 off ``value`` seconds later.

    Prefix sums of two levels: the steps are dealt to ranges of time of about equal numbers (as many as shuffle
    partitions, or ``ranges``), each range sums its own on top of the sum of those before it, so neither a busy day nor the table is one task.
    """
    end = F.expr("timestampadd(MICROSECOND, cast(round(value * 1000000) as bigint), ts)")
    steps = events.select(F.explode(F.array(F.struct(F.col("ts").alias("at"), F.lit(1).alias("step")), F.struct(end.alias("at"), F.lit(-1).alias("step")))).alias("x")).select("x.*")
    steps = steps.groupBy("at").agg(F.sum("step").alias("step"))
    dealt = steps.repartitionByRange(ranges, "at") if ranges else steps.repartitionByRange("at")
    dealt = kept(dealt.withColumn("part", F.spark_partition_id()), "request-steps")
    parts = dealt.groupBy("part").agg(F.sum("step").alias("net"))
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    parts = parts.withColumn("carried", F.coalesce(F.sum("net").over(before), F.lit(0))).select("part", "carried")
    now = F.sum("step").over(W.partitionBy("part").orderBy("at")) + F.col("carried")
    return dealt.join(F.broadcast(parts), "part").withColumn("now", now).groupBy(F.window("at", width).alias("w")).agg(F.max("now").alias("most")).select(F.col("w.start").alias("window_start"), "most")


def metric_sketches(events: DataFrame, width: str = "1 minute", *labels: str, k: int = 200, lg_k: int = 12) -> DataFrame:
    """Mergeable sketches a window and label combination: (window_start, labels, n, total, latency, users).

    ``latency`` is a KLL sketch of ``value`` (its rank error falls with ``k``: about 1.3 % at 200), ``users`` a HyperLogLog sketch of
    ``user_id`` (an error of about 1.6 % at ``lg_k`` 12); both are binary columns that can be stored and merged to any wider window.
    """
    g = events.groupBy(F.window("ts", width).alias("w"), *labels)
    made = g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.kll_sketch_agg_double("value", k).alias("latency"), F.hll_sketch_agg("user_id", lg_k).alias("users"))
    return made.select(F.col("w.start").alias("window_start"), *labels, "n", "total", "latency", "users")


def merged_sketches(sketches: DataFrame, width: str | None = None, *labels: str) -> DataFrame:
    """Stored sketches merged to wider windows (None: to one row for each label combination, the dashboard's totals)."""
    keys = [F.window("window_start", width).alias("w")] if width else []
    g = sketches.groupBy(*keys, *labels).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("latency").alias("latency"), F.hll_union_agg("users").alias("users"))
    start = [F.col("w.start").alias("window_start")] if width else []
    return g.select(*start, *labels, "n", "total", "latency", "users")


def sketch_values(sketches: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Quantiles (p50, ...), mean and number of users that sketches stand for, beside their other columns."""
    own = [F.kll_sketch_get_quantile_double("latency", F.lit(q)).alias(f"p{round(100 * q)}") for q in quantiles]
    rest = [c for c in sketches.columns if c not in ("latency", "users", "total")]
    return sketches.select(*rest, *own, (F.col("total") / F.col("n")).alias("avg_value"), F.hll_sketch_estimate("users").alias("users"))


def dashboard_totals(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("total_queries"), F.countDistinct("user_id").alias("total_users"), F.round(F.avg("value"), 6).alias("avg_response"), F.round(F.count_if(F.col("event_type") != "error") / F.count(F.lit(1)), 6).alias("success_rate"))


def recent_activity(events: DataFrame, n: int = 20) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def metadata_project(base: Column, side: Column) -> Column:
    """``base``, a map of strings, with the fields of a JSON object in ``side`` put over it: of equal keys the JSON's wins.

    Null, empty or malformed JSON, and JSON that is no object, adds nothing; of a key that stands twice in it the last counts;
    values that are no strings keep their JSON text, a JSON null becomes null. A null base is empty.
    """
    none = F.create_map().cast("map<string,string>")
    found = F.from_json(side, "map<string,string>")
    keys = F.map_keys(found)
    last = F.filter(F.map_entries(found), lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["key"]))
    fields = F.coalesce(F.map_from_entries(last), none)
    return F.map_concat(F.map_filter(F.coalesce(base, none), lambda k, _: ~F.array_contains(F.map_keys(fields), k)), fields)


def access_log_rows(events: DataFrame) -> DataFrame:
    """One JSON line an event: request id, endpoint, method, status, duration in ms."""
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    fields = F.struct(F.col("event_id").alias("request_id"), F.concat(F.lit("/"), "event_type").alias("endpoint"), F.lit("GET").alias("method"), status.alias("status"), F.round(F.col("value") * 1000, 2).alias("duration_ms"))
    return events.select("event_id", fields.alias("f")).select("event_id", "f.*", F.to_json("f").alias("line"))


def _events(spark, sf_dir, *columns):
    return table(spark, sf_dir, "events", *columns)


_5 = "time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2000-01-01')"


@query("SELECT date_trunc('minute', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def request_rate_per_minute_events(spark, sf_dir):
    return rate(_events(spark, sf_dir, "ts", "event_type"), "1 minute", "event_type")


@query(f"SELECT {_5} AS window_start, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_p95_exact_events(spark, sf_dir):
    return latency_exact(_events(spark, sf_dir, "ts", "value"), "5 minutes")


_CUM = ", ".join(f"count(*) FILTER (value <= {b}) AS b{i}" for i, b in enumerate(BUCKETS))
_CASES = " ".join(f"WHEN b{i} >= total * 0.95 THEN {BUCKETS[i - 1] if i else 0.0} + {b - (BUCKETS[i - 1] if i else 0.0)} * (total * 0.95 - {f'b{i - 1}' if i else 0}) / (b{i} - {f'b{i - 1}' if i else 0})" for i, b in enumerate(BUCKETS))


@query(f"SELECT window_start, round(CAST(CASE {_CASES} ELSE {BUCKETS[-1]} END AS DOUBLE), 6) AS quantile FROM (SELECT date_trunc('hour', ts) AS window_start, count(*)::DOUBLE AS total, {_CUM} FROM events GROUP BY 1)")
def latency_p95_histogram_events(spark, sf_dir):
    return latency_histogram(_events(spark, sf_dir, "ts", "value"), "1 hour")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2000-01-01') AS window_start, true AS within_bound FROM events GROUP BY 1")
def latency_p95_approx_events(spark, sf_dir):
    """The approximate p95 of each day, held against its bound: a rank within 1 / 1000 of the one asked for."""
    e = _events(spark, sf_dir, "ts", "value")
    about = latency_approx(e, "1 day")
    j = e.join(F.broadcast(about), F.date_trunc("day", "ts") == F.col("window_start"))  # a row a day
    n, low, high = F.count(F.lit(1)), F.count_if(F.col("value") < F.col("quantile")), F.count_if(F.col("value") <= F.col("quantile"))
    return j.groupBy("window_start").agg(((low <= n * 0.951 + 1) & (high >= n * 0.949 - 1)).alias("within_bound"))


_STATUS = "CASE WHEN event_type = 'error' THEN '500' ELSE '200' END"


@query(f"SELECT {_5} AS window_start, {_STATUS} AS status, count(*) AS n FROM events GROUP BY ALL")
def rate_by_status_events(spark, sf_dir):
    e = _events(spark, sf_dir, "ts", "event_type").withColumn("status", F.when(F.col("event_type") == "error", "500").otherwise("200"))
    return rate(e, "5 minutes", "status")


@query(f"SELECT {_5} AS window_start, CASE user_id % 3 WHEN 0 THEN 'ka' WHEN 1 THEN 'ru' ELSE 'en' END AS language, {_STATUS} AS status, count(*) AS n FROM events GROUP BY ALL")
def query_rate_by_language_events(spark, sf_dir):
    e = _events(spark, sf_dir, "ts", "event_type", "user_id").withColumn("language", F.when(F.col("user_id") % 3 == 0, "ka").when(F.col("user_id") % 3 == 1, "ru").otherwise("en"))
    return rate(e.withColumn("status", F.when(F.col("event_type") == "error", "500").otherwise("200")), "5 minutes", "language", "status")


@query("SELECT date_trunc('hour', ts) AS window_start, round(quantile_cont((props::JSON->>'k')::INT, 0.95), 6) AS p95 FROM events GROUP BY 1")
def retrieval_count_p95_events(spark, sf_dir):
    e = _events(spark, sf_dir, "ts", "props").select("ts", F.get_json_object("props", "$.k").cast("int").alias("value"))
    return latency_exact(e, "1 hour", (0.95,))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type AS status, count(*) AS n, round(sum(value), 4) AS documents FROM events GROUP BY ALL")
def scraper_task_rate_events(spark, sf_dir):
    g = _events(spark, sf_dir, "ts", "event_type", "value").groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("status"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("documents")).select(F.col("w.start").alias("window_start"), "status", "n", "documents")


@query(f"SELECT {_5} AS window_start, count(*) FILTER (event_type = 'click') AS hits, count(*) FILTER (event_type = 'view') AS misses, round(count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type IN ('click', 'view')), 0), 6) AS ratio FROM events GROUP BY 1")
def cache_hit_ratio_events(spark, sf_dir):
    return hit_ratio(_events(spark, sf_dir, "ts", "event_type"), "5 minutes", F.col("event_type") == "click", F.col("event_type") == "view")


@query("""WITH s AS (SELECT moment, sum(step) AS step FROM (SELECT ts AS moment, 1 AS step FROM events UNION ALL SELECT make_timestamp(epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT)), -1 FROM events) GROUP BY moment),
r AS (SELECT moment, sum(step) OVER (ORDER BY moment) AS total FROM s) SELECT date_trunc('hour', moment) AS window_start, CAST(max(total) AS BIGINT) AS most FROM r GROUP BY 1""")
def active_requests_events(spark, sf_dir):
    return active_requests(_events(spark, sf_dir, "ts", "value"))


@query("SELECT count(*) AS total_queries, count(DISTINCT user_id) AS total_users, round(avg(value), 6) AS avg_response, round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_rate FROM events")
def dashboard_totals_events(spark, sf_dir):
    return dashboard_totals(_events(spark, sf_dir))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_activity_events(spark, sf_dir):
    return recent_activity(_events(spark, sf_dir, "event_id", "ts", "event_type"))


@query("SELECT event_id, event_id AS request_id, '/' || event_type AS endpoint, 'GET' AS method, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, round(value * 1000, 2) AS duration_ms FROM events")
def access_log_rows_events(spark, sf_dir):
    return access_log_rows(_events(spark, sf_dir)).drop("line")


#: Side columns of all kinds: the event's own, none, broken, a clashing key, no object, a nested value.
_PROPS = """CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '{broken' WHEN 2 THEN '{"source": "side", "k": "' || user_id || '"}' WHEN 3 THEN '[1, 2]' WHEN 4 THEN '{"o": {"a": [1,2]}, "k": null}' ELSE props END"""


@query("""SELECT event_id, CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN json_extract_string(props, '$.k') END AS k, event_type AS source FROM events""")
def metadata_project_events(spark, sf_dir):
    """JSON side columns merged into a metadata map."""
    meta = metadata_project(F.create_map(F.lit("source"), F.col("event_type")), F.col("props"))
    return _events(spark, sf_dir, "event_id", "event_type", "props").select("event_id", meta.alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["source"].alias("source"))


@query(f"""WITH e AS (SELECT event_id, event_type, {_PROPS} AS p FROM events), j AS (SELECT *, CASE WHEN json_valid(p) THEN CASE WHEN json_type(p) = 'OBJECT' THEN p::JSON END END AS o FROM e)
SELECT event_id, json_extract_string(o, '$.k') AS k, coalesce(json_extract_string(o, '$.source'), event_type) AS source, json_extract_string(o, '$.o') AS o, CAST(len(list_distinct(list_concat(['source'], coalesce(json_keys(o), []::VARCHAR[])))) AS INT) AS fields FROM j""")
def metadata_merge_events(spark, sf_dir):
    """The same over side columns of all kinds, also null, broken, clashing and nested ones."""
    e = _events(spark, sf_dir, "event_id", "event_type", "user_id", "props").withColumn("p", F.expr(_PROPS))
    m = metadata_project(F.create_map(F.lit("source"), F.col("event_type")), F.col("p"))
    return e.select("event_id", m.alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["source"].alias("source"), F.col("m")["o"].alias("o"), F.size("m").alias("fields"))


def _sketched(spark, sf_dir) -> DataFrame:
    """Sketches a minute, stored and read again."""
    e = _events(spark, sf_dir, "ts", "event_type", "user_id", "value")
    return kept(metric_sketches(e, "1 minute", "event_type"), "sketches")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2000-01-01') AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS avg_value, true AS quantiles_hold, true AS users_hold FROM events GROUP BY ALL")
def merged_sketches_events(spark, sf_dir):
    """Minute sketches merged to days, held against the exact values: the p50 and p95 against ranks, the users against their number."""
    days = sketch_values(merged_sketches(_sketched(spark, sf_dir), "1 day", "event_type"))
    e = _events(spark, sf_dir, "ts", "event_type", "user_id", "value")
    j = e.join(days.select(F.col("window_start").alias("s"), F.col("event_type").alias("t"), "p50", "p95"), (F.date_trunc("day", "ts") == F.col("s")) & (F.col("event_type") == F.col("t")))
    share = lambda c, low: F.avg(((F.col("value") < F.col(c)) if low else (F.col("value") <= F.col(c))).cast("double"))
    ranks = j.groupBy("s", "t").agg(F.count(F.lit(1)).alias("m"), F.countDistinct("user_id").alias("u"), *(share(c, low).alias(f"{c}{low:d}") for c in ("p50", "p95") for low in (True, False)))
    near = lambda c, q: (F.col(f"{c}1") <= q + 0.02) & (F.col(f"{c}0") >= q - 0.02)
    out = days.join(ranks, (F.col("window_start") == F.col("s")) & (F.col("event_type") == F.col("t")))
    return out.select("window_start", "event_type", "n", F.round("avg_value", 6).alias("avg_value"), (near("p50", 0.5) & near("p95", 0.95)).alias("quantiles_hold"), (F.abs(F.col("users") - F.col("u")) <= 0.06 * F.col("u") + 1).alias("users_hold"))
