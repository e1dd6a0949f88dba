"""Document types, priorities, quotas and key document look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusq.operators.many_searches import search_hits
from corpusq.registry import query, table

#: Names of document types, and the types they stand for.
DOCUMENT_TYPES = {
    "საქართველოს კონსტიტუცია/კონსტიტუციური კანონი": "constitution",
    "საქართველოს ორგანული კანონი": "organic_law",
    "საქართველოს კანონი": "law",
    "მთავრობის დადგენილება": "government_resolution",
    "ბრძანება": "order",
    "ერთობლივი ბრძანება": "joint_order",
    "სიტუაციური სახელმძღვანელო": "situational_guideline",
    "მეთოდური მითითება": "methodological_guideline",
    "პროცედურული სახელმძღვანელო": "procedural_guideline",
    "ბრძანება ინსტრუქციების დამტკიცების შესახებ": "instruction_order",
    "სტანდარტი": "standard",
    "შემოსავლების სამსახურის დავების გადაწყვეტილება": "revenue_service_decision",
    "ფინანსთა სამინისტროს დავების გადაწყვეტილება": "ministry_decision",
    "უზენაესი სასამართლოს გადაწყვეტილება": "supreme_court_decision",
    "სააპელაციო სასამართლოს გადაწყვეტილება": "appeals_court_decision",
    "საქალაქო სასამართლოს გადაწყვეტილება": "city_court_decision",
    "საჯარო გადაწყვეტილება": "public_decision",
    "სახელმწიფოთაშორისი ხელშეკრულება/შეთანხმება": "international_agreement",
    "მთავრობათაშორისი ხელშეკრულება/შეთანხმება": "intergovernmental_agreement",
}
#: Weights of types; others weigh 30.
PRIORITY_WEIGHTS = {
    "law": 100, "order": 90, "government_resolution": 85, "organic_law": 95, "constitution": 100, "methodological_guideline": 70, "situational_guideline": 60, "instruction_order": 65,
    "international_agreement": 75, "ministry_decision": 40, "revenue_service_decision": 35, "supreme_court_decision": 50, "appeals_court_decision": 45, "city_court_decision": 40, "public_decision": 35,
}
QUOTAS = {"high": 100, "medium": 50, "low": 20}


def _lookup(df: DataFrame, column: str, values: dict, default, name: str) -> DataFrame:
    """``name`` from a dictionary of fixed size, as a broadcast dimension."""
    kind = "int" if isinstance(default, int) else "string"
    dim = df.sparkSession.createDataFrame(list(values.items()), f"_k string, _v {kind}")
    return df.join(F.broadcast(dim), F.col(column) == F.col("_k"), "left").withColumn(name, F.coalesce("_v", F.lit(default))).drop("_k", "_v")


def map_document_type(df: DataFrame, column: str, types: dict[str, str] = DOCUMENT_TYPES, name: str = "document_type") -> DataFrame:
    return _lookup(df, column, types, "unknown", name)


def priority_weight(df: DataFrame, column: str = "document_type", weights: dict[str, int] = PRIORITY_WEIGHTS, name: str = "weight") -> DataFrame:
    return _lookup(df, column, weights, 30, name)


def priority_class(weight: Column) -> Column:
    return F.when(weight >= 80, "high").when(weight >= 50, "medium").otherwise("low")


def priority_stats(df: DataFrame) -> DataFrame:
    """Counts by type, by class and overall of ``df(document_type, priority)``."""
    return df.sparkSession.sql("SELECT CASE WHEN grouping(document_type) = 0 THEN 'type' WHEN grouping(priority) = 0 THEN 'priority' ELSE 'total' END AS level, coalesce(document_type, priority, 'all') AS value, count(*) AS n FROM {d} GROUP BY GROUPING SETS ((document_type), (priority), ())", d=df)


def quota_per_type(df: DataFrame, key: str, quotas: dict[str, int] = QUOTAS) -> DataFrame:
    """At most the class's quota of each type, in key order; ``step`` orders the types, highest class first."""
    q = F.when(F.col("priority") == "high", quotas["high"]).when(F.col("priority") == "medium", quotas["medium"]).otherwise(quotas["low"])
    step = F.when(F.col("priority") == "high", 1).when(F.col("priority") == "medium", 2).otherwise(3)
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy("document_type").orderBy(key))).where(F.col("rank") <= max(quotas.values()))  # a literal, by which Spark cuts each task's part before the shuffle
    return ranked.where(F.col("rank") <= q).withColumn("step", step)


def quota_per_page(df: DataFrame, key: str, max_pages: int, per_page: int = 10) -> DataFrame:
    """At most ``per_page`` rows of each (section, page), of pages up to the lesser of ``max_pages`` and the section's."""
    d = df.where(F.col("page") <= F.least(F.lit(max_pages), F.col("total_pages")))
    return d.withColumn("rank", F.row_number().over(W.partitionBy("section", "page").orderBy(key))).where(F.col("rank") <= per_page)


def _searches(docs: DataFrame, searches: DataFrame | list[tuple[str, str]]) -> DataFrame:
    return searches if isinstance(searches, DataFrame) else docs.sparkSession.createDataFrame(searches, "name string, q string")


def key_document_lookup(docs: DataFrame, searches: DataFrame | list[tuple[str, str]], top: int = 3, least: int = 100) -> DataFrame:
    """For each search (name, q): the first of the first ``top`` documents holding the words whose text is long enough."""
    hits = search_hits(docs.select("doc_id", "text", F.length("text").alias("n")), _searches(docs, searches), keep=("n",))
    first = hits.withColumn("rank", F.row_number().over(W.partitionBy("name").orderBy("doc_id"))).where(F.col("rank") <= top)
    return first.where(F.col("n") >= least).groupBy("name").agg(F.min("doc_id").alias("doc_id"))


def key_search_summary(docs: DataFrame, searches: DataFrame | list[tuple[str, str]], top: int = 5) -> DataFrame:
    """For each search of ``docs(doc_id, title, url, text)``: how many documents hold the words, and title and url of the first ``top``."""
    hits = search_hits(docs, _searches(docs, searches), keep=("title", "url"))
    total = hits.groupBy("name").agg(F.count(F.lit(1)).alias("documents_found"))
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("name").orderBy("doc_id"))).where(F.col("rank") <= top)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "title", "url"))), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url")))
    return total.join(ranked.groupBy("name").agg(listed.alias("documents")), "name")


#: Names for the test tables: part types and document sources stand in for document types.
TYPES = {"ECONOMY": "law", "PROMO": "order", "STANDARD": "methodological_guideline", "SMALL": "supreme_court_decision"}
SOURCES = {f"src{i}": 100 - 5 * i for i in range(12)}
SEARCHES = [("license", "license"), ("tion", "ciónes de"), ("und", " und "), ("none", "no such words")]

_TYPE = "CASE p_type WHEN 'ECONOMY' THEN 'law' WHEN 'PROMO' THEN 'order' WHEN 'STANDARD' THEN 'methodological_guideline' WHEN 'SMALL' THEN 'supreme_court_decision' ELSE 'unknown' END"
_WEIGHT = "CASE WHEN source IN ('src0','src1','src2','src3','src4','src5','src6','src7','src8','src9','src10','src11') THEN 100 - 5 * CAST(source[4:] AS INT) ELSE 30 END"
_CLASS = f"CASE WHEN {_WEIGHT} >= 80 THEN 'high' WHEN {_WEIGHT} >= 50 THEN 'medium' ELSE 'low' END"


def _weighed(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "source").withColumnRenamed("source", "document_type")
    return priority_weight(d, "document_type", SOURCES).withColumn("priority", priority_class(F.col("weight")))


@query(f"SELECT p_partkey, {_TYPE} AS document_type FROM part")
def map_document_type_part(spark, sf_dir):
    return map_document_type(table(spark, sf_dir, "part", "p_partkey", "p_type"), "p_type", TYPES).select("p_partkey", "document_type")


@query(f"SELECT p_partkey, CASE {_TYPE} WHEN 'law' THEN 100 WHEN 'order' THEN 90 WHEN 'methodological_guideline' THEN 70 WHEN 'supreme_court_decision' THEN 50 ELSE 30 END AS weight FROM part")
def priority_weight_part(spark, sf_dir):
    return priority_weight(map_document_type(table(spark, sf_dir, "part", "p_partkey", "p_type"), "p_type", TYPES)).select("p_partkey", "weight")


@query(f"SELECT doc_id, {_CLASS} AS priority FROM documents")
def priority_class_documents(spark, sf_dir):
    return _weighed(spark, sf_dir).select("doc_id", "priority")


@query(f"SELECT 'type' AS level, source AS value, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'priority', {_CLASS}, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM documents")
def priority_stats_documents(spark, sf_dir):
    return priority_stats(_weighed(spark, sf_dir))


@query(f"SELECT doc_id, rank, CASE c WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS step FROM (SELECT doc_id, {_CLASS} AS c, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= CASE c WHEN 'high' THEN 100 WHEN 'medium' THEN 50 ELSE 20 END")
def quota_per_type_documents(spark, sf_dir):
    return quota_per_type(_weighed(spark, sf_dir), "doc_id").select("doc_id", "rank", "step")


@query("SELECT section, page, doc_id, rank FROM (SELECT lang AS section, doc_id // 40 AS page, doc_id, row_number() OVER (PARTITION BY lang, doc_id // 40 ORDER BY doc_id) AS rank FROM documents) WHERE page <= least(15, 20) AND rank <= 10")
def quota_per_page_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "lang").select("doc_id", F.col("lang").alias("section"), F.expr("doc_id div 40").alias("page"), F.lit(20).alias("total_pages"))
    return quota_per_page(d, "doc_id", 15).select("section", "page", "doc_id", "rank")


_HITS = "WITH s(name, q) AS (VALUES ('license', 'license'), ('tion', 'ciónes de'), ('und', ' und '), ('none', 'no such words')), h AS (SELECT name, doc_id, text, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS rank FROM documents JOIN s ON contains(text, q)) "


@query(_HITS + "SELECT name, min(doc_id) AS doc_id FROM h WHERE rank <= 3 AND length(text) >= 100 GROUP BY name")
def key_document_lookup_documents(spark, sf_dir):
    return key_document_lookup(table(spark, sf_dir, "documents", "doc_id", "text"), SEARCHES)


@query(_HITS + "SELECT name, count(*) AS documents_found, string_agg('Document ' || doc_id || ' doc/' || doc_id, ',' ORDER BY doc_id) FILTER (rank <= 5) AS documents FROM h GROUP BY name")
def key_search_summary_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", "text", F.concat(F.lit("Document "), "doc_id").alias("title"), F.concat(F.lit("doc/"), "doc_id").alias("url"))
    return key_search_summary(d, SEARCHES).withColumn("documents", F.array_join(F.transform("documents", lambda x: F.concat_ws(" ", x["title"], x["url"])), ","))
