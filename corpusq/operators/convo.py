"""Conversations: titles, history windows, listings, details, deletion, counts, exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusq.registry import query, table


def conversation_titles(messages: DataFrame) -> DataFrame:
    """First 100 characters of each conversation's first user message."""
    return messages.where("role = 'user'").groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 100).alias("title"))


def history_window(messages: DataFrame, at: DataFrame, first: int = 10, last: int = 5, order: str = "oldest") -> DataFrame:
    """User messages that a prompt takes in for ``at(conv_id, before)``, in order.

    Of the ``first`` oldest messages of the conversation those before the turn, of these the ``last``, of these
    the user's. With ``order="latest"`` the messages right before the turn count instead.
    """
    w = W.partitionBy("conv_id")
    m = messages.withColumn("_n", F.row_number().over(w.orderBy("turn")))
    m = m.join(at.select("conv_id", "before"), "conv_id").where("turn < before")
    m = m.where(F.col("_n") <= first) if order == "oldest" else m
    m = m.withColumn("_b", F.row_number().over(w.orderBy(F.desc("turn")))).where((F.col("_b") <= last) & (F.col("role") == "user"))
    return m.select("conv_id", "turn", "text")


def conversation_list(conversations: DataFrame, user: str, updated: str, key: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of each user's conversations, last updated first."""
    n = F.row_number().over(W.partitionBy(user).orderBy(F.desc(updated), key))
    return conversations.withColumn("rank", n).where(F.col("rank").between(offset + 1, offset + limit))


def conversation_detail(messages: DataFrame, owned: DataFrame) -> DataFrame:
    """Messages of the conversations in ``owned(conv_id)``; rank gives their order."""
    m = messages.join(owned.select("conv_id"), "conv_id", "left_semi")
    return m.withColumn("rank", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))


def conversation_delete(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Conversations or messages without those of the conversations in ``gone``."""
    return rows.join(gone.select("conv_id"), "conv_id", "left_anti")


def conversation_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages_count"), F.count_if(F.col("role") == "user").alias("user_count"), F.count_if(F.col("role") == "assistant").alias("assistant_count"))


def turn_pairs(messages: DataFrame) -> DataFrame:
    """User messages with the assistant message that follows at once."""
    w = W.partitionBy("conv_id").orderBy("turn")
    m = messages.withColumn("answer", F.lead("text").over(w)).withColumn("_r", F.lead("role").over(w))
    return m.where("role = 'user' and _r = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@query("SELECT conv_id, min_by(text, turn)[:100] AS title FROM conversations WHERE role = 'user' GROUP BY conv_id")
def conversation_titles_conversations(spark, sf_dir):
    return conversation_titles(_messages(spark, sf_dir))


@query("""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), q AS (SELECT conv_id, max(turn) AS b FROM conversations GROUP BY conv_id),
h AS (SELECT m.*, row_number() OVER (PARTITION BY m.conv_id ORDER BY turn DESC) AS r FROM m JOIN q ON q.conv_id = m.conv_id AND m.turn < q.b WHERE n <= 10)
SELECT conv_id, turn, text FROM h WHERE r <= 5 AND role = 'user'
""")
def history_window_conversations(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return history_window(m, m.groupBy("conv_id").agg(F.max("turn").alias("before")))


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank BETWEEN 3 AND 12")
def conversation_list_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    return conversation_list(o, "o_custkey", "o_orderdate", "o_orderkey", 10, 2).select("o_custkey", "o_orderkey", "rank")


def _owned(spark, sf_dir):
    owner = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("conv_id") % 3 + 1).cast("int"))
    return _messages(spark, sf_dir).select("conv_id", owner.alias("owner")).distinct().where("owner = 'b'")


@query("SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations WHERE conv_id % 3 = 1")
def conversation_detail_conversations(spark, sf_dir):
    return conversation_detail(_messages(spark, sf_dir), _owned(spark, sf_dir)).select("conv_id", "turn", "role", "text", "rank")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id % 3 <> 1")
def conversation_delete_conversations(spark, sf_dir):
    return conversation_delete(_messages(spark, sf_dir), _owned(spark, sf_dir)).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, count(*) AS messages_count, count(*) FILTER (role = 'user') AS user_count, count(*) FILTER (role = 'assistant') AS assistant_count FROM conversations GROUP BY conv_id")
def conversation_counts_conversations(spark, sf_dir):
    return conversation_counts(_messages(spark, sf_dir))


@query("SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant'")
def turn_pairs_conversations(spark, sf_dir):
    return turn_pairs(_messages(spark, sf_dir))
