"""The engine's tables from the driver's: each a fixed rule, see the docstrings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages from events: conversation is the user, clicks are the owner's rows, signups rows the owner
    reacted on, errors mention others, views with k below 10 the owner; k divisible by 5 replies to
    the row before."""
    w = Window.partitionBy("conversation_id").orderBy("ts", "message_id")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("conversation_id"), F.col("event_id").alias("message_id"), F.col("ts").cast("timestamp").alias("ts"), k.alias("k"), "value", "event_type",
        (F.col("event_type") == "click").alias("owner"), (F.col("event_type") == "signup").alias("reacted"), (F.col("event_type") == "error").alias("mentions_other"),
        ((F.col("event_type") == "view") & (k < 10)).alias("mentions_owner"),
    )
    return e.withColumn("idx", F.row_number().over(w)).withColumn("reply_to", F.when(F.col("k") % 5 == 0, F.lag("message_id").over(w)))


EVENT_MESSAGES_SQL = r"""
base AS (SELECT user_id AS conversation_id, event_id AS message_id, ts, CAST(regexp_extract(props, '(\d+)', 1) AS INT) AS k, value, event_type,
  event_type = 'click' AS owner, event_type = 'signup' AS reacted, event_type = 'error' AS mentions_other FROM events),
m AS (SELECT *, event_type = 'view' AND k < 10 AS mentions_owner, row_number() OVER w AS idx, CASE WHEN k % 5 = 0 THEN lag(message_id) OVER w END AS reply_to
  FROM base WINDOW w AS (PARTITION BY conversation_id ORDER BY ts, message_id))
"""


def event_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner's reactions on event_messages: one without id on signups, with k divisible by 3 a second one whose id, of ten, comes back
    in its conversation; one with an id and a time of its own on clicks with k divisible by 4."""
    m = event_messages(spark, sf_dir)
    entry = lambda pos, name, minutes: F.struct(F.lit(pos).alias("pos"), name.alias("reaction_id"), (F.col("ts") + F.expr(f"interval {minutes} minutes")).alias("action_time"))
    none = F.lit(None).cast("string")
    marks = F.array_compact(F.array(
        F.when(F.col("reacted"), entry(0, none, 0)), F.when(F.col("reacted") & (F.col("k") % 3 == 0), entry(2, F.concat(F.lit("r"), F.col("k") % 10), 5)),
        F.when(F.col("owner") & (F.col("k") % 4 == 0), entry(0, F.concat(F.lit("o"), "message_id"), 90)),
    ))
    return m.select("conversation_id", "message_id", F.explode(marks).alias("e")).select("conversation_id", "message_id", "e.*")


EVENT_REACTIONS_SQL = """
rx AS (SELECT conversation_id, message_id, idx, ts, owner, 0 AS pos, NULL AS reaction_id, ts AS action_time FROM m WHERE reacted
  UNION ALL SELECT conversation_id, message_id, idx, ts, owner, 2, 'r' || k % 10, ts + INTERVAL 5 MINUTE FROM m WHERE reacted AND k % 3 = 0
  UNION ALL SELECT conversation_id, message_id, idx, ts, owner, 0, 'o' || message_id, ts + INTERVAL 90 MINUTE FROM m WHERE owner AND k % 4 = 0),
sg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id, signal_id ORDER BY idx, pos) AS nth FROM (SELECT *, coalesce(reaction_id, 'reaction:' || message_id || ':' || pos) AS signal_id FROM rx)) WHERE nth = 1)
"""


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages from conversations: the user's turns are the owner's, a turn replies to the one before."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("conversation_id"), F.concat_ws(":", "conv_id", "turn").alias("message_id"), F.col("turn").alias("idx"), (F.col("role") == "user").alias("owner"), (F.col("role") == "system").alias("is_system"), F.lit("text").alias("message_type"), "text")


def order_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(draft_id, evidence, file, conversation, source_file): drafts are the orders, their evidence the parts, files the supplier and part, conversation the customer, source file the nation."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return o.join(c, o.o_custkey == c.c_custkey).join(line, o.o_orderkey == line.l_orderkey).select(F.col("o_orderkey").alias("draft_id"), F.col("l_partkey").alias("evidence"), F.concat_ws(":", "l_suppkey", "l_partkey").alias("file"), F.col("o_custkey").alias("conversation"), F.col("c_nationkey").alias("source_file"))


ORDER_DRAFTS_SQL = """
d AS (SELECT o_orderkey AS draft_id, l_partkey AS evidence, l_suppkey || ':' || l_partkey AS file, o_custkey AS conversation, c_nationkey AS source_file
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey)
"""
