"""Sources and memo over conversations, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtrail.sources import chat, sinks
from evtrail.sources.tables import table

from .registry import query


def _raw(spark, d):
    c = table(spark, d, "conversations")
    even = F.to_json(F.struct(F.col("conv_id").cast("string").alias("chat_id"), F.concat_ws(":", "conv_id", "turn").alias("message_id"), F.struct(F.col("role").alias("open_id")).alias("sender"), F.lit("2024-01-02T03:04:05Z").alias("send_time"), F.col("text").alias("text")))
    odd = F.to_json(F.struct(F.struct(F.col("conv_id").cast("string").alias("id")).alias("chat"), F.concat_ws(":", "conv_id", "turn").alias("id"), F.struct(F.struct(F.col("role").alias("openId")).alias("id")).alias("sender"), F.lit("1704164645000").alias("create_time"), F.lit("system").alias("msg_type")))
    return c.select(F.when(F.col("turn") % 2 == 0, even).otherwise(odd).alias("raw"), F.col("turn").alias("ingest_seq"))


@query("SELECT conv_id::VARCHAR AS conversation_id, conv_id || ':' || turn AS message_id, role AS sender_open_id, 1704164645 AS seconds, CASE WHEN turn % 2 = 0 THEN 'unknown' ELSE 'system' END AS message_type, turn % 2 = 1 AS is_system FROM conversations")
def s1_normalize_messages(spark, d):
    return chat.normalize_messages(_raw(spark, d)).select("conversation_id", "message_id", "sender_open_id", F.unix_seconds("send_ts").alias("seconds"), "message_type", "is_system")


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN floor(epoch(ts))::BIGINT - 8 * 3600 ELSE floor(epoch(ts))::BIGINT END AS seconds FROM events")
def s7_event_time(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    form = F.when(F.col("event_id") % 4 == 0, F.unix_millis("ts").cast("string")).when(F.col("event_id") % 4 == 1, F.unix_seconds("ts").cast("string")).when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select("event_id", F.unix_seconds(chat.to_event_ts(form)).alias("seconds"))


@query("SELECT user_id AS message_id, max(event_id) AS ingest_seq FROM events GROUP BY 1")
def s8_dedupe_messages(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("message_id"), F.col("event_id").alias("ingest_seq"))
    return chat.dedupe_messages(e)


@query("WITH l AS (SELECT page_id % 50 AS message_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS url, CASE WHEN page_id % 3 = 0 THEN '' ELSE 't' || page_id END AS title, page_id AS pos FROM pages) SELECT message_id, url, coalesce(first(title ORDER BY pos) FILTER (title <> ''), '') AS title FROM l GROUP BY 1, 2")
def s6_dedupe_links(spark, d):
    title = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("t"), F.col("page_id").cast("string")))
    links = table(spark, d, "pages").select((F.col("page_id") % 50).alias("message_id"), F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("url"), title.alias("title"), F.col("page_id").alias("pos"))
    return chat.dedupe_links(links).select("message_id", "url", "title")


@query("SELECT page_id % 40 AS message_id, url AS attachment_id, min(page_id) AS pos, max(page_id) AS file_name FROM pages GROUP BY 1, 2")
def s5_dedupe_attachments(spark, d):
    rows = table(spark, d, "pages").select((F.col("page_id") % 40).alias("message_id"), F.col("url").alias("attachment_id"), F.col("page_id").alias("pos"), F.col("page_id").alias("file_name"))
    return chat.dedupe_attachments(rows)


@query("SELECT page_id AS message_id, page_id || '#link1' AS link_id, regexp_replace(regexp_replace(url, '(?:</?[A-Za-z][^>]*)+$', ''), '[)>\\]}\"''，。！？、；;]+$', '') AS url, '' AS title, 'normal' AS link_type FROM pages")
def x3_message_links(spark, d):
    none = F.array().cast("array<struct<url:string,title:string>>")
    return chat.message_links(table(spark, d, "pages").select(F.col("page_id").alias("message_id"), F.concat_ws(" ", F.lit("see"), "url", "url", F.lit("now")).alias("text"), none.alias("links")))


@query("SELECT source AS source_file, CASE WHEN bool_or(lang = 'de') THEN 'upstream_merged' WHEN bool_or(lang = 'fr') THEN 'enhanced' ELSE 'legacy' END AS kind FROM documents GROUP BY 1")
def s16_classify_source(spark, d):
    return chat.classify_source(table(spark, d, "documents").select(F.col("source").alias("source_file"), (F.col("lang") == "de").alias("is_merged"), (F.col("lang") == "fr").alias("has_metadata")))


@query("SELECT doc_id AS pos, source || '#' || row_number() OVER (PARTITION BY source ORDER BY doc_id) || ':' || lang AS draft_id FROM documents")
def s17_assign_draft_ids(spark, d):
    return chat.assign_draft_ids(table(spark, d, "documents").select(F.col("source").alias("source_file"), F.col("doc_id").alias("pos"), F.col("lang").alias("event_id"))).select("pos", "draft_id")


@query("SELECT doc_id, text IN (SELECT text FROM documents WHERE doc_id % 3 = 0) AS hit FROM documents")
def s21_split_memo(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    hits, todo = sinks.split_memo(docs, docs.where("doc_id % 3 = 0").select(sinks.input_hash("text").alias("fingerprint"), F.to_json(F.struct("text")).alias("input"), F.lit(1).alias("result")), ("text",))
    return hits.select("doc_id", F.lit(True).alias("hit")).union(todo.select("doc_id", F.lit(False).alias("hit")))
