"""Message and keyword filters over conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtrail.operators import filters
from evtrail.sources.tables import chat_messages, event_messages, table

from .registry import query


@query("SELECT conv_id || ':' || turn AS message_id FROM conversations WHERE role <> 'system' AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def f1_filter_messages(spark, d):
    return filters.filter_messages(chat_messages(spark, d)).select("message_id")


@query("SELECT conv_id || ':' || turn AS message_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def f2_exclude_conversations(spark, d):
    msgs = chat_messages(spark, d)
    return filters.exclude_conversations(msgs, msgs.where("is_system")).select("message_id")


@query("SELECT DISTINCT 1::BIGINT AS owner_id, user_id AS conversation_id FROM events WHERE event_type IN ('click', 'signup')")
def f3_target_conversations(spark, d):
    msgs = event_messages(spark, d).withColumn("owner_id", F.lit(1).cast("long"))
    wrote = msgs.select("owner_id", "conversation_id", F.when(F.col("owner"), 1).otherwise(0).alias("sender_open_id"))
    marks = msgs.where("reacted").select("owner_id", "conversation_id", F.lit(1).alias("operator_open_id"))
    return filters.target_conversations(wrote, marks)


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-04'")
def f4_on_day(spark, d):
    return table(spark, d, "events").where(filters.on_day(F.col("ts"), "2024-01-03")).select("event_id")


_KINDS = "CASE WHEN text LIKE '%password%' OR text LIKE '%token%' THEN 'sensitive' WHEN text LIKE '%icense%' OR source LIKE '%src7%' THEN 'excluded' END"


@query(f"SELECT doc_id, {_KINDS} AS reject_kind FROM documents")
def f5_keyword_filter(spark, d):
    docs = table(spark, d, "documents")
    return filters.keyword_filter(docs, ["text", "source"], ("password", "token"), ("icense", "src7"), diagnostics=True).select("doc_id", "reject_kind")


@query(f"SELECT coalesce({_KINDS}, 'kept') AS kind, count(*) AS n FROM documents GROUP BY 1")
def f6_filter_diagnostics(spark, d):
    return f5_keyword_filter(spark, d).groupBy(F.coalesce("reject_kind", F.lit("kept")).alias("kind")).agg(F.count("*").alias("n"))


_POLICY = filters.RetentionPolicy(
    generic_object_hints=("src1", "src2"), personal_social=("clown",), privacy_objects=("src3",), leave_or_travel=("the",), private_reasons=("idiot",),
    generic_review=("moron",), approval_actions=("loser",), administrative=("trash",), substantive=("license",), low_information_suffixes=("x",),
)


def _drafts(spark, d):
    reason = F.when(F.col("doc_id") % 11 == 0, "other").otherwise("decision_made")
    return table(spark, d, "documents").select("doc_id", reason.alias("retention_reason"), F.col("text").alias("content"), F.substring("text", 1, 10).alias("topic"), F.col("source").alias("object_hint"), F.substring("text", 1, 40).alias("retention_detail"))


_RETENTION = r"""
WITH x AS (SELECT doc_id, source AS o, lower(trim(regexp_replace(text[1:10], '\s*\n\s*', chr(10), 'g'), ' ' || chr(10))) AS t, lower(trim(regexp_replace(text, '[ ]*\n', chr(10), 'g'), ' ' || chr(10))) AS c, lower(trim(regexp_replace(text[1:40], '[ ]*\n', chr(10), 'g'), ' ' || chr(10))) AS dt FROM documents),
y AS (SELECT *, t || ' ' || c || ' ' || dt AS three, t || ' ' || c || ' ' || dt || ' ' || o AS four FROM x),
z AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing_or_invalid_retention_reason'
  WHEN contains(o, 'src3') OR (contains(four, 'the') AND contains(four, 'idiot')) THEN 'personal_privacy_or_leave_event'
  WHEN contains(three, 'clown') AND NOT contains(three, 'license') THEN 'personal_social_or_reputation_event'
  WHEN (contains(four, 'moron') OR contains(four, 'loser')) AND contains(four, 'trash') AND NOT contains(four, 'license') THEN 'administrative_approval_event'
  WHEN contains(four, 'moron') AND NOT contains(four, 'license') THEN 'generic_review_completion'
  WHEN o IN ('src1', 'src2') THEN 'missing_or_generic_object_hint'
  WHEN length(dt) < 6 OR dt = t OR dt = c OR dt = o OR (length(dt) <= 16 AND dt = t || 'x') THEN 'missing_or_generic_retention_detail' ELSE '' END AS reason
FROM y)
"""


@query(f"{_RETENTION} SELECT doc_id, reason FROM z")
def f7_retention_cascade(spark, d):
    """F7 with its rules F8 to F14."""
    return _drafts(spark, d).select("doc_id", filters.retention_reason(_POLICY).alias("reason"))


@query("SELECT doc_id FROM documents WHERE list_contains(list_transform(string_split_regex(text, '[\\n.]'), lambda c: contains(c, 'moron') AND contains(c, 'the')), true)")
def f17_assigns_to(spark, d):
    return table(spark, d, "documents").where(filters.assigns_to(F.col("text"), F.lit("moron"), ("the",), r"[\n.]")).select("doc_id")


@query(r"""WITH s AS (SELECT conv_id, count(*) AS n, count(DISTINCT role) AS people FROM conversations GROUP BY 1)
SELECT conv_id AS draft_id, n, people, concat_ws(',', CASE WHEN conv_id % 7 = 0 THEN 'incomplete_facts' END, CASE WHEN n >= 4 THEN 'many_sources' END, CASE WHEN people >= 3 THEN 'many_people' END, CASE WHEN conv_id % 5 = 0 THEN 'risk_flags' END) AS reasons FROM s WHERE n >= 4 OR people >= 3 OR conv_id % 5 = 0 OR conv_id % 7 = 0""")
def f21_select_fact_review(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.concat_ws(":", "conv_id", "turn").alias("message_id"), F.col("role").alias("sender_open_id"))
    flags = F.when(F.col("conv_id") % 5 == 0, F.array(F.lit("multiple_locations"))).otherwise(F.array().cast("array<string>"))
    drafts = c.groupBy("conv_id").agg(F.collect_list("message_id").alias("source_message_ids")).select(F.col("conv_id").alias("draft_id"), "source_message_ids", flags.alias("fact_risk_flags"))
    return filters.select_fact_review(drafts, c, sources=4, incomplete=drafts.where("draft_id % 7 = 0")).select("draft_id", "n", "people", F.array_join("reasons", ",").alias("reasons"))
