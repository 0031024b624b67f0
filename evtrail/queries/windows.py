"""Windows, ranking and nearest rows over event messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtrail.operators import windows as W
from evtrail.scratch import written
from evtrail.sources.tables import EVENT_MESSAGES_SQL as M
from evtrail.sources.tables import EVENT_REACTIONS_SQL, event_messages, event_reactions

from .registry import query

GAP = 600
_RUNS = """
r AS (SELECT *, sum(CASE WHEN owner AND NOT coalesce(prev, false) THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY idx) AS run FROM (SELECT *, lag(owner) OVER (PARTITION BY conversation_id ORDER BY idx) AS prev FROM m))
"""
_ANCHORS = (
    _RUNS
    + """,
u AS (SELECT conversation_id, run, min(idx) AS first, max(idx) AS last, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS rows FROM r WHERE owner GROUP BY 1, 2
  UNION ALL SELECT conversation_id, NULL, idx, idx, ts, ts, 1 FROM m WHERE reacted AND NOT owner),
a AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY first, last) AS anchor FROM u)
"""
)
_WINDOWS = (
    _ANCHORS
    + f""",
pairs AS (SELECT conversation_id, anchor, lag(anchor) OVER v AS before, lag(last) OVER v AS plast, first, date_diff('microsecond', lag(last_ts) OVER v, first_ts) / 60e6 AS gap FROM a WINDOW v AS (PARTITION BY conversation_id ORDER BY anchor)),
mem AS (SELECT m.conversation_id, m.message_id, a.anchor FROM m JOIN a ON m.conversation_id = a.conversation_id AND m.idx BETWEEN a.first AND a.last AND (m.owner OR a.run IS NULL)),
f AS (SELECT p.conversation_id, p.anchor, count(*) AS unrelated FROM pairs p JOIN m ON m.conversation_id = p.conversation_id AND m.idx > p.plast AND m.idx < p.first
  LEFT JOIN mem ON mem.conversation_id = m.conversation_id AND mem.message_id = m.reply_to
  WHERE NOT m.owner AND NOT m.mentions_owner AND NOT coalesce(mem.anchor IN (p.anchor, p.before), false) GROUP BY 1, 2),
s AS (SELECT p.*, coalesce(unrelated, 0) AS unrelated, CASE WHEN before IS NULL OR gap > {GAP} OR coalesce(unrelated, 0) > 3 THEN 1 ELSE 0 END AS fresh FROM pairs p LEFT JOIN f USING (conversation_id, anchor)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY conversation_id ORDER BY anchor) AS win FROM s),
h AS (SELECT n.conversation_id, win AS "window", count(*) AS n_anchors, sum(a.rows)::BIGINT AS anchor_rows, min(a.first)::INT AS first, max(a.last)::INT AS last, date_diff('microsecond', min(first_ts), max(last_ts)) / 60e6 AS span_minutes FROM n JOIN a USING (conversation_id, anchor) GROUP BY 1, 2)
"""
)


def _header(spark, d):
    msgs = written(event_messages(spark, d), "messages")  # numbered once, read by every branch of the joins
    return msgs, W.window_header(W.anchor_windows(msgs, GAP))


@query(f"WITH {M}, {_RUNS} SELECT conversation_id, run::BIGINT AS run, count(*) AS n, min(idx)::INT AS first, max(idx)::INT AS last FROM r WHERE owner GROUP BY 1, 2")
def w1_owner_runs(spark, d):
    return W.owner_runs(event_messages(spark, d)).groupBy("conversation_id", "run").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"))


@query(f"""WITH {M}, {EVENT_REACTIONS_SQL}, {_RUNS}, t AS (SELECT conversation_id, run, min(idx) AS first, max(idx) AS last, count(*) AS rows FROM r WHERE owner GROUP BY 1, 2),
u AS (SELECT conversation_id, first, last, rows, rows + (SELECT count(*) FROM sg WHERE sg.owner AND sg.conversation_id = t.conversation_id AND sg.idx BETWEEN first AND last) AS signals, 0 AS pos FROM t
  UNION ALL SELECT conversation_id, idx, idx, 1, 1, pos FROM sg WHERE NOT owner)
SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY first, last, pos)::INT AS anchor, first::INT AS first, last::INT AS last, rows::BIGINT AS rows, signals::BIGINT AS signals FROM u""")
def w2_anchors(spark, d):
    return W.build_anchors(event_messages(spark, d), event_reactions(spark, d)).select("conversation_id", "anchor", "first", "last", "rows", "signals")


@query(f"WITH {M}, {_WINDOWS} SELECT conversation_id, \"window\"::BIGINT AS \"window\", n_anchors, anchor_rows, first, last, round(span_minutes, 3) AS span_minutes FROM h")
def w3_anchor_windows(spark, d):
    return _header(spark, d)[1].withColumn("span_minutes", F.round("span_minutes", 3))


@query(f"WITH {M}, {_WINDOWS}, x AS (SELECT *, unnest(range(greatest(first - 2, 1), last + 1)) AS idx FROM h) SELECT conversation_id, \"window\"::BIGINT AS \"window\", m.message_id, CASE WHEN x.idx < first THEN 'timeline' ELSE 'main' END AS role FROM x JOIN m USING (conversation_id, idx)")
def w5_window_members(spark, d):
    msgs, header = _header(spark, d)
    return W.window_members(header, msgs).drop("idx")


@query(f"""WITH {M}, {_WINDOWS}, x AS (SELECT h.conversation_id, "window", m.message_id, m.reply_to FROM h JOIN m ON m.conversation_id = h.conversation_id AND m.idx BETWEEN first AND last),
k AS (SELECT x.conversation_id, "window", m.message_id FROM x JOIN m ON m.conversation_id = x.conversation_id AND m.reply_to = x.message_id UNION SELECT x.conversation_id, "window", x.reply_to FROM x WHERE x.reply_to IS NOT NULL)
SELECT conversation_id, "window"::BIGINT AS "window", message_id FROM k WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.conversation_id = k.conversation_id AND x."window" = k."window" AND x.message_id = k.message_id)""")
def j2_window_relations(spark, d):
    msgs, header = _header(spark, d)
    return W.window_relations(W.window_members(header, msgs), msgs).select("conversation_id", "window", "message_id")


@query(f"WITH {M}, {_ANCHORS}, x AS (SELECT *, unnest(range(greatest(first - 2, 1), last + 3)) AS idx FROM a) SELECT conversation_id, anchor::INT AS anchor, message_id FROM x JOIN m USING (conversation_id, idx)")
def j6_base_window(spark, d):
    msgs = event_messages(spark, d)
    return W.base_window(W.build_anchors(msgs), msgs, 2, 2).select("conversation_id", "anchor", "message_id")


@query(f"WITH {M}, e AS (SELECT conversation_id, max(idx) AS edge FROM m WHERE owner GROUP BY 1), x AS (SELECT conversation_id, edge, unnest(range(edge + 1, edge + 8)) AS idx FROM e) SELECT conversation_id AS request_id, message_id FROM x JOIN m USING (conversation_id, idx)")
def j7_nearest_later(spark, d):
    msgs = event_messages(spark, d)
    requests = msgs.where("owner").select(F.col("conversation_id").alias("request_id"), "conversation_id", "idx")
    return W.nearest_messages(requests, msgs, "later", 7).select("request_id", "message_id")


@query(f"""WITH RECURSIVE {M}, a(start_id, message_id, depth) AS (SELECT message_id, reply_to, 1 FROM m WHERE owner AND reply_to IS NOT NULL UNION SELECT a.start_id, m.reply_to, a.depth + 1 FROM a JOIN m ON m.message_id = a.message_id WHERE m.reply_to IS NOT NULL)
SELECT start_id, message_id, depth::INT AS depth FROM a""")
def j4_reply_ancestors(spark, d):
    msgs = event_messages(spark, d)
    return W.reply_ancestors(msgs.where("owner").select("message_id"), msgs)


@query(f"""WITH {M}, x AS (SELECT *, idx - max(CASE WHEN owner THEN idx END) OVER (PARTITION BY conversation_id ORDER BY idx) AS back, min(CASE WHEN owner THEN idx END) OVER (PARTITION BY conversation_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - idx AS ahead FROM m),
y AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY CASE WHEN owner THEN 0 WHEN reacted THEN 1 ELSE 2 END, least(back, ahead) ASC NULLS LAST, idx) AS rank FROM x) SELECT conversation_id, message_id, rank::INT AS rank FROM y WHERE rank <= 20""")
def w7_trim_conversation(spark, d):
    priority = F.when(F.col("owner"), 0).when(F.col("reacted"), 1).otherwise(2)
    return W.trim_conversation(event_messages(spark, d), 20, priority).select("conversation_id", "message_id", "rank")


@query(f"""WITH {M}, {EVENT_REACTIONS_SQL}, s AS (SELECT conversation_id, 'text:' || message_id AS signal_id, message_id, ts FROM m WHERE owner UNION ALL SELECT conversation_id, signal_id, message_id, action_time FROM sg)
SELECT conversation_id, signal_id, message_id, row_number() OVER (PARTITION BY conversation_id ORDER BY ts, signal_id)::INT AS pos FROM s""")
def w8_response_signals(spark, d):
    return W.response_signals(event_messages(spark, d), event_reactions(spark, d)).select("conversation_id", "signal_id", "message_id", "pos")


@query(f"WITH {M} SELECT conversation_id, message_id FROM m WHERE NOT owner AND reply_to IS NULL AND mentions_other AND NOT mentions_owner")
def w9_hard_boundaries(spark, d):
    return W.hard_boundaries(event_messages(spark, d)).select("conversation_id", "message_id")


@query(f"WITH {M}, x AS (SELECT *, sum(CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY idx) AS n FROM m) SELECT conversation_id, message_id, 'turn-' || lpad(greatest(n, 1)::BIGINT::VARCHAR, 3, '0') AS segment FROM x")
def w10_segments(spark, d):
    msgs = event_messages(spark, d)
    return W.segments_from_starts(msgs, msgs.where("k % 7 = 0")).select("conversation_id", "message_id", "segment")


@query(f"""WITH {M}, {_RUNS}, u AS (SELECT conversation_id, run, min(idx) AS first, max(idx) AS last, min(ts) AS first_ts, max(ts) AS last_ts FROM r WHERE owner GROUP BY 1, 2),
g AS (SELECT conversation_id, run::BIGINT AS run, date_diff('microsecond', lag(last_ts) OVER v, first_ts) / 60e6 AS gap, first - lag(last) OVER v - 1 AS rows_between FROM u WINDOW v AS (PARTITION BY conversation_id ORDER BY first)) , e AS (SELECT DISTINCT conversation_id, run::BIGINT AS run, k % 4 AS e FROM r WHERE owner AND k % 3 > 0), o AS (SELECT run_of.*, (SELECT max(p.run) FROM (SELECT DISTINCT conversation_id, run FROM r WHERE owner) p WHERE p.conversation_id = run_of.conversation_id AND p.run < run_of.run) AS before FROM (SELECT DISTINCT conversation_id, run::BIGINT AS run FROM r WHERE owner) run_of)
SELECT conversation_id, run, round(gap, 3) AS gap_minutes, rows_between::INT AS rows_between, CASE WHEN EXISTS (SELECT 1 FROM e x JOIN e y ON x.e = y.e WHERE x.conversation_id = g.conversation_id AND y.conversation_id = g.conversation_id AND x.run = g.run AND y.run = o.before) THEN 'same'
  WHEN EXISTS (SELECT 1 FROM e x WHERE x.conversation_id = g.conversation_id AND x.run = g.run) AND EXISTS (SELECT 1 FROM e x WHERE x.conversation_id = g.conversation_id AND x.run = o.before) THEN 'different' ELSE 'unclassified' END AS relation FROM g JOIN o USING (conversation_id, run) WHERE gap IS NOT NULL""")
def w19_anchor_gaps(spark, d):
    msgs = written(event_messages(spark, d), "messages")
    events = msgs.where("k % 3 > 0").select("message_id", (F.col("k") % 4).alias("event_id"))
    return W.anchor_gaps(msgs, events).withColumn("gap_minutes", F.round("gap_minutes", 3))


@query("WITH p AS (SELECT event_type AS stage, sum(value) AS seconds FROM events GROUP BY 1), q AS (SELECT *, seconds / sum(seconds) OVER () AS share, row_number() OVER (ORDER BY seconds DESC, stage) AS rank FROM p) SELECT stage, round(seconds, 2) AS seconds, round(share, 4) AS share, rank::INT AS rank, share >= 0.25 AS slow FROM q WHERE rank <= 5")
def w20_rank_stages(spark, d):
    log = event_messages(spark, d).select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    return W.rank_stages(log).withColumns({"seconds": F.round("seconds", 2), "share": F.round("share", 4)})
