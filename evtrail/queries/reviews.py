"""Context expansion and group review over event messages and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtrail.operators import context, evidence, relations
from evtrail.operators import windows as W
from evtrail.scratch import written
from evtrail.sources.tables import EVENT_MESSAGES_SQL as M
from evtrail.sources.tables import ORDER_DRAFTS_SQL as D
from evtrail.sources.tables import event_messages, order_drafts

from .registry import query
from .windows import _ANCHORS, _WINDOWS, _header


@query(f"WITH {M} SELECT conversation_id, message_id FROM m WHERE message_id % 9 = 0 AND conversation_id % 2 = 0")
def j8_messages_by_id(spark, d):
    msgs = event_messages(spark, d)
    ids = msgs.where("message_id % 9 = 0").select((F.col("conversation_id") + F.col("conversation_id") % 2 * 1000000).alias("conversation_id"), "message_id")
    return context.messages_by_id(ids, msgs).select("conversation_id", "message_id")


def _round_sql(n: int) -> str:
    """The rows that round n adds, as SQL over the rounds before."""
    return f"""
q{n} AS (SELECT q.s, q.kind, q.block, m.conversation_id, m.message_id, m.idx FROM q JOIN k{n - 1} k ON k.s = q.s AND k.message_id = q.message_id JOIN m ON m.message_id = q.message_id WHERE q.round = {n}),
t{n} AS (SELECT s, kind, block, min(message_id) AS message_id FROM q{n} WHERE kind IN ('attachment', 'linked_text') AND block % 10 < 7 AND message_id = block // 10 {"AND NOT EXISTS (SELECT 1 FROM t1 WHERE t1.s = q2.s AND t1.kind = q2.kind AND t1.block = q2.block)" if n == 2 else ""} GROUP BY 1, 2, 3),
e{n} AS (SELECT s, conversation_id, kind, min(idx) AS lo, max(idx) AS hi FROM q{n} WHERE kind IN ('earlier', 'later') GROUP BY 1, 2, 3),
n{n} AS (SELECT DISTINCT s, m.message_id, m.reply_to FROM e{n} e JOIN m USING (conversation_id) WHERE (kind = 'later' AND idx BETWEEN hi + 1 AND hi + 7) OR (kind = 'earlier' AND idx BETWEEN lo - 7 AND lo - 1)),
a{n} AS (SELECT s, message_id, 'temporal' AS kind FROM n{n} WHERE (s, message_id) NOT IN (SELECT (s, message_id) FROM k{n - 1})
  UNION SELECT s, reply_to, 'relation' FROM n{n} WHERE reply_to IS NOT NULL AND (s, reply_to) NOT IN (SELECT (s, message_id) FROM k{n - 1}) AND (s, reply_to) NOT IN (SELECT (s, message_id) FROM n{n})),
k{n} AS (SELECT * FROM k{n - 1} UNION SELECT s, message_id FROM a{n})"""


@query(f"""WITH {M}, k0 AS (SELECT conversation_id AS s, message_id FROM m WHERE owner AND k % 4 = 0),
q AS (SELECT conversation_id AS s, 1 AS round, CASE WHEN conversation_id % 2 = 0 THEN 'later' ELSE 'earlier' END AS kind, message_id, NULL::BIGINT AS block FROM m WHERE k % 3 = 0
  UNION ALL SELECT conversation_id, 2, CASE WHEN k % 2 = 0 THEN 'later' ELSE 'earlier' END, message_id, NULL FROM m WHERE NOT owner
  UNION ALL SELECT conversation_id, 1 + k % 2, CASE WHEN k % 5 = 0 THEN 'attachment' ELSE 'linked_text' END, message_id, message_id * 10 + k % 10 FROM m WHERE k % 3 = 1),
{_round_sql(1)}, {_round_sql(2)}
SELECT s AS slice_id, 1 AS round, kind, message_id, NULL::BIGINT AS block_id FROM a1 UNION ALL SELECT s, 2, kind, message_id, NULL FROM a2
UNION ALL SELECT s, 1, kind, message_id, block FROM t1 UNION ALL SELECT s, 2, kind, message_id, block FROM t2""")
def j10_expand_context(spark, d):
    msgs = written(event_messages(spark, d), "messages")
    slices = msgs.where("owner and k % 4 = 0").select(F.col("conversation_id").alias("slice_id"), "conversation_id", "message_id")
    none, own = F.lit(None).cast("long"), F.col("message_id") * 10 + F.col("k") % 10
    ask = lambda rows, n, kind, block: rows.select(F.col("conversation_id").alias("slice_id"), n.alias("round"), kind.alias("request_type"), "message_id", block.alias("block_id"))
    even = lambda c: F.when(F.col(c) % 2 == 0, "later").otherwise("earlier")
    text = F.when(F.col("k") % 5 == 0, "attachment").otherwise("linked_text")
    requests = ask(msgs.where("k % 3 = 0"), F.lit(1), even("conversation_id"), none).union(ask(msgs.where("not owner"), F.lit(2), even("k"), none)).union(ask(msgs.where("k % 3 = 1"), F.col("k") % 2 + 1, text, own))
    blocks = msgs.select(text.alias("kind"), "message_id", own.alias("block_id")).where("block_id % 10 < 7")
    return context.expand_context(slices, requests, msgs, blocks)


@query(f"""WITH {M}, {_ANCHORS}, t AS (SELECT conversation_id, run, greatest(first - 2, 1) AS first, last + 2 AS last FROM a WHERE run IS NOT NULL),
z AS (SELECT m.conversation_id, m.idx, min(t.run) AS run FROM m LEFT JOIN t ON t.conversation_id = m.conversation_id AND m.idx BETWEEN t.first AND t.last WHERE m.reacted AND NOT m.owner GROUP BY 1, 2)
SELECT conversation_id, first::INT AS first, last::INT AS last, (SELECT count(*) FROM z WHERE z.conversation_id = t.conversation_id AND z.run = t.run) AS reactions FROM t
UNION ALL SELECT conversation_id, greatest(idx - 2, 1), idx + 2, 1 FROM z WHERE run IS NULL""")
def w6_anchor_units(spark, d):
    return context.anchor_units(event_messages(spark, d), 2, 2).drop("unit")


@query(f"""WITH {M}, {_WINDOWS}, x AS (SELECT DISTINCT h.conversation_id, "window", m.message_id, m.owner, m.reacted, m.mentions_owner, m.reply_to FROM h JOIN m ON m.conversation_id = h.conversation_id AND m.idx BETWEEN first AND last)
SELECT conversation_id || ':' || "window"::BIGINT AS segment, message_id FROM x WHERE owner OR reacted OR mentions_owner OR reply_to IN (SELECT message_id FROM m WHERE owner)""")
def f22_self_evidence(spark, d):
    msgs, header = _header(spark, d)
    members = W.window_members(header, msgs, 0).select(F.concat_ws(":", "conversation_id", "window").alias("segment"), "conversation_id", "message_id")
    return context.self_evidence(members, msgs)


@query(f"""WITH {M}, {_WINDOWS}, x AS (SELECT *, unnest(range(greatest(first - 2, 1), last + 1)) AS idx FROM h) SELECT conversation_id || ':' || "window"::BIGINT AS slice_id, m.message_id, CASE WHEN x.idx < first THEN 'context' ELSE 'primary' END AS role FROM x JOIN m USING (conversation_id, idx)""")
def f25_slices(spark, d):
    msgs, header = _header(spark, d)
    return context.to_slices(W.window_members(header, msgs))


@query()
def w16_split_windows(spark, d):
    """Tests check that parts keep the order, cover all rows and are under the target or single."""
    msgs, header = _header(spark, d)
    rows = W.window_members(header, msgs).select(F.concat_ws(":", "conversation_id", "window").alias("window_id"), F.col("idx").alias("pos"), F.lit(600).alias("ascii"), F.lit(0).alias("other"))
    return context.split_windows(rows, 1200)


@query()
def w16_split_units(spark, d):
    """Windows cut by anchors, rows, attachments and linked texts; tests hold the operator against plain recursion."""
    msgs, header = _header(spark, d)
    at = W.window_members(header, msgs).join(msgs.select("conversation_id", "message_id", "owner", "k"), ["conversation_id", "message_id"])
    at = written(at.withColumn("unit_id", F.concat_ws(":", "conversation_id", "window")), "units")
    rows = at.select("unit_id", "message_id", F.col("idx").alias("pos"), (F.col("role") == "main").alias("main"), (F.col("owner") & (F.col("role") == "main")).alias("anchor"), (F.col("k") * 9).alias("ascii"), F.lit(0).alias("other"))
    kind = F.when(F.col("k") % 3 == 0, "attachment").otherwise("linked")
    texts = at.where("k % 2 = 0").select("unit_id", kind.alias("kind"), F.explode(F.sequence(F.lit(1), F.col("k") % 4 + 1)).alias("n"), "message_id", "k").select("unit_id", "kind", (F.col("message_id") * 10 + F.col("n")).alias("block_id"), "message_id", (F.col("k") * 20).alias("ascii"), F.lit(0).alias("other"))
    cut, kept = context.split_units(rows, texts, W.direct_links(msgs), 700)
    n = kept.groupBy("unit_id").agg(F.count("*").alias("texts"))
    return cut.groupBy("unit_id").agg(F.count_if("main").alias("mains"), F.count_if("anchor").alias("anchors"), F.count("*").alias("rows"), F.first("oversized").alias("oversized")).join(n.hint("merge"), "unit_id", "left").fillna(0, ["texts"])


@query(f"""WITH RECURSIVE {M}, {_WINDOWS}, x AS (SELECT *, unnest(range(greatest(first - 6, 1), last + 1)) AS idx FROM h), y AS (SELECT conversation_id || ':' || "window"::BIGINT AS s, x.idx, CASE WHEN x.idx < first THEN 1 ELSE 0 END AS r, message_id % 700 AS a FROM x JOIN m USING (conversation_id, idx)),
z AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY r, idx) AS n FROM y), p AS (SELECT s, n, idx, true AS kept, a::BIGINT AS held FROM z WHERE n = 1 UNION ALL SELECT z.s, z.n, z.idx, f, p.held + CASE WHEN f THEN z.a ELSE 0 END FROM p JOIN z ON z.s = p.s AND z.n = p.n + 1, LATERAL (SELECT z.r = 0 OR ((p.held + z.a) * 5 + 11) // 12 + 200 <= 900 AS f))
SELECT s AS slice_id, idx::BIGINT AS pos FROM p WHERE kept""")
def w17_limit_context(spark, d):
    msgs, header = _header(spark, d)
    rows = W.window_members(header, msgs, 6).select(F.concat_ws(":", "conversation_id", "window").alias("slice_id"), F.col("idx").alias("pos"), F.when(F.col("role") == "main", "main").otherwise("temporal").alias("kind"), (F.col("message_id") % 700).alias("ascii"), F.lit(0).alias("other"))
    return context.limit_context(rows, 900)


_PAIRS = "k AS (SELECT DISTINCT draft_id, evidence FROM d), p AS (SELECT DISTINCT x.draft_id AS a, y.draft_id AS b FROM k x JOIN k y ON x.evidence = y.evidence AND x.draft_id < y.draft_id)"


def _pairs(spark, d):
    return relations.evidence_pairs(order_drafts(spark, d).select("draft_id", F.col("evidence").alias("key")).distinct())


@query(f"""WITH RECURSIVE {D}, {_PAIRS}, s AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(id, c) USING KEY (id) AS (SELECT DISTINCT a, a FROM s UNION SELECT s.b, min(r.c) FROM r JOIN s ON s.a = r.id JOIN recurring.r AS o ON o.id = s.b WHERE r.c < o.c GROUP BY s.b)
SELECT id AS group_id, c AS component, dense_rank() OVER (ORDER BY c) AS number FROM r""")
def g2_review_components(spark, d):
    groups = order_drafts(spark, d).select(F.col("draft_id").alias("group_id")).distinct()
    keys = order_drafts(spark, d).select("draft_id", F.col("evidence").alias("key")).distinct()
    return evidence.review_components(groups, relations.hub_links(keys))


@query(f"""WITH {D}, k AS (SELECT DISTINCT draft_id, evidence FROM d), h AS (SELECT evidence, min(draft_id) AS b FROM k GROUP BY 1), p AS (SELECT DISTINCT draft_id AS a, b FROM k JOIN h USING (evidence) WHERE draft_id <> b),
c AS (SELECT conversation AS c, min(draft_id) AS lo, max(draft_id) AS hi FROM d GROUP BY 1), t AS (SELECT x.c, x.lo, x.hi, y.lo AS other FROM c x JOIN c y ON y.c = x.c + 1 WHERE x.c % 3 = 0), q AS (SELECT draft_id, min(evidence) AS part FROM k GROUP BY 1),
s AS (SELECT a || '-' || b AS rel, '0' AS side, a AS draft, true AS st FROM p UNION ALL SELECT a || '-' || b, '1', b, true FROM p UNION SELECT 't' || t.c, conversation::VARCHAR, draft_id, false FROM t JOIN d ON conversation IN (t.c, t.c + 1)),
u AS (SELECT *, (a * 7 + b) % 10 AS h FROM p),
res AS (SELECT a || '-' || b AS rel, CASE WHEN h = 2 THEN 'other' WHEN (a + b) % 3 = 0 THEN 'merged' ELSE 'separate' END AS decision, CASE WHEN h IN (3, 4) THEN [] WHEN h = 5 THEN [a] ELSE [a, b] END AS conn, [qa.part] || CASE WHEN h % 2 = 0 THEN [qb.part] ELSE [] END AS ev
  FROM u JOIN q qa ON qa.draft_id = a JOIN q qb ON qb.draft_id = b, unnest(range(0, CASE h WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END)) WHERE true
  UNION ALL SELECT 't' || c, CASE WHEN c % 5 < 2 THEN 'merged' ELSE 'separate' END, CASE c % 4 WHEN 0 THEN [] WHEN 1 THEN [lo, other] WHEN 2 THEN [lo, hi] ELSE [lo] END, [qa.part] || CASE WHEN c % 7 > 0 THEN [qb.part] ELSE [] END FROM t JOIN q qa ON qa.draft_id = lo JOIN q qb ON qb.draft_id = other
  UNION ALL SELECT 'nope', 'merged', [], []),
kn AS (SELECT rel, count(DISTINCT side) AS sides, bool_or(st) AS st FROM s GROUP BY 1), one AS (SELECT res.*, sides, st FROM res JOIN kn USING (rel) WHERE rel IN (SELECT rel FROM res GROUP BY rel HAVING count(*) = 1)),
na AS (SELECT DISTINCT rel, unnest(conn) AS draft FROM one), ne AS (SELECT rel, draft::VARCHAR AS side, draft FROM na UNION SELECT rel, side, draft FROM s JOIN one USING (rel) WHERE len(conn) = 0),
be AS (SELECT DISTINCT rel FROM (SELECT rel, side, bool_or(k.draft_id IS NOT NULL) AS met FROM ne JOIN one USING (rel) LEFT JOIN k ON k.draft_id = draft AND list_contains(ev, k.evidence) GROUP BY 1, 2) WHERE NOT met),
jo AS (SELECT DISTINCT rel FROM (SELECT rel FROM s GROUP BY rel, draft % 4 HAVING count(DISTINCT side) > 1)),
f AS (SELECT one.*, rel IN (SELECT rel FROM jo) AS joined, (SELECT count(*) FROM na WHERE na.rel = one.rel) AS drafts, (SELECT count(DISTINCT draft % 4) FROM na WHERE na.rel = one.rel) AS groups, (SELECT count(DISTINCT s.side) FROM na JOIN s ON s.rel = na.rel AND s.draft = na.draft WHERE na.rel = one.rel) AS hit FROM one),
g AS (SELECT *, decision = 'merged' OR (decision = 'separate' AND drafts > 0) AS two FROM f)
SELECT rel AS relation_id, 'unknown_relation' AS error FROM res WHERE rel NOT IN (SELECT rel FROM kn) UNION ALL SELECT rel, 'unresolved' FROM kn WHERE rel NOT IN (SELECT rel FROM res) UNION ALL SELECT rel, 'repeated' FROM res WHERE rel IN (SELECT rel FROM kn) GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT rel, 'side_without_evidence' FROM be UNION ALL SELECT rel, 'invalid_decision' FROM g WHERE decision NOT IN ('merged', 'separate') UNION ALL SELECT rel, 'fewer_than_two_drafts' FROM g WHERE two AND drafts < 2
UNION ALL SELECT rel, 'merged_not_reflected' FROM g WHERE decision = 'merged' AND (groups > 1 OR NOT joined) UNION ALL SELECT rel, 'representatives_together' FROM g WHERE decision = 'separate' AND drafts > 0 AND groups < 2
UNION ALL SELECT rel, 'separate_contradicted' FROM g WHERE decision = 'separate' AND drafts = 0 AND joined UNION ALL SELECT rel, 'structural_not_named' FROM g WHERE two AND st AND hit < sides UNION ALL SELECT rel, 'one_side_only' FROM g WHERE two AND NOT st AND hit < 2""")
def v6_audit_resolutions(spark, d):
    rows = written(order_drafts(spark, d), "order-drafts")
    keys = written(rows.select("draft_id", F.col("evidence").alias("key")).distinct(), "keys")
    ties = written(relations.hub_links(keys), "ties").select("a", "b", F.concat_ws("-", "a", "b").alias("relation_id"), ((F.col("a") * 7 + F.col("b")) % 10).alias("h"))
    part = written(keys.groupBy("draft_id").agg(F.min("key").alias("part")), "parts")
    of = rows.groupBy(F.col("conversation").alias("c")).agg(F.min("draft_id").alias("lo"), F.max("draft_id").alias("hi"))
    titles = of.where("c % 3 = 0").join(of.select((F.col("c") - 1).alias("c"), F.col("lo").alias("other")), "c")
    name = F.concat(F.lit("t"), "c").alias("relation_id")
    both = titles.select(name, F.explode(F.array("c", F.col("c") + 1)).alias("conversation")).join(rows.select("conversation", "draft_id").distinct(), "conversation")
    side = lambda n, c: ties.select("relation_id", F.lit(n).alias("side"), F.col(c).alias("draft_id"), F.lit(True).alias("structural"))
    sides = side("0", "a").union(side("1", "b")).union(both.select("relation_id", F.col("conversation").cast("string"), "draft_id", F.lit(False)))

    def parts(df, left, right):
        return df.join(part.select(F.col("draft_id").alias(left), F.col("part").alias("pa")), left).join(part.select(F.col("draft_id").alias(right), F.col("part").alias("pb")), right)

    none = F.array().cast("array<bigint>")
    some = lambda x, c: F.array_compact(F.array(x, F.when(c, F.col("pb"))))
    decision = F.when(F.col("h") == 2, "other").when((F.col("a") + F.col("b")) % 3 == 0, "merged").otherwise("separate")
    named = F.when(F.col("h").isin(3, 4), none).when(F.col("h") == 5, F.array("a")).otherwise(F.array("a", "b"))
    answers = parts(ties.where("h <> 0"), "a", "b").select("relation_id", decision.alias("decision"), named.alias("connected_draft_ids"), some(F.col("pa"), F.col("h") % 2 == 0).alias("evidence_message_ids"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("h") == 1, 2).otherwise(1)))).drop("col")
    k = F.col("c") % 4
    told = F.when(k == 0, none).when(k == 1, F.array("lo", "other")).when(k == 2, F.array("lo", "hi")).otherwise(F.array("lo"))
    answers = answers.union(parts(titles, "lo", "other").select(name, F.when(F.col("c") % 5 < 2, "merged").otherwise("separate"), told, some(F.col("pa"), F.col("c") % 7 > 0)))
    answers = answers.union(spark.range(1).select(F.lit("nope"), F.lit("merged"), none, none))
    assign = part.select("draft_id", (F.col("draft_id") % 4).alias("group_id"))
    return evidence.audit_resolutions(sides, answers, assign, keys.select("draft_id", F.col("key").alias("message_id")))


@query(f"""WITH {D}, b AS (SELECT DISTINCT draft_id, conversation AS g FROM d), a AS (SELECT draft_id, CASE WHEN draft_id % 6 = 0 THEN -draft_id ELSE g END AS g FROM b), s AS (SELECT string_agg(draft_id, ',' ORDER BY draft_id::VARCHAR) AS m FROM b GROUP BY g)
SELECT g AS group_id, string_agg(draft_id, ',' ORDER BY draft_id::VARCHAR) NOT IN (SELECT m FROM s) AS was_repaired FROM a GROUP BY g""")
def v4_repair_status(spark, d):
    before = order_drafts(spark, d).select("draft_id", F.col("conversation").alias("group_id")).distinct()
    after = before.withColumn("group_id", F.when(F.col("draft_id") % 6 == 0, -F.col("draft_id")).otherwise(F.col("group_id")))
    return evidence.repair_status(before, after)


_TIES = f"""WITH RECURSIVE {D}, m AS (SELECT DISTINCT conversation AS g, draft_id FROM d), k AS (SELECT DISTINCT conversation AS g, draft_id, evidence FROM d),
e AS (SELECT DISTINCT x.g, x.draft_id AS a, y.draft_id AS b, x.draft_id || '-' || y.draft_id AS id FROM k x JOIN k y ON x.g = y.g AND x.evidence = y.evidence AND x.draft_id < y.draft_id)"""


@query(f"""{_TIES}, l AS (SELECT g, list(draft_id ORDER BY draft_id) AS ms, range(1, count(*) + 1) AS own FROM m GROUP BY 1), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id) AS n FROM e),
f AS (SELECT g, ms, own, 0 AS n, ''::VARCHAR AS ids FROM l UNION ALL SELECT g, ms, CASE WHEN x = y THEN own ELSE list_transform(own, lambda v: CASE WHEN v = greatest(x, y) THEN least(x, y) ELSE v END) END, f.n + 1,
  CASE WHEN x = y THEN ids WHEN ids = '' THEN id ELSE ids || ',' || id END FROM (SELECT f.*, o.id, own[list_position(ms, a)] AS x, own[list_position(ms, b)] AS y FROM f JOIN o ON o.g = f.g AND o.n = f.n + 1) f),
z AS (SELECT g, arg_max(own, n) AS own, arg_max(ids, n) AS ids FROM f GROUP BY 1)
SELECT g AS group_id, ids AS relation_ids, len(list_distinct(own)) AS parts, list_max(map_values(list_histogram(own)))::BIGINT AS covered, len(own) - list_max(map_values(list_histogram(own)))::BIGINT AS uncovered FROM z""")
def g6_evidence_audit(spark, d):
    assign, rel = _ties(spark, d)
    return evidence.evidence_audit(assign, rel)


@query(f"""{_TIES}, s AS (SELECT g, a, b FROM e UNION SELECT g, b, a FROM e), r(g, id, c) USING KEY (g, id) AS (SELECT g, draft_id, draft_id FROM m UNION SELECT s.g, s.b, min(r.c) FROM r JOIN s ON s.g = r.g AND s.a = r.id JOIN recurring.r AS o ON o.g = s.g AND o.id = s.b WHERE r.c < o.c GROUP BY s.g, s.b),
n AS (SELECT g, c, count(*) AS n FROM r GROUP BY 1, 2), t AS (SELECT g, arg_min(c, (-n, c)) AS c FROM n GROUP BY 1)
SELECT r.g AS group_id, r.id AS draft_id, r.c AS component, r.c = t.c AS covered FROM r JOIN t USING (g)""")
def g6_evidence_members(spark, d):
    return evidence.evidence_members(*_ties(spark, d))


def _ties(spark, d):
    """Orders of a customer are a group, a part that two of its orders have ties them."""
    rows = order_drafts(spark, d)
    assign = rows.select("draft_id", F.col("conversation").alias("group_id")).distinct()
    keys = rows.select("draft_id", F.concat_ws("|", "conversation", "evidence").alias("key")).distinct()
    return assign, relations.key_pairs(keys).select("a", "b").distinct().select(F.concat_ws("-", "a", "b").alias("relation_id"), F.array("a", "b").alias("draft_ids"))
