"""Evidence relations, components, merging, audits and metrics over orders, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtrail.operators import audit, evidence, graph, merge, metrics, packing, relations
from evtrail.sources.tables import ORDER_DRAFTS_SQL as D
from evtrail.sources.tables import order_drafts, table

from .drafts import _LAYERS, _order_layers
from .registry import query


def _keys(spark, d, key="evidence"):
    return order_drafts(spark, d).select("draft_id", F.col(key).alias("key")).distinct()


_K = "k AS (SELECT DISTINCT draft_id, evidence AS key FROM d)"
_PAIRS = f"{_K}, n AS (SELECT draft_id, count(*) AS n FROM k GROUP BY 1), p AS (SELECT x.draft_id AS a, y.draft_id AS b, count(*) AS shared FROM k x JOIN k y ON x.key = y.key AND x.draft_id < y.draft_id GROUP BY 1, 2)"


@query(f"WITH {D}, {_PAIRS} SELECT a, b, shared, shared = x.n AND shared = y.n AS same FROM p JOIN n x ON x.draft_id = a JOIN n y ON y.draft_id = b")
def j12_evidence_pairs(spark, d):
    return relations.evidence_pairs(_keys(spark, d))


@query(f"WITH {D}, {_PAIRS} SELECT a, b, 'MSG-' || printf('%03d', row_number() OVER (ORDER BY a, b)) AS relation_id FROM p")
def j13_relation_catalog(spark, d):
    return relations.relation_catalog(relations.evidence_pairs(_keys(spark, d)).select("a", "b", F.lit("message").alias("kind"))).select("a", "b", "relation_id")


@query(f"WITH {D}, k AS (SELECT DISTINCT draft_id, conversation AS key FROM d), s AS (SELECT key, string_agg(draft_id, ',' ORDER BY draft_id) AS members FROM k GROUP BY 1 HAVING count(*) >= 2), f AS (SELECT min(key) AS key FROM s GROUP BY members) SELECT key AS set_key, draft_id FROM k JOIN f USING (key)")
def j14_conversation_sets(spark, d):
    return relations.conversation_sets(_keys(spark, d, "conversation"))


@query(f"""WITH {D}, x AS (SELECT DISTINCT draft_id, 'part' AS t, evidence::VARCHAR AS key FROM d UNION SELECT draft_id, 'file', file FROM d UNION SELECT draft_id, 'conversation', conversation::VARCHAR FROM d),
p AS (SELECT DISTINCT l.draft_id AS a, r.draft_id AS b, l.t FROM x l JOIN x r ON l.t = r.t AND l.key = r.key AND l.draft_id < r.draft_id), g AS (SELECT DISTINCT draft_id, draft_id % 5 AS g FROM d)
SELECT a, b, string_agg(t, ',' ORDER BY t) AS types FROM p JOIN g x ON x.draft_id = a JOIN g y ON y.draft_id = b WHERE x.g <> y.g GROUP BY 1, 2""")
def j15_group_relations(spark, d):
    kinds = {n: _keys(spark, d, c).withColumn("key", F.col("key").cast("string")) for n, c in (("part", "evidence"), ("file", "file"), ("conversation", "conversation"))}
    assign = order_drafts(spark, d).select("draft_id", (F.col("draft_id") % 5).alias("group_id")).distinct()
    return relations.group_relations(kinds, assign).select("a", "b", "types")


@query(f"""WITH RECURSIVE {D}, {_K}, h AS (SELECT key, min(draft_id) AS m FROM k GROUP BY 1), e AS (SELECT DISTINCT k.draft_id AS a, m AS b FROM k JOIN h USING (key) WHERE k.draft_id <> m), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, c) USING KEY (id) AS (SELECT DISTINCT draft_id, draft_id FROM k UNION SELECT s.b, min(r.c) FROM r JOIN s ON s.a = r.id JOIN recurring.r AS o ON o.id = s.b WHERE r.c < o.c GROUP BY s.b)
SELECT id AS draft_id, c AS component FROM r""")
def g1_components(spark, d):
    keys = _keys(spark, d)
    return graph.draft_components(keys, keys)


@query(f"""WITH RECURSIVE {D}, g AS (SELECT DISTINCT conversation AS g, draft_id FROM d), s AS (SELECT DISTINCT x.draft_id AS a, y.draft_id AS b FROM d x JOIN d y ON x.conversation = y.conversation AND x.evidence = y.evidence AND x.draft_id <> y.draft_id),
r(id, c) USING KEY (id) AS (SELECT draft_id, draft_id FROM g UNION SELECT s.b, min(r.c) FROM r JOIN s ON s.a = r.id JOIN recurring.r AS o ON o.id = s.b WHERE r.c < o.c GROUP BY s.b)
SELECT g AS group_id, count(DISTINCT c) = 1 AS connected FROM g JOIN r ON r.id = g.draft_id GROUP BY 1""")
def g7_connected_by(spark, d):
    assign = order_drafts(spark, d).select("draft_id", F.col("conversation").alias("group_id")).distinct()
    return graph.connected_by(assign, _keys(spark, d))


_BEFORE, _AFTER = "SELECT o_orderkey AS draft_id, o_custkey::VARCHAR AS g FROM orders", "SELECT o_orderkey AS draft_id, o_custkey || '|' || o_orderpriority AS g FROM orders"


def _assignments(spark, d):
    o = table(spark, d, "orders")
    before = o.select(F.col("o_orderkey").alias("draft_id"), F.col("o_custkey").cast("string").alias("group_id"))
    return before, o.select(F.col("o_orderkey").alias("draft_id"), F.concat_ws("|", "o_custkey", "o_orderpriority").alias("group_id"))


@query(f"""WITH b AS ({_BEFORE}), a AS ({_AFTER}), pb AS (SELECT x.g, x.draft_id AS a, y.draft_id AS b FROM b x JOIN b y ON x.g = y.g AND x.draft_id < y.draft_id), pa AS (SELECT x.g, x.draft_id AS a, y.draft_id AS b FROM a x JOIN a y ON x.g = y.g AND x.draft_id < y.draft_id)
SELECT 'merged' AS change, g AS group_id, count(*) AS pairs FROM pa ANTI JOIN pb USING (a, b) GROUP BY g UNION ALL SELECT 'split', g, count(*) FROM pb ANTI JOIN pa USING (a, b) GROUP BY g""")
def g10_partition_diff(spark, d):
    return graph.partition_diff(*_assignments(spark, d))


@query(f"""WITH b AS ({_BEFORE}), a AS ({_AFTER}), x AS (SELECT b.g AS o, a.g AS n FROM b JOIN a USING (draft_id))
SELECT 'merged' AS metric, count(*) AS n FROM (SELECT n FROM x GROUP BY n HAVING count(DISTINCT o) > 1) UNION ALL SELECT 'split', count(*) FROM (SELECT o FROM x GROUP BY o HAVING count(DISTINCT n) > 1)""")
def a27_review_metrics(spark, d):
    return metrics.review_metrics(*_assignments(spark, d))


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 AND turn = 1 THEN 'other' ELSE 'title' END AS title, (SELECT string_agg(x.text, ' ' ORDER BY x.turn) FROM conversations x WHERE x.conv_id = c.conv_id AND (x.turn <= c.turn OR (c.conv_id % 5 = 0 AND x.turn = c.turn + 1)) AND (x.turn > 0 OR c.turn < 2 OR c.conv_id % 4 <> 0)) AS content FROM conversations c),
k AS (SELECT *, regexp_replace(trim(content), '\\s+', ' ', 'g') AS t FROM c)
SELECT conv_id AS event_id, count(*) AS n, count(DISTINCT title) = 1 AND (SELECT coalesce(bool_and(contains(b.t, a.t) OR contains(a.t, b.t)), true) FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE a.conv_id = k.conv_id) AS same FROM k GROUP BY conv_id""")
def a1_exact_groups(spark, d):
    c = table(spark, d, "conversations")
    late = (F.col("x.turn") <= F.col("c.turn")) | ((F.col("c.conv_id") % 5 == 0) & (F.col("x.turn") == F.col("c.turn") + 1))
    kept = (F.col("x.turn") > 0) | (F.col("c.turn") < 2) | (F.col("c.conv_id") % 4 != 0)
    both = c.alias("c").join(c.alias("x"), (F.col("c.conv_id") == F.col("x.conv_id")) & late & kept)
    texts = both.groupBy("c.conv_id", "c.turn").agg(F.array_sort(F.collect_list(F.struct("x.turn", "x.text"))).alias("m"))
    content = F.array_join(F.transform("m", lambda x: x["text"]), "  ")
    title = F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") == 1), "other").otherwise(" title ")
    return merge.exact_groups(texts.select(F.col("conv_id").alias("event_id"), F.col("turn").alias("draft_id"), title.alias("title"), content.alias("content")))


@query("WITH c AS (SELECT doc_id, source, trim(regexp_replace(text, '[ \\t\\r]+\\n', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents) SELECT source, max_by(text, (CASE WHEN length(text) <= 4000 THEN 1 ELSE 0 END)::BIGINT * 1000000000000 + least(length(text), 4000)::BIGINT * 100000000 - doc_id) AS text FROM c GROUP BY source")
def a6_preferred_text(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(merge.preferred_text(F.col("text"), F.col("doc_id")).alias("text"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) GROUP BY 1")
def a8_ordered_distinct(spark, d):
    return merge.ordered_distinct(table(spark, d, "conversations"), ["conv_id"], "role", "turn", "roles").withColumn("roles", F.array_join("roles", ","))


@query("""WITH x AS (SELECT DISTINCT lang, source FROM documents), l AS (SELECT lang, length(source) AS n, source FROM (SELECT DISTINCT lang, source FROM x)),
r AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS k FROM l) SELECT lang, string_agg(source, '；' ORDER BY k) AS detail FROM r WHERE k <= 3 GROUP BY 1""")
def a15_merge_detail(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(merge.merge_detail(F.col("source")).alias("detail"))


@query("""WITH x AS (SELECT conv_id, role, text, min(turn) AS turn FROM conversations GROUP BY 1, 2, 3), t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r, min(turn) OVER (PARTITION BY conv_id, role) AS start FROM x),
f AS (SELECT conv_id, text, min_by(struct_pack(r := r, start := start), r * 1000000 + start) AS o FROM t GROUP BY 1, 2) SELECT conv_id AS group_id, string_agg(text, chr(10) ORDER BY o.r, o.start) AS content FROM f GROUP BY 1""")
def a11_balanced_content(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("group_id"), F.col("role").alias("source"), F.col("text").alias("content"), F.col("turn").alias("pos"))
    return merge.balanced_content(rows)


@query("SELECT lang, round_even(avg(length(text)), 2) AS avg, round_even(median(length(text)), 2) AS median, min(length(text))::INT AS min, max(length(text))::INT AS max FROM documents GROUP BY 1")
def a17_text_metrics(spark, d):
    return metrics.text_metrics(table(spark, d, "documents"), "text", ("lang",))


_QUALITY = """q AS (SELECT r_name AS region, n_name AS scope, o_custkey AS g, count(*) AS rows, count(*) FILTER (o_orderstatus = 'F') AS kept FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3),
s AS (SELECT region, scope, sum(rows)::BIGINT AS sources, count(*) AS groups, sum(kept)::BIGINT AS kept, max(rows) AS largest, count(*) FILTER (rows > 1) AS merged_groups, round_even(sum(kept) / sum(rows), 4) AS kept_ratio FROM q GROUP BY 1, 2)"""


def _quality(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    at = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    rows = at.select(F.col("r_name").alias("region"), F.col("n_name").alias("scope"), F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("draft_id"), F.col("o_custkey").alias("owner"), (F.col("o_orderstatus") == "F").alias("kept"))
    return metrics.quality_summary(rows, ("region", "scope"))


@query(f"WITH {_QUALITY} SELECT * FROM s")
def a18_quality_summary(spark, d):
    return _quality(spark, d).drop("most_owners")


@query(f"WITH {_QUALITY} SELECT region, scope, sum(sources)::BIGINT AS sources, sum(groups)::BIGINT AS groups, max(largest) AS largest, round_even(sum(kept_ratio * sources) / sum(sources), 4) AS kept_ratio FROM s GROUP BY ROLLUP (region, scope)")
def a19_rollup_quality(spark, d):
    return metrics.rollup_quality(_quality(spark, d), "region", "scope")


@query("SELECT field, missing FROM (SELECT 'text' AS field, count(*) FILTER (coalesce(text, '') = '') AS missing FROM documents UNION ALL SELECT 'lang', count(*) FILTER (coalesce(lang, '') = '') FROM documents)")
def a22_missing_fields(spark, d):
    return metrics.missing_fields(table(spark, d, "documents"), ["text", "lang"])


_CALLS = "c AS (SELECT event_type AS kind, (user_id % 3)::BIGINT AS backend, CASE WHEN value >= 5 THEN round(value * 100)::BIGINT END AS tokens FROM events)"


@query(f"WITH {_CALLS} SELECT kind, backend, count(*) AS calls, sum(tokens)::BIGINT AS tokens, count(tokens) AS reported, count(*) FILTER (tokens IS NULL) AS missing FROM c GROUP BY GROUPING SETS ((), (kind), (backend))")
def a24_usage_summary(spark, d):
    tokens = F.when(F.col("value") >= 5, F.round(F.col("value") * 100).cast("long"))
    return metrics.usage_summary(table(spark, d, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 3).alias("backend"), tokens.alias("tokens")))


@query("WITH p AS (SELECT event_type AS stage, count(*) AS calls, sum(value) AS seconds, max(value) AS longest, max(user_id % 97 + value) - min(user_id % 97) AS wall FROM events GROUP BY 1) SELECT stage, calls, round(seconds, 2) AS seconds, longest, CASE WHEN stage <> 'view' THEN round(seconds / (SELECT sum(seconds) FROM p WHERE stage <> 'view'), 4) END AS share, round(wall, 2) AS wall, round(seconds / wall, 3) AS ratio FROM p")
def a25_timing_report(spark, d):
    log = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"), (F.col("user_id") % 97).alias("started"))
    return metrics.timing_report(log, ("view",)).withColumns({"seconds": F.round("seconds", 2), "share": F.round("share", 4), "wall": F.round("wall", 2), "ratio": F.round("ratio", 3)})


@query("""WITH x AS (SELECT event_type AS relation, value AS gap, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT relation, max(n) AS n, min(gap) AS min, median(gap) AS median, max(CASE WHEN r = round_even((n - 1) * 0.75, 0) + 1 THEN gap END) AS p75, max(gap) AS max FROM x GROUP BY 1""")
def a29_gap_quantiles(spark, d):
    return metrics.gap_quantiles(table(spark, d, "events").select(F.col("event_type").alias("relation"), F.col("value").alias("gap")))


@query("SELECT user_id AS call_id, count(*) AS rows, count(DISTINCT event_type) AS messages, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM events GROUP BY 1")
def a30_call_inputs(spark, d):
    calls = metrics.call_inputs(table(spark, d, "events").select(F.col("user_id").alias("call_id"), F.col("event_type").alias("message_id"), F.col("ts").cast("timestamp").alias("ts")))
    return calls.withColumns({"first": F.unix_micros("first"), "last": F.unix_micros("last")})


@query("SELECT user_id AS run, CASE WHEN bool_or(event_type = 'error') THEN 'failed' WHEN bool_or(event_type = 'signup') THEN 'warnings' ELSE 'success' END AS status FROM events GROUP BY 1")
def a32_fold_status(spark, d):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "warnings").otherwise("success")
    return metrics.fold_status(table(spark, d, "events").select(F.col("user_id").alias("run"), status.alias("status")), "run")


@query(f"""WITH b AS ({_BEFORE}), x AS (SELECT draft_id FROM b WHERE draft_id % 10 <> 0 UNION ALL SELECT draft_id FROM b WHERE draft_id % 10 = 3 UNION ALL SELECT -draft_id FROM b WHERE draft_id % 10 = 4)
SELECT draft_id, CASE WHEN draft_id < 0 THEN 'unknown' WHEN draft_id % 10 = 0 THEN 'missing' ELSE 'duplicate' END AS error FROM (SELECT draft_id FROM b WHERE draft_id % 10 IN (0, 3) UNION SELECT draft_id FROM x WHERE draft_id < 0)""")
def v1_audit_partition(spark, d):
    b, _ = _assignments(spark, d)
    given = b.where("draft_id % 10 <> 0").select("draft_id").unionAll(b.where("draft_id % 10 = 3").select("draft_id")).unionAll(b.where("draft_id % 10 = 4").select((-F.col("draft_id")).alias("draft_id")))
    return audit.audit_partition(b, given)


@query(f"""WITH RECURSIVE {_LAYERS}, o AS (SELECT o_custkey AS g, o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS st FROM orders), c AS (SELECT g, id, c FROM r WHERE layer = 'both'),
a AS (SELECT DISTINCT x.g FROM o x JOIN o y ON x.g = y.g AND x.p = y.p JOIN c i ON i.g = x.g AND i.id = x.k JOIN c j ON j.g = y.g AND j.id = y.k WHERE i.c <> j.c),
f AS (SELECT g FROM o WHERE g % 3 = 0 GROUP BY g HAVING count(DISTINCT st) > 1 AND g NOT IN (SELECT g FROM z WHERE layer = 'both'))
SELECT g AS group_id, concat_ws(',', CASE WHEN count(*) >= 10 THEN 'many_events' END, CASE WHEN count(DISTINCT k % 5) >= 4 THEN 'many_files' END, CASE WHEN count(DISTINCT k % 2) > 1 THEN 'cross_batch' END, CASE WHEN bool_or(k % 7 = 0) THEN 'repaired' END,
  CASE WHEN g IN (SELECT g FROM a) THEN 'same_conversation_only' END, CASE WHEN g IN (SELECT g FROM f) THEN 'semantic_only_object_conflict' END, CASE WHEN g % 5 = 0 THEN 'broad_object' END) AS reasons FROM o GROUP BY g HAVING reasons <> ''""")
def v17_risk_reasons(spark, d):
    assign, keys = _order_layers(spark, d)
    merged = keys.where("kind <> 'conversation'").select("draft_id", F.concat_ws("|", "kind", "key").alias("key"))
    alone = graph.conversation_only(assign, merged, keys.where("kind = 'conversation'").select("draft_id", "key"))
    hints = table(spark, d, "orders").select(F.col("o_orderkey").alias("draft_id"), F.concat(F.lit(" "), F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")), F.lit("\u3000")).alias("hint"))
    flags = assign.where("group_id % 5 = 0").select("group_id", F.lit("broad_object").alias("flag")).union(assign.select("group_id", F.lit("other")))
    conflicts = evidence.semantic_conflicts(assign, keys, assign.where("group_id % 3 = 0").select("group_id", F.lit("same_matter").alias("reason")), hints)
    k = F.col("draft_id")
    return audit.risk_reasons(assign.select("group_id", "draft_id", (k % 5).alias("source_file"), (k % 2).alias("batch"), (k % 7 == 0).alias("repaired")), alone=alone, conflicts=conflicts, flags=flags)


@query("SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, 'AKIA[A-Z0-9]{12}') THEN 'access_key' END, CASE WHEN regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') THEN 'mail' END) AS found FROM documents")
def v21_privacy_scan(spark, d):
    patterns = {"access_key": "AKIA[A-Z0-9]{12}", "mail": "[A-Za-z0-9._]+@[A-Za-z0-9.]+"}
    return table(spark, d, "documents").select("doc_id", F.array_join(audit.privacy_scan(F.col("text"), patterns), ",").alias("found"))


@query("SELECT event_id, CASE WHEN event_type IN ('error') THEN 'failure' WHEN event_type IN ('click', 'view') THEN 'traffic' ELSE 'runtime' END AS category FROM events")
def v22_error_category(spark, d):
    return table(spark, d, "events").select("event_id", audit.error_category(F.col("event_type"), {"failure": ("error",), "traffic": ("click", "view")}).alias("category"))


@query("WITH r AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k FROM documents) SELECT doc_id, CASE WHEN k = 1 THEN lang ELSE 'manual-' || sha1(source || '|' || lang || '|' || '|' || k)[1:16] END AS event_id FROM r")
def v19_fix_duplicate_ids(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("source_file"), F.col("lang").alias("event_id"), F.lit("").alias("content"), F.col("doc_id").alias("pos"))
    return audit.fix_duplicate_ids(docs).select(F.col("pos").alias("doc_id"), "event_id")


_FOLD = """
n AS (SELECT conv_id, turn, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))::BIGINT AS a, length(text)::BIGINT AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
p AS (SELECT n.conv_id, n.turn, n.k, n.a, n.t - n.a AS x, 1::BIGINT AS batch, (n.a * 5 + 11) // 12 + n.t - n.a + 200 > 320 AS oversized FROM n WHERE k = 1
  UNION ALL SELECT n.conv_id, n.turn, n.k, CASE WHEN f THEN p.a + n.a ELSE n.a END, CASE WHEN f THEN p.x + n.t - n.a ELSE n.t - n.a END, p.batch + CASE WHEN f THEN 0 ELSE 1 END, (n.a * 5 + 11) // 12 + n.t - n.a + 200 > 320
  FROM p JOIN n ON n.conv_id = p.conv_id AND n.k = p.k + 1, LATERAL (SELECT ((p.a + n.a) * 5 + 11) // 12 + p.x + n.t - n.a + 200 <= 320 AS f))
"""


@query(f"WITH RECURSIVE {_FOLD} SELECT conv_id, turn, batch, oversized FROM p")
def w14_pack(spark, d):
    n = F.length(F.regexp_replace("text", r"[^\x00-\x7F]", ""))
    rows = table(spark, d, "conversations").select("conv_id", "turn", n.alias("a"), (F.length("text") - n).alias("x"))
    return packing.pack(rows, ("conv_id",), "turn", "a", "x", 320).select("conv_id", "turn", "batch", "oversized")


@query(r"""WITH RECURSIVE p(doc_id, pos, piece, rest) AS (SELECT doc_id, 0::BIGINT, ''::VARCHAR, text FROM documents
UNION ALL SELECT doc_id, pos + 1, rest[1:n], rest[n + 1:] FROM p, LATERAL (SELECT CASE WHEN length(rest) <= 2000 THEN length(rest) WHEN length(regexp_extract(rest[1001:2000], '(?s)^(.*[。！？!?;；
.])', 1)) > 0 THEN 1000 + length(regexp_extract(rest[1001:2000], '(?s)^(.*[。！？!?;；
.])', 1)) ELSE 2000 END AS n) WHERE length(rest) > 0)
SELECT doc_id, pos, length(piece)::INT AS n, md5(piece) AS piece FROM p WHERE pos > 0""")
def w18_shard_content(spark, d):
    at = table(spark, d, "documents").select("doc_id", F.posexplode(packing.shard_content(F.col("text"), 2000)).alias("pos", "piece"))
    return at.select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), F.length("piece").alias("n"), F.md5("piece").alias("piece"))


@query(f"""WITH {D}, s AS (SELECT DISTINCT draft_id AS source_id, evidence AS m FROM d), o AS (SELECT DISTINCT conversation AS output_id, evidence AS m FROM d WHERE draft_id % 3 <> 0), n AS (SELECT source_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT source_id, output_id, count(*) AS k FROM s JOIN o USING (m) GROUP BY 1, 2), y AS (SELECT source_id, max(k) AS k FROM x GROUP BY 1) SELECT source_id, coalesce(k = n, false) AS covered FROM n LEFT JOIN y USING (source_id)""")
def a18_coverage(spark, d):
    rows = order_drafts(spark, d)
    return metrics.coverage(rows.select(F.col("draft_id").alias("source_id"), F.col("evidence").alias("message_id")).distinct(), rows.where("draft_id % 3 <> 0").select(F.col("conversation").alias("output_id"), F.col("evidence").alias("message_id")).distinct())


@query("""WITH r AS (SELECT source AS group_id, doc_id AS pos, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id) AS k, count(*) OVER (PARTITION BY source) AS c, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY length(text), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents),
l AS (SELECT *, floor((20000 - before) / (c - k + 1)) AS level FROM r), f AS (SELECT group_id, min(k) AS cut FROM l WHERE n > level GROUP BY 1), v AS (SELECT l.group_id, l.level AS share, cut FROM l JOIN f ON f.group_id = l.group_id AND l.k = f.cut),
s AS (SELECT l.*, v.cut, v.share, k >= coalesce(v.cut, 1000000000) AS long FROM l LEFT JOIN v USING (group_id)), t AS (SELECT *, sum(CASE WHEN long THEN share ELSE n END) OVER (PARTITION BY group_id) AS spent, row_number() OVER (PARTITION BY group_id, long ORDER BY pos) AS turn FROM s)
SELECT group_id, pos, CASE WHEN long THEN least(n, share + CASE WHEN turn <= 20000 - spent THEN 1 ELSE 0 END) ELSE n END::BIGINT AS share FROM t""")
def a12_allocate_lengths(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("group_id"), F.col("doc_id").alias("pos"), F.length("text").alias("length"))
    return merge.allocate_lengths(rows, 20000).select("group_id", "pos", "share")


@query("""WITH r AS (SELECT source AS g, length(text)::BIGINT AS n FROM documents), c AS (SELECT g, n, count(*) AS k FROM r GROUP BY 1, 2), q AS (SELECT g, unnest(range(0, least(20000, max(n)) + 1)) AS q FROM r GROUP BY g)
SELECT g AS group_id, max(q)::BIGINT AS quota FROM (SELECT g, q, sum(least(n, q) * k) AS total FROM q JOIN c USING (g) GROUP BY 1, 2) WHERE total <= 20000 GROUP BY g""")
def a13_fit_quota(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("group_id"), F.length("text").alias("length"))
    return merge.fit_quota(rows, 20000)


@query()
def w15_pack_components(spark, d):
    """Tests check that components stay whole while they fit."""
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), F.floor(F.col("turn") / 2).alias("component"), F.length("text").cast("long").alias("ascii"), F.lit(0).cast("long").alias("other"))
    return packing.pack_components(rows, ("conv_id",), 320)
