"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, licenses, lm, packing, quality, repair, secrets, substring, toxicity, trie, warc
from .common import bucket_of, table


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents")).drop("intervals")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = F.array_join(F.array_sort(F.array_distinct("found.family")), ",")
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_license"), families.alias("families"), spans.alias("spans"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, digests=True)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, records = warc.archive(spark, table(spark, sf_dir, "pages"))
    return records.drop("url")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(repair.damaged(table(spark, sf_dir, "conversations")))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), path=public_tokenizers.path("byte_bpe_50k.json"), ids=False)


QUERIES = {f.__name__: f for f in (op1_substring, op2_decontaminate, op3_licenses, op4_lm, op5_secrets, op6_toxicity, op7_jaccard, op8_bpe, op9_quality, op10_warc, op11_trie, op12_repair, op13_packing)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, i, w[i:i + 49] AS k FROM d, unnest(range(1, greatest(len(w) - 49, 0) + 1)) t(i)),
m AS (SELECT k, min(doc_id) AS first FROM s GROUP BY k HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, j FROM (SELECT s.doc_id, s.i FROM s JOIN m USING (k) WHERE s.doc_id > m.first), unnest(range(i, i + 50)) t(j)),
c AS (SELECT doc_id, list(j) AS gone FROM r GROUP BY doc_id),
x AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN c USING (doc_id)),
p AS (SELECT doc_id, list(w[i] ORDER BY i) AS kept FROM (SELECT doc_id, w, gone, unnest(range(1, len(w) + 1)) AS i FROM x) WHERE NOT list_contains(gone, i) GROUP BY doc_id)
SELECT x.doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM x LEFT JOIN p USING (doc_id)
"""

_OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS n, w[i:i + 9] AS k FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM p),
s AS (SELECT doc_id, n, i, w[i:i + n - 1] AS k FROM d, sizes, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) t(i)),
h AS (SELECT s.doc_id, s.n, s.i, p.item FROM s JOIN p ON s.n = p.n AND s.k = p.k),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + n)) t(j) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


# the patterns as the task states them, not as the operator writes them
_KINDS = (
    ("assign", r'''(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)''', 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32), ("token", "[A-Za-z0-9+/_-]+", 0, 20),
)


def _secret_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT doc_id, source, '{kind}' AS kind, {rank} AS rank, {least} AS least, regexp_extract_all(text, '{pattern}', 0) AS whole, regexp_extract_all(text, '{pattern}', {group}) AS value, string_split_regex(text, '{pattern}') AS gap FROM documents"
        for rank, (kind, pattern, group, least) in enumerate(_KINDS)
    )
    return f'''
WITH f AS ({parts}),
i AS (SELECT doc_id, source, kind, rank, least, unnest(whole) AS whole, unnest(value) AS v, unnest(gap[1:len(whole)]) AS gap, generate_subscripts(whole, 1) AS i FROM f),
p AS (SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id, kind ORDER BY i)::INT AS e FROM i),
s AS (SELECT doc_id, source AS owner, kind, rank, v, e - length(whole) AS a, length(whole)::INT AS n FROM p WHERE length(v) >= least),
base AS (SELECT * FROM s WHERE kind <> 'token'),
extra AS (SELECT * FROM s WHERE kind = 'token' AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND s.a < b.a + b.n AND b.a < s.a + s.n)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
live AS (SELECT v, count(DISTINCT coalesce('o' || owner, '')) < 3 AND count(DISTINCT doc_id) < 10 AS live FROM every GROUP BY v),
kept AS (SELECT e.*, live, kind || ':' || a || ':' || (a + n) AS span FROM every e JOIN live USING (v) WHERE kind <> 'token' OR live),
per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY a, rank) FILTER (kind <> 'token') AS b, string_agg(span, ',' ORDER BY a, rank) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents LEFT JOIN per USING (doc_id)
'''


_OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + 3] AS k FROM d, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) t(i)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id WHERE r.m < e.b),
g AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY 1)
SELECT r.doc_id, any_value(coalesce(n, 0))::BIGINT AS n_shingles, min(m) AS component_id, any_value(coalesce(n_links, 0))::BIGINT AS n_links FROM r LEFT JOIN z USING (doc_id) LEFT JOIN g USING (doc_id) GROUP BY r.doc_id
"""

_OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

# crc32 of a text of ASCII characters: eight steps a character, of which the first takes the character in
_CRC = "(4294967295 - list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(range(1, length(({0})) + 1), lambda i: [unicode(({0})[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))]), lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)))"

_OP11 = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY pos) AS own FROM t GROUP BY 1),
h AS (SELECT conv_id, own, {_CRC.format("conv_id::VARCHAR")} % 6 AS h FROM o),
b AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h], []), h.own[h + 1:]) AS turns FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d, turns[1:d] AS k, len(turns) = d AS last FROM b, unnest(range(0, len(turns) + 1)) u(d)),
n AS (SELECT k, any_value(d)::BIGINT AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256,
  CASE WHEN any_value(d) > 0 THEN (count(*) - 1) * length(any_value(k[d].x)) ELSE 0 END AS saves FROM p GROUP BY k),
c AS (SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (k)),
s AS (SELECT k[1:d] AS k, sum(saves)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM m, unnest(range(0, depth + 1)) u(d) GROUP BY 1)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN s USING (k) LEFT JOIN n q ON m.depth > 0 AND q.k = m.k[1:m.depth - 1]
"""

# an inserted turn costs 5, to delete its neighbour, or a lone s and its neighbour, 4 at most: so no cheapest repair inserts
_OP12 = rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
c AS (SELECT *, {_CRC.format("key")} % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c, unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) WHERE kind <> 0),
e AS (SELECT *, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS cut, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
f AS (SELECT *, CASE WHEN cut = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2 WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) || role[1] AS pair FROM e),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, list({{'i': role[1], 'r': role, 't': text, 'f': fault}} ORDER BY pos) AS rows FROM f GROUP BY 1),
v AS (SELECT conv_id, rows, 0 AS i, [{{'c': 0, 'e': '', 's': '', 'o': NULL::VARCHAR}}] AS best FROM g
  UNION ALL
  SELECT conv_id, rows, i + 1, list_filter([list_min(list_filter(list_transform(best, lambda b: CASE
      WHEN b.s = to_s THEN {{'c': b.c + 2, 'e': b.e || 'D', 's': b.s, 'o': b.o}} END), lambda x: x IS NOT NULL) || list_filter(list_transform(best, lambda b: CASE
      WHEN rows[i + 1].f IN (1, 2) OR to_s = '' OR NOT ((to_s = 's' AND b.s = '') OR (to_s = 'u' AND b.s <> 'u') OR (to_s = 'a' AND b.s = 'u')) THEN NULL
      WHEN rows[i + 1].i = to_s THEN {{'c': b.c + CASE WHEN rows[i + 1].f = 3 THEN 5 ELSE 0 END, 'e': b.e || 'K', 's': to_s, 'o': coalesce(b.o || chr(10), '') || rows[i + 1].r || ':' || rows[i + 1].t}}
      WHEN to_s <> 's' THEN {{'c': b.c + 1 + CASE WHEN rows[i + 1].f = 3 THEN 5 ELSE 0 END, 'e': b.e || 'R', 's': to_s, 'o': coalesce(b.o || chr(10), '') || CASE to_s WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || rows[i + 1].t}} END), lambda x: x IS NOT NULL))
    FOR to_s IN ['', 's', 'u', 'a']], lambda x: x IS NOT NULL)
  FROM v WHERE i < len(rows)),
w AS (SELECT conv_id, list_min(list_filter(best, lambda b: b.s IN ('', 'a'))) AS b FROM v WHERE i = len(rows))
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.e, '') AS audit, sha256(coalesce(b.o, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM a.conv_id
"""

ORACLES = {"op1_substring": _OP1, "op2_decontaminate": _OP2, "op5_secrets": _secret_sql(), "op7_jaccard": _OP7, "op10_warc": _OP10, "op11_trie": _OP11, "op12_repair": _OP12}
