"""Message functions, context and review operators: hand-made cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtrail.functions import messages as m
from evtrail.operators import context, evidence, packing
from evtrail.sources import chat, sinks


def test_compress_text(spark):
    cases = [
        ("hi <at id='1'>Li Lei</at> see https://a.b/c :smile: ok", "text", "hi @Li Lei see [链接] ok"),
        ("![x](img_1)", "text", "[图片]"), ("[doc](https://a.b)", "text", "doc[链接]"), ("[Sticker]", "text", ""), ("x", "file", "[文件附件]"),
        ("[Image: img_1]", "image", "[图片]"), ('<audio duration="3s" name="n.mp3"/>', "audio", "[语音消息 3s: n.mp3]"), ('<video duration="9s"/>', "media", "[视频 9s]"),
        ("![a](img_1)\n![b](img_2)\ntext", "post", "[图片]\ntext"), (None, "text", ""), ("a &amp; b<br>c / d", "text", "a & b\nc\nd"),
    ]
    df = spark.createDataFrame(cases, "t string, k string, want string")
    for r in df.select("want", m.compress_text(F.col("t"), F.col("k")).alias("got")).collect():
        assert r.got == r.want


def test_base_names(spark):
    cases = [("合同 V1.2（最终版）.DOCX", "合同.docx"), ("ｒｅｐｏｒｔ_v2.pdf", "report.pdf"), ("终版.txt", ""), (None, ""), ("a v1.txt", "a.txt"), (".v2", "."), ("Straße  x", "strasse x"), ("a_v1_v2_修订版", "a")]
    df = spark.createDataFrame(cases, "n string, want string")
    assert [(r.want, r.got) for r in df.select("want", m.attachment_base_name(F.col("n")).alias("got")).collect()] == [(w, w) for _, w in cases]


def test_labels_and_links(spark):
    df = spark.createDataFrame([(["甲", "other", "甲"], "see u1 now", [("u1", "T"), ("u2", "")])], "l array<string>, t string, k array<struct<url:string,title:string>>")
    r = df.select(m.labels_to_keys(F.col("l"), {"甲": "a"}).alias("a"), m.readable_files(F.col("t"), F.col("k")).alias("b"), m.message_to_text(F.col("t"), F.col("k")).alias("c")).first()
    assert r.a == ["a", "other"] and r.b == "see 《T》 now" and r.c == "see u1 now\nT u1\nu2"


def test_links_are_put_in_at_once(spark):
    cases = [
        ("see http://a/b and http://a/b/c", [("http://a/b", "T1"), ("http://a/b/c", "T2")], False, "see 《T1》 and 《T2》"),
        ("T1 names http://a/b", [("http://a/b", "T1"), ("http://x", "a")], False, "《T1》 n《a》mes 《T1》"),
        ("ab", [("a", "b"), ("b", "a")], False, "《b》《b》"), ("《T》 T", [("u", "T")], False, "《T》 《T》"), ("x", [("", "")], True, "x"), ("", [("u", "T")], True, "《T》"),
        ("x", [("u", "《T》"), ("v", "W")], True, "《T》x"), ("has W", [("u", "T"), ("v", "W")], True, "has 《W》"), ("a.c $1 \\E b", [("a.c", "$1"), ("\\E", "q\\Q")], False, "《$1》 《$1》 《q\\Q》 b"),
        ("by AbCdEf12!", [("https://x.org/docx/AbCdEf12?q", "")], False, "by 《https://x.org/docx/AbCdEf12?q》!"), (None, [("u", "T")], False, None), ("keep", None, True, "keep"),
    ]
    df = spark.createDataFrame(cases, "t string, k array<struct<url:string,title:string>>, prefix boolean, want string")
    for prefix in (True, False):
        for r in df.where(F.col("prefix") == prefix).select("want", m.readable_files(F.col("t"), F.col("k"), prefix).alias("got")).collect():
            assert r.got == r.want


def test_all_character_references(spark):
    from evtrail.functions import text

    cases = [("<p>caf&eacute; &#8220;x&#x201D; &amp;lt; &notit; &bogus; &nbsp;y</p>", "café “x” &lt; ¬it; &bogus; y"), (None, None), ("a & b", "a & b")]
    df = spark.createDataFrame(cases, "t string, want string").select("want", text.markup_to_text("t").alias("got"), text.markup_title(F.concat(F.lit("<title>"), "t", F.lit("</title>"))).alias("title"))
    for r in df.collect():
        assert r.got == r.want
        assert r.title == (r.want and r.want.replace("café", "<p>café").replace(" y", " y</p>"))


def test_unclosed_references_of_pages(spark, tmp_path):
    import duckdb

    from evtrail.queries import ORACLES, QUERIES

    cases = ["and&amp", "a&amp;&amp;b&amp", "&lt &amp;lt; &lt;b&gt;&#39;&copy;&nbsp;&middot;c", "&bogus; &amp;amp; &&quot;"]
    rows = [(i, f"<title>{t}</title><p>{t}</p>") for i, t in enumerate(cases)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("x23_markup_title", "x23_markup_to_text"):
        want = duckdb.sql(ORACLES[name].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
        assert sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()) == sorted(want)


def test_times_and_reactions(spark):
    df = spark.createDataFrame([("2024-01-01T08:00:00+08:00",), ("2024-01-01T00:00:00Z",), ("2024-01-01 08:00:00",), ("1704067200",), ("1704067200000",), ("nonsense",)], "t string")
    got = [r[0] for r in df.select(F.unix_seconds(chat.to_event_ts(F.col("t")))).collect()]
    assert got == [1704067200] * 5 + [None]
    raw = '{"reactions":[{"emoji_type":"OK","create_time":"5","details":[{"operator_id":"u1"},{"operator_id":"u1"},{"operator":{"open_id":"u2"},"reaction_type":{"emoji_type":"NO"}}]},{"operator_id":"u3"}]}'
    rows = chat.flatten_reactions(spark.createDataFrame([("m", raw)], "message_id string, raw string")).collect()
    assert {(r.operator_open_id, r.emoji_type, r.action_time) for r in rows} == {("u1", "OK", "5"), ("u2", "NO", "5")}


def test_logs(spark, tmp_path):
    (tmp_path / "2026-07-10-Li.md").write_text("# x\n<!-- event:start -->\n- 标题: A\n<!-- event:end -->\nmanual\n<!-- event:start -->\n- title: B")
    logs = chat.read_event_logs(spark, str(tmp_path))
    blocks = chat.event_blocks(logs)
    got = blocks.select(chat.block_field(F.col("block"), "标题", "title").alias("title")).collect()
    assert sorted(r.title for r in got) == ["A", "B"] and logs.first().owner == "Li"


def test_write_day_and_memo(spark, tmp_path):
    days = spark.createDataFrame([("o", "2026-01-01"), ("o", "2026-01-02")], "owner_id string, date string")
    events = spark.createDataFrame([("o", "2026-01-01", "e1", 1, "T", "C")], "owner_id string, date string, event_id string, pos int, title string, content string")
    path = str(tmp_path / "days")
    assert sinks.write_day(events, path, days) == 1
    assert sinks.write_day(events.limit(0), path, days.where("date = '2026-01-01'")) == 0
    assert spark.read.parquet(path).count() == 2  # two day markers
    body = sinks.render_day(events).first().body
    assert body.startswith("# 2026-01-01") and "## T" in body


def test_split_windows_and_limits(spark):
    rows = spark.createDataFrame([("w", i, 100, 0) for i in range(10)] + [("big", 1, 9000, 0)], "window_id string, pos long, ascii long, other long")
    parts = context.split_windows(rows, 330).collect()
    assert len(parts) == 11
    for part in {(r.window_id, r.part) for r in parts}:
        inside = sorted(r.pos for r in parts if (r.window_id, r.part) == part)
        assert inside == list(range(inside[0], inside[-1] + 1))
        assert len(inside) == 1 or (100 * len(inside) * 5 + 11) // 12 + 200 <= 330
    mix = spark.createDataFrame([("s", 1, "main", 600, 0), ("s", 2, "relation", 100, 0), ("s", 3, "temporal", 5000, 0), ("s", 4, "temporal", 100, 0)], "slice_id string, pos long, kind string, ascii long, other long")
    assert sorted(r.pos for r in context.limit_context(mix, 540).collect()) == [1, 2, 4]


def test_pack_components(spark):
    rows = spark.createDataFrame([(1, i, c, n, 0) for i, (c, n) in enumerate([(1, 600), (2, 600), (1, 600), (3, 9000), (3, 60), (2, 600)])], "g int, pos long, component long, ascii long, other long")
    got = {r.pos: r.batch for r in packing.pack_components(rows, ("g",), 800).collect()}
    assert got[0] == got[2] and got[1] == got[5] and got[0] != got[1] and got[3] != got[4]


def test_evidence_audit(spark):
    assign = spark.createDataFrame([("g", i) for i in range(4)], "group_id string, draft_id long")
    rel = spark.createDataFrame([("a", [0, 1]), ("b", [1, 2]), ("c", [0, 1, 2]), ("d", [2, 9])], "relation_id string, draft_ids array<long>")
    r = evidence.evidence_audit(assign, rel).first()
    assert (r.relation_ids, r.parts, r.covered, r.uncovered) == ("a,b", 2, 3, 1)  # not connected: in order; d is not inside
    r = evidence.evidence_audit(assign.where("draft_id < 3"), rel).first()
    assert (r.relation_ids, r.parts) == ("c", 1)
    got = {x.draft_id: (x.component, x.covered) for x in evidence.evidence_members(assign, rel).collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (0, True), 3: (3, False)}
