"""Hand-made cases and plain loops for operators whose order or Unicode handling matters."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from evtrail.functions import hashing, text
from evtrail.operators import audit, context, evidence, filters, graph, merge, metrics, numbering, packing, relations, windows
from evtrail.sources import chat, sinks


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_clean_text(spark):
    assert one(spark, "　 a \r\n\tb 　 c\xa0", text.clean_text) == "a\n\tb\nc"
    assert one(spark, "你好妈？\n妈妈在", text.clean_text) == "你好吗？\n妈妈在"
    assert one(spark, "abc中文 x", text.estimate_tokens) == 205


def test_urls(spark):
    assert one(spark, "see https://a.b/c). and https://a.b/c</p> https://x.y", text.extract_urls) == ["https://a.b/c", "https://x.y"]
    assert one(spark, " HTTPS://Ex.COM?q=1#f ", text.normalize_url) == "https://ex.com/"
    assert one(spark, "no url", text.normalize_url) == ""
    assert one(spark, "https://x.feishu.cn/docx/AbCdEf12", text.link_type) == "doc"
    assert one(spark, "https://x.feishu.cn/docx/AbCdEf12?a=1", text.doc_token) == "AbCdEf12"


def test_names_and_markup(spark):
    assert one(spark, ' a/b: c?.', text.safe_file_name) == "a_b__c"
    parts = one(spark, "2026-07-10-Li_Lei-merged.md", text.file_name_parts)
    assert (parts.day, parts.owner, parts.merged) == ("2026-07-10", "Li_Lei", True)
    assert one(spark, "---\na: 1\nb: x:y\n---\nrest", text.front_matter) == {"a": "1", "b": "x:y"}
    assert one(spark, "<title> A\n b </title><script>x<p></script><p>c&amp;d</p>", text.markup_title) == "A b"
    assert one(spark, "<script>x<p></script><p>c&amp;d</p>", text.markup_to_text) == "c&d"


def test_fingerprints(spark):
    assert one(spark, "", hashing.attachment_key) == ""
    assert one(spark, "m1", lambda c: hashing.is_fingerprint(hashing.evidence_fingerprint(c)))


def test_filter_messages(spark):
    rows = [("a", "text", False, [], ["x"]), (" ", "text", False, [], []), (" ", "text", False, ["f"], []), ("hi", "recall", False, [], []), ("某人撤回了", "text", False, [], []), ("b", "text", True, [], [])]
    df = spark.createDataFrame(rows, "text string, message_type string, is_system boolean, attachments array<string>, links array<string>")
    assert sorted(r.text for r in filters.filter_messages(df).collect()) == [" ", "a"]


def test_keyword_order(spark):
    df = spark.createDataFrame([("s and e",), ("E",), ("e",), (None,)], "t string")
    got = [r.reject_kind for r in filters.keyword_filter(df, ["t"], ("s",), ("e",), diagnostics=True).collect()]
    assert got == ["sensitive", None, "excluded", None]


def loop_windows(rows, gap, most):
    """rows of one conversation in order: (message, minute, owner, reacted, mentions_owner, reply_to)."""
    runs, anchors = [], []
    for i, r in enumerate(rows):
        if r[2]:
            if runs and runs[-1][-1] == i - 1:
                runs[-1].append(i)
            else:
                runs.append([i])
        elif r[3]:
            anchors.append([i])
    anchors = sorted(runs + anchors)
    window, out = 0, []
    for k, a in enumerate(anchors):
        if k == 0:
            window = 1
        else:
            p = anchors[k - 1]
            targets = {rows[i][0] for i in (*p, *a)}
            n = sum(1 for r in rows[p[-1] + 1 : a[0]] if not r[2] and not r[4] and r[5] not in targets)
            window += rows[a[0]][1] - rows[p[-1]][1] > gap or n > most
        out.append((a[0] + 1, a[-1] + 1, window))
    return out


def test_anchor_windows_random(spark):
    r, rows, want = random.Random(11), [], []
    for c in range(60):
        minute, conv = 0, []
        for i in range(r.randint(1, 40)):
            minute += r.choice([0, 1, 2, 12])
            conv.append((1000 * c + i, minute, r.random() < 0.25, r.random() < 0.1, r.random() < 0.1, 1000 * c + r.randrange(i) if i and r.random() < 0.4 else None))
        want += [(c, *x) for x in loop_windows(conv, 10, 3)]
        rows += [(c, *x[:1], x[1] * 60, *x[2:]) for x in conv]
    df = spark.createDataFrame(rows, "conversation_id long, message_id long, s long, owner boolean, reacted boolean, mentions_owner boolean, reply_to long").withColumn("ts", F.timestamp_seconds("s"))
    got = windows.anchor_windows(windows.with_index(df)).select("conversation_id", "first", "last", "window").collect()
    assert sorted(tuple(x) for x in got) == sorted(want)


def test_pack(spark):
    sizes = [3, 3, 3, 9, 1, 1, 7, 20, 2]
    df = spark.createDataFrame([(1, i, 0, n) for i, n in enumerate(sizes)], "g int, o long, a long, x long")
    got = packing.pack(df, ("g",), "o", "a", "x", 8, base=0).orderBy("o").collect()
    assert [r.batch for r in got] == [1, 1, 2, 3, 4, 4, 5, 6, 7] and [r.oversized for r in got] == [False] * 3 + [True] + [False] * 3 + [True, False]
    capped = packing.pack(df, ("g",), "o", "a", "x", 100, max_rows=2, base=0).orderBy("o").collect()
    assert [r.batch for r in capped] == [1, 1, 2, 2, 3, 3, 4, 4, 5]


def test_shards_and_excerpt(spark):
    value = "Aaaa bbbb. Cccc dddd. " * 40
    shards = one(spark, value, lambda c: packing.shard_content(c, 50))
    assert "".join(shards) == value and max(map(len, shards)) <= 50 and all(s.endswith(".") for s in shards[:-1])
    said = "".join(f"Satz {i} 说了。" for i in range(20))
    cut = one(spark, said, lambda c: packing.excerpt(c, 40))
    assert cut == "Satz 0 说了。...Satz 18 说了。\nSatz 19 说了。" and len(cut) <= 40
    assert one(spark, "x" * 50, lambda c: packing.excerpt(c, 13)) == "x" * 5 + "..." + "x" * 5
    assert one(spark, " short ", lambda c: packing.excerpt(c, 13)) == "short" and one(spark, "long", lambda c: packing.excerpt(c, 3)) == "lon"
    assert one(spark, "long", lambda c: packing.excerpt(c, 0)) == ""


def test_trimmed_texts(spark):
    assert one(spark, " ab cd ef ", lambda c: text.trim_text(c, 6)) == "ab cd..." and one(spark, "ab cd", lambda c: text.trim_text(c, 5)) == "ab cd"
    assert one(spark, "x" * 200, text.preview) == "x" * 120 + "..." and one(spark, "x" * 200, lambda c: text.preview(c, 50)) == "x" * 50 + "..."
    assert [one(spark, v, text.conversation_mode) for v in (" P2P ", "other", "Topic")] == ["p2p", "", "topic"]


def test_pack_carries_on_over_batches(spark):
    """Groups longer than an Arrow batch fold as one."""
    r = random.Random(2)
    sizes = {g: [r.randint(1, 9) for _ in range(n)] for g, n in (("a", 2500), ("b", 3), ("c", 900))}
    df = spark.createDataFrame([(g, i, 0, n) for g, ns in sizes.items() for i, n in enumerate(ns)], "g string, o long, a long, x long").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = {(x.g, x.o): x.batch for x in packing.pack(df, ("g",), "o", "a", "x", 20, base=0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g, ns in sizes.items():
        held, batch = 0, 0
        for i, n in enumerate(ns):
            held, batch = (held + n, batch) if batch and held + n <= 20 else (n, batch + 1)
            assert got[g, i] == batch


def test_pack_components_keeps_what_fits(spark):
    r = random.Random(6)
    rows = [("g", i, i // 3, r.randint(1, 30), 0) for i in range(60)]
    got = packing.pack_components(spark.createDataFrame(rows, "g string, pos long, component long, ascii long, other long"), ("g",), 40, base=0).collect()
    size = {c: sum(x[3] for x in rows if x[2] == c) for c in range(20)}
    for c, n in size.items():
        if (n * 5 + 11) // 12 <= 40:
            assert len({x.batch for x in got if x.component == c}) == 1
    for b in {x.batch for x in got}:
        part = [x for x in got if x.batch == b]
        assert (sum(x["ascii"] for x in part) * 5 + 11) // 12 <= 40 or len(part) == 1


def test_pack_components_by_locked_sets(spark):
    rows = [("g", i, 1, 10, 0, {0: "a", 3: "a", 1: "b", 2: "b", 4: None}[i]) for i in range(5)]
    got = packing.pack_components(spark.createDataFrame(rows, "g string, pos long, component long, ascii long, other long, locked string"), ("g",), 10, base=0).collect()
    batch = {x.pos: x.batch for x in got}
    assert batch[0] == batch[3] and batch[1] == batch[2] and len(set(batch.values())) == 3


def test_split_windows(spark):
    rows = [(w, i, 600, 0) for w, n in ((1, 37), (2, 1), (3, 5)) for i in range(n)] + [(4, 0, 90_000, 0)]
    got = context.split_windows(spark.createDataFrame(rows, "window_id long, pos long, ascii long, other long"), 1200).collect()
    assert sorted((x.window_id, x.pos) for x in got) == sorted(x[:2] for x in rows)
    parts = {}
    for x in sorted(got, key=lambda x: (x.window_id, x.pos)):
        parts.setdefault((x.window_id, x.part), []).append(x)
    for part in parts.values():
        assert [x.pos for x in part] == list(range(part[0].pos, part[0].pos + len(part)))
        assert len(part) == 1 or (sum(x["ascii"] for x in part) * 5 + 11) // 12 + 200 <= 1200


def test_evidence_audit_against_all_subsets(spark):
    r, rows, want = random.Random(9), [], {}
    for g in range(25):
        members = list(range(100 * g, 100 * g + r.randint(1, 6)))
        pairs = sorted({tuple(sorted(r.sample(members, 2))) for _ in range(r.randint(0, 6))}) if len(members) > 1 else []
        rows.append((g, members, pairs))

        def parts(chosen, members=members):
            find = {m: m for m in members}
            for a, b in chosen:
                a, b = find[a], find[b]
                find = {k: a if v == b else v for k, v in find.items()}
            return len(set(find.values()))

        names = sorted(pairs, key=lambda p: f"{p[0]}-{p[1]}")
        best = next(c for k in range(len(names) + 1) for c in itertools.combinations(names, k) if parts(c) == parts(names))
        want[g] = (",".join(f"{a}-{b}" for a, b in best), parts(names))
    assign = spark.createDataFrame([(g, m) for g, ms, _ in rows for m in ms], "group_id long, draft_id long")
    rel = spark.createDataFrame([(f"{a}-{b}", [a, b]) for _, _, ps in rows for a, b in ps], "relation_id string, draft_ids array<long>")
    got = {x.group_id: (x.relation_ids, x.parts) for x in evidence.evidence_audit(assign, rel).collect()}
    assert got == want


def joined(sets, chosen, members):
    parts = [{m} for m in members]
    for i in chosen:
        hit = [p for p in parts if p & sets[i]]
        parts = [p for p in parts if not p & sets[i]] + ([set().union(*hit)] if hit else [])
    return len(parts)


def test_smallest_connecting_sets_against_all_subsets():
    r, done = random.Random(3), 0
    while done < 300:
        members = list(range(r.randint(2, 9)))
        sets = [frozenset(r.sample(members, min(len(members), r.choice([2, 2, 3, 4])))) for _ in range(r.randint(1, 12))]
        if joined(sets, range(len(sets)), set().union(*sets)) > 1:
            continue
        done += 1
        best = next(c for k in range(len(sets) + 1) for c in itertools.combinations(range(len(sets)), k) if joined(sets, c, set().union(*sets)) == 1)
        assert tuple(evidence.smallest_connecting(sets)) == best


def test_larger_relations_at_any_number(spark):
    r, rows, want = random.Random(5), [], {}
    for g in range(12):
        members = list(range(100 * g, 100 * g + r.randint(5, 9)))
        sets = sorted({tuple(sorted(r.sample(members, r.choice([2, 2, 3, 3, 4])))) for _ in range(r.randint(14, 20))})
        names = [f"r{g:02}-{i:02}" for i in range(len(sets))]
        rows += [(g, members, n, list(s)) for n, s in zip(names, sets, strict=True)]
        sets = [frozenset(s) for s in sets]
        parts = joined(sets, range(len(sets)), members)
        if parts == 1:
            best = next(c for k in range(len(sets) + 1) for c in itertools.combinations(range(len(sets)), k) if joined(sets, c, members) == 1)
        else:
            best = [i for i in range(len(sets)) if joined(sets, range(i + 1), members) < joined(sets, range(i), members)]
        want[g] = (",".join(names[i] for i in best), parts)
    # nine drafts, thirteen relations, of which the last two are enough
    many = [[0, 1], [1, 2], [2, 3], [3, 4], [4, 5], [5, 6], [6, 7], [7, 8], [0, 8], [1, 3], [2, 4], [0, 1, 2, 3, 4], [4, 5, 6, 7, 8]]
    rows += [(50, [9000 + i for i in range(9)], f"r{n:02}", [9000 + i for i in ids]) for n, ids in enumerate(many)]
    want[50] = ("r11,r12", 1)
    assign = spark.createDataFrame(sorted({(g, m) for g, ms, _, _ in rows for m in ms}), "group_id long, draft_id long")
    rel = spark.createDataFrame([(n, ids) for _, _, n, ids in rows], "relation_id string, draft_ids array<long>")
    got = {x.group_id: (x.relation_ids, x.parts) for x in evidence.evidence_audit(assign, rel).collect()}
    assert got == want
    assert evidence.evidence_audit(assign.limit(0), rel).count() == 0
    assert {x.parts for x in evidence.evidence_audit(assign.where("group_id = 50"), rel.limit(0)).collect()} == {9}


def test_numbers_over_a_whole_table(spark):
    r = random.Random(1)
    rows = [(r.choice("abc"), r.randrange(1000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(6)
    order = {x[2]: n for n, x in enumerate(sorted(rows, key=lambda x: (x[1], x[2])), 1)}
    assert {x.i: x.n for x in numbering.numbered(df, ["v", "i"], "n").collect()} == order
    got = {x.i: x.n for x in numbering.numbered(df, ["v", "i"], "n", ["k"]).collect()}
    for k in "abc":
        assert [got[x[2]] for x in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2]))] == list(range(1, sum(x[0] == k for x in rows) + 1))
    assert numbering.numbered(df.limit(0), ["v"], "n").count() == 0


def test_reply_chains_longer_than_twenty_and_cycles(spark):
    msgs = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)] + [(100, 101), (101, 100)], "message_id long, reply_to long")
    got = windows.reply_ancestors(spark.createDataFrame([(39,), (100,)], "message_id long"), msgs).collect()
    assert sorted((x.start_id, x.message_id, x.depth) for x in got) == sorted([(39, 39 - k, k) for k in range(1, 40)] + [(100, 101, 1)])


def test_a_chain_of_five_thousand_replies(spark, monkeypatch):
    from evtrail import scratch

    tables, real = [], scratch.written

    def counted(df, what, rows=None):
        tables.append(what)
        return real(df, what, rows)

    monkeypatch.setattr(scratch, "written", counted)
    msgs = spark.range(5001).select(F.col("id").alias("message_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("reply_to"))
    got = windows.reply_ancestors(spark.createDataFrame([(5000,), (7,)], "message_id long"), msgs)
    assert got.groupBy("start_id").agg(F.count("*").alias("n"), F.max("depth").alias("d"), F.sum("message_id").alias("s")).orderBy("start_id").collect() == [(7, 7, 7, 21), (5000, 5000, 5000, 5000 * 4999 // 2)]
    assert tables.count("ancestors") <= 15  # one to begin with, and fourteen rounds


def test_ancestors_against_a_walk(spark):
    r = random.Random(8)
    rows = [(i, r.choice([None, r.randrange(60)])) for i in range(60)] + [(5, 9), (5, 11)]  # some ids twice, many cycles
    up = {}
    for i, p in rows:
        up.setdefault(i, set()).update({p} - {None})
    want = []
    for start in range(0, 60, 3):
        seen, at, depth = {start}, {start}, 0
        while at:
            at, depth = {p for x in at for p in up.get(x, ())} - seen, depth + 1
            want += [(start, p, depth) for p in at]
            seen |= at
    got = windows.reply_ancestors(spark.createDataFrame([(i,) for i in range(0, 60, 3)], "message_id long"), spark.createDataFrame(rows, "message_id long, reply_to long")).collect()
    assert sorted((x.start_id, x.message_id, x.depth) for x in got) == sorted(want)


def test_content_trees(spark):
    tree = '{"a": [{"tag": "text", "text": " one "}, [[{"tag": "a", "href": "http://x", "text": "L"}]], {"tag": "at", "user_id": "u1", "text": "name"}], "b": {"image_key": "img_1", "text": "two"}}'
    got = chat.extract_content(spark.createDataFrame([(tree,), ("plain",), (None,), ("[]",)], "content string")).select("parts.*").collect()
    assert (got[0].text, got[0].links[0].url, got[0].links[0].title, got[0].images, got[0].mentions) == ("one\nL\ntwo", "http://x", "L", ["img_1"], ["u1"])
    assert [x.text for x in got[1:]] == ["plain", "", ""]


def test_a_collision_of_events_fails(spark):
    rows = [("2026-01-01", ["m"], ["c"], "x")] * 2
    drafts = spark.createDataFrame(rows, "date string, source_message_ids array<string>, source_conversation_ids array<string>, content string")
    assert [x.collision for x in merge.build_events(drafts).collect()] == [True, True]
    with pytest.raises(Exception, match="two events have the id"):
        merge.checked_events(drafts).collect()
    assert merge.checked_events(drafts.limit(1)).count() == 1


def test_days_are_written_anew(spark, tmp_path):
    rows = [("a", "2026-01-01", "e1"), ("a", "2026-01-01", "e2"), ("b", "2026-01-01", "e3")]
    events = spark.createDataFrame(rows, "owner_id string, date string, event_id string")
    days = spark.createDataFrame([("a", "2026-01-01"), ("b", "2026-01-01"), ("c", "2026-01-01")], "owner_id string, date string")
    path = str(tmp_path / "days")
    assert sinks.write_day(events, path, days) == 3
    assert sinks.write_day(events.where("event_id = 'e1'"), path, days.where("owner_id = 'a'")) == 1
    assert spark.read.parquet(path).where("not is_marker").count() == 2 and spark.read.parquet(path).where("is_marker").count() == 3
    known = sinks.remember(events.select(sinks.input_hash("event_id").alias("fingerprint"), F.to_json(F.struct("event_id")).alias("input"), F.lit(1).alias("result"), "owner_id"))
    assert known.columns == ["fingerprint", "input", "result"]


def test_catalogs_are_checked(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('[{"emoji_type": "a", "name": "A", "description": "x"}, {"emoji_type": "b", "name": "B", "description": "y"}]')
    bad.write_text('[{"emoji_type": "a", "name": "A", "description": "x"}, {"emoji_type": "a", "name": "", "description": "y"}]')
    assert chat.load_catalog(spark, str(good), 2).count() == 2
    for path, n in ((good, 3), (bad, None)):
        with pytest.raises(ValueError, match="not sound"):
            chat.load_catalog(spark, str(path), n)


def test_merge_contents(spark):
    df = spark.createDataFrame([(["b", "a b c", "b", "", "x\n\ny", "y"],)], "v array<string>")
    assert df.select(merge.merge_contents(F.col("v"))).first()[0] == "a b c\n\nx\n\ny"


def test_groups(spark):
    drafts = spark.createDataFrame([(1, "t1", "long content", ["m2", "m1"]), (2, "t2", "short", ["m1", "m3"]), (3, "t3", "c", ["m4"])], "draft_id long, topic string, content string, source_message_ids array<string>")
    assign = spark.createDataFrame([("g", 2, 0, True), ("g", 1, 1, False), ("h", 3, 0, False)], "group_id string, draft_id long, pos int, primary boolean")
    got = {r.group_id: r for r in merge.materialize_groups(drafts, assign).collect()}
    assert (got["g"].topic, got["g"].draft_ids, got["g"].source_message_ids) == ("t2", [2, 1], ["m1", "m3", "m2"]) and got["h"].topic == "t3"
    same = spark.createDataFrame([("e", "t", "ab", 1), ("e", "t", "xabx", 2), ("f", "t", "ab", 3), ("f", "t", "cd", 4)], "event_id string, title string, content string, draft_id long")
    assert {r.event_id: r.same for r in merge.exact_groups(same).collect()} == {"e": True, "f": False}


def test_components_random(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(500, 560)] + [(7000, 7000)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges for x in e}


def test_evidence_and_audits(spark):
    keys = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, "y"), (4, "z"), (5, "x"), (5, "q")], "draft_id long, key string")
    got = {(r.a, r.b): (r.shared, r.same) for r in relations.evidence_pairs(keys).collect()}
    assert got == {(1, 2): (1, False), (1, 5): (1, False), (2, 5): (1, False), (2, 3): (1, False)}
    assert {(r.a, r.b) for r in relations.hub_links(keys, 2).collect()} == {(2, 1), (5, 1)}
    assign = spark.createDataFrame([("g", 1, 0), ("g", 2, 1), ("h", 2, 2), ("h", 9, 3)], "group_id string, draft_id long, pos int")
    expected = spark.createDataFrame([(1,), (2,), (3,)], "draft_id long")
    assert {(r.draft_id, r.error) for r in audit.audit_partition(expected, assign).collect()} == {(2, "duplicate"), (3, "missing"), (9, "unknown")}
    assert {(r.draft_id, r.group_id) for r in audit.repair_partition(assign, expected).collect()} == {(1, "g"), (2, "g"), (3, "single:3")}
    assert [r.connected for r in graph.connected_by(spark.createDataFrame([("g", 1), ("g", 2), ("g", 3)], "group_id string, draft_id long"), keys).collect()] == [True]
    assert graph.conversation_only(spark.createDataFrame([("g", 1), ("g", 4)], "group_id string, draft_id long"), keys, spark.createDataFrame([(1, "c"), (4, "c")], "draft_id long, key string")).count() == 1


def test_evidence_pairs_of_hot_keys(spark):
    sets = {i: {"hot"} | ({"odd"} if i % 2 else set()) | ({f"k{i % 97}"} if i % 3 else set()) for i in range(1, 1102)}
    keys = spark.createDataFrame([(i, k) for i, s in sets.items() for k in s], "draft_id long, key string")
    want = {(a, b): (len(sets[a] & sets[b]), sets[a] == sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert len(want) == 1101 * 1100 // 2
    assert {(r.a, r.b): (r.shared, r.same) for r in relations.evidence_pairs(keys).toLocalIterator()} == want
    some = keys.where("draft_id <= 40")
    got = relations.evidence_pairs(some, fan_out=3).collect()
    assert len(got) == 40 * 39 // 2 and {(r.a, r.b): (r.shared, r.same) for r in got} == {p: v for p, v in want.items() if p[1] <= 40}


def shuffled(df, what: str) -> bool:
    """Whether the plan that ran shuffles by this column."""
    df.collect()
    return f"hashpartitioning({what}#" in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_pairs_are_told_where_they_meet(spark):
    import random

    r = random.Random(4)
    sets = {i: {r.randrange(30) for _ in range(r.choice((1, 2, 3, 12)))} for i in range(60)}
    keys = spark.createDataFrame([(i, k) for i, s in sets.items() for k in s] + [(99, None)], "draft_id long, key long")
    want = {(a, b): (len(sets[a] & sets[b]), sets[a] == sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert not shuffled(relations.evidence_pairs(keys), "a")
    for carried, fan_out in ((64, 1000), (64, 4), (3, 1000), (3, 4), (0, 4)):
        got = relations.evidence_pairs(keys, fan_out, carried).collect()
        assert len(got) == len(want) and {(x.a, x.b): (x.shared, x.same) for x in got} == want


def test_group_relations_of_all_kinds(spark):
    import random

    r = random.Random(5)
    sets = {kind: {i: {r.randrange(n) for _ in range(r.choice((1, 2, 9)))} for i in range(40)} for kind, n in (("part", 25), ("file", 60), ("conversation", 9))}
    kinds = {k: spark.createDataFrame([(i, x) for i, s in v.items() for x in s], "draft_id long, key long") for k, v in sets.items()}
    assign = spark.createDataFrame([(i, i % 3) for i in range(38)], "draft_id long, group_id long")
    want = {}
    for a in range(38):
        for b in range(a + 1, 38):
            types = sorted(k for k, v in sets.items() if v[a] & v[b])
            if types and a % 3 != b % 3:
                want[a, b] = ",".join(types)
    assert not shuffled(relations.group_relations(kinds, assign), "a")
    for carried, fan_out in ((64, 1000), (4, 5)):
        got = relations.group_relations(kinds, assign, fan_out, carried).collect()
        assert len(got) == len(want) and {(x.a, x.b): x.types for x in got} == want


def test_shared_counts_of_few_and_many_keys(spark):
    import random

    r = random.Random(7)
    sets = {i * 10**10: {f"k{r.randrange(20)}" for _ in range(r.choice((1, 4, 9)))} for i in range(70)}
    keys = spark.createDataFrame([(i, k) for i, s in sets.items() for k in s] + [(7, "alone"), (8, None)], "draft_id long, key string")
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    for most_keys, block in ((2048, 2048), (2048, 9), (3, 9)):
        got = relations.shared_counts(keys, most_keys, block).collect()
        assert len(got) == len(want) and {(x.a, x.b): x.n for x in got} == want
    # of few keys no pair is shuffled or met more than once
    assert "MapInArrow" in relations.shared_counts(keys)._jdf.queryExecution().optimizedPlan().toString()
    assert relations.shared_counts(keys.limit(0)).count() == 0


def test_coverage_looks_at_rarest_ids(spark):
    import random

    r = random.Random(6)
    outputs = {o: {r.randrange(60) for _ in range(r.choice((3, 12, 40)))} for o in range(40)}
    sources = {i: {r.randrange(61) for _ in range(r.choice((1, 2, 3, 5)))} for i in range(200)}
    sources |= {200 + o: set(r.sample(sorted(x), min(4, len(x)))) for o, x in outputs.items()}
    want = {i: any(x <= y for y in outputs.values()) for i, x in sources.items()}
    df = spark.createDataFrame([(i, m) for i, x in sources.items() for m in x], "source_id long, message_id long")
    out = spark.createDataFrame([(o, m) for o, x in outputs.items() for m in x], "output_id long, message_id long")
    for words in (4, 1):
        got = metrics.coverage(df, out, words).collect()
        assert len(got) == len(want) and {x.source_id: x.covered for x in got} == want
    # a message that all outputs have and one that a single output has: only that output is looked at
    hot = spark.range(3000).select(F.col("id").alias("output_id"), F.lit(0).cast("long").alias("message_id")).union(spark.createDataFrame([(7, 1)], "output_id long, message_id long"))
    asked = spark.createDataFrame([(i, m) for i in range(50) for m in (0, 1)], "source_id long, message_id long")
    df = metrics.coverage(asked, hot)
    assert df.collect() and all(x.covered for x in df.collect())
    near = [f for f in df.inputFiles() if "coverage-near" in f]
    assert spark.read.parquet(*near).count() == 50


def test_metrics(spark):
    assert one(spark, 'stage="a b" seconds=3.5 n=1', metrics.parse_timing_log) == {"stage": "a b", "seconds": "3.5", "n": "1"}
    pairs = spark.createDataFrame([("r", float(i)) for i in range(7)], "relation string, gap double")
    assert metrics.gap_quantiles(pairs).first().p75 == float(sorted(range(7))[round(6 * 0.75)])
    a, b = (spark.createDataFrame(x, "metric string, value long") for x in ([("m", 4), ("only", 1)], [("m", 5)]))
    assert {r.metric: (r.delta, r.percent) for r in metrics.metric_delta(a, b).collect()} == {"m": (1, 25.0), "only": (-1, -100.0)}


def test_scans_over_hot_keys(spark):
    r = random.Random(6)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), r.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(7)
    got = {x.i: (x.n, x.s) for x in numbering.scanned(df, ["v", "i"], ["k"], "n", {"s": F.col("v")}).collect()}
    for k in ("hot", "b", None):
        total = 0
        for n, (_, v, i) in enumerate(sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2])), 1):
            total += v
            assert got[i] == (n, total)
    assert numbering.scanned(df.limit(0), ["v"], ["k"], "n", {"s": F.col("v")}).count() == 0


def test_gap_quantiles_with_nulls(spark):
    df = spark.createDataFrame([("a", 4.0), ("a", 1.0), ("a", None), ("a", 2.0), ("a", 9.0), (None, 3.0), ("b", None)], "relation string, gap double")
    got = {x.relation: tuple(x)[1:] for x in metrics.gap_quantiles(df).collect()}
    assert got["a"] == (5, 1.0, 3.0, 4.0, 9.0) and got[None] == (1, 3.0, 3.0, 3.0, 3.0)
    assert got["b"] == (1, None, None, None, None)


def test_shares_of_repeated_rows_and_zero_budget(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 2, 5), ("g", 3, 1), ("h", 1, 7)], "group_id string, pos long, length long")
    shares = lambda budget: {(x.group_id, x.pos): x.share for x in merge.allocate_lengths(df, budget).collect()}
    assert shares(8) == {("g", 1): 4, ("g", 2): 3, ("g", 3): 1, ("h", 1): 7}
    assert shares(0) == {("g", 1): 0, ("g", 2): 0, ("g", 3): 0, ("h", 1): 0}
    assert {x.group_id: x.quota for x in merge.fit_quota(df, 8).collect()} == {"g": 3, "h": 7}
    assert merge.ordered_distinct(df, ["group_id"], "length", "pos", "v").orderBy("group_id").first().v == [5, 1]
