"""Reactions as anchors and signals, and context in rounds."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from evtrail.operators import context, windows

MSGS = "conversation_id long, message_id string, s long, owner boolean, mentions_owner boolean, reply_to string"


def messages(spark, rows):
    return windows.with_index(spark.createDataFrame(rows, MSGS).withColumn("ts", F.timestamp_seconds("s")), order=("s", "message_id"))


def test_two_reactions_are_two_anchors(spark):
    msgs = messages(spark, [(1, "a", 0, False, False, None), (1, "b", 60, True, False, None), (1, "c", 120, True, False, None), (1, "d", 180, False, False, None), (1, "e", 240, False, False, None)])
    rows = [(1, "a", 0, None, None), (1, "a", 1, "x", 500), (1, "b", 0, "y", None), (1, "d", 0, "x", None), (1, "e", 3, "", None)]  # x comes back on d
    marks = spark.createDataFrame(rows, "conversation_id long, message_id string, pos int, reaction_id string, at long").withColumn("action_time", F.timestamp_seconds("at"))
    got = windows.build_anchors(msgs, marks).orderBy("anchor").select("first", "last", "rows", "signals").collect()
    assert [tuple(x) for x in got] == [(1, 1, 1, 1), (1, 1, 1, 1), (2, 3, 2, 3), (5, 5, 1, 1)]
    signals = windows.response_signals(msgs, marks).orderBy("pos").collect()
    assert [x.signal_id for x in signals] == ["reaction:a:0", "text:b", "y", "text:c", "reaction:e:3", "x"]  # x is late by its own time
    assert windows.anchor_windows(msgs, 10, 3, marks).groupBy("window").count().collect()[0]["count"] == 4
    assert windows.build_anchors(msgs.limit(0), marks).count() == 0 == windows.response_signals(msgs, marks.limit(0)).where("kind = 'reaction'").count()


def test_rows_of_round_one_are_targets_of_round_two(spark):
    msgs = messages(spark, [(1, f"m{i:02}", i, i == 20, False, {18: "m02", 25: "m40", 12: "gone"}.get(i)) for i in range(41)])
    slices = spark.createDataFrame([("s", 1, "m20"), ("z", 1, "m20")], "slice_id string, conversation_id long, message_id string")
    ask = [("s", 1, "earlier", "m20", None), ("s", 2, "earlier", "m18", None), ("s", 2, "later", "m39", None), ("s", 1, "attachment", "m20", "f1"), ("s", 2, "attachment", "m18", "f1"), ("s", 2, "linked_text", "m18", "l1"), ("z", 2, "earlier", "m18", None)]
    blocks = spark.createDataFrame([("attachment", "m20", "f1"), ("attachment", "m18", "f1"), ("linked_text", "m18", "l1"), ("attachment", "m20", "f2")], "kind string, message_id string, block_id string")
    requests = spark.createDataFrame(ask, "slice_id string, round int, request_type string, message_id string, block_id string")
    got = context.expand_context(slices, requests, msgs, blocks, cap=3).collect()
    found = {(x.slice_id, x.round, x.kind, x.block_id or x.message_id) for x in got}
    assert found == {
        ("s", 1, "attachment", "f1"), ("s", 1, "temporal", "m19"), ("s", 1, "temporal", "m18"), ("s", 1, "temporal", "m17"), ("s", 1, "relation", "m02"),
        ("s", 2, "linked_text", "l1"), ("s", 2, "temporal", "m16"), ("s", 2, "temporal", "m15"),
    }  # m39 is not in the slice, m18 not in z
    assert len(got) == len(found)
    assert context.expand_context(slices, requests.limit(0), msgs).count() == 0


def plain_split(unit, target):
    """One unit at a time: (name, rows in order, main ids, anchor ids, blocks)."""
    todo, out = [unit], []
    while todo:
        name, rows, main, anchors, blocks, links = todo.pop(0)
        place = {m: i for i, (m, _) in enumerate(rows)}
        size = sum(n for _, n in rows) + sum(b[3] for b in blocks)
        if (size * 5 + 11) // 12 + 200 <= target:
            out.append((name, rows, main, anchors, blocks, False))
            continue
        mains = [m for m, _ in rows if m in (main or place)]
        marks = [m for m, _ in rows if m in anchors]
        kinds = {k: [b for b in blocks if b[0] == k] for k in ("attachment", "linked")}
        if len(marks) > 1:
            left, right = marks[: len(marks) // 2], marks[len(marks) // 2 :]
            start = min(place[m] for m in right)
            cut = [("part", [m for m in mains if place[m] < start], left, None), ("part", [m for m in mains if place[m] >= start], right, None)]
        elif len(mains) > 1:
            cut = [("part", part, marks, None) for part in (mains[: len(mains) // 2], mains[len(mains) // 2 :])]
        else:
            kind = next((k for k in kinds if len(kinds[k]) > 1), None)
            if kind is None:
                out.append((name, rows, main, anchors, blocks, True))
                continue
            n = len(kinds[kind]) // 2
            cut = [(kind, mains, marks, (kind, part)) for part in (kinds[kind][:n], kinds[kind][n:])]
        for i, (suffix, m, k, named) in enumerate(cut, 1):
            core = {*m, *k}
            near = core | {t for a, t in links if a in core} | {a for a, t in links if t in core}
            some = [(x, n) for x, n in rows if x in near]
            held = [b for b in blocks if (named and b[0] == named[0] and b in named[1]) or (not (named and b[0] == named[0]) and b[2] in near and b[2] in dict(some))]
            todo.append((f"{name}:{suffix}-{i}", some, set(m), set(k), held, links))
    return out


def test_units_are_cut_by_anchors_rows_and_texts(spark):
    r, units = random.Random(12), []
    for u in range(25):
        ids = [f"u{u}m{i:02}" for i in range(r.randint(1, 14))]
        rows = [(m, r.choice([50, 300, 900])) for m in ids]
        main, anchors = {m for m in ids if r.random() < 0.6}, {m for m in ids if r.random() < 0.25}
        blocks = sorted((k, f"{m}{k}{n}", m, r.choice([100, 2000])) for m in ids for k in ("attachment", "linked") for n in range(r.choice([0, 0, 0, 1, 3])))
        links = [(r.choice(ids), r.choice(ids)) for _ in range(4)]
        units.append((f"u{u}", rows, main, anchors, sorted(blocks, key=lambda b: (b[0], b[2], b[1])), links))
    rows = [(u, m, i, m in main, m in marks, n, 0) for u, rs, main, marks, _, _ in units for i, (m, n) in enumerate(rs)]
    blocks = [(u, k, b, m, n, 0) for u, *_, bs, _ in units for k, b, m, n in bs]
    got, texts = context.split_units(
        spark.createDataFrame(rows, "unit_id string, message_id string, pos long, main boolean, anchor boolean, ascii long, other long"),
        spark.createDataFrame(blocks, "unit_id string, kind string, block_id string, message_id string, ascii long, other long"),
        spark.createDataFrame([x for u in units for x in u[5]], "message_id string, target string"), 900,
    )
    want = [x for u in units for x in plain_split(u, 900)]
    assert {(x.unit_id, x.message_id, x.main, x.anchor, x.oversized) for x in got.collect()} == {(n, m, m in main, m in marks, over) for n, rs, main, marks, _, over in want for m, _ in rs}
    assert sorted((x.unit_id, x.block_id) for x in texts.collect()) == sorted((n, b[1]) for n, *_, bs, _ in want for b in bs)
    assert any(over for *_, over in want) and any(":attachment-" in x[0] for x in want) and any(":linked-" in x[0] for x in want)


def test_split_units_sends_no_side_to_the_driver(spark):
    rows = spark.range(40).selectExpr("concat('u', id % 4) as unit_id", "id as message_id", "id as pos", "true as main", "id % 3 = 0 as anchor", "300 as ascii", "0 as other")
    texts = spark.createDataFrame([("u1", "linked", 1, 1, 50, 0)], "unit_id string, kind string, block_id long, message_id long, ascii int, other int")
    links = spark.createDataFrame([(5, 1)], "message_id long, target long")
    for df in context.split_units(rows, texts, links, 400):
        assert df.count() > 0
        assert "Join" not in df._jdf.queryExecution().sparkPlan().toString()
