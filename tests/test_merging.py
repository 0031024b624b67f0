"""Whole merges and the lineage of synthetic events."""

from __future__ import annotations

import random
import re

from evtrail.operators import audit, merge


def plain_contents(texts):
    kept = []
    for t in filter(None, (x.strip() for x in texts)):
        if not any(t in k for k in kept):
            kept = [k for k in kept if k not in t] + [t]
    return "\n\n".join(dict.fromkeys(p.strip() for p in re.split(r"\n\s*\n", "\n\n".join(kept)) if p.strip()))


def test_merge_whole_against_a_plain_loop(spark):
    r = random.Random(7)
    parts = ["one", "one two", "two three\n\none", "four", "", "four five\n \nsix", "six"]
    rows = [(g, p, r.choice(parts), r.choice(["", "t", "longer"]), p == first, [r.choice(["a", "b", "", "c"]) for _ in range(r.randint(0, 3))]) for g in range(20) for first in [r.randint(0, 9)] for p in range(r.randint(1, 6))]
    df = spark.createDataFrame(rows, "g long, pos long, content string, topic string, primary boolean, labels array<string>").repartition(4)
    got = {x.g: x for x in merge.merge_whole(df, ["g"], ("topic",), ("labels",), "primary").collect()}
    for g in range(20):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: x[1])
        assert got[g].content == plain_contents([x[2] for x in own]) and got[g].n == len(own)
        assert got[g].labels == list(dict.fromkeys(v for x in own for v in x[5] if v))
        said = next((x[3] for x in own if x[4] and x[3]), None) or max((x[3] for x in own), key=len) or None
        assert (got[g].topic or None) == said
    assert merge.merge_whole(df.limit(0), ["g"], ("topic",), ("labels",)).count() == 0


def test_lineage_of_synthetic_events(spark):
    groups = spark.createDataFrame([("g", 1, 0, "", ""), ("g", 2, 1, "", ""), ("h", 3, 0, "", "")], "group_id string, draft_id long, pos long, summary_title string, summary_content string")
    events = spark.createDataFrame([(1, "T", "one", ["a", "b"]), (2, "T", "two", ["b"]), (3, "U", "three", [])], "draft_id long, title string, content string, source_ids array<string>")
    summaries = merge.summary_events(groups, events)
    name = {x.group_id: x.synthetic_id for x in summaries.collect()}
    got = {tuple(x) for x in merge.summary_lineage(groups, summaries).collect()}
    assert got == {(name["g"], d, s) for d in (1, 2) for s in "ab"} | {(name["h"], 3, None)}


def test_sources_grow_by_the_evidence_of_facts(spark):
    drafts = spark.createDataFrame([("d", ["m3", "m9", "m1"]), ("e", ["x"])], "draft_id string, source_message_ids array<string>")
    told = spark.createDataFrame([("d", "m2"), ("d", "unknown"), ("d", "m3")], "draft_id string, message_id string")
    allowed = spark.createDataFrame([("d", f"m{i}", i) for i in range(1, 5)], "draft_id string, message_id string, pos long")
    got = {x.draft_id: x.source_message_ids for x in audit.extend_sources(drafts, told, allowed).collect()}
    assert got == {"d": ["m1", "m2", "m3", "m9"], "e": ["x"]}
