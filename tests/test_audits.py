"""Audits of answers: hand-made cases, each for one finding."""

from __future__ import annotations

from evtrail.operators import audit, evidence


def errors(df):
    return {tuple(x) for x in df.collect()}


def test_resolutions_need_evidence_on_each_side(spark):
    sides = spark.createDataFrame([("r", "0", 1, True), ("r", "1", 2, True), ("t", "x", 1, False), ("t", "x", 3, False), ("t", "y", 4, False)], "relation_id string, side string, draft_id long, structural boolean")
    assign = spark.createDataFrame([(1, "g"), (2, "g"), (3, "h"), (4, "h")], "draft_id long, group_id string")
    sources = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (4, "a")], "draft_id long, message_id string")

    def of(*rows):
        given = spark.createDataFrame(rows, "relation_id string, decision string, connected_draft_ids array<long>, evidence_message_ids array<string>")
        return errors(evidence.audit_resolutions(sides, given, assign, sources))

    good = ("t", "separate", [1, 4], ["a", "d"])
    assert of(("r", "merged", [1, 2], ["a", "b"]), good) == set()
    assert of(("r", "merged", [1, 2], ["a"]), good) == {("r", "side_without_evidence")}
    assert of(("r", "merged", [1], ["a"]), good) == {("r", "fewer_than_two_drafts"), ("r", "structural_not_named")}
    assert of(("r", "merged", [1, 3], ["a", "c"]), good) == {("r", "merged_not_reflected"), ("r", "structural_not_named")}
    assert of(("r", "separate", [], ["a", "b"]), good) == {("r", "separate_contradicted")}
    assert of(("r", "separate", [1, 2], ["a", "b"]), good) == {("r", "representatives_together")}
    assert of(("r", "perhaps", None, ["a", "b"]), ("t", "merged", None, ["c"])) == {("r", "invalid_decision"), ("t", "side_without_evidence"), ("t", "fewer_than_two_drafts"), ("t", "one_side_only")}
    assert of(("r", "merged", [1, 2], ["a", "b"]), ("t", "merged", [3, 4], ["c", "d"])) == set()  # h has drafts of both sides
    assert of(("r", "merged", [1, 2], ["a", "b"]), ("r", "merged", [1, 2], ["a", "b"]), ("z", "merged", [], [])) == {("r", "repeated"), ("t", "unresolved"), ("z", "unknown_relation")}


def test_resolutions_take_their_evidence_along(spark):
    """No step shuffles the sources of all drafts that answers name, and each step is written."""
    sides = spark.createDataFrame([("r", "0", 1, True), ("r", "1", 2, True)], "relation_id string, side string, draft_id long, structural boolean")
    assign = spark.createDataFrame([(1, "g"), (2, "g")], "draft_id long, group_id string")
    sources = spark.range(2000).selectExpr("id % 2 + 1 as draft_id", "cast(id as string) as message_id")
    given = spark.createDataFrame([("r", "merged", [1, 2, 2], ["0", None]), ("nope", "merged", None, None)], "relation_id string, decision string, connected_draft_ids array<long>, evidence_message_ids array<string>")
    df = evidence.audit_resolutions(sides, given, assign, sources)
    assert errors(df) == {("r", "side_without_evidence"), ("nope", "unknown_relation")}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_group_audit_asks_for_evidence_and_reason(spark):
    assign = spark.createDataFrame([("g", 1, True), ("g", 2, False), ("h", 3, True)], "group_id string, draft_id long, primary boolean")
    sources = spark.createDataFrame([(1, "a"), (3, "c")], "draft_id long, message_id string")
    none = spark.createDataFrame([], "group_id string, message_id string")
    reasons = spark.createDataFrame([("g", " ")], "group_id string, reason string")
    assert errors(audit.audit_groups(assign, none, sources, reasons)) == {("g", "missing_evidence"), ("g", "missing_reason")}
    given = spark.createDataFrame([("g", "a"), ("h", "a")], "group_id string, message_id string")
    assert errors(audit.audit_groups(assign, given, sources)) == {("h", "evidence_outside_members")}


def test_declared_reasons_connect_on_their_own(spark):
    assign = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3), ("h", 4)], "group_id string, draft_id long")
    keys = spark.createDataFrame([(1, "message", "m"), (2, "message", "m"), (2, "file", "f"), (3, "file", "f"), (1, "conversation", "c"), (2, "conversation", "c"), (3, "conversation", "c")], "draft_id long, kind string, key string")
    kinds = {"by_message": "message", "by_file": "file", "by_chat": "conversation"}

    def of(*reasons, scope=None):
        rows = spark.createDataFrame([("g", r) for r in reasons], "group_id string, reason string")
        return errors(evidence.audit_basis(assign, keys, rows, kinds, scope))

    assert of("by_message", "by_file", "by_chat") == set()  # together they connect
    assert of("by_message") == {("g", "by_message", "not_connected")}
    assert of("by_chat") == set()
    assert of("by_chat", scope=assign.select("group_id")) == set()  # messages and files connect
    keys = keys.where("kind = 'conversation'")
    assert of("by_chat", scope=assign.select("group_id")) == {("g", None, "no_basis")} and of("same_matter", scope=assign.select("group_id")) == set()


def test_orders_of_starts_and_sources(spark):
    msgs = spark.createDataFrame([(1, f"m{i}", i, i == 1) for i in range(4)], "conversation_id long, message_id string, idx long, owner boolean")

    def starts(*ids):
        return errors(audit.audit_starts(spark.createDataFrame([(1, n, i) for n, i in enumerate(ids)], "conversation_id long, pos long, message_id string"), msgs, msgs.where("idx = 2")))

    assert starts("m0", "m2") == set() and starts("m0", "m3", "m2") == {(1, "not_in_order")} == starts("m0", "m2", "m2")
    assert starts("m2", "x") == {(1, "not_from_first_row"), (1, "unknown_start")} and starts() == {(1, "no_start"), (1, "boundary_omitted")}

    def segments(*rows):
        return errors(audit.audit_segments(spark.createDataFrame([(1, i, s, n) for n, (i, s) in enumerate(rows)], "conversation_id long, message_id string, segment string, pos long"), msgs))

    assert segments(("m0", "a"), ("m1", "a"), ("m2", "b"), ("m3", "b")) == set()
    assert segments(("m0", "a"), ("m1", "b"), ("m2", "a"), ("m3", "c")) == {(1, "segment_id_again"), (1, "not_contiguous")}
    assert segments(("m1", "a"), ("m0", "a"), ("m2", "b"), ("m3", "b"), ("x", "b")) == {(1, "not_in_order"), (1, "unknown")}
    members = msgs.withColumnRenamed("conversation_id", "slice_id")
    drafts = spark.createDataFrame([("d", 1, ["m1", "m3"], ["l"], ["m1"], ["r"]), ("e", 1, ["m3", "m1"], ["k"], ["m3"], ["q"])], "draft_id string, slice_id long, source_message_ids array<string>, link_ids array<string>, evidence_message_ids array<string>, relations array<string>")
    links = spark.createDataFrame([("l", "m3"), ("k", "m0")], "link_id string, message_id string")
    want = {("e", x) for x in ("sources_not_in_order", "link_of_no_source", "evidence_not_owners", "relation_not_allowed", "relation_without_evidence")}
    assert errors(audit.audit_drafts(drafts, members, links, None, ("r",))) == want
