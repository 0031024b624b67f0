"""Context of windows: rows asked for by id or direction, budgets, splitting, roles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evtrail.functions.text import tokens_of_counts

from .windows import direct_links, nearest_messages


def messages_by_id(ids: DataFrame, msgs: DataFrame) -> DataFrame:
    """Rows by (conversation_id, message_id); an id of another conversation finds nothing."""
    return msgs.join(ids.select("conversation_id", "message_id").distinct(), ["conversation_id", "message_id"], "left_semi")


def private_external(windows: DataFrame, day: DataFrame, every: DataFrame, target: str = "reply_to") -> DataFrame:
    """(conversation_id, message_id): rows outside the day that rows of private windows reply to, or that
    reply to them.  windows: conversation_id, message_id of p2p windows."""
    some = every.join(windows.select("conversation_id").distinct(), "conversation_id", "left_semi")
    children = some.select("conversation_id", F.col("message_id").alias("found"), F.col(target).alias("message_id")).join(windows, ["conversation_id", "message_id"], "left_semi").select("conversation_id", "found")
    parents = day.where(F.col(target).isNotNull()).join(windows, ["conversation_id", "message_id"], "left_semi").select("conversation_id", F.col(target).alias("found"))
    both = children.union(parents).distinct().withColumnRenamed("found", "message_id")
    return both.join(day.select("conversation_id", "message_id"), ["conversation_id", "message_id"], "left_anti").join(some.select("conversation_id", "message_id"), ["conversation_id", "message_id"], "left_semi")


def valid_requests(requests: DataFrame, members: DataFrame, types: tuple[str, ...] = ("earlier", "later", "attachment", "linked_text"), attachments: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """Requests of a known type whose targets all stand in their slice; requests: request_id, slice_id, request_type,
    target_message_ids.

    Where they have target_attachment_ids and target_link_ids, a request of attachments names some, all of its target messages, and no
    link; one of linked texts the other way round; any other names neither.  attachments: message_id,
    attachment_id; links: message_id, link_id."""
    at = requests.select("request_id", "slice_id", F.explode_outer("target_message_ids").alias("message_id"))
    known = members.select("slice_id", "message_id", F.lit(True).alias("known")).distinct()
    good = at.join(known, ["slice_id", "message_id"], "left").groupBy("request_id").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("good")).where("good")
    out = requests.where(F.col("request_type").isin(*types)).join(good.select("request_id"), "request_id", "left_semi")
    if "target_attachment_ids" not in requests.columns:
        return out
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    asks = {"attachment": ("target_attachment_ids", attachments, "attachment_id"), "linked_text": ("target_link_ids", links, "link_id")}
    for kind, (own, owned, name) in asks.items():
        each = requests.where(F.col("request_type") == kind).select("request_id", F.explode(own).alias(name), "target_message_ids")
        held = each.select("request_id", name, F.explode("target_message_ids").alias("message_id")).join(owned.select("message_id", name), ["message_id", name], "left_semi").select("request_id", name).distinct()
        out = out.join(each.join(held, ["request_id", name], "left_anti").select("request_id"), "request_id", "left_anti")
    exclusive = F.when(F.col("request_type") == "attachment", some("target_attachment_ids") & ~some("target_link_ids")).when(F.col("request_type") == "linked_text", some("target_link_ids") & ~some("target_attachment_ids"))
    return out.where(exclusive.otherwise(~some("target_attachment_ids") & ~some("target_link_ids")))


def expand_context(slices: DataFrame, requests: DataFrame, msgs: DataFrame, blocks: DataFrame | None = None, cap: int = 7, rounds: int = 2) -> DataFrame:
    """(slice_id, round, kind, message_id, block_id): what the requests of each round add to their slices.

    A round takes texts first (kinds attachment and linked_text, with their block_id), then for each slice and direction the `cap` rows
    before its first or behind its last target (temporal), then what these reply to or quote (relation); a row
    comes once.  A target has to be in its slice when its round begins, so rows of round one can be targets of round two.

    slices: slice_id, conversation_id, message_id; requests: slice_id, round, request_type (earlier, later, attachment, linked_text),
    message_id (a row a target), block_id (the text that is asked for); msgs: conversation_id, message_id, idx, reply_to
    and quote_to, if there; blocks: kind, message_id, block_id.  A job a round, whatever the number of slices."""
    from evtrail.scratch import written

    known = slices.select("slice_id", "conversation_id", "message_id").distinct()
    place = msgs.select("conversation_id", "message_id", "idx")
    links = direct_links(msgs)
    out, held = [], None
    for n in range(1, rounds + 1):
        asked = requests.where(F.col("round") == n).join(known, ["slice_id", "message_id"])
        if blocks is not None:
            texts = asked.where("block_id is not null").join(blocks.select(F.col("kind").alias("request_type"), "message_id", "block_id"), ["request_type", "message_id", "block_id"])
            texts = texts.select("slice_id", F.col("request_type").alias("kind"), "message_id", "block_id").distinct()
            fresh = texts if held is None else texts.join(held, ["slice_id", "kind", "block_id"], "left_anti").select(texts.columns)
            # a block belongs to the message that asks for it first
            fresh = written(fresh.groupBy("slice_id", "kind", "block_id").agg(F.min("message_id").alias("message_id")), "context-texts")
            held = fresh.select("slice_id", "kind", "block_id") if held is None else held.union(fresh.select("slice_id", "kind", "block_id"))
            out.append(fresh.select("slice_id", F.lit(n).alias("round"), "kind", "message_id", "block_id"))
        targets = asked.join(place, ["conversation_id", "message_id"]).select(F.col("slice_id").alias("request_id"), "conversation_id", "idx", "request_type")
        near = reduce(DataFrame.union, [nearest_messages(targets.where(F.col("request_type") == kind), msgs, kind, cap) for kind in ("earlier", "later")])
        near = written(near.select(F.col("request_id").alias("slice_id"), "conversation_id", "message_id").distinct(), "context-near")
        more = near.join(known, ["slice_id", "conversation_id", "message_id"], "left_anti")
        behind = near.join(links, ["conversation_id", "message_id"]).select("slice_id", "conversation_id", F.col("target").alias("message_id")).distinct()
        behind = behind.join(place, ["conversation_id", "message_id"], "left_semi").select(near.columns)
        behind = behind.join(known.union(near), ["slice_id", "conversation_id", "message_id"], "left_anti")
        new = written(more.withColumn("kind", F.lit("temporal")).union(behind.withColumn("kind", F.lit("relation"))), "context")
        out.append(new.select("slice_id", F.lit(n).alias("round"), "kind", "message_id", F.lit(None).cast(blocks.schema["block_id"].dataType if blocks is not None else "string").alias("block_id")))
        known = known.union(new.select(known.columns))
    return reduce(DataFrame.union, out)


def image_parents(units: DataFrame, msgs: DataFrame) -> DataFrame:
    """Parents with an image of the owner's rows; units: unit_id, conversation_id, message_id; msgs: mime_types."""
    own = units.join(msgs.where("owner and reply_to is not null").select("conversation_id", "message_id", "reply_to"), ["conversation_id", "message_id"])
    image = msgs.where(F.exists("mime_types", lambda m: m.startswith("image/"))).select("conversation_id", F.col("message_id").alias("reply_to"))
    return own.join(image, ["conversation_id", "reply_to"]).select("unit_id", F.col("reply_to").alias("message_id")).distinct()


def limit_context(rows: DataFrame, target: int, base: int = 200) -> DataFrame:
    """(slice_id, pos) of context rows that fit: temporal ones first, then relations; one that does not fit is
    passed over.

    rows: slice_id, pos, kind (main, temporal, relation), ascii, other."""
    from .packing import estimate, fold_rows

    def make() -> Callable:
        a = x = 0

        def step(row: dict) -> tuple[bool]:
            nonlocal a, x
            fits = row["rank"] == 0 or estimate(a + row["ascii"], x + row["other"], base) <= target
            if fits:
                a, x = a + row["ascii"], x + row["other"]
            return (fits,)

        return step

    order = F.when(F.col("kind") == "main", 0).when(F.col("kind") == "temporal", 1).otherwise(2).alias("rank")
    at = rows.select("slice_id", order, F.col("pos").cast("long").alias("pos"), F.col("ascii").cast("long").alias("ascii"), F.col("other").cast("long").alias("other"))
    return fold_rows(at, ("slice_id",), ("rank", "pos"), make, "kept boolean").where("kept").select("slice_id", "pos")


def split_windows(rows: DataFrame, target: int, base: int = 200) -> DataFrame:
    """Halves a window's rows again and again until each part is under the target or has one row.

    rows: window_id, pos, ascii, other; returns them with part, its bounds encoded as a binary path.  Each
    round sums the parts still too large, for all windows at once; parts halve, so rounds are as many as
    the logarithm of the largest window."""
    from evtrail.scratch import written

    at, done = rows.withColumn("part", F.lit("1")), []
    while True:
        w = Window.partitionBy("window_id", "part")
        n, rank = F.count("*").over(w), F.row_number().over(w.orderBy("pos"))
        over = tokens_of_counts(F.sum("ascii").over(w), F.sum("other").over(w), base) > target
        half = F.when(rank <= F.ceil(n / 2), "0").otherwise("1")
        at = written(at.withColumn("cut", over & (n > 1)).withColumn("part", F.when(F.col("cut"), F.concat("part", half)).otherwise(F.col("part"))), "split")
        done.append(at.where("not cut").drop("cut"))
        at = at.where("cut").drop("cut")
        if at.isEmpty():
            return reduce(DataFrame.union, done)


def split_units(rows: DataFrame, blocks: DataFrame, links: DataFrame, target: int, base: int = 200) -> tuple[DataFrame, DataFrame]:
    """(rows, blocks) of units cut again and again until each is under the target or can't be cut: with unit_id, to which each cut adds
    :part-1, :attachment-2 and so on, and oversized, which marks what stayed too large.

    A unit of several anchors is cut between them, its main rows at the first anchor of the second half; else its main rows are halved and
    both keep the anchor; else its attachments, else its linked texts are halved, with all rows on both sides.  A part has its
    main rows and anchors, what these reply to or quote and what replies to or quotes them, and the texts that hang on
    these rows.  A unit without main rows takes all its rows for main.

    rows: unit_id, message_id, pos, main, anchor, ascii, other; blocks: unit_id, kind (attachment or linked), block_id, message_id, ascii,
    other; links: message_id, target.  All units are cut at once, a few jobs a round; rounds are as many as the logarithms of a unit's
    anchors, rows and texts together.  What has ended is written in its round, and no join sends a side of it to the driver: such a side grows
    with the units, and the rounds' sides would all be there at once."""
    from evtrail.scratch import written

    rows = rows.select("unit_id", "message_id", "pos", "main", "anchor", F.col("ascii").cast("long").alias("ascii"), F.col("other").cast("long").alias("other"))
    blocks = blocks.select("unit_id", "kind", "block_id", "message_id", F.col("ascii").cast("long").alias("ascii"), F.col("other").cast("long").alias("other"))
    links = written(links.select("message_id", "target").where("target is not null").distinct(), "split-links")
    shuffled = lambda df: df.hint("merge")
    done_rows, done_blocks = [], []
    while True:
        held = rows.groupBy("unit_id").agg(F.count_if("anchor").alias("anchors"), F.count_if("main").alias("mains"), F.count("*").alias("all"), F.sum("ascii").alias("a"), F.sum("other").alias("x"))
        texts = blocks.groupBy("unit_id").agg(F.count_if(F.col("kind") == "attachment").alias("attachments"), F.count_if(F.col("kind") == "linked").alias("linked"), F.sum("ascii").alias("ta"), F.sum("other").alias("tx"))
        held = held.join(shuffled(texts), "unit_id", "left").fillna(0)
        mains = F.when(F.col("mains") == 0, F.col("all")).otherwise(F.col("mains"))
        over = tokens_of_counts(F.col("a") + F.col("ta"), F.col("x") + F.col("tx"), base) > target
        kind = F.when(F.col("anchors") > 1, "anchor").when(mains > 1, "row").when(F.col("attachments") > 1, "attachment").when(F.col("linked") > 1, "linked")
        state = written(held.select("unit_id", over.alias("over"), F.when(over, kind).alias("cut"), "anchors", mains.alias("mains"), (F.col("mains") == 0).alias("bare"), "attachments", "linked"), "split-state")
        ended = state.where("cut is null").select("unit_id", F.col("over").alias("oversized"))
        done_rows.append(written(rows.join(shuffled(ended), "unit_id"), "split-done-rows"))
        done_blocks.append(written(blocks.join(shuffled(ended), "unit_id"), "split-done-blocks"))
        going = state.where("cut is not null").drop("over")
        if going.isEmpty():
            return reduce(DataFrame.union, done_rows), reduce(DataFrame.union, done_blocks)

        by = Window.partitionBy("unit_id")
        at = rows.join(shuffled(going), "unit_id").withColumn("main", F.col("main") | F.col("bare"))
        nth = lambda flag: F.row_number().over(Window.partitionBy("unit_id", flag).orderBy("pos", "message_id"))
        half = lambda rank, n: F.when(rank <= F.floor(F.col(n) / 2), 1).otherwise(2)
        at = at.withColumn("anchor_side", F.when(F.col("anchor"), half(nth("anchor"), "anchors"))).withColumn("row_side", F.when(F.col("main"), half(nth("main"), "mains")))
        at = at.withColumn("right", F.min(F.when(F.col("anchor_side") == 2, F.struct("pos", "message_id"))).over(by))
        at = at.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("side"))
        main_side = F.when(F.col("cut") == "anchor", F.when(F.struct("pos", "message_id") < F.col("right"), 1).otherwise(2)).when(F.col("cut") == "row", F.col("row_side")).otherwise(F.col("side"))
        anchor_side = F.when(F.col("cut") == "anchor", F.col("anchor_side")).otherwise(F.col("side"))
        name = F.concat("unit_id", F.lit(":"), F.when(F.col("cut").isin("anchor", "row"), "part").otherwise(F.col("cut")), F.lit("-"), F.col("side").cast("string"))
        at = at.select(name.alias("unit_id"), "message_id", "pos", (F.col("main") & (main_side == F.col("side"))).alias("main"), (F.col("anchor") & (anchor_side == F.col("side"))).alias("anchor"), "ascii", "other")
        at = written(at, "split-dealt")
        core = at.where("main or anchor").select("unit_id", "message_id")
        named = core.join(shuffled(links), "message_id").select("unit_id", F.col("target").alias("message_id"))
        naming = core.withColumnRenamed("message_id", "target").join(shuffled(links), "target").select("unit_id", "message_id")
        rows = written(at.join(shuffled(core.union(named).union(naming).distinct()), ["unit_id", "message_id"], "left_semi").select(rows.columns), "split-rows")

        parts = blocks.join(shuffled(going.select("unit_id", "cut", "attachments", "linked")), "unit_id").withColumn("nth", F.row_number().over(Window.partitionBy("unit_id", "kind").orderBy("message_id", "block_id")))
        own = F.when(F.col("cut") == F.col("kind"), half(F.col("nth"), "n"))
        parts = parts.withColumn("n", F.when(F.col("kind") == "attachment", F.col("attachments")).otherwise(F.col("linked"))).withColumn("own", own)
        parts = parts.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("side")).where("own is null or own = side")
        parts = parts.select(name.alias("unit_id"), "kind", "block_id", "message_id", "ascii", "other", F.col("own").isNotNull().alias("named"))
        there = rows.select("unit_id", "message_id", F.lit(True).alias("there")).distinct()
        blocks = written(parts.join(shuffled(there), ["unit_id", "message_id"], "left").where("named or there").select(blocks.columns), "split-blocks")


def self_evidence(members: DataFrame, msgs: DataFrame) -> DataFrame:
    """(segment, message_id) that may prove the owner's part: own rows, direct replies to them, rows that mention
    the owner, rows the owner reacted on."""
    at = members.select("segment", "conversation_id", "message_id").join(msgs, ["conversation_id", "message_id"])
    own = at.where("owner or reacted or mentions_owner").select("segment", "message_id")
    owner = msgs.where("owner").select("conversation_id", F.col("message_id").alias("reply_to"))
    replies = at.join(owner, ["conversation_id", "reply_to"], "left_semi").select("segment", "message_id")
    return own.union(replies).distinct()


def demote_relation_context(members: DataFrame, context: DataFrame) -> DataFrame:
    """Rows that came as relation context are never primary."""
    ids = context.select("message_id", F.lit(True).alias("ctx")).distinct()
    return members.join(ids, "message_id", "left").withColumn("role", F.when(F.coalesce("ctx", F.lit(False)) & (F.col("role") == "primary"), "context").otherwise(F.col("role"))).drop("ctx")


def to_slices(members: DataFrame) -> DataFrame:
    """Window members as slices: main rows become primary, all others context."""
    return members.select(F.concat_ws(":", F.col("conversation_id").cast("string"), F.col("window").cast("string")).alias("slice_id"), "message_id", F.when(F.col("role") == "main", "primary").otherwise("context").alias("role"))


def anchor_units(msgs: DataFrame, before: int, after: int) -> DataFrame:
    """Fixed units around owner runs; a reaction within a text unit goes to the first unit that has it, any
    other is a unit of its own.  (conversation_id, unit, first, last, reactions)"""
    from .windows import owner_runs

    runs = owner_runs(msgs).groupBy("conversation_id", "run").agg(F.greatest(F.min("idx") - before, F.lit(1)).alias("first"), (F.max("idx") + after).alias("last"))
    cover = runs.select("conversation_id", "run", F.explode(F.sequence("first", "last")).alias("idx"))
    marks = msgs.where("reacted and not owner").select("conversation_id", "idx").join(cover, ["conversation_id", "idx"], "left").groupBy("conversation_id", "idx").agg(F.min("run").alias("run"))
    held = marks.where("run is not null").groupBy("conversation_id", "run").agg(F.count("*").alias("reactions"))
    text = runs.join(held, ["conversation_id", "run"], "left").select("conversation_id", "first", "last", F.coalesce("reactions", F.lit(0)).alias("reactions"))
    alone = marks.where("run is null").select("conversation_id", F.greatest(F.col("idx") - before, F.lit(1)).alias("first"), (F.col("idx") + after).alias("last"), F.lit(1).cast("long").alias("reactions"))
    return text.union(alone).withColumn("unit", F.row_number().over(Window.partitionBy("conversation_id").orderBy("first", "last")))
