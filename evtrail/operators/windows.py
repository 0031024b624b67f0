"""Anchors, session windows and their context, ranking and ordering.

Input messages have conversation_id, message_id, ts, idx (position in the conversation), owner
(boolean), reacted (the owner reacted on it), mentions_owner, reply_to and optionally quote_to.
Conversation windows partition by conversation; foreign rows enter them only as counts per gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_index(msgs: DataFrame, conversation: str = "conversation_id", order: tuple[str, ...] = ("ts", "message_id")) -> DataFrame:
    return msgs.withColumn("idx", F.row_number().over(Window.partitionBy(conversation).orderBy(*order)))


def owner_runs(msgs: DataFrame) -> DataFrame:
    """Owner rows with the number of their run of consecutive owner rows."""
    w = Window.partitionBy("conversation_id").orderBy("idx")
    fresh = F.col("owner") & ~F.coalesce(F.lag("owner").over(w), F.lit(False))
    return msgs.withColumn("run", F.sum(fresh.cast("long")).over(w)).where("owner")


def own_reactions(msgs: DataFrame, reactions: DataFrame | None = None) -> DataFrame:
    """(conversation_id, message_id, idx, ts, owner, signal_id, pos, action_time): the owner's reactions, each signal id once in a
    conversation, where it is seen first.

    reactions: conversation_id, message_id, pos (from 0, among all reactions on the message), reaction_id and
    action_time, either of which may be null or the id empty; without them a row's `reacted` is one reaction without id."""
    if reactions is None:
        at = msgs.where("reacted").withColumns({"pos": F.lit(0), "reaction_id": F.lit(None).cast("string"), "action_time": F.lit(None).cast("timestamp")})
    else:
        at = msgs.join(reactions.select("conversation_id", "message_id", "pos", "reaction_id", "action_time"), ["conversation_id", "message_id"])
    made = F.concat_ws(":", F.lit("reaction"), "message_id", "pos")
    signal = F.when(F.coalesce("reaction_id", F.lit("")) != "", F.col("reaction_id")).otherwise(made)
    first = F.row_number().over(Window.partitionBy("conversation_id", "signal_id").orderBy("idx", "pos"))
    at = at.select("conversation_id", "message_id", "idx", "ts", "owner", signal.alias("signal_id"), F.col("pos").cast("int").alias("pos"), F.coalesce("action_time", "ts").alias("action_time"))
    return at.withColumn("_nth", first).where("_nth = 1").drop("_nth")


def build_anchors(msgs: DataFrame, reactions: DataFrame | None = None) -> DataFrame:
    """One row an anchor: a run of owner rows, or one reaction of the owner on a foreign row, so that two reactions on a row are two
    anchors; a reaction on an own row belongs to its run.  Numbered by first row, those of a row in the order of
    its reactions; signals counts an anchor's reactions and own rows.  See own_reactions() for `reactions`."""
    marks = own_reactions(msgs, reactions)
    runs = owner_runs(msgs)
    held = marks.where("owner").join(runs.select("conversation_id", "message_id", "run"), ["conversation_id", "message_id"]).groupBy("conversation_id", "run").agg(F.count("*").alias("marks"))
    text = runs.groupBy("conversation_id", "run").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("rows"))
    text = text.join(held, ["conversation_id", "run"], "left").select(*text.columns, (F.col("rows") + F.coalesce("marks", F.lit(0))).alias("signals"), F.lit(0).alias("pos"))
    one = F.lit(1).cast("long")
    alone = marks.where("not owner").select("conversation_id", F.lit(None).cast("long").alias("run"), F.col("idx").alias("first"), F.col("idx").alias("last"), F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"), one.alias("rows"), one.alias("signals"), "pos")
    return text.union(alone).withColumn("anchor", F.row_number().over(Window.partitionBy("conversation_id").orderBy("first", "last", "pos"))).drop("pos")


def direct_links(msgs: DataFrame) -> DataFrame:
    """(conversation_id, message_id, target): what each row replies to or quotes."""
    every = None
    for column in ("reply_to", "quote_to"):
        if column in msgs.columns:
            part = msgs.where(F.col(column).isNotNull()).select("conversation_id", "message_id", F.col(column).alias("target"))
            every = part if every is None else every.union(part)
    return every


def anchor_windows(msgs: DataFrame, gap_minutes: float = 10, max_unrelated: int = 3, reactions: DataFrame | None = None) -> DataFrame:
    """Anchors with the window they belong to.

    A new window starts when the gap to the previous anchor is over `gap_minutes` or when more than
    `max_unrelated` foreign rows between them reply to neither, quote neither (column quote_to, if
    there) and do not mention the owner.  A conversation with a private row (boolean column private, if
    there) is one window.
    """
    anchors = build_anchors(msgs, reactions)
    w = Window.partitionBy("conversation_id").orderBy("idx")
    # several anchors may stand on one row: the last one is what comes before the next
    mark = anchors.groupBy("conversation_id", F.col("last").alias("idx")).agg(F.max("anchor").alias("anchor"))
    at = msgs.join(mark, ["conversation_id", "idx"], "left")
    # anchors that ended before a row, and the anchor that each anchor row belongs to
    at = at.withColumn("gap", F.max("anchor").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    foreign = at.where("not owner and anchor is null and gap is not null").select("conversation_id", "message_id", "gap", "mentions_owner")
    own = owner_runs(msgs).select("conversation_id", "message_id", "run").join(anchors.where("run is not null").select("conversation_id", "run", "anchor"), ["conversation_id", "run"])
    single = msgs.where("not owner").select("conversation_id", "idx", "message_id").join(anchors.where("run is null").select("conversation_id", F.col("first").alias("idx"), "anchor"), ["conversation_id", "idx"])
    member = own.select("conversation_id", F.col("message_id").alias("target"), "anchor").union(single.select("conversation_id", F.col("message_id").alias("target"), "anchor"))
    near = foreign.join(direct_links(msgs), ["conversation_id", "message_id"]).join(member, ["conversation_id", "target"]).where((F.col("anchor") == F.col("gap")) | (F.col("anchor") == F.col("gap") + 1))
    alien = foreign.where(~F.coalesce("mentions_owner", F.lit(False))).join(near.select("conversation_id", "message_id"), ["conversation_id", "message_id"], "left_anti")
    unrelated = alien.groupBy("conversation_id", F.col("gap").alias("before")).agg(F.count("*").alias("unrelated"))
    v = Window.partitionBy("conversation_id").orderBy("anchor")
    out = anchors.withColumn("before", F.lag("anchor").over(v)).withColumn("gap_minutes", (F.unix_micros("first_ts") - F.unix_micros(F.lag("last_ts").over(v))) / 60e6)
    out = out.join(unrelated, ["conversation_id", "before"], "left").fillna(0, ["unrelated"])
    fresh = (F.col("gap_minutes") > gap_minutes) | (F.col("unrelated") > max_unrelated)
    if "private" in msgs.columns:
        private = msgs.where("private").select("conversation_id", F.lit(True).alias("private")).distinct()
        out = out.join(private, "conversation_id", "left").withColumn("private", F.coalesce("private", F.lit(False)))
        fresh = ~F.col("private") & fresh
    fresh = F.col("before").isNull() | fresh
    return out.withColumn("window", F.sum(fresh.cast("long")).over(v)).drop("before")


def window_header(windows: DataFrame) -> DataFrame:
    """One row a window: range, anchors and span in minutes."""
    span = (F.unix_micros(F.max("last_ts")) - F.unix_micros(F.min("first_ts"))) / 60e6
    return windows.groupBy("conversation_id", "window").agg(F.count("*").alias("n_anchors"), F.sum("rows").alias("anchor_rows"), F.min("first").alias("first"), F.max("last").alias("last"), span.alias("span_minutes"))


def window_ids(members: DataFrame, relations: DataFrame, signals: DataFrame) -> DataFrame:
    """(conversation_id, window, main_ids, relation_ids, signal_ids) in order of index, id and time.

    members: conversation_id, window, idx, message_id, role; relations: conversation_id, window, message_id;
    signals: conversation_id, message_id, signal_id, pos."""
    listed = lambda df, order, value, name: df.groupBy("conversation_id", "window").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(name))
    main = members.where("role = 'main'")
    told = main.join(signals.select("conversation_id", "message_id", "signal_id", "pos"), ["conversation_id", "message_id"])
    out = listed(main, "idx", "message_id", "main_ids")
    found = relations.select("conversation_id", "window", "message_id", F.col("message_id").alias("other"))
    out = out.join(listed(found, "other", "message_id", "relation_ids"), ["conversation_id", "window"], "left").join(listed(told, "pos", "signal_id", "signal_ids"), ["conversation_id", "window"], "left")
    return out.select("conversation_id", "window", "main_ids", F.coalesce("relation_ids", F.array().cast(out.schema["relation_ids"].dataType)).alias("relation_ids"), F.coalesce("signal_ids", F.array().cast("array<string>")).alias("signal_ids"))


def expand_direct(units: DataFrame, msgs: DataFrame) -> DataFrame:
    """(unit_id, message_id): a unit's rows, what its anchor rows reply to or quote, the rows that reply to or
    quote those, and their other target.

    units: unit_id, conversation_id, message_id, anchor (boolean)."""
    links = direct_links(msgs)
    anchors = units.where("anchor").select("unit_id", "conversation_id", "message_id")
    up = anchors.join(links, ["conversation_id", "message_id"]).select("unit_id", F.col("target").alias("message_id"))
    child = anchors.select("unit_id", "conversation_id", F.col("message_id").alias("target")).join(links, ["conversation_id", "target"])
    child = child.select("unit_id", "conversation_id", "message_id").join(anchors, ["unit_id", "conversation_id", "message_id"], "left_anti").distinct()
    side = child.join(links, ["conversation_id", "message_id"]).select("unit_id", F.col("target").alias("message_id"))
    return units.select("unit_id", "message_id").union(up).union(child.select("unit_id", "message_id")).union(side).distinct()


def order_events(events: DataFrame, msgs: DataFrame) -> DataFrame:
    """events with pos: by the earliest time of their sources (events whose sources are unknown first), the first
    source id and the event id; numbered over the whole table.  events: event_id, source_message_ids."""
    from .numbering import numbered

    seen = events.select("event_id", F.explode("source_message_ids").alias("message_id")).join(msgs.select("message_id", "ts"), "message_id").groupBy("event_id").agg(F.min("ts").alias("first_ts"))
    at = events.join(seen, "event_id", "left").withColumn("first_id", F.coalesce(F.get("source_message_ids", F.lit(0)).cast("string"), F.lit("")))
    return numbered(at, ["first_ts", "first_id", "event_id"], "pos").drop("first_id")


def input_size(units: DataFrame, base: int = 200) -> DataFrame:
    """(unit_id, rows, tokens, pos): the estimate of each unit's input and its place, the largest first."""
    from evtrail.functions.text import ascii_count, tokens_of_counts

    from .numbering import numbered

    a = ascii_count("text")
    per = units.groupBy("unit_id").agg(F.count("*").alias("rows"), F.sum(a).alias("a"), F.sum(F.length(F.coalesce("text", F.lit(""))) - a).alias("x"))
    at = per.select("unit_id", "rows", tokens_of_counts(F.col("a"), F.col("x"), base).alias("tokens")).withColumn("less", -F.col("tokens"))
    return numbered(at, ["less", "unit_id"], "pos").drop("less")


def window_preview(members: DataFrame, msgs: DataFrame) -> DataFrame:
    """(conversation_id, window, line, role, text): the rows of each window in order, as a listing shows them."""
    from evtrail.functions.text import preview

    line = F.row_number().over(Window.partitionBy("conversation_id", "window").orderBy("idx"))
    at = members.join(msgs.select("conversation_id", "message_id", "text"), ["conversation_id", "message_id"])
    return at.select("conversation_id", "window", line.alias("line"), "role", preview("text").alias("text"))


def window_members(header: DataFrame, msgs: DataFrame, before: int = 2) -> DataFrame:
    """(conversation_id, window, message_id, role): main rows and the `before` rows ahead of them.

    The rows of a window are listed as indexes and joined by equality, not by a range."""
    spans = F.explode(F.sequence(F.greatest(F.col("first") - before, F.lit(1)), F.col("last"))).alias("idx")
    return header.select("conversation_id", "window", "first", spans).join(msgs.select("conversation_id", "idx", "message_id"), ["conversation_id", "idx"]).select("conversation_id", "window", "idx", "message_id", F.when(F.col("idx") < F.col("first"), "timeline").otherwise("main").alias("role"))


def window_relations(members: DataFrame, msgs: DataFrame, target: str = "reply_to") -> DataFrame:
    """Rows outside a window that reply to its main rows, or that its main rows reply to."""
    main = members.where("role = 'main'").select("conversation_id", "window", "message_id")
    children = main.join(msgs.where(F.col(target).isNotNull()).select("conversation_id", F.col(target).alias("message_id"), F.col("message_id").alias("found")), ["conversation_id", "message_id"])
    parents = main.join(msgs.where(F.col(target).isNotNull()).select("conversation_id", "message_id", F.col(target).alias("found")), ["conversation_id", "message_id"])
    found = children.select("conversation_id", "window", "found").union(parents.select("conversation_id", "window", "found")).distinct().withColumnRenamed("found", "message_id")
    return found.join(main, ["conversation_id", "window", "message_id"], "left_anti").join(msgs.select("conversation_id", "message_id"), ["conversation_id", "message_id"], "left_semi")


def base_window(anchors: DataFrame, msgs: DataFrame, before: int, after: int) -> DataFrame:
    """The rows from `before` rows ahead of each anchor to `after` rows behind it."""
    at = anchors.select("conversation_id", "anchor", F.explode(F.sequence(F.greatest(F.col("first") - before, F.lit(1)), F.col("last") + after)).alias("idx"))
    return at.join(msgs.select("conversation_id", "idx", "message_id"), ["conversation_id", "idx"])


def nearest_messages(requests: DataFrame, msgs: DataFrame, direction: str, limit: int) -> DataFrame:
    """For each request (request_id, conversation_id, idx of a target) the `limit` nearest rows before its
    first or behind its last target, without the targets."""
    later = direction == "later"
    edge = requests.groupBy("request_id", "conversation_id").agg((F.max if later else F.min)("idx").alias("edge"))
    step = F.sequence(F.lit(1), F.lit(limit))
    near = F.explode(F.transform(step, lambda k: F.col("edge") + k if later else F.col("edge") - k)).alias("idx")
    return edge.select("request_id", "conversation_id", near).join(msgs.select("conversation_id", "idx", "message_id"), ["conversation_id", "idx"])


def reply_ancestors(starts: DataFrame, msgs: DataFrame, target: str = "reply_to") -> DataFrame:
    """(start_id, message_id, depth): what each start replies to, what that replies to and so on; depth is the smallest number of steps.

    Links of 1, 2, 4, ... steps: a round puts one behind all that is found so far and joins the links with themselves, so that
    rounds grow with the logarithm of the depth.  A row is found once for each start, which ends cycles."""
    from evtrail.scratch import written

    links = written(msgs.where(F.col(target).isNotNull()).select(F.col("message_id").alias("at"), F.col(target).alias("parent")).distinct(), "ancestor-links")
    begin = starts.select(F.col("message_id").alias("at")).distinct()
    found = written(begin.join(links, "at").where("at <> parent").select(F.col("at").alias("start_id"), F.col("parent").alias("message_id"), F.lit(1).alias("depth")), "ancestors")
    step = 1
    while True:
        ahead = found.join(links, found.message_id == links.at).where("start_id <> parent").select("start_id", F.col("parent").alias("message_id"), (F.col("depth") + step).alias("depth"))
        more = ahead.groupBy("start_id", "message_id").agg(F.min("depth").alias("depth")).join(found.select("start_id", "message_id"), ["start_id", "message_id"], "left_anti")
        more = written(more, "ancestors")
        if more.isEmpty():
            return found
        found, step = found.union(more), 2 * step
        twice = links.select(F.col("at").alias("from"), F.col("parent").alias("at")).join(links, "at").select(F.col("from").alias("at"), "parent").distinct()
        links = written(twice, "ancestor-links")


def trim_conversation(msgs: DataFrame, k: int, priority: Column) -> DataFrame:
    """The k rows of each conversation by priority, then distance to the nearest anchor row, then index."""
    w = Window.partitionBy("conversation_id").orderBy("idx")
    own = F.when(F.col("owner"), F.col("idx"))
    back = F.col("idx") - F.last(own, True).over(w)
    ahead = F.first(own, True).over(w.rowsBetween(0, Window.unboundedFollowing)) - F.col("idx")
    at = msgs.withColumn("distance", F.least(back, ahead)).withColumn("priority", priority)
    rank = F.row_number().over(Window.partitionBy("conversation_id").orderBy("priority", F.col("distance").asc_nulls_last(), "idx"))
    return at.withColumn("rank", rank).where(F.col("rank") <= k)


def response_signals(msgs: DataFrame, reactions: DataFrame | None = None) -> DataFrame:
    """Owner texts and reactions as signals, in order of time and id; a signal id counts once, where the conversation has it first.
    (conversation_id, signal_id, kind, message_id, ts, pos); see own_reactions() for `reactions`."""
    texts = msgs.where("owner").select("conversation_id", F.concat(F.lit("text:"), F.col("message_id").cast("string")).alias("signal_id"), F.lit("text").alias("kind"), "message_id", "ts", "idx", F.lit(-1).alias("nth"))
    marks = own_reactions(msgs, reactions).select("conversation_id", "signal_id", F.lit("reaction").alias("kind"), "message_id", F.col("action_time").alias("ts"), "idx", F.col("pos").alias("nth"))
    first = F.row_number().over(Window.partitionBy("conversation_id", "signal_id").orderBy("idx", "nth"))
    both = texts.union(marks).withColumn("_nth", first).where("_nth = 1").drop("_nth", "idx", "nth")
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("conversation_id").orderBy("ts", "signal_id")))


def hard_boundaries(msgs: DataFrame) -> DataFrame:
    """Foreign rows that reply to nothing and mention others but not the owner."""
    return msgs.where("not owner and reply_to is null and mentions_other and not mentions_owner")


def segments_from_starts(msgs: DataFrame, starts: DataFrame) -> DataFrame:
    """Contiguous segments turn-001, turn-002, ... of each conversation."""
    w = Window.partitionBy("conversation_id").orderBy("idx")
    at = msgs.join(starts.select("conversation_id", "message_id", F.lit(1).alias("start")).distinct(), ["conversation_id", "message_id"], "left")
    n = F.greatest(F.sum(F.coalesce("start", F.lit(0))).over(w), F.lit(1))
    return at.withColumn("segment", F.format_string("turn-%03d", n)).drop("start")


def dedupe_ownership(members: DataFrame) -> DataFrame:
    """The first segment that lists a message owns it; for the others it is context."""
    rank = F.row_number().over(Window.partitionBy("message_id").orderBy("segment_order", "segment"))
    return members.withColumn("role", F.when(rank == 1, "primary").otherwise("context"))


def anchor_segments(members: DataFrame) -> DataFrame:
    keep = members.where("role = 'primary' and owner").select("conversation_id", "segment").distinct()
    return members.join(keep, ["conversation_id", "segment"], "left_semi")


def anchor_gaps(msgs: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Gap in minutes and rows between neighbouring owner runs; with events (message_id, event_id) also relation:
    'same' if the two runs share an event, 'different' if both have events but none in common, else
    'unclassified'."""
    w = Window.partitionBy("conversation_id").orderBy("first")
    own = owner_runs(msgs)
    runs = own.groupBy("conversation_id", "run").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    relation = []
    if events is not None:
        held = own.join(events, "message_id").groupBy("conversation_id", "run").agg(F.collect_set("event_id").alias("events"))
        runs = runs.join(held, ["conversation_id", "run"], "left")
        before = F.lag("events").over(w)
        relation = [F.when(F.arrays_overlap("events", before), "same").when(before.isNotNull() & F.col("events").isNotNull(), "different").otherwise("unclassified").alias("relation")]
    gap = (F.unix_micros("first_ts") - F.unix_micros(F.lag("last_ts").over(w))) / 60e6
    return runs.select("conversation_id", "run", gap.alias("gap_minutes"), (F.col("first") - F.lag("last").over(w) - 1).alias("rows_between"), *relation).where("gap_minutes is not null")


def rank_stages(timings: DataFrame, top: int = 5, slow_share: float = 0.25) -> DataFrame:
    """Stages by time with their share; the ranking sees one row a stage."""
    per = timings.groupBy("stage").agg(F.sum("seconds").alias("seconds"))
    whole = Window.partitionBy()
    share = F.col("seconds") / F.sum("seconds").over(whole)
    return per.withColumn("share", share).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("seconds"), "stage"))).where(F.col("rank") <= top).withColumn("slow", F.col("share") >= slow_share)
