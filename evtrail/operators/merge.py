"""Deterministic merging of drafts and events.  Order is data: every fold takes a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtrail.functions.text import clean_text, collapse, dedupe_paragraphs

from .numbering import scanned


def preferred_text(value: Column, pos: Column, limit: int = 4000) -> Column:
    """Of the clean values, within the limit first, then longest, then earliest: an aggregate that combines
    before the shuffle."""
    value = clean_text(value)
    n = F.length(value)
    return F.max_by(value, F.when(value != "", F.struct((n <= limit).alias("fits"), F.least(n, F.lit(limit)).alias("n"), (-pos).alias("pos"))))


def ordered_distinct(rows: DataFrame, keys: list[str], value: str, pos: str, name: str) -> DataFrame:
    """(keys, name): the distinct values of each key in the order they come first.  Each value goes down to its first place
    before the shuffle, so a key's row holds its distinct values and no more."""
    first = rows.groupBy(*keys, value).agg(F.min(pos).alias("_pos")).where(F.col(value).isNotNull())
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col("_pos"), F.col(value).alias("_v")))), lambda x: x["_v"])
    return rows.select(*keys).distinct().join(first.groupBy(*keys).agg(listed.alias(name)), keys, "left") if keys else first.agg(listed.alias(name))


def merge_contents(texts: Column) -> Column:
    """Drops texts that others contain, in order, then repeated paragraphs."""

    def step(kept: Column, t: Column) -> Column:
        return F.when(F.exists(kept, lambda k: k.contains(t)), kept).otherwise(F.concat(F.filter(kept, lambda k: ~t.contains(k)), F.array(t)))

    clean = F.filter(F.transform(texts, clean_text), lambda t: t != "")
    return dedupe_paragraphs(F.array_join(F.aggregate(clean, F.array().cast("array<string>"), step), "\n\n"))


def exact_groups(events: DataFrame) -> DataFrame:
    """(event_id, n, same): rows of one id that have one title, and contents each of which the next longer
    one contains, white space apart; anything else under one id is divergent."""
    events = events.withColumn("content", collapse("content"))
    w = Window.partitionBy("event_id").orderBy(F.length("content"), "content", "draft_id")
    at = events.withColumn("within", F.coalesce(F.col("content").contains(F.lag("content").over(w)), F.lit(True)))
    return at.groupBy("event_id").agg(F.count("*").alias("n"), (F.bool_and("within") & (F.count_distinct(collapse("title")) == 1)).alias("same"))


def merge_duplicates(drafts: DataFrame) -> DataFrame:
    """One row for drafts with the same ordered sources and the same topic."""
    key = [F.array_join("source_message_ids", ",").alias("sources"), collapse("topic").alias("key_topic")]
    at = drafts.withColumn("pos", F.row_number().over(Window.partitionBy(F.array_join("source_message_ids", ","), collapse("topic")).orderBy("draft_id")))
    return at.groupBy(*key).agg(F.min("draft_id").alias("draft_id"), preferred_text(F.col("content"), F.col("pos")).alias("content"), F.count("*").alias("n"))


def materialize_groups(drafts: DataFrame, assign: DataFrame) -> DataFrame:
    """One row a group: the primary's topic and content, else the preferred ones, and the members' sources.

    assign: group_id, draft_id, pos, primary; drafts: draft_id, topic, content, source_message_ids."""
    at = assign.join(drafts, "draft_id")
    first = lambda c: F.coalesce(F.max(F.when(F.col("primary"), F.col(c))), preferred_text(F.col(c), F.col("pos")))
    rows = at.groupBy("group_id").agg(first("topic").alias("topic"), first("content").alias("content"), F.array_sort(F.collect_list(F.struct("pos", "draft_id", "source_message_ids"))).alias("m"))
    ids = F.array_distinct(F.flatten(F.transform("m", lambda x: x["source_message_ids"])))
    return rows.select("group_id", "topic", "content", F.transform("m", lambda x: x["draft_id"]).alias("draft_ids"), ids.alias("source_message_ids"))


def merge_whole(rows: DataFrame, keys: list[str], texts: tuple[str, ...], lists: tuple[str, ...], primary: str | None = None) -> DataFrame:
    """One row a key, whole: contents merged in order of `pos`, of each of `texts` the primary's (a boolean column) or else the preferred
    one, of each of `lists` the values in the order they come first, none empty; n rows.

    Lists go down to their distinct values before they are gathered, each beside its first place, so a key's row holds what the result
    has; rows: the keys, pos, content, the columns named."""
    first = lambda c: F.coalesce(F.max(F.when(F.col(primary) & (clean_text(c) != ""), F.col(c))), preferred_text(F.col(c), F.col("pos"))) if primary else preferred_text(F.col(c), F.col("pos"))
    held = F.array_sort(F.collect_list(F.struct("pos", "content")))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(first(c).alias(c) for c in texts), merge_contents(F.transform(held, lambda x: x["content"])).alias("content"))
    for c in lists:
        each = rows.select(*keys, "pos", F.posexplode(c).alias("_nth", "_v")).where(F.coalesce(F.col("_v").cast("string"), F.lit("")) != "").withColumn("_at", F.struct("pos", "_nth"))
        out = out.join(ordered_distinct(each, keys, "_v", "_at", c), keys, "left").withColumn(c, F.coalesce(c, F.array().cast(rows.schema[c].dataType)))
    return out


def summary_lineage(groups: DataFrame, summaries: DataFrame) -> DataFrame:
    """(synthetic_id, draft_id, source_id): which drafts and which of their sources each synthetic event stands for.
    groups: group_id, draft_id; summaries: as summary_events() returns them."""
    at = summaries.select("group_id", "synthetic_id", F.explode_outer("source_ids").alias("source_id"))
    return groups.select("group_id", "draft_id").distinct().join(at, "group_id").select("synthetic_id", "draft_id", "source_id")


def order_sources(ids: DataFrame, msgs: DataFrame) -> DataFrame:
    """(group_id, ids): source ids in the order of messages, unknown ones last by id."""
    at = ids.join(msgs.select("message_id", "idx"), "message_id", "left")
    key = F.struct(F.col("idx").isNull().alias("unknown"), "idx", "message_id")
    return at.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_set(key)), lambda x: x["message_id"]).alias("ids"))


def order_relations(relations: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(group_id, relations): in the configured order, others behind in the order met; relations: group_id, relation, pos."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col("relation")), F.lit(0)), F.lit(len(order) + 1))
    at = relations.groupBy("group_id", "relation").agg(F.min("pos").alias("pos")).withColumn("place", place)
    return at.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "pos", "relation"))), lambda x: x["relation"]).alias("relations"))


def balanced_content(rows: DataFrame) -> DataFrame:
    """(group_id, content): distinct contents taken in turn from each source; rows: group_id, source, content, pos."""
    at = rows.groupBy("group_id", "source", "content").agg(F.min("pos").alias("pos"))
    turn = F.row_number().over(Window.partitionBy("group_id", "source").orderBy("pos"))
    start = F.min("pos").over(Window.partitionBy("group_id", "source"))
    at = at.withColumn("turn", turn).withColumn("start", start)
    return at.groupBy("group_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("turn", "start", "content"))), lambda x: x["content"])), "\n").alias("content"))


def merge_detail(value: Column, separator: str = "；") -> Column:
    """The three longest distinct details (ties by text), joined."""
    longest = F.array_sort(F.transform(F.collect_set(value), lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v"))))
    return F.array_join(F.transform(F.slice(longest, 1, 3), lambda x: x["v"]), separator)


def group_titles(rows: DataFrame, keys: list[str], title: str, pos: str) -> DataFrame:
    """(keys, titles): the distinct titles of each key, none empty, in the order they come first, joined."""
    at = ordered_distinct(rows, keys, title, pos, "titles")
    return at.withColumn("titles", F.array_join(F.filter(F.coalesce("titles", F.array().cast("array<string>")), lambda t: t != ""), "；"))


def allocate_lengths(rows: DataFrame, budget: int) -> DataFrame:
    """Fair shares of `budget` characters per group: short texts keep all, the long ones share a level, what
    is left over goes one each by position.  rows: group_id, pos, length.

    Ranks and sums within a group come from sorted ranges (scanned), so a group may hold most of the rows."""
    at, cut = _levels(rows.select("group_id", "pos", F.col("length").cast("long").alias("length")), budget)
    at = at.join(cut, "group_id", "left").withColumn("long", F.col("cut").isNotNull() & (F.struct("length", "pos") >= F.struct("cut.length", "cut.pos")))
    spent = at.groupBy("group_id").agg(F.sum(F.when(F.col("long"), F.col("cut.level")).otherwise(F.col("length"))).alias("spent"))
    turns = scanned(at.where("long").select("group_id", "pos", "length"), ["pos", "length"], ["group_id"], "turn").select("group_id", "pos", "length", "turn")
    share = F.least(F.col("length"), F.col("cut.level") + F.when(F.col("turn") <= budget - F.col("spent"), 1).otherwise(0))
    short = at.where("not long").select("group_id", "pos", "length", F.col("length").alias("share"))
    return short.union(turns.join(cut, "group_id").join(spent, "group_id").select("group_id", "pos", "length", share.cast("long").alias("share")))


def _levels(rows: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """The rows with rank and level (what each text may have if all from it on have equally much), and (group_id, cut): the first text of
    each group, by length, that its level does not reach; its level holds for all from there on."""
    order = [c for c in ("length", "pos") if c in rows.columns]
    at = scanned(rows, order, ["group_id"], "rank", {"upto": F.col("length")})
    n = rows.groupBy("group_id").agg(F.count("*").alias("n"))
    at = at.join(n, "group_id").withColumn("level", F.floor((budget - (F.col("upto") - F.col("length"))) / (F.col("n") - F.col("rank") + 1)))
    cut = at.where("length > level").groupBy("group_id").agg(F.min(F.struct(*order, "rank", "level")).alias("cut"))
    return at, cut


def fit_quota(rows: DataFrame, budget: int) -> DataFrame:
    """(group_id, quota): the largest q with sum(min(length, q)) <= budget; the longest length if all fit.
    rows: group_id, length.  Closed form from one sort: the first length whose level does not reach it."""
    at, cut = _levels(rows.select("group_id", F.col("length").cast("long").alias("length")), budget)
    most = at.groupBy("group_id").agg(F.max("length").alias("most"))
    return most.join(cut, "group_id", "left").select("group_id", F.coalesce("cut.level", "most").cast("long").alias("quota"))


def merge_drafts(rows: DataFrame, key: str) -> DataFrame:
    """One row a key: contents merged in order, and the ordered unions of the members' lists.

    rows: the key, pos, content and array columns, which are flattened in order of pos without repeats."""
    lists = [f.name for f in rows.schema if f.dataType.typeName() == "array"]
    listed = lambda c: F.array_distinct(F.flatten(F.transform("m", lambda x: F.coalesce(x[c], F.array().cast(rows.schema[c].dataType))))).alias(c)
    at = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "content", *lists))).alias("m"))
    return at.select(key, merge_contents(F.transform("m", lambda x: x["content"])).alias("content"), *[listed(c) for c in lists])


def build_events(drafts: DataFrame) -> DataFrame:
    """Adds event_id, the fingerprints of the sources and conversations, and `collision`: whether another draft
    has the same id.  drafts: date (text), source_message_ids, source_conversation_ids, content."""
    from evtrail.functions.hashing import conversation_fingerprint, evidence_fingerprint, stable_event_id

    conversations = F.filter(F.transform("source_conversation_ids", lambda c: conversation_fingerprint(F.col("date"), c)), lambda f: f != "")
    at = drafts.withColumns({
        "event_id": stable_event_id(F.col("date"), F.col("source_message_ids"), F.col("content")),
        "evidence_fingerprints": F.transform("source_message_ids", evidence_fingerprint), "conversation_fingerprints": conversations,
    })
    twice = at.groupBy("event_id").agg((F.count("*") > 1).alias("collision"))
    return at.join(twice, "event_id")


def checked_events(drafts: DataFrame) -> DataFrame:
    """build_events() without the mark; a collision fails the job that reads them, at the row that has it."""
    at = build_events(drafts)
    failed = F.raise_error(F.concat(F.lit("two events have the id "), F.col("event_id"))).cast("string")
    return at.withColumn("event_id", F.when(F.col("collision"), failed).otherwise(F.col("event_id"))).drop("collision")


def materialize_merged(events: DataFrame, assign: DataFrame) -> DataFrame:
    """One row a group of events of several people: the preferred title, the balanced content, and the ordered
    unions of people, sources, owners, labels and fingerprints.

    events: draft_id, title, content, person, event_id, owner and the arrays source_people, source_event_ids,
    source_owners, action_labels, evidence_fingerprints; assign: group_id, draft_id, pos."""
    or_own = lambda many, one: F.when(F.size(F.coalesce(F.col(many), F.array().cast("array<string>"))) > 0, F.col(many)).otherwise(F.array(one))
    owners = F.filter(F.concat(F.coalesce("source_owners", F.array().cast("array<string>")), F.array("owner")), lambda o: F.coalesce(o, F.lit("")) != "")
    at = assign.join(events, "draft_id").withColumns({"source_people": or_own("source_people", "person"), "source_event_ids": or_own("source_event_ids", "event_id"), "source_owners": owners})
    lists = ("source_people", "source_event_ids", "source_owners", "action_labels", "evidence_fingerprints")
    rows = at.groupBy("group_id").agg(preferred_text(F.col("title"), F.col("pos")).alias("title"), F.array_sort(F.collect_list(F.struct("pos", "draft_id", *lists))).alias("m"))
    listed = lambda c: F.array_distinct(F.flatten(F.transform("m", lambda x: x[c]))).alias(c)
    rows = rows.select("group_id", "title", *map(listed, lists))
    return rows.join(balanced_content(at.select("group_id", F.col("person").alias("source"), "content", "pos")), "group_id")


def summary_events(groups: DataFrame, events: DataFrame) -> DataFrame:
    """(group_id, synthetic_id, title, content, summary_source, source_ids): each group as one event to go on with.

    A group of one keeps its event's words; one with a whole given summary takes that; any other the preferred
    title and the merged contents.  groups: group_id, draft_id, pos, summary_title, summary_content; events:
    draft_id, title, content, source_ids."""
    at = groups.join(events, "draft_id")
    rows = at.groupBy("group_id").agg(
        F.count("*").alias("n"), F.max(clean_text(F.coalesce("summary_title", F.lit("")))).alias("st"), F.max(clean_text(F.coalesce("summary_content", F.lit("")))).alias("sc"),
        preferred_text(F.col("title"), F.col("pos")).alias("title"), F.array_sort(F.collect_list(F.struct("pos", "content", "source_ids"))).alias("m"),
    )
    given = (F.col("st") != "") & (F.col("sc") != "")
    source = F.when(F.col("n") == 1, "original_singleton").when(given, "given").otherwise("merged")
    content = F.when(F.col("n") == 1, F.col("m")[0]["content"]).when(given, F.col("sc")).otherwise(merge_contents(F.transform("m", lambda x: x["content"])))
    return rows.select(
        "group_id", F.concat(F.lit("summary-"), F.col("group_id").cast("string")).alias("synthetic_id"), F.when(source == "given", F.col("st")).otherwise(F.col("title")).alias("title"),
        content.alias("content"), source.alias("summary_source"), F.array_distinct(F.flatten(F.transform("m", lambda x: x["source_ids"]))).alias("source_ids"),
    )
