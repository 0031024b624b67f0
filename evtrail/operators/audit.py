"""Checks of supplied tables.  Each returns a table of findings, empty where all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtrail.functions.text import clean_text, strip

from .numbering import scanned


def audit_partition(expected: DataFrame, assign: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, draft_id, error): missing, duplicate and unknown members of a partition."""
    n = assign.groupBy(*keys, "draft_id").agg(F.count("*").alias("n"))
    both = expected.select(*keys, "draft_id").distinct().withColumn("known", F.lit(True)).join(n, [*keys, "draft_id"], "full")
    error = F.when(F.col("n").isNull(), "missing").when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "duplicate")
    return both.select(*keys, "draft_id", error.alias("error")).where("error is not null")


def audit_atomic(assign: DataFrame, atoms: DataFrame) -> DataFrame:
    """Atoms (atom_id, draft_id) whose members stand in more than one group."""
    return atoms.join(assign.select("draft_id", "group_id"), "draft_id").groupBy("atom_id").agg(F.count_distinct("group_id").alias("groups")).where("groups > 1")


def audit_groups(assign: DataFrame, evidence: DataFrame, sources: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """(group_id, error): evidence ids that are no source of a member, groups without or with two primaries, and of groups of several
    drafts those without evidence or, where reasons (group_id, reason) are given, without a reason that says something."""
    member = assign.select("group_id", "draft_id").join(sources.select("draft_id", "message_id"), "draft_id").select("group_id", "message_id").distinct()
    given = evidence.select("group_id", "message_id").distinct()
    outside = given.join(member, ["group_id", "message_id"], "left_anti").select("group_id", F.lit("evidence_outside_members").alias("error")).distinct()
    groups = assign.groupBy("group_id").agg(F.count_if("primary").alias("primaries"), (F.count_distinct("draft_id") > 1).alias("several"))
    out = outside.union(groups.where("primaries <> 1").select("group_id", F.lit("not_one_primary").alias("error")))
    several = groups.where("several").select("group_id")
    out = out.union(several.join(given.select("group_id").distinct(), "group_id", "left_anti").select("group_id", F.lit("missing_evidence").alias("error")))
    if reasons is not None:
        said = reasons.where(strip(F.coalesce("reason", F.lit(""))) != "").select("group_id").distinct()
        out = out.union(several.join(said, "group_id", "left_anti").select("group_id", F.lit("missing_reason").alias("error")))
    return out


def repair_partition(assign: DataFrame, expected: DataFrame) -> DataFrame:
    """Unknown members dropped, the first assignment wins, missing drafts become groups of their own."""
    rank = F.row_number().over(Window.partitionBy("draft_id").orderBy("pos", "group_id"))
    kept = assign.join(expected.select("draft_id"), "draft_id", "left_semi").withColumn("rank", rank).where("rank = 1").select("draft_id", F.col("group_id").cast("string").alias("group_id"))
    alone = expected.join(kept, "draft_id", "left_anti").select("draft_id", F.concat(F.lit("single:"), F.col("draft_id").cast("string")).alias("group_id"))
    return kept.union(alone)


def order_breaks(given: DataFrame, reference: DataFrame, keys: list[str], pos: str, place: str, item: str) -> DataFrame:
    """The keys whose sequence of items, given in the order of `pos`, does not run strictly in the order of `place` that
    reference has of them; items that reference does not have are passed over."""
    at = given.select(*keys, item, pos).join(reference.select(*keys, item, F.col(place).alias("_place")), [*keys, item])
    before = F.lag("_place").over(Window.partitionBy(*keys).orderBy(pos))
    return at.withColumn("_before", before).where("_before >= _place").select(*keys).distinct()


def audit_segments(segments: DataFrame, msgs: DataFrame, boundaries: DataFrame | None = None) -> DataFrame:
    """(conversation_id, error): rows missing from the segments, unknown or repeated ones, segments with holes, a boundary inside one;
    where segments have `pos`, their rows' place in the answer, also rows out of order and segment ids that come back."""
    known = msgs.select("conversation_id", "message_id", "idx")
    listed = segments.select("conversation_id", "message_id", "segment")
    say = lambda df, error: df.select("conversation_id", F.lit(error).alias("error"))
    at = known.join(listed, ["conversation_id", "message_id"], "left")
    whole = at.where("segment is not null").groupBy("conversation_id", "segment").agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.count_distinct("idx").alias("n"))
    out = say(at.where("segment is null"), "missing").union(say(whole.where("b - a + 1 <> n"), "not_contiguous"))
    out = out.union(say(listed.join(known, ["conversation_id", "message_id"], "left_anti"), "unknown"))
    out = out.union(say(listed.groupBy("conversation_id", "message_id").count().where("count > 1"), "repeated"))
    if "pos" in segments.columns:
        out = out.union(say(order_breaks(segments, msgs, ["conversation_id"], "pos", "idx", "message_id"), "not_in_order"))
        fresh = F.lag("segment").over(Window.partitionBy("conversation_id").orderBy("pos"))
        runs = segments.withColumn("fresh", ~F.col("segment").eqNullSafe(fresh)).groupBy("conversation_id", "segment").agg(F.count_if("fresh").alias("runs")).where("runs > 1")
        out = out.union(say(runs, "segment_id_again"))
    if boundaries is not None:
        inside = at.join(boundaries.select("conversation_id", "message_id"), ["conversation_id", "message_id"], "left_semi").join(whole, ["conversation_id", "segment"]).where("idx > a")
        out = out.union(say(inside, "boundary_inside"))
    return out.distinct()


def audit_starts(starts: DataFrame, msgs: DataFrame, boundaries: DataFrame | None = None) -> DataFrame:
    """(conversation_id, error) of segments given by their first rows (conversation_id, pos, message_id): the first one is not the first row,
    unknown rows, starts out of order or repeated, boundaries that are no start, conversations without a start."""
    known = msgs.select("conversation_id", "message_id", "idx")
    say = lambda df, error: df.select("conversation_id", F.lit(error).alias("error"))
    ahead = known.groupBy("conversation_id").agg(F.min_by("message_id", "idx").alias("row"))
    first = starts.groupBy("conversation_id").agg(F.min_by("message_id", "pos").alias("start"))
    out = say(ahead.join(first, "conversation_id").where("row <> start"), "not_from_first_row")
    out = out.union(say(ahead.join(first, "conversation_id", "left_anti"), "no_start"))
    out = out.union(say(starts.join(known, ["conversation_id", "message_id"], "left_anti"), "unknown_start"))
    out = out.union(say(order_breaks(starts, msgs, ["conversation_id"], "pos", "idx", "message_id"), "not_in_order"))
    if boundaries is not None:
        out = out.union(say(boundaries.select("conversation_id", "message_id").join(starts, ["conversation_id", "message_id"], "left_anti"), "boundary_omitted"))
    return out.distinct()


def audit_drafts(drafts: DataFrame, members: DataFrame, links: DataFrame | None = None, attachments: DataFrame | None = None, relations: tuple[str, ...] | None = None) -> DataFrame:
    """(draft_id, error): repeated draft ids; source ids that the slice does not have or that are not in its order; links and attachments of
    no source; evidence that is no row of the owner in the slice; relations that are not allowed or have no such evidence.

    drafts: draft_id, slice_id, source_message_ids and, if there, link_ids, attachment_ids, evidence_message_ids, relations; members:
    slice_id, message_id and, if there, idx and owner; links: link_id, message_id; attachments: attachment_id, message_id."""
    say = lambda df, error: df.select("draft_id", F.lit(error).alias("error"))
    out = say(drafts.groupBy("draft_id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate_draft_id")
    used = drafts.select("draft_id", "slice_id", F.posexplode("source_message_ids").alias("pos", "message_id"))
    out = out.union(say(used.join(members.select("slice_id", "message_id"), ["slice_id", "message_id"], "left_anti"), "unknown_source"))
    if "idx" in members.columns:
        out = out.union(say(_source_breaks(used, members), "sources_not_in_order"))
    for column, owned, name in (("link_ids", links, "link_id"), ("attachment_ids", attachments, "attachment_id")):
        if owned is not None and column in drafts.columns:
            have = used.join(owned.select("message_id", name), "message_id").select("draft_id", name).distinct()
            out = out.union(say(drafts.select("draft_id", F.explode(column).alias(name)).join(have, ["draft_id", name], "left_anti"), f"{name.removesuffix('_id')}_of_no_source"))
    if "evidence_message_ids" in drafts.columns:
        given = drafts.select("draft_id", "slice_id", F.explode("evidence_message_ids").alias("message_id"))
        own = members.where("owner").select("slice_id", "message_id").distinct()
        out = out.union(say(given.join(own, ["slice_id", "message_id"], "left_anti"), "evidence_not_owners"))
        if relations is not None:
            told = drafts.select("draft_id", F.explode("relations").alias("relation"))
            good = given.join(own, ["slice_id", "message_id"], "left_semi").select("draft_id").distinct()
            out = out.union(say(told.where(~F.col("relation").isin(*relations)), "relation_not_allowed")).union(say(told.join(good, "draft_id", "left_anti"), "relation_without_evidence"))
    return out.distinct()


def _source_breaks(used: DataFrame, members: DataFrame) -> DataFrame:
    """Drafts whose sources do not run in the order of their slice."""
    at = used.join(members.select("slice_id", "message_id", "idx"), ["slice_id", "message_id"]).distinct()
    return at.withColumn("before", F.lag("idx").over(Window.partitionBy("draft_id", "slice_id").orderBy("pos"))).where("before >= idx")


def audit_facts(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Drafts whose fact items, joined in order, do not make up a field's text exactly.

    items: draft_id, field_name, pos, text; texts: draft_id, field_name, text."""
    joined = items.groupBy("draft_id", "field_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("made"))
    return texts.join(joined, ["draft_id", "field_name"], "left").where("made is null or made <> text").select("draft_id", "field_name")


def audit_fact_items(items: DataFrame, texts: DataFrame, sources: DataFrame, fields: tuple[str, ...], joined: tuple[str, ...] = ("content",)) -> DataFrame:
    """(draft_id, field_name, error): items of a field that is not allowed, without text or evidence, or with evidence that is no source of
    the draft; items of a field without text; fields that their items do not cover exactly: those of `joined` one
    after the other, any other by a single item.

    items: draft_id, field_name, pos, text, evidence_message_ids; texts: draft_id, field_name, text; sources: draft_id, message_id."""
    say = lambda df, error: df.select("draft_id", "field_name", F.lit(error).alias("error"))
    at = items.select("draft_id", strip("field_name").alias("field_name"), "pos", clean_text(F.coalesce("text", F.lit(""))).alias("text"), "evidence_message_ids")
    out = say(at.where(~F.col("field_name").isin(*fields)), "field_not_allowed").union(say(at.where("text = ''"), "empty_item"))
    out = out.union(say(at.where(F.coalesce(F.size("evidence_message_ids"), F.lit(0)) <= 0), "no_evidence"))
    given = at.select("draft_id", "field_name", F.explode("evidence_message_ids").alias("message_id"))
    out = out.union(say(given.join(sources.select("draft_id", "message_id"), ["draft_id", "message_id"], "left_anti"), "evidence_outside_sources"))
    made = at.groupBy("draft_id", "field_name").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("made"))
    want = texts.where(F.col("field_name").isin(*fields)).select("draft_id", "field_name", clean_text(F.coalesce("text", F.lit(""))).alias("want"))
    both = want.join(made, ["draft_id", "field_name"], "left")
    out = out.union(say(both.where("want = '' and n > 0"), "items_of_an_empty_field"))
    covered = F.when(F.col("field_name").isin(*joined), clean_text("made") == F.col("want")).otherwise((F.col("n") == 1) & (F.col("made") == F.col("want")))
    return out.union(say(both.where((F.col("want") != "") & ~F.coalesce(covered, F.lit(False))), "not_covered")).distinct()


def audit_coverage(groups: DataFrame) -> DataFrame:
    """Groups whose covered ids are not their members; columns group_id, member_ids, covered_ids."""
    missing, extra = F.array_except("member_ids", "covered_ids"), F.array_except("covered_ids", "member_ids")
    return groups.select("group_id", missing.alias("missing"), extra.alias("extra")).where((F.size("missing") > 0) | (F.size("extra") > 0))


def apply_retention(drafts: DataFrame, verdicts: DataFrame, uncertain: str = "drop") -> DataFrame:
    """Adds decision: substantive signals keep, routine ones drop, neither follows the policy."""
    at = drafts.join(verdicts, "draft_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    return at.withColumn("decision", F.when(F.col("substantive").isNull() & F.col("routine").isNull(), "keep").when(n("substantive"), "keep").when(n("routine"), "drop").otherwise(uncertain))


def apply_facts(drafts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Adds outcome (confirmed, revised or dropped) and the text that holds; verdicts: draft_id, supported, content."""
    at = drafts.join(verdicts.withColumnRenamed("content", "new"), "draft_id", "left")
    revised = F.col("new").isNotNull() & (F.col("new") != F.col("content"))
    outcome = F.when(~F.coalesce("supported", F.lit(True)), "dropped").when(revised, "revised").otherwise("confirmed")
    return at.withColumn("outcome", outcome).withColumn("content", F.coalesce("new", "content")).drop("new")


def extend_sources(drafts: DataFrame, evidence: DataFrame, allowed: DataFrame) -> DataFrame:
    """(draft_id, source_message_ids): the sources of each draft and what the evidence of its reviewed facts adds, those that are allowed
    first, in their order, then the draft's others in the order they had.

    drafts: draft_id, source_message_ids; evidence: draft_id, message_id; allowed: draft_id, message_id, pos."""
    own = drafts.select("draft_id", F.posexplode("source_message_ids").alias("own", "message_id")).groupBy("draft_id", "message_id").agg(F.min("own").alias("own"))
    at = own.join(evidence.select("draft_id", "message_id", F.lit(True).alias("told")).distinct(), ["draft_id", "message_id"], "full")
    at = at.join(allowed.groupBy("draft_id", "message_id").agg(F.min("pos").alias("pos")), ["draft_id", "message_id"], "left").where("pos is not null or own is not null")
    key = F.struct(F.col("pos").isNull().alias("other"), "pos", "own", "message_id")
    listed = at.groupBy("draft_id").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["message_id"]).alias("source_message_ids"))
    return drafts.select("draft_id").distinct().join(listed, "draft_id", "left")


def risk_reasons(groups: DataFrame, *, events: int = 10, files: int = 4, alone: DataFrame | None = None, conflicts: DataFrame | None = None, flags: DataFrame | None = None) -> DataFrame:
    """(group_id, reasons): why groups need a review, of seven reasons in a fixed order.

    groups: group_id, draft_id, source_file, batch, repaired; alone (graph.conversation_only) and conflicts
    (evidence.semantic_conflicts): group_id; flags: group_id, flag, of which broad_object counts."""
    per = groups.groupBy("group_id").agg(F.count("*").alias("n"), F.count_distinct("source_file").alias("files"), F.count_distinct("batch").alias("batches"), F.bool_or("repaired").alias("repaired"))
    names = [F.when(F.col("n") >= events, "many_events"), F.when(F.col("files") >= files, "many_files"), F.when(F.col("batches") > 1, "cross_batch"), F.when(F.col("repaired"), "repaired")]
    broad = None if flags is None else flags.where("flag = 'broad_object'")
    for name, found in (("same_conversation_only", alone), ("semantic_only_object_conflict", conflicts), ("broad_object", broad)):
        if found is not None:
            per = per.join(found.select("group_id", F.lit(True).alias(name)).distinct(), "group_id", "left")
            names.append(F.when(F.col(name), name))
    return per.select("group_id", F.array_join(F.array_compact(F.array(*names)), ",").alias("reasons")).where("reasons <> ''")


def fix_duplicate_ids(events: DataFrame) -> DataFrame:
    """Of equal ids in a file the first row keeps its id, the others get one from their text and place among them; places come from sorted
    ranges, so an id may be repeated in most of the rows."""
    at = scanned(events, ["pos"], ["source_file", "event_id"], "_rank")
    made = F.concat(F.lit("manual-"), F.substring(F.sha1(F.concat_ws("|", "source_file", "event_id", "content", F.col("_rank").cast("string"))), 1, 16))
    return at.withColumn("event_id", F.when(F.col("_rank") == 1, F.col("event_id")).otherwise(made)).drop("_rank")


def privacy_scan(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns found, in their order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), name) for name, p in patterns.items()]))


def error_category(text: Column, categories: dict[str, tuple[str, ...]], default: str = "runtime") -> Column:
    out = None
    for name, patterns in categories.items():
        hit = F.lower(text).rlike("|".join(patterns))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default) if out is not None else F.lit(default)


def repair_locked(assign: DataFrame, expected: DataFrame, locked: DataFrame) -> DataFrame:
    """repair_partition(), and groups that hold a part of a locked set only are given up: their drafts become
    groups of their own.  locked: atom_id, draft_id."""
    kept = repair_partition(assign, expected)
    size = locked.groupBy("atom_id").agg(F.count_distinct("draft_id").alias("size"))
    part = kept.join(locked, "draft_id").groupBy("group_id", "atom_id").agg(F.count_distinct("draft_id").alias("n")).join(size, "atom_id").where("n < size").select("group_id").distinct()
    alone = F.concat(F.lit("single:"), F.col("draft_id").cast("string"))
    return kept.join(part.withColumn("broken", F.lit(True)), "group_id", "left").select("draft_id", F.when(F.coalesce("broken", F.lit(False)), alone).otherwise(F.col("group_id")).alias("group_id"))


def audit_locked(expected: DataFrame, assign: DataFrame, locked: DataFrame) -> DataFrame:
    """(draft_id, error): the findings of audit_partition(), and the members of locked sets that several groups share."""
    torn = audit_atomic(assign, locked).select("atom_id")
    members = locked.join(torn, "atom_id").select("draft_id", F.lit("locked_set_torn").alias("error")).distinct()
    return audit_partition(expected, assign).union(members)


def audit_segment_drafts(drafts: DataFrame, segments: DataFrame, attachments: DataFrame, signals: DataFrame) -> DataFrame:
    """(draft_id, error): sources outside the draft's segment, unknown signals, attachments that neither are the
    segment's nor belong to the one message that is named in their place.

    drafts: draft_id, segment, source_message_ids, attachment_ids, signal_ids; segments: segment, message_id;
    attachments: message_id, attachment_id; signals: segment, signal_id."""
    each = lambda c, name: drafts.select("draft_id", "segment", F.explode(c).alias(name))
    known = segments.select("segment", "message_id").distinct()
    files = known.join(attachments, "message_id").select("segment", "message_id", "attachment_id")
    # a message id in the place of an attachment id stands for its attachment, if it has just one
    single = files.groupBy("segment", "message_id").agg(F.count("*").alias("n")).where("n = 1").select("segment", F.col("message_id").alias("attachment_id"))
    good = files.select("segment", "attachment_id").union(single).distinct()
    say = lambda df, error: df.select("draft_id", F.lit(error).alias("error"))
    out = say(each("source_message_ids", "message_id").join(known, ["segment", "message_id"], "left_anti"), "source_outside_segment")
    out = out.union(say(each("attachment_ids", "attachment_id").join(good, ["segment", "attachment_id"], "left_anti"), "unknown_attachment"))
    return out.union(say(each("signal_ids", "signal_id").join(signals, ["segment", "signal_id"], "left_anti"), "unknown_signal")).distinct()


def detect_edits(events: DataFrame) -> DataFrame:
    """Adds edit: 'manual_modified' where version 3 has another fingerprint than the content, 'manual_unknown'
    without metadata or, from version 2 on, without conversations and earlier marks; else the mark it has.

    events: version, content_fingerprint, actual_fingerprint, conversation_fingerprints, source_edit_types, manual_edit_type."""
    none = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) == 0
    version, held = F.coalesce("version", F.lit(0)), F.coalesce("content_fingerprint", F.lit(""))
    edit = (
        F.when(F.coalesce("manual_edit_type", F.lit("")) != "", F.col("manual_edit_type"))
        .when((version == 3) & (held != "") & (held != F.col("actual_fingerprint")), "manual_modified")
        .when((version == 0) | (version.isin(2, 3) & none("conversation_fingerprints") & none("source_edit_types")), "manual_unknown")
        .otherwise("")
    )
    return events.withColumn("edit", edit)
