"""Message, keyword and retention filters: one pass of column predicates, pushed to the scan where
they are plain comparisons."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evtrail.functions.text import PUNCTUATION, clean_text, contains_any, let, strip

# Fixed values.
SYSTEM_TYPES = ("system", "recall", "chat_info", "group_event")
SYSTEM_MARKERS = ("撤回", "加入群聊", "移出群聊", "修改群名", "系统消息")
RETENTION_REASONS = ("deliverable_updated", "decision_made", "issue_or_risk_found", "follow_up_assigned", "external_business_progress", "substantive_approval")


def filter_messages(df: DataFrame) -> DataFrame:
    """Drops system rows, rows without text, links and attachments, and rows with a system marker."""
    has = lambda c: F.size(F.coalesce(F.col(c), F.array())) > 0 if c in df.columns else F.lit(False)
    text = F.coalesce(F.col("text"), F.lit(""))
    system = F.coalesce(F.col("is_system"), F.lit(False)) | F.coalesce(F.col("message_type").isin(*SYSTEM_TYPES), F.lit(False))
    empty = (strip(text) == "") & ~has("links") & ~has("attachments")
    return df.where(~system & ~empty & ~contains_any(text, SYSTEM_MARKERS))


def exclude_conversations(df: DataFrame, blacklist: DataFrame) -> DataFrame:
    return df.join(blacklist.select("conversation_id").distinct(), "conversation_id", "left_anti")


def target_conversations(messages: DataFrame, reactions: DataFrame) -> DataFrame:
    """Conversations in which the owner wrote or reacted: (owner_id, conversation_id)."""
    wrote = messages.where("sender_open_id = owner_id").select("owner_id", "conversation_id")
    reacted = reactions.where("operator_open_id = owner_id").select("owner_id", "conversation_id")
    return wrote.union(reacted).distinct()


def on_day(ts: Column, day: str) -> Column:
    """A range on the bare column, so that it reaches the scan."""
    return (ts >= F.lit(day).cast("timestamp")) & (ts < F.date_add(F.lit(day).cast("date"), 1).cast("timestamp"))


def reject_kind(fields: list[Column], sensitive: tuple[str, ...], excluded: tuple[str, ...]) -> Column:
    """'sensitive', 'excluded' or null: case-sensitive substrings, sensitive first."""
    clean = [clean_text(F.coalesce(f, F.lit(""))) for f in fields]
    has = lambda words: reduce(lambda a, b: a | b, [contains_any(f, words) for f in clean], F.lit(False))
    return F.when(has(sensitive), "sensitive").when(has(excluded), "excluded")


def keyword_filter(df: DataFrame, fields: list[str], sensitive: tuple[str, ...], excluded: tuple[str, ...], diagnostics: bool = False) -> DataFrame:
    """The kept rows, or with `diagnostics` all rows with their reject_kind."""
    out = df.withColumn("reject_kind", reject_kind([F.col(f) for f in fields], sensitive, excluded))
    return out if diagnostics else out.where("reject_kind is null").drop("reject_kind")


@dataclass(frozen=True)
class RetentionPolicy:
    generic_object_hints: tuple[str, ...] = ()
    personal_social: tuple[str, ...] = ()
    privacy_objects: tuple[str, ...] = ()
    leave_or_travel: tuple[str, ...] = ()
    private_reasons: tuple[str, ...] = ()
    generic_review: tuple[str, ...] = ()
    approval_actions: tuple[str, ...] = ()
    administrative: tuple[str, ...] = ()
    substantive: tuple[str, ...] = ()
    low_information_suffixes: tuple[str, ...] = ()


def retention_reason(policy: RetentionPolicy, *, reason="retention_reason", detail="retention_detail", object_hint="object_hint", title="topic", content="content", strip_punct: bool = False) -> Column:
    """Name of the first rule that a draft fails, '' if it is kept."""
    norm = lambda words: tuple(w.strip().lower() for w in words)
    clean = {c: clean_text(F.coalesce(F.col(c), F.lit(""))) for c in (title, content, detail, object_hint)}
    texts = F.struct(*[t.alias(f"t{i}") for i, t in enumerate(clean.values())])

    def compared(v: Column) -> Column:
        # the fields are clean: joined by a blank they stay so, and each is folded once
        t, c, d, o = (F.lower(F.regexp_replace(v[f"t{i}"], PUNCTUATION, "") if strip_punct else v[f"t{i}"]) for i in range(4))
        return F.struct(t.alias("t"), c.alias("c"), d.alias("d"), o.alias("o"))

    def joined(v: Column) -> Column:
        three = F.concat_ws("" if strip_punct else " ", v["t"], v["c"], v["d"])
        return F.struct(*[v[k].alias(k) for k in "tcdo"], three.alias("three"), F.concat_ws("" if strip_punct else " ", three, v["o"]).alias("four"))

    def first_failure(v: Column) -> Column:
        t, c, d, o, three, four = (v[k] for k in ("t", "c", "d", "o", "three", "four"))
        work = lambda x: contains_any(x, norm(policy.substantive))
        privacy = ((o != "") & contains_any(o, norm(policy.privacy_objects))) | (contains_any(four, norm(policy.leave_or_travel)) & contains_any(four, norm(policy.private_reasons)))
        admin = contains_any(four, norm(policy.generic_review + policy.approval_actions)) & contains_any(four, norm(policy.administrative)) & ~work(four)
        repeated = (t != "") & (d != "") & (F.length(d) <= 16) & reduce(lambda a, b: a | b, [d == F.concat(t, F.lit(s)) for s in norm(policy.low_information_suffixes)], d == t)
        vague = (F.length(d) < 6) | (d == t) | (d == c) | (d == o) | repeated
        hints = norm(policy.generic_object_hints)
        return (
            F.when(privacy, "personal_privacy_or_leave_event")
            .when(contains_any(three, norm(policy.personal_social)) & ~work(three), "personal_social_or_reputation_event")
            .when(admin, "administrative_approval_event")
            .when(contains_any(four, norm(policy.generic_review)) & ~work(four), "generic_review_completion")
            .when((o == "") | (o.isin(*hints) if hints else F.lit(False)), "missing_or_generic_object_hint")
            .when(vague, "missing_or_generic_retention_detail")
            .otherwise("")
        )

    known = F.coalesce(clean_text(F.col(reason)).isin(*RETENTION_REASONS), F.lit(False))
    return F.when(~known, "missing_or_invalid_retention_reason").otherwise(let(let(let(texts, compared), joined), first_failure))


def filter_retained(df: DataFrame, policy: RetentionPolicy, **columns: str) -> DataFrame:
    return df.where(retention_reason(policy, **columns) == "")


def filter_owner_related(drafts: DataFrame, members: DataFrame) -> DataFrame:
    """Drafts with an own source, a source that replies to an anchor, or an explicit assignment.

    members: (draft_id, message_id, own, replies_to_anchor, assigned) booleans per source."""
    related = members.groupBy("draft_id").agg(F.bool_or(F.col("own") | F.col("replies_to_anchor") | F.col("assigned")).alias("related")).where("related")
    return drafts.join(related.select("draft_id"), "draft_id", "left_semi")


def assigns_to(text: Column, name: Column, verbs: tuple[str, ...], clause: str = r"[。！？!?;；\n]") -> Column:
    """A clause that contains both the name and an assignment verb."""
    return F.exists(F.split(clean_text(text), clause), lambda c: (name != "") & c.contains(name) & contains_any(c, verbs))


def filter_valid_relations(df: DataFrame) -> DataFrame:
    return df.where(F.size(F.coalesce(F.col("self_relations"), F.array())) > 0)


def select_fact_review(drafts: DataFrame, messages: DataFrame, *, sources: int = 8, people: int = 3, incomplete: DataFrame | None = None) -> DataFrame:
    """Drafts to review with their reasons; drafts has draft_id, source_message_ids, fact_risk_flags; incomplete (draft_id) has those
    whose facts do not hold, as audit.audit_fact_items() finds them."""
    seen = drafts.select("draft_id", F.explode(F.array_distinct("source_message_ids")).alias("message_id"))
    who = seen.join(messages.select("message_id", "sender_open_id"), "message_id", "left").groupBy("draft_id").agg(F.count("*").alias("n"), F.count_distinct("sender_open_id").alias("people"))
    who = drafts.select("draft_id").distinct().join(who, "draft_id", "left").fillna(0, ["n", "people"])
    bare = incomplete.select("draft_id", F.lit(True).alias("bare")).distinct() if incomplete is not None else who.select("draft_id", F.lit(False).alias("bare"))
    who = who.join(bare, "draft_id", "left")
    reasons = F.array_compact(F.array(F.when(F.col("bare"), "incomplete_facts"), F.when(F.col("n") >= sources, "many_sources"), F.when(F.col("people") >= people, "many_people"), F.when(F.size("fact_risk_flags") > 0, "risk_flags")))
    return drafts.join(who, "draft_id").withColumn("reasons", reasons).drop("bare").where(F.size("reasons") > 0)


def select_retention_review(drafts: DataFrame, reasons: tuple[str, ...], *, enabled: bool = True, without_files: bool = True) -> DataFrame:
    """Drafts to review for retention: of one of the reasons and, if asked for, without links and attachments."""
    size = lambda c: F.size(F.coalesce(F.col(c), F.array()))
    at = drafts.where(F.lit(enabled) & F.col("retention_reason").isin(*reasons))
    return at.where((size("referenced_link_ids") == 0) & (size("referenced_attachment_ids") == 0)) if without_files else at


def eligible_attachments(df: DataFrame, extensions: tuple[str, ...], max_bytes: int, cap: int, keys: tuple[str, ...] = ("owner_id", "date")) -> DataFrame:
    from pyspark.sql import Window

    ext = F.lower(F.regexp_extract("file_name", r"(\.[^.]+)$", 1))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("message_id", "attachment_id"))
    return df.where(ext.isin(*extensions) & (F.coalesce("file_size", F.lit(0)) <= max_bytes)).withColumn("rank", rank).where(F.col("rank") <= cap)
