"""Raw chat JSON to messages, links, attachments, reactions; log-file names and metadata.

Raw rows have a JSON string column `raw`.  Fields come under several names; the first that is
there and not empty wins.  All narrow, but for the last-wins deduplication.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtrail.functions.text import clean_text, extract_urls, file_name_parts, link_type, strip
from evtrail.operators.numbering import scanned

INLINE_IMAGE = r"(?i)\[Image:\s*(img_[^\]\s]+)\]"
MARKDOWN_IMAGE = r"(?i)!\[[^\]]*\]\((img_[^)\s]+)\)"


def first_of(raw: Column, *paths: str) -> Column:
    values = [F.get_json_object(raw, f"$.{p}") for p in paths]
    return F.coalesce(*[F.when(v != "", v) for v in values])


def to_event_ts(c: Column, tz: str = "Asia/Shanghai") -> Column:
    """ISO text with offset, Z or none (then in tz), or epoch seconds or milliseconds (above 1e10), as text."""
    number = F.when(c.rlike(r"^\d+$"), c.cast("double"))
    seconds = F.when(number > 1e10, number / 1000).otherwise(number)
    naive = ~c.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    iso = F.regexp_replace(c, "T", " ")
    zoned = F.try_to_timestamp(F.regexp_replace(iso, "Z$", "+00:00"))
    local = F.to_utc_timestamp(F.try_to_timestamp(iso), tz)
    return F.when(number.isNotNull(), F.timestamp_micros((seconds * 1000000).cast("long"))).when(naive, local).otherwise(zoned)


def normalize_messages(df: DataFrame, tz: str = "Asia/Shanghai") -> DataFrame:
    r = F.col("raw")
    kind = F.coalesce(first_of(r, "message_type", "msg_type", "type"), F.lit("unknown"))
    mode = F.lower(strip(F.coalesce(first_of(r, "chat_mode", "chat_type"), F.lit(""))))
    body = first_of(r, "text_content", "text", "body.content.text", "body.text", "content")
    system = F.coalesce(first_of(r, "is_system", "system") == "true", F.lit(False)) | kind.isin("system", "recall", "chat_info")
    return df.select(
        F.coalesce(first_of(r, "chat_id", "conversation_id", "chatId", "conversationId", "chat.id"), F.lit("")).alias("conversation_id"),
        F.coalesce(first_of(r, "chat_name", "conversation_name", "chatName", "conversationName", "chat.name"), F.lit("")).alias("conversation_name"),
        F.coalesce(first_of(r, "message_id", "messageId", "id"), F.lit("")).alias("message_id"),
        first_of(r, "sender_open_id", "sender.open_id", "sender.id.open_id", "sender.id.openId", "sender.id").alias("sender_open_id"),
        F.coalesce(first_of(r, "sender_name", "sender.name", "sender.sender_name"), F.lit("")).alias("sender_name"),
        to_event_ts(first_of(r, "send_time", "create_time", "createTime", "timestamp"), tz).alias("send_ts"),
        kind.alias("message_type"), clean_text(F.coalesce(body, F.lit(""))).alias("text"),
        first_of(r, "parent_id", "reply_to", "reply_to_message_id", "replyToMessageId").alias("reply_to"),
        first_of(r, "root_id", "quote_message_id", "quoteMessageId").alias("quote_to"),
        F.when(mode.isin("p2p", "group", "topic"), mode).otherwise("").alias("conversation_mode"), system.alias("is_system"), *[c for c in df.columns if c != "raw"],
    )


def extract_mentions(raw: Column) -> Column:
    """Distinct ids of the mention objects, whichever field holds them."""
    items = F.from_json(F.get_json_object(raw, "$.mentions"), "array<struct<open_id:string,id:string,user_id:string>>")
    ids = F.transform(F.coalesce(items, F.array().cast("array<struct<open_id:string,id:string,user_id:string>>")), lambda x: F.coalesce(x["open_id"], F.get_json_object(x["id"], "$.open_id"), x["id"], x["user_id"]))
    return F.array_distinct(F.filter(F.transform(ids, strip), lambda x: F.coalesce(x != "", F.lit(False))))


_ITEM = "struct<reaction_id:string,emoji_type:string,reaction_type:struct<emoji_type:string>,operator_open_id:string,operator_id:string,operator:struct<operator_id:string,open_id:string>,action_time:string,create_time:string"


def flatten_reactions(df: DataFrame, id_col: str = "message_id") -> DataFrame:
    """(message_id, reaction_id, operator_open_id, emoji_type, action_time): details inherit from their
    parent; equal 4-tuples count once."""
    at = df.select(id_col, F.explode(F.from_json(F.get_json_object("raw", "$.reactions"), f"array<{_ITEM},details:array<{_ITEM}>>>>")).alias("p"))
    own = lambda x, up=None: F.struct(
        *[F.coalesce(*v, *([up[n]] if up is not None else []), F.lit("")).alias(n) for n, v in (("reaction_id", (x["reaction_id"],)), ("emoji_type", (x["emoji_type"], x["reaction_type"]["emoji_type"])), ("action_time", (x["action_time"], x["create_time"])))],
        F.coalesce(x["operator_open_id"], x["operator_id"], x["operator"]["operator_id"], x["operator"]["open_id"]).alias("operator_open_id"),
    )
    at = at.withColumn("o", own(F.col("p")))
    nested = F.transform(F.coalesce("p.details", F.array().cast(f"array<{_ITEM}>>")), lambda x: own(x, F.col("o")))
    rows = at.select(id_col, F.explode(F.concat(F.array("o"), nested)).alias("r")).select(id_col, "r.*")
    return rows.where("operator_open_id is not null and (reaction_id <> '' or emoji_type <> '')").distinct()


def extract_attachments(text: Column) -> Column:
    """Distinct ids of inline images, in either notation."""
    found = lambda p: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1))
    return F.array_distinct(F.concat(found(INLINE_IMAGE), found(MARKDOWN_IMAGE)))


#: Keys of a message's content and tags within its text that hold a file: default name and kind. Fixed values.
MEDIA = {"image": ("[Image]", "image/*"), "file": ("[File]", "application/octet-stream"), "audio": ("[Audio]", "audio/*"), "video": ("[Video]", "video/*")}


def extract_media(content: Column, text: Column) -> Column:
    """Attachments of a message, array of (attachment_id, file_name, mime_type): media keys of its content (JSON), tags such as <file
    key="..." name="..."/> and inline images in its text; of equal ids the last one's fields at the first one's place."""
    entry = lambda i, name, mime: F.struct(i.alias("attachment_id"), name.alias("file_name"), mime.alias("mime_type"))
    value = lambda *names: F.coalesce(*(F.nullif(F.get_json_object(content, f"$.{n}"), F.lit("")) for n in names))
    keyed = [entry(value(f"{kind}_key"), F.coalesce(value("file_name", "name"), F.lit(name)), F.coalesce(value("mime_type", "mimeType"), F.lit(mime))) for kind, (name, mime) in MEDIA.items()]
    keyed = F.filter(F.array(*keyed), lambda x: x["attachment_id"].isNotNull())
    tags = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i)<(?:{'|'.join(MEDIA)})\b[^>]*>"), F.lit(0))

    def of(tag: Column) -> Column:
        kind = F.lower(F.regexp_extract(tag, r"^<(\w+)", 1))
        read = lambda *names: F.coalesce(*(F.nullif(F.regexp_extract(tag, rf'\s{n}="([^"]*)"', 1), F.lit("")) for n in names))
        known = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in MEDIA.items() for x in (k, v[i])]), kind)
        return entry(read("key", "(?:image|file|audio|video)_key"), F.coalesce(read("name", "file_name"), known(0)), F.coalesce(read("mime_type"), known(1)))

    tagged = F.filter(F.transform(tags, of), lambda x: x["attachment_id"].isNotNull())
    images = F.transform(extract_attachments(text), lambda i: entry(i, F.lit("[Image]"), F.lit("image/*")))
    every = F.concat(keyed, images, tagged)
    ids = F.array_distinct(F.transform(every, lambda x: x["attachment_id"]))
    return F.transform(ids, lambda i: F.element_at(F.filter(every, lambda x: x["attachment_id"] == i), -1))


def dedupe_attachments(df: DataFrame, keys: tuple[str, ...] = ("message_id",)) -> DataFrame:
    """One row an attachment: the last one's fields at the first one's place; df has attachment_id, pos."""
    rest = [c for c in df.columns if c not in (*keys, "attachment_id", "pos")]
    return df.where("attachment_id <> ''").groupBy(*keys, "attachment_id").agg(F.min("pos").alias("pos"), *[F.max_by(c, "pos").alias(c) for c in rest])


def dedupe_links(df: DataFrame, keys: tuple[str, ...] = ("message_id",)) -> DataFrame:
    """One row a URL: the first with a title, else the first; df has url, title, pos."""
    title = F.min_by("title", F.struct((F.trim(F.coalesce("title", F.lit(""))) == "").alias("bare"), "pos"))
    return df.where("url <> ''").groupBy(*keys, "url").agg(title.alias("title"), F.min("pos").alias("pos"))


def message_links(df: DataFrame) -> DataFrame:
    """(message_id, link_id, url, title, link_type): explicit links (array of url and title), then URLs of the text."""
    known = F.coalesce("links", F.array().cast("array<struct<url:string,title:string>>"))
    found = F.filter(extract_urls("text"), lambda u: ~F.exists(known, lambda k: k["url"] == u))
    every = F.concat(known, F.transform(found, lambda u: F.struct(u.alias("url"), F.lit("").alias("title"))))
    at = df.select("message_id", F.posexplode(every).alias("pos", "l"))
    return at.select("message_id", F.concat(F.col("message_id").cast("string"), F.lit("#link"), (F.col("pos") + 1).cast("string")).alias("link_id"), "l.url", "l.title", link_type("l.url").alias("link_type"))


def dedupe_messages(df: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """The last row of each message id; rows without id are dropped."""
    rank = F.row_number().over(Window.partitionBy("message_id").orderBy(F.desc(seq)))
    return df.where("coalesce(cast(message_id as string), '') <> ''").withColumn("rank", rank).where("rank = 1").drop("rank")


def read_event_logs(spark, path: str) -> DataFrame:
    """One row a log file: path, parts of its name, its text; files are read whole, as a block may span lines."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"))
    return files.select("path", file_name_parts("file").alias("name"), "body").select("path", "name.*", "body")


def event_blocks(logs: DataFrame, mark: str = "event") -> DataFrame:
    """(path, pos, block, manual): texts between <!-- event:start --> and the end mark, the next start, or the
    file's end; what begins with a heading outside the marks is a block written by hand."""
    parts = F.split("body", rf"<!--\s*{mark}:start\s*-->")
    end = rf"(?s)<!--\s*{mark}:end\s*-->"
    at = logs.select("path", F.posexplode(parts).alias("part", "text"))
    marked = at.where("part > 0").select("path", "part", F.lit(0).alias("k"), strip(F.regexp_replace("text", end + ".*", "")).alias("block"), F.lit(False).alias("manual"))
    # outside: all before the first mark, and what follows the end mark of a part
    outside = F.when(F.col("part") == 0, F.col("text")).otherwise(F.regexp_extract("text", end + "(.*)", 1))
    loose = at.select("path", "part", F.posexplode(F.split(outside, r"(?m)^(?=## )")).alias("k", "block")).where(F.col("block").startswith("## "))
    every = marked.union(loose.select("path", "part", F.col("k") + 1, strip("block"), F.lit(True)))
    return every.select("path", F.row_number().over(Window.partitionBy("path").orderBy("part", "k")).alias("pos"), "block", "manual")


def block_field(block: Column, *labels: str) -> Column:
    """The value behind `- label: ` under any of the labels."""
    names = "|".join(labels)
    return strip(F.regexp_extract(block, rf"(?m)^\s*[-*]\s*\**(?:{names})\**\s*[:：]\s*(.*)$", 1))


def parse_event_block(blocks: DataFrame, labels: dict[str, tuple[str, ...]], keys: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """blocks with title and one column a field: `labels` names the field's labels, old ones among them; of a field
    in `keys` the labels found, cut at commas, become keys."""
    from evtrail.functions.messages import labels_to_keys

    title = strip(F.regexp_extract("block", r"(?m)^#{2,}\s+(?:\d+[.、]\s*)?(.*)$", 1))
    out = blocks.withColumn("title", title)
    for name, known in labels.items():
        value = block_field(F.col("block"), *known)
        if keys and name in keys:
            value = labels_to_keys(F.filter(F.transform(F.split(value, "[,，、]"), strip), lambda x: x != ""), keys[name])
        out = out.withColumn(name, value)
    return out


def classify_source(rows: DataFrame) -> DataFrame:
    """(source_file, kind): rows is (source_file, is_merged, has_metadata)."""
    return rows.groupBy("source_file").agg(F.when(F.bool_or("is_merged"), "upstream_merged").when(F.bool_or("has_metadata"), "enhanced").otherwise("legacy").alias("kind"))


def assign_draft_ids(rows: DataFrame) -> DataFrame:
    """rows with draft_id: source file, place in it by pos and event id; places come from sorted ranges, so a file may be large."""
    at = scanned(rows, ["pos"], ["source_file"], "_n")
    return at.withColumn("draft_id", F.concat(F.col("source_file"), F.lit("#"), F.col("_n").cast("string"), F.lit(":"), F.col("event_id"))).drop("_n")


def read_audit(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, status, blocks, bare, reason): success, partial (some blocks without title) or skipped, how many blocks were read and how many of
    them are bare, and why not all: the name has no day or not the file's own, there is no block, or blocks without title.

    files: path and, if there, file (its name) and date (what its front matter says); blocks: path, title."""
    per = blocks.groupBy("path").agg(F.count("*").alias("blocks"), F.count_if(F.coalesce("title", F.lit("")) == "").alias("bare"))
    at = files.join(per, "path", "left").fillna(0, ["blocks", "bare"])
    day = file_name_parts("file")["day"] if "file" in files.columns else F.lit(None).cast("string")
    unnamed, other = F.coalesce(day == "", F.lit(False)), F.coalesce(day != F.col("date"), F.lit(False)) if "date" in files.columns else F.lit(False)
    status = F.when(unnamed | (F.col("blocks") == 0), "skipped").when(F.col("bare") > 0, "partial").otherwise("success")
    reason = F.when(unnamed, "no day in the file name").when(F.col("blocks") == 0, "no event block").when(F.col("bare") > 0, "blocks without title").when(other, "day differs from the file name").otherwise("")
    return at.select("path", status.alias("status"), "blocks", "bare", reason.alias("reason"))


def check_catalog(catalog: DataFrame) -> DataFrame:
    """One row: count, distinct types, rows with an empty name or description."""
    empty = (F.coalesce("name", F.lit("")) == "") | (F.coalesce("description", F.lit("")) == "")
    return catalog.agg(F.count("*").alias("n"), F.count_distinct("emoji_type").alias("types"), F.count_if(empty).alias("empty"))


_CONTENT = "text string, links array<struct<url:string,title:string>>, images array<string>, mentions array<string>"


def content_parts(content: str | None) -> tuple[str, list, list, list]:
    """Text, links, image keys and mentioned ids of one content tree, in the order of the tree."""
    try:
        todo = [json.loads(content or "")]
    except ValueError:
        return content or "", [], [], []
    text, links, images, mentions = [], {}, {}, {}
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo += reversed(node)
        elif isinstance(node, dict):
            said = str(node.get("text") or node.get("title") or "").strip()
            tag = str(node.get("tag") or node.get("type") or "").lower()
            if tag in ("at", "mention", "user"):
                who = node.get("open_id") or node.get("user_id") or node.get("id")
                if isinstance(who, str) and who.strip():
                    mentions[who.strip()] = None
            elif said:
                text.append(said)
            if url := node.get("href") or node.get("url"):
                links[str(url)] = links.get(str(url)) or (said if tag not in ("at", "mention", "user") else "")
            if key := node.get("image_key") or node.get("file_key"):
                images[str(key)] = None
            todo += reversed([v for v in node.values() if isinstance(v, (dict, list))])
    return "\n".join(text), [{"url": u, "title": t} for u, t in links.items()], list(images), list(mentions)


def extract_content(df: DataFrame, content: str = "content") -> DataFrame:
    """df with parts: text, links, images and mentions of a JSON tree of any depth; text that is no JSON is itself.
    Spark has no type that holds itself, so batches of trees are walked in Python, tree by tree."""

    @F.pandas_udf(_CONTENT)
    def of(trees: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([content_parts(t) for t in trees], columns=["text", "links", "images", "mentions"])

    return df.withColumn("parts", of(F.col(content))).withColumn("parts", F.col("parts").withField("text", clean_text("parts.text")))


_META = "version int, self_relations array<string>, evidence_fingerprints array<string>, file_keys array<string>, source_report_owners array<string>, conversation_fingerprints array<string>, source_event_ids array<string>, source_manual_edit_types array<string>, manual_edit_type string, content_fingerprint string"
_IDS = r"\b(?:ou|oc|om|on)_[0-9a-zA-Z]{8,}\b"


def parse_merge_meta(block: Column, edit_types: tuple[str, ...] = ("manual_modified", "manual_unknown"), mark: str = "meta") -> Column:
    """The metadata line of a block as a struct, null unless all of it is valid: version 1 to 3, arrays of text
    (from version 2 on with conversations and events, in 3 with edit types), fingerprints in their form, no
    internal ids, known edit types and the content's fingerprint in version 3."""
    from evtrail.functions.hashing import is_fingerprint

    line = F.regexp_extract(block, rf"(?m)^<!-- {mark}: (\{{.*\}}) -->$", 1)
    kinds = F.from_json(line, "map<string,string>")

    def valid(m: Column) -> Column:
        version = m["version"]
        listed = lambda c, since: F.when(version >= since, F.coalesce(kinds[c].isNull() | (m[c].isNotNull() & ~F.exists(m[c], lambda x: x.isNull())), F.lit(True)))
        every = lambda c, test: F.forall(F.coalesce(m[c], F.array().cast("array<string>")), test)
        lists = [("self_relations", 1), ("evidence_fingerprints", 1), ("file_keys", 1), ("source_report_owners", 1), ("conversation_fingerprints", 2), ("source_event_ids", 2), ("source_manual_edit_types", 3)]
        good = version.isin(1, 2, 3)
        for c, since in lists:
            good = good & F.coalesce(listed(c, since), F.lit(True))
        for c in ("evidence_fingerprints", "file_keys", "conversation_fingerprints"):
            good = good & every(c, is_fingerprint)
        for c in ("self_relations", "source_event_ids", "source_report_owners", "source_manual_edit_types"):
            good = good & every(c, lambda x: ~x.rlike(_IDS))
        edits = every("source_manual_edit_types", lambda x: x.isin(*edit_types)) & F.coalesce(m["manual_edit_type"], F.lit("")).isin("", *edit_types)
        return F.coalesce(good & ((version < 3) | (edits & is_fingerprint(F.coalesce(m["content_fingerprint"], F.lit(""))))), F.lit(False))

    meta = F.from_json(line, _META)
    return F.when(valid(meta), meta)


def scope_of(path: Column, root: str) -> Column:
    """'' of a file in the root folder, the folder's name one level below; null of anything deeper or hidden."""
    rest = F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, 1 << 20))
    parts = F.split(rest, "/")
    return F.when(F.size(parts) == 1, F.when(~parts[0].startswith("."), "")).when((F.size(parts) == 2) & ~parts[0].startswith(".") & ~parts[1].startswith("."), parts[0])


def scan_scopes(files: DataFrame, root: str, day: str, owner: str) -> DataFrame:
    """files (path) with scope: those of the day in the root folder and its first-level folders, without hidden
    and merged ones and the owner's own output."""
    at = files.withColumn("scope", scope_of(F.col("path"), root)).withColumn("name", file_name_parts(F.substring_index("path", "/", -1)))
    own = F.col("name.owner") == owner
    return at.where(F.col("scope").isNotNull() & F.col("path").endswith(".md") & (F.col("name.day") == day) & ~F.col("name.merged") & ~own).drop("name")


def load_catalog(spark, path: str, expected: int | None = None) -> DataFrame:
    """The reaction catalog of a JSON file; fails unless types are unique, names and descriptions filled and, if
    given, the number of rows is as expected."""
    catalog = spark.read.json(path, multiLine=True)
    found = check_catalog(catalog).first()
    if found["n"] != found["types"] or found["empty"] or (expected is not None and found["n"] != expected):
        raise ValueError(f"the catalog at {path} is not sound: {found}")
    return catalog
