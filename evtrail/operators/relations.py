"""Evidence joins through inverted indexes: explode the keys, join them by equality, count.

A key that very many drafts share gives all its pairs, part by part (`evidence_pairs`); where only what
is connected counts, `hub_links` ties its drafts to the smallest one, linear in the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtrail.functions.text import clean_text, doc_token, strip
from evtrail.scratch import written

from .numbering import numbered
from .substrings import contains_join


#: Drafts of at most so many keys take them along to where pairs meet.
CARRIED = 64


def key_counts(keys: DataFrame) -> DataFrame:
    """(key, n): keys is (draft_id, key) without repeats."""
    return keys.groupBy("key").agg(F.count("*").alias("n"))


def hub_links(keys: DataFrame, fan_out: int = 0) -> DataFrame:
    """(a, b): each draft with the smallest draft of each of its keys; linear in the rows."""
    hubs = keys.groupBy("key").agg(F.min("draft_id").alias("b"), F.count("*").alias("n")).where(F.col("n") > max(1, fan_out))
    return keys.join(hubs, "key").where("draft_id <> b").select(F.col("draft_id").alias("a"), "b").distinct()


def dealt_sides(keys: DataFrame, fan_out: int) -> tuple[DataFrame, DataFrame]:
    """(key, i, j, a) and (key, i, j, b): a key's drafts in parts of about `fan_out`, each part against each."""
    parts = F.ceil(F.col("n") / fan_out).cast("int")
    held = keys.join(key_counts(keys).where("n > 1"), "key").select("key", "draft_id", parts.alias("parts"), F.pmod(F.xxhash64("draft_id"), parts).cast("int").alias("part"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return held.select("key", F.col("part").alias("i"), every.alias("j"), F.col("draft_id").alias("a")), held.select("key", every.alias("i"), F.col("part").alias("j"), F.col("draft_id").alias("b"))


def shared_pairs(keys: DataFrame, extra: tuple[str, ...] = (), kinds: int = 1, fan_out: int = 1000, carried: int = CARRIED) -> tuple[DataFrame, DataFrame]:
    """All pairs a < b that share a key, once each, in two tables: (a, b, size_a, size_b, kinds, ...) with an array of the kinds of all
    shared keys, and (a, b, size_a, size_b, kind, ...), a row for each shared key.

    A draft of at most `carried` shared keys takes them along, so that a pair is told where its smallest shared key is met and no pairs
    are shuffled; pairs with a draft of more are in the second table.  A key of more than `fan_out` drafts is dealt into parts.
    keys: draft_id, key, the columns of `extra`, of which both drafts' come along as name_a and name_b, and, where there are
    several kinds, kind, an int from 0 that tells equal keys apart; all without repeats."""
    by, who = (["key", "kind"] if kinds > 1 else ["key"]), ["draft_id", *extra]
    keys = written(keys, "pair-keys")
    number = F.monotonically_increasing_id() * kinds + (F.col("kind") if kinds > 1 else F.lit(0))
    # numbers of the keys that some pair has, fixed by being written
    several = written(keys.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by, F.ceil(F.col("n") / fan_out).cast("int").alias("parts"), number.alias("id")), "pair-numbers")
    size = Window.partitionBy(*who)
    at = keys.withColumn("size", F.count("*").over(size)).join(several, by).select(*who, "size", "id", "parts").withColumn("met", F.count("*").over(size))
    at = written(at, "pair-sides")

    few = at.where(F.col("met") <= carried).groupBy(*who, "size").agg(F.sort_array(F.collect_list(F.struct("id", "parts"))).alias("ids"))
    few = few.select(F.struct(*who, "size", F.col("ids.id").alias("held")).alias("x"), F.explode("ids").alias("i")).select("x", "i.id", "i.parts")
    cold = few.where("parts = 1").groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("m")).where(F.size("m") > 1)
    both = cold.select("id", "m", F.posexplode("m").alias("pos", "x")).select("id", "x", F.explode(F.slice("m", F.col("pos") + 2, F.size("m"))).alias("y"))
    part = lambda of: F.pmod(F.xxhash64(f"{of}.draft_id"), "parts").cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    if not several.where("parts > 1").isEmpty():
        hot = few.where("parts > 1")
        both = both.union(hot.select("id", part("x").alias("i"), every.alias("j"), "x").join(hot.select("id", every.alias("i"), part("x").alias("j"), F.col("x").alias("y")), ["id", "i", "j"]).select("id", "x", "y"))
    # an array of one, so that what is shared is worked out once a pair
    both = both.where("x.draft_id < y.draft_id").select("id", "x", "y", F.explode(F.array(F.array_intersect("x.held", "y.held"))).alias("ids")).where(F.col("ids")[0] == F.col("id"))
    told = [F.col(f"{of}.{c}").alias(name) for side, of in (("a", "x"), ("b", "y")) for c, name in (("draft_id", side), ("size", f"size_{side}"), *((c, f"{c}_{side}") for c in extra))]
    kind = lambda i: (i % kinds).cast("int")
    first = both.select(*told, (F.transform("ids", kind) if kinds > 1 else F.col("ids")).alias("kinds"))

    many = at.where(F.col("met") > carried).select("id", "parts", F.struct(*who, "size").alias("x"))
    rest = at.join(many.select("id").distinct(), "id", "left_semi").select("id", "parts", F.struct(*who, "size").alias("y"), (F.col("met") > carried).alias("heavy"))
    met = many.select("id", part("x").alias("i"), every.alias("j"), "x").join(rest.select("id", every.alias("i"), part("y").alias("j"), "y", "heavy"), ["id", "i", "j"])
    low = F.col("x.draft_id") < F.col("y.draft_id")
    met = met.where(low | (~F.col("heavy") & (F.col("x.draft_id") > F.col("y.draft_id"))))  # two of many keys meet twice
    met = met.select("id", F.when(low, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(low, F.col("y")).otherwise(F.col("x")).alias("y"))
    return first, met.select(*told, kind(F.col("id")).alias("kind"))


def evidence_pairs(keys: DataFrame, fan_out: int = 1000, carried: int = CARRIED) -> DataFrame:
    """(a, b, shared, same) for all pairs a < b that share a key; same says that their key sets are equal.

    keys is (draft_id, key) without repeats.  The pairs are as many as the drafts of a key squared; see shared_pairs()."""
    few, many = shared_pairs(keys.select("draft_id", "key"), fan_out=fan_out, carried=carried)
    pair = ["a", "b", "size_a", "size_b"]
    pairs = few.select(*pair, F.size("kinds").cast("long").alias("shared")).union(many.groupBy(*pair).agg(F.count("*").alias("shared")))
    return pairs.select("a", "b", "shared", ((F.col("shared") == F.col("size_a")) & (F.col("shared") == F.col("size_b"))).alias("same"))


def key_pairs(keys: DataFrame, fan_out: int = 1000) -> DataFrame:
    """(a, b, key): each pair a < b that shares the key, a hot key dealt into parts as in evidence_pairs()."""
    left, right = dealt_sides(keys, fan_out)
    return left.join(right, ["key", "i", "j"]).where("a < b").select("a", "b", "key")


def relation_catalog(pairs: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Adds relation_id MSG-001, FILE-001, ...: numbered per kind (column kind, 'message' or 'file') by a, b."""
    at = numbered(pairs, ["a", "b"], "_number", [*scope, "kind"])
    return at.withColumn("relation_id", F.concat(F.when(F.col("kind") == "message", "MSG-").otherwise("FILE-"), F.format_string("%03d", "_number"))).drop("_number")


def conversation_sets(events: DataFrame) -> DataFrame:
    """(set_key, draft_id): distinct sets of two or more events that share a conversation key, each named by
    its smallest key; events is (draft_id, key).  Sets are told apart by their size and two sums of
    hashes, so none is gathered into a row."""
    at = events.select("draft_id", "key").distinct()
    sums = [F.sum(F.xxhash64(F.lit(salt), "draft_id").cast("decimal(38,0)")).alias(f"h{salt}") for salt in (1, 2)]
    sets = at.groupBy("key").agg(F.count("*").alias("n"), *sums).where("n >= 2").groupBy("n", "h1", "h2").agg(F.min("key").alias("key"))
    return at.join(sets.select("key"), "key").select(F.col("key").alias("set_key"), "draft_id")


def group_relations(kinds: dict[str, DataFrame], assign: DataFrame, fan_out: int = 1000, carried: int = CARRIED) -> DataFrame:
    """(a, b, types): draft pairs of different groups that share a key, with the kinds of key.

    kinds maps a name to (draft_id, key); assign is (draft_id, group_id)."""
    names = sorted(kinds)
    every = reduce(DataFrame.union, [kinds[n].select("draft_id", F.col("key").cast("string").alias("key")).distinct().withColumn("kind", F.lit(i)) for i, n in enumerate(names)])
    every = every.join(assign.select("draft_id", "group_id").distinct(), "draft_id")
    few, many = (p.where("group_id_a <> group_id_b") for p in shared_pairs(every, ("group_id",), max(2, len(names)), fan_out, carried))
    pair = ["a", "b", "group_id_a", "group_id_b"]
    name = lambda i: F.element_at(F.array(*map(F.lit, names)), i + 1)
    said = lambda found: F.array_join(F.transform(found, name), ",")
    types = F.when(F.size("kinds") == 1, name(F.col("kinds")[0])).otherwise(said(F.array_sort(F.array_distinct("kinds"))))
    found = few.select(*pair, types.alias("types")).union(many.groupBy(*pair).agg(said(F.sort_array(F.collect_set("kind"))).alias("types")))
    return found.withColumnsRenamed({"group_id_a": "group_a", "group_id_b": "group_b"})


def draft_attachment_names(drafts: DataFrame, attachments: DataFrame, ignored: tuple[str, ...] = ("image/",)) -> DataFrame:
    """(draft_id, key): base names of a draft's attachments, those of an ignored kind left out.

    drafts: draft_id, referenced_attachment_ids; attachments: attachment_id, file_name, mime_type."""
    from evtrail.functions.messages import attachment_base_name

    own = drafts.select("draft_id", F.explode("referenced_attachment_ids").alias("attachment_id")).distinct()
    kind = F.lower(F.coalesce("mime_type", F.lit("")))
    plain = attachments.where(~F.coalesce(reduce(lambda a, b: a | b, [kind.startswith(i) for i in ignored], F.lit(False)), F.lit(False)))
    # names are folded once each, not once a draft
    names = plain.select("file_name").distinct().select("file_name", attachment_base_name(F.col("file_name")).alias("key")).where("key <> ''")
    return own.join(plain.select("attachment_id", "file_name"), "attachment_id").join(names, "file_name").select("draft_id", "key").distinct()


def name_relations(assign: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b, key): pairs of groups whose drafts have an attachment of the same base name.

    assign: draft_id, group_id; names: draft_id, key."""
    at = names.join(assign, "draft_id").select(F.col("group_id").alias("draft_id"), "key").distinct()
    return key_pairs(at)


def name_counts(assign: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b, n): pairs of groups with the number of base names that both have; arguments as in name_relations()."""
    return shared_counts(names.join(assign, "draft_id").select(F.col("group_id").alias("draft_id"), "key").distinct())


def shared_counts(keys: DataFrame, most_keys: int = 2048, block: int = 2048) -> DataFrame:
    """(a, b, n): all pairs a < b with the number of keys that both have; keys is (draft_id, key) without repeats.

    Where few keys (`most_keys` at most) give most pairs of drafts, the drafts are dealt into blocks of about `block`, and each pair of
    blocks is one product of matrices of 0 and 1, given out bit by bit; a task holds two blocks.  Else pairs are met
    key by key, see shared_pairs()."""
    keys = written(keys.select("draft_id", "key"), "count-keys")
    n = key_counts(keys).where("n > 1")
    met = n.agg(F.count("*").alias("keys"), F.sum(F.col("n").cast("double") ** 2).alias("met")).first()
    drafts = keys.select("draft_id").distinct().count()
    if keys.schema["draft_id"].dataType.typeName() not in ("long", "integer") or met["keys"] > most_keys or (met["met"] or 0) * 64 < drafts**2:
        return evidence_pairs(keys).select("a", "b", F.col("shared").alias("n"))
    width, blocks = met["keys"], -(-drafts // block)
    number = written(n.select("key", (F.row_number().over(Window.orderBy("key")) - 1).alias("place")), "count-places")  # most_keys rows
    rows = keys.where("draft_id is not null").join(F.broadcast(number), "key").groupBy(F.col("draft_id").cast("long").alias("id")).agg(F.collect_list("place").alias("places"))
    held = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("i")).agg(F.collect_list("id").alias("ids"), F.collect_list(F.size("places")).alias("sizes"), F.flatten(F.collect_list("places")).alias("places"))
    held = written(held, "count-blocks")
    tasks = min(2000, max(1, blocks * (blocks + 1) // 2))
    one = F.struct("ids", "sizes", "places")
    left = held.select("i", F.explode(F.sequence("i", F.lit(blocks - 1))).alias("j"), one.alias("x")).repartition(tasks, "i", "j")
    right = held.select(F.explode(F.sequence(F.lit(0), "i")).alias("i"), F.col("i").alias("j"), one.alias("y")).repartition(tasks, "i", "j")

    def matrix(side: dict) -> tuple[np.ndarray, np.ndarray]:
        m = np.zeros((len(side["ids"]), width), np.float32)
        m[np.repeat(np.arange(len(m)), side["sizes"]), side["places"]] = 1
        return np.array(side["ids"], np.int64), m

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                (a, x), (b, y) = matrix(row["x"]), matrix(row["y"])
                for first in range(0, len(a), 128):
                    some = a[first : first + 128]
                    shared = x[first : first + 128] @ y.T
                    r, c = np.nonzero(shared * (some[:, None] < b) if row["i"] == row["j"] else shared)
                    low, high = some[r], b[c]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(low, high)), pa.array(np.maximum(low, high)), pa.array(shared[r, c].astype(np.int64))], names=["a", "b", "n"])

    found = left.hint("merge").join(right, ["i", "j"]).mapInArrow(count, "a long, b long, n long")
    kind = keys.schema["draft_id"].dataType
    return found.select(F.col("a").cast(kind), F.col("b").cast(kind), "n")


def draft_file_keys(drafts: DataFrame, links: DataFrame) -> DataFrame:
    """(draft_id, key): attachments of a draft and the links it refers to, by their file keys."""
    from evtrail.functions.hashing import attachment_key, file_key

    own = drafts.select("draft_id", F.explode("referenced_attachment_ids").alias("x")).select("draft_id", attachment_key(F.col("x")).alias("key"))
    linked = drafts.select("draft_id", F.explode("referenced_link_ids").alias("link_id")).join(links.select("link_id", "url"), "link_id").select("draft_id", file_key(F.col("url")).alias("key"))
    return own.union(linked).where("key <> ''").distinct()


def enrich_reactions(df: DataFrame, catalog: DataFrame, template: str = "{emoji_type}", max_rows: int = 10_000) -> DataFrame:
    """Left join with the catalog, which goes out whole only while it has at most `max_rows` rows."""
    known = catalog.select("emoji_type", "description")
    small = catalog.limit(max_rows + 1).count() <= max_rows
    fallback = F.replace(F.lit(template), F.lit("{emoji_type}"), F.col("emoji_type"))
    return df.join(F.broadcast(known) if small else known, "emoji_type", "left").withColumn("description", F.coalesce("description", fallback))


def attach_links(events: DataFrame, links: DataFrame) -> DataFrame:
    """(event_id, url, title): referenced links whose tokens occur in the event's text; of equal URLs the
    first with a title.  events: event_id, text, link_ids; links: link_id, url, title, tokens."""
    at = events.select("event_id", F.lower("text").alias("text"), F.posexplode("link_ids").alias("pos", "link_id")).join(links, "link_id")
    hit = at.where(F.exists("tokens", lambda t: F.col("text").contains(t)))
    return hit.groupBy("event_id", "url").agg(F.min_by("title", F.struct((F.coalesce("title", F.lit("")) == "").alias("bare"), "pos")).alias("title"))


def attach_mentioned_links(events: DataFrame, links: DataFrame, keys: tuple[str, ...] = ("owner_id", "date")) -> DataFrame:
    """Links of the same owner and day whose URL or document token occurs in the event's text, found through an index of
    pieces (substrings.contains_join)."""
    at = links.withColumn("token", doc_token("url"))
    return contains_join(events, at, list(keys), [(F.col("text"), strip("url")), (F.col("text"), F.col("token"))])


def attach_named_files(events: DataFrame, attachments: DataFrame) -> DataFrame:
    """Attachments of the event's conversation that its text names, in any case, found through an index of pieces."""
    return contains_join(events, attachments, ["conversation_id"], [(F.lower("text"), F.lower(strip("file_name")))])


def filter_lineage(filtered: DataFrame, sources: DataFrame) -> DataFrame:
    """(event_id, files, people) of merged events; filtered has event_id and source_ids."""
    at = filtered.select("event_id", F.explode(F.array_distinct("source_ids")).alias("draft_id")).join(sources.select("draft_id", "source_file", "person"), "draft_id")
    return at.groupBy("event_id").agg(F.sort_array(F.collect_set("source_file")).alias("files"), F.sort_array(F.collect_set("person")).alias("people"))


def mark_owner(events: DataFrame, owner: str | Column) -> DataFrame:
    return events.withColumn("is_owner", clean_text("person") == (F.lit(owner) if isinstance(owner, str) else owner))


def hydrate_titles(links: DataFrame, titles: DataFrame) -> DataFrame:
    """Fills empty link titles from (token, title) by the document token of the URL."""
    own = F.when(F.coalesce("title", F.lit("")) != "", F.col("title"))
    known = titles.select("token", F.col("title").alias("found")).dropDuplicates(["token"])
    return links.withColumn("token", doc_token("url")).join(known, "token", "left").withColumn("title", F.coalesce(own, "found", F.lit(""))).drop("token", "found")


def attach_texts(segments: DataFrame, texts: DataFrame) -> DataFrame:
    return segments.join(texts, "message_id")
