"""Connected components and the set and graph operators on groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtrail.scratch import drop_written, written


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    Alternating large-star and small-star steps: each is one partial aggregation and one join on the
    node.  A step's minima are written before they are joined, so that both sides of the join are
    plain shuffles and Spark can split the partition of a hub.  Rounds grow with the logarithm of
    the longest path; each is written to the shared folder, and the round before is deleted.
    """
    edges = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null").distinct(), "components")
    loops = edges.where("u = v").select(F.col("u").alias("node"))
    at, mark = edges.where("u <> v"), (edges.count(), None)
    for done in range(max_rounds):
        both = at.union(at.select("v", "u"))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components-low", mark[0])
        large = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "components-large", mark[0])
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "components-low", mark[0])
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        last, at = at, written(small.where("u <> v").distinct(), "components", mark[0])
        for table in (low, large, least, *([last] if done else [])):
            drop_written(table)
        now = tuple(at.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    roots = at.select(F.col("v").alias("node")).distinct()
    found = at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
    return found.union(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))


def draft_components(keys: DataFrame, drafts: DataFrame, locked: DataFrame | None = None) -> DataFrame:
    """(draft_id, component) of drafts that share keys (draft_id, key) or stand in a locked group (draft_id, group_id).

    A key links its drafts to its smallest one, so the edges are as many as the rows; drafts without
    a partner are components of their own."""
    from .relations import hub_links

    edges = hub_links(keys.select("draft_id", F.col("key").cast("string").alias("key")).distinct())
    if locked is not None:
        edges = edges.union(hub_links(locked.select("draft_id", F.col("group_id").cast("string").alias("key")).distinct()))
    found = components(edges).withColumnRenamed("node", "draft_id")
    return drafts.select("draft_id").distinct().join(found, "draft_id", "left").select("draft_id", F.coalesce("component", "draft_id").alias("component"))


def connected_by(assign: DataFrame, keys: DataFrame) -> DataFrame:
    """(group_id, connected): whether the keys connect all members of the group among themselves."""
    own = assign.join(keys, "draft_id").select("draft_id", F.concat_ws("|", "group_id", "key").alias("key"))
    parts = assign.join(draft_components(own, assign), "draft_id").groupBy("group_id").agg(F.count_distinct("component").alias("parts"))
    return parts.select("group_id", (F.col("parts") == 1).alias("connected"))


def conversation_only(assign: DataFrame, evidence: DataFrame, conversations: DataFrame) -> DataFrame:
    """Groups in which two members share a conversation but no chain of evidence."""
    own = assign.join(evidence, "draft_id").select("draft_id", F.concat_ws("|", "group_id", "key").alias("key"))
    at = assign.join(draft_components(own, assign), "draft_id").join(conversations, "draft_id")
    return at.groupBy("group_id", "key").agg(F.count_distinct("component").alias("n")).where("n > 1").select("group_id").distinct()


def discovery_pairs(checks: DataFrame) -> DataFrame:
    """(a, b, reasons): undirected pairs, their distinct reasons in order of `pos`."""
    at = checks.select(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"), "reason", "pos").where("a <> b")
    first = at.groupBy("a", "b", "reason").agg(F.min("pos").alias("pos"))
    return first.groupBy("a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "reason"))), lambda x: x["reason"]), "; ").alias("reasons"))


def replace_components(groups: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Drafts of reviewed get its groups, the rest keep theirs; numbered by their first member."""
    kept = groups.join(reviewed.select("draft_id"), "draft_id", "left_anti").select("draft_id", F.concat(F.lit("k:"), F.col("group_id").cast("string")).alias("g"))
    every = kept.union(reviewed.select("draft_id", F.concat(F.lit("r:"), F.col("group_id").cast("string")).alias("g")))
    first = every.groupBy("g").agg(F.min("draft_id").alias("group_id"))
    return every.join(first, "g").select("draft_id", "group_id")


def partition_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, group_id, pairs): how many draft pairs each group of `after` puts together that were apart, and
    how many each group of `before` had that are apart now; both are (draft_id, group_id).

    Counted from how many drafts each old and new group share, so no pair is made."""
    shared = before.select("draft_id", F.col("group_id").alias("old")).join(after.select("draft_id", F.col("group_id").alias("new")), "draft_id").groupBy("old", "new").agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2

    def change(name: str, side: str) -> DataFrame:
        n = pairs(F.sum("n")) - F.sum(pairs(F.col("n")))
        return shared.groupBy(F.col(side).cast("string").alias("group_id")).agg(n.cast("long").alias("pairs")).where("pairs > 0").select(F.lit(name).alias("change"), "group_id", "pairs")

    return change("merged", "new").union(change("split", "old"))

