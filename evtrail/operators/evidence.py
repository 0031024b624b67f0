"""Review of groups: components to review, resolutions, the basis of a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtrail.scratch import written

from .graph import components, connected_by
from .numbering import numbered
from .packing import fold_rows


def review_components(groups: DataFrame, pairs: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """(group_id, component, number): groups with an edge (a, b), and required ones even without; numbered by
    their smallest group."""
    found = components(pairs).select(F.col("node").alias("group_id"), "component")
    if required is not None:
        found = found.union(required.join(found, "group_id", "left_anti").select("group_id", F.col("group_id").alias("component")))
    found = found.join(groups.select("group_id").distinct(), "group_id", "left_semi")
    numbers = numbered(found.groupBy("component").agg(F.min("group_id").alias("first")), ["first", "component"], "number").drop("first")
    return found.join(numbers, "component")


def merge_review_components(groups: DataFrame, pairs: DataFrame, risks: DataFrame, atoms: DataFrame) -> DataFrame:
    """(component, group_id, number, reasons, atoms): groups tied by a relation, and groups of high risk even
    alone; with each group its reasons to review and the atomic sets that lie inside its component.

    groups: group_id, draft_id; pairs: a, b (groups), type; risks: group_id, reason; atoms: atom_id, draft_id."""
    at = review_components(groups, pairs.select("a", "b"), risks.select("group_id").distinct())
    ties = pairs.select(F.col("a").alias("group_id"), F.col("type").alias("reason")).union(pairs.select(F.col("b").alias("group_id"), F.col("type").alias("reason")))
    reasons = ties.union(risks.select("group_id", "reason")).distinct().groupBy("group_id").agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))
    size = atoms.groupBy("atom_id").agg(F.count_distinct("draft_id").alias("size"))
    inside = atoms.join(groups.select("group_id", "draft_id"), "draft_id").join(at.select("group_id", "component"), "group_id").groupBy("component", "atom_id").agg(F.count_distinct("draft_id").alias("n")).join(size, "atom_id").where("n = size")
    held = inside.groupBy("component").agg(F.count("*").alias("atoms"))
    return at.join(reasons, "group_id", "left").join(held, "component", "left").select("component", "group_id", "number", F.coalesce("reasons", F.lit("")).alias("reasons"), F.coalesce("atoms", F.lit(0)).alias("atoms"))


def covers_group(assign: DataFrame, relations: DataFrame) -> DataFrame:
    """(group_id, covered): whether the group's chosen relations (group_id, a, b) connect all its members."""
    keys = relations.select("group_id", F.concat_ws("-", "a", "b").alias("key"), F.explode(F.array("a", "b")).alias("draft_id"))
    return connected_by(assign, keys.select("draft_id", "key")).withColumnRenamed("connected", "covered")


def contained_relations(assign: DataFrame, relations: DataFrame) -> DataFrame:
    """(group_id, relation_id, draft_id, size): the drafts of the relations that lie wholly inside a group and have two or more."""
    each = relations.select("relation_id", F.explode("draft_ids").alias("draft_id")).distinct()
    size = each.groupBy("relation_id").agg(F.count("*").alias("size")).where("size > 1")
    at = each.join(assign.select("group_id", "draft_id").distinct(), "draft_id")
    whole = at.groupBy("group_id", "relation_id").agg(F.count("*").alias("size")).join(size, ["relation_id", "size"])
    return at.join(whole, ["group_id", "relation_id"]).select("group_id", "relation_id", "draft_id", "size")


class _Parts:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while (up := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up.setdefault(up, up)
        return x

    def join(self, a, b) -> bool:
        """Whether they were apart."""
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _forest(edges: DataFrame, within: tuple[str, ...]) -> DataFrame:
    """The edges (group_id, relation_id, a, b) that, taken in the order of relation_id within `within`, join two parts: a
    spanning forest, as the union-find of one group is all that a task holds."""

    def make() -> Callable:
        parts = _Parts()
        return lambda row: (parts.join(row["a"], row["b"]),)

    return fold_rows(edges, within, ("relation_id", "a", "b"), make, "kept boolean").where("kept").drop("kept")


def relation_forest(contained: DataFrame, salts: int = 8) -> DataFrame:
    """(group_id, relation_id, a, b): a forest of ties between drafts, from the first relations by id that join two parts of their
    group.  Edges of a group are dealt to `salts` tasks first and each keeps the forest of its own: an edge that is in
    no such forest is in none of the whole."""
    hub = contained.groupBy("group_id", "relation_id").agg(F.min("draft_id").alias("a"))
    edges = contained.join(hub, ["group_id", "relation_id"]).where("draft_id <> a").select("group_id", "relation_id", "a", F.col("draft_id").alias("b"))
    part = F.pmod(F.xxhash64("relation_id", "b"), F.lit(salts)).cast("int")
    return _forest(_forest(edges.withColumn("part", part), ("group_id", "part")).drop("part"), ("group_id",))


def evidence_members(assign: DataFrame, relations: DataFrame) -> DataFrame:
    """(group_id, draft_id, component, covered): the parts that the relations make of a group, named by their smallest draft; the
    largest one, of equal ones the first, is covered."""
    forest = written(relation_forest(contained_relations(assign, relations)), "forest")
    return _members(assign, forest)


def _members(assign: DataFrame, forest: DataFrame) -> DataFrame:
    kinds = ", ".join(f"{c} {assign.schema[c].dataType.simpleString()}" for c in ("group_id", "draft_id")) + f", component {assign.schema['draft_id'].dataType.simpleString()}"

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, parts = None, _Parts()
        for batch in batches:
            out = []
            for g, a, b in batch.itertuples(index=False, name=None):
                if g != group:
                    out += [(group, x, parts.root(x)) for x in list(parts.up)]
                    group, parts = g, _Parts()
                parts.join(a, b)
            yield pd.DataFrame(out, columns=["group_id", "draft_id", "component"])
        yield pd.DataFrame([(group, x, parts.root(x)) for x in list(parts.up)], columns=["group_id", "draft_id", "component"])

    found = forest.select("group_id", "a", "b").repartition("group_id").sortWithinPartitions("group_id").mapInPandas(label, kinds)
    at = assign.select("group_id", "draft_id").distinct().join(found, ["group_id", "draft_id"], "left").withColumn("component", F.coalesce("component", "draft_id"))
    size = at.groupBy("group_id", "component").agg(F.count("*").alias("n"))
    most = size.groupBy("group_id").agg(F.min_by("component", F.struct(-F.col("n"), "component")).alias("most"))
    return at.join(most, "group_id").select("group_id", "draft_id", "component", (F.col("component") == F.col("most")).alias("covered"))


def evidence_audit(assign: DataFrame, relations: DataFrame) -> DataFrame:
    """(group_id, relation_ids, parts, covered, uncovered): the smallest set of relations that connects the group, of equally small ones
    the first by ids; of a group that they don't connect, those that join parts in the order of ids. covered and
    uncovered count the drafts in and out of the largest part.

    relations: relation_id, draft_ids; one counts for a group that has all its drafts.  Where all relations of a group are pairs,
    the first ones that join two parts are that set, and no group is gathered.  Larger relations are searched exactly, at any
    number (smallest_connecting): a row then has the group's larger relations and those of its pairs that are in the
    forest of the pairs, as no other can be in the set."""
    contained = written(contained_relations(assign, relations), "contained")
    forest = written(relation_forest(contained), "forest")
    n = assign.select("group_id", "draft_id").distinct().groupBy("group_id").agg(F.count("*").alias("n"))
    joined = forest.groupBy("group_id").agg(F.count("*").alias("edges"))
    parts = n.join(joined, "group_id", "left").select("group_id", "n", (F.col("n") - F.coalesce("edges", F.lit(0))).alias("parts"))
    hard = contained.where("size > 2").select("group_id").distinct().join(parts.where("parts = 1"), "group_id")
    asked = contained.join(hard.select("group_id"), "group_id", "left_semi")
    pairs = relation_forest(asked.where("size = 2")).select("group_id", "relation_id").join(asked, ["group_id", "relation_id"])
    lists = asked.where("size > 2").union(pairs.select(asked.columns)).groupBy("group_id", "relation_id").agg(F.sort_array(F.collect_list("draft_id")).alias("draft_ids"))
    lists = lists.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("relation_id", "draft_ids"))).alias("relations"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                sets = [frozenset(r["draft_ids"]) for r in row.relations]
                out += [(row.group_id, row.relations[i]["relation_id"]) for i in smallest_connecting(sets)]
            yield pd.DataFrame(out, columns=["group_id", "relation_id"])

    kinds = {c: contained.schema[c].dataType.simpleString() for c in ("group_id", "relation_id")}
    found = lists.mapInPandas(choose, f"group_id {kinds['group_id']}, relation_id {kinds['relation_id']}")
    easy = forest.select("group_id", "relation_id").distinct().join(hard.select("group_id"), "group_id", "left_anti")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("relation_id")), lambda x: x.cast("string")), ",").alias("relation_ids")
    chosen = easy.union(found).groupBy("group_id").agg(ids)
    held = _members(assign, forest).groupBy("group_id").agg(F.count_if("covered").alias("covered"), F.count_if(~F.col("covered")).alias("uncovered"))
    return parts.join(chosen, "group_id", "left").join(held, "group_id").select("group_id", F.coalesce("relation_ids", F.lit("")).alias("relation_ids"), "parts", "covered", "uncovered")


def smallest_connecting(sets: list[frozenset]) -> list[int]:
    """Indexes of the smallest number of sets that connect all members of all sets, the first in the order of indexes; the sets
    together connect them.

    A set inside an earlier one is never needed.  The rest falls into blocks that share single members only, and each
    is searched alone, with one more set at a time, no further where the sets left can't join the parts
    in the number left or have failed from the same parts before.  The number of sets is not limited; the time grows
    with how many of a block are needed."""
    kept = [i for i, s in enumerate(sets) if not any(s <= sets[j] for j in range(i))]
    return sorted(i for block in _blocks({i: sets[i] for i in kept}) for i in _search(block, sets))


def _blocks(sets: dict[int, frozenset]) -> list[list[int]]:
    """The sets in blocks: two are together where taking away any one member leaves a way between them."""
    after: dict = {}
    for i, s in sets.items():
        for m in s:
            after.setdefault(("m", m), []).append(("s", i))
        after[("s", i)] = [("m", m) for m in sorted(s)]
    number: dict = {}
    low: dict = {}
    label = {i: i for i in sets}

    def top(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    for start in after:
        if start in number:
            continue
        number[start] = low[start] = len(number)
        open_nodes, walk = [start], [(start, None, iter(after[start]))]
        while walk:
            node, up, ways = walk[-1]
            other = next(ways, None)
            if other is None:
                walk.pop()
                if up is not None:
                    low[up] = min(low[up], low[node])
                    if low[node] >= number[up]:  # what is below hangs on `up` alone
                        block = []
                        while not block or block[-1] != node:
                            block.append(open_nodes.pop())
                        own = [i for kind, i in [*block, up] if kind == "s"]
                        for i in own[1:]:
                            label[top(i)] = top(own[0])
            elif other not in number:
                number[other] = low[other] = len(number)
                open_nodes.append(other)
                walk.append((other, node, iter(after[other])))
            elif other != up:
                low[node] = min(low[node], number[other])
    blocks: dict[int, list[int]] = {}
    for i in sets:
        blocks.setdefault(top(i), []).append(i)
    return list(blocks.values())


def _search(block: list[int], sets: list[frozenset]) -> list[int]:
    members = sorted(set().union(*(sets[i] for i in block)))
    bit = {m: 1 << n for n, m in enumerate(members)}
    masks = [sum(bit[m] for m in sets[i]) for i in block]
    failed: dict[tuple, int] = {}

    def merge(parts: tuple[int, ...], mask: int) -> tuple[int, ...]:
        hit = [p for p in parts if p & mask]
        return parts if len(hit) < 2 else tuple(sorted([p for p in parts if not p & mask] + [sum(hit)]))

    def possible(parts: tuple[int, ...], left: int, allowed: tuple[int, ...]) -> bool:
        """Whether `left` of the allowed sets join all parts: some part must be met, so the one that the fewest sets meet is tried."""
        if len(parts) == 1:
            return True
        if left == 0 or failed.get((parts, allowed), -1) >= left:
            return False
        gains = {i: n for i in allowed if (n := sum(1 for p in parts if p & masks[i]) - 1) > 0}
        if sum(sorted(gains.values(), reverse=True)[:left]) >= len(parts) - 1:
            tried = min(([i for i in gains if p & masks[i]] for p in parts), key=len)
            rest = list(gains)
            for i in sorted(tried, key=lambda i: -gains[i]):
                rest.remove(i)
                if possible(merge(parts, masks[i]), left - 1, tuple(rest)):
                    return True
        failed[(parts, allowed)] = left
        return False

    parts, chosen, allowed = tuple(1 << n for n in range(len(members))), [], tuple(range(len(masks)))
    size = next((k for k in range(len(masks) + 1) if possible(parts, k, allowed)), None)
    if size is None:
        raise ValueError("the sets don't connect their members")
    for left in range(size - 1, -1, -1):  # the first set that some solution goes on from
        for i in allowed:
            if len(now := merge(parts, masks[i])) < len(parts) and possible(now, left, tuple(j for j in allowed if j > i)):
                break
        parts, chosen, allowed = now, [*chosen, block[i]], tuple(j for j in allowed if j > i)
    return chosen


def audit_resolutions(sides: DataFrame, resolutions: DataFrame, assign: DataFrame, sources: DataFrame) -> DataFrame:
    """(relation_id, error): relations that are not resolved once, and answers that their evidence or the groups contradict.

    sides: relation_id, side, draft_id, structural; a relation between drafts has one draft a side and is structural, one between
    groups has the drafts of a group as a side. resolutions: relation_id, decision (merged or separate),
    connected_draft_ids, evidence_message_ids; assign: draft_id, group_id, as they came out; sources: draft_id, message_id.

    An answer's evidence has to meet the sources of every draft that it names, or, where it names none, of some draft of
    every side: what each side needs, without what is met, in one pass over all relations."""
    # step by step, each written, so that no more than one step's shuffles are on disk
    sides, resolutions = written(sides.select("relation_id", F.col("side").cast("string").alias("side"), "draft_id", "structural"), "sides"), written(resolutions, "resolutions")
    groups = assign.select("draft_id", "group_id")
    known = sides.groupBy("relation_id").agg(F.count_distinct("side").alias("sides"), F.bool_or("structural").alias("structural"))
    n = resolutions.groupBy("relation_id").agg(F.count("*").alias("n"))
    known = written(known.join(n, "relation_id", "full"), "relations")
    state = F.when(F.col("sides").isNull(), "unknown_relation").when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "repeated")
    out = [known.select("relation_id", state.alias("error")).where("error is not null")]
    named = F.array_distinct(F.coalesce("connected_draft_ids", F.array().cast(resolutions.schema["connected_draft_ids"].dataType)))
    once = resolutions.select("relation_id", "decision", named.alias("named"), "evidence_message_ids").join(known.where("n = 1 and sides is not null").drop("n"), "relation_id")
    once = written(once, "resolved-once")

    # an answer's evidence goes along to the sources of each draft that it has to meet
    each = once.select("relation_id", F.explode("named").alias("draft_id"), "evidence_message_ids").select("relation_id", F.col("draft_id").cast("string").alias("side"), "draft_id", "evidence_message_ids")
    unnamed = sides.join(once.where(F.size("named") == 0).select("relation_id", "evidence_message_ids"), "relation_id")
    needed = each.union(unnamed.select(each.columns))
    met = F.coalesce(F.array_contains("evidence_message_ids", F.col("message_id")), F.lit(False))
    bare = needed.join(sources.select("draft_id", "message_id"), "draft_id", "left").groupBy("relation_id", "side").agg(F.bool_or(met).alias("met")).where("not met")
    out.append(written(bare.select("relation_id").distinct().select("relation_id", F.lit("side_without_evidence").alias("error")), "bare"))

    # a group that has drafts of two sides joins the relation
    joined = sides.join(groups, "draft_id").groupBy("relation_id", "group_id").agg((F.min("side") != F.max("side")).alias("joined")).where("joined").select("relation_id", "joined").distinct()
    joined = written(joined, "joined")
    # an answer's drafts are an array, so what they belong to is no more than that
    told = each.select("relation_id", "draft_id").join(groups, "draft_id", "left").join(sides.select("relation_id", "draft_id", "side"), ["relation_id", "draft_id"], "left")
    told = written(told.groupBy("relation_id").agg(F.size(F.collect_set("group_id")).alias("groups"), F.size(F.collect_set("side")).alias("hit")), "told")
    at = once.select("relation_id", "decision", "sides", "structural", F.size("named").alias("drafts")).join(told, "relation_id", "left").join(joined, "relation_id", "left")
    at = at.fillna(0, ["groups", "hit"]).withColumn("joined", F.coalesce("joined", F.lit(False)))
    merged, separate, named_some = F.col("decision") == "merged", F.col("decision") == "separate", F.col("drafts") > 0
    of_two = merged | (separate & named_some)
    checks = {
        "invalid_decision": ~F.coalesce(merged | separate, F.lit(False)),
        "fewer_than_two_drafts": of_two & (F.col("drafts") < 2),
        "merged_not_reflected": merged & ((F.col("groups") > 1) | ~F.col("joined")),
        "representatives_together": separate & named_some & (F.col("groups") < 2),
        "separate_contradicted": separate & ~named_some & F.col("joined"),
        "structural_not_named": of_two & F.col("structural") & (F.col("hit") < F.col("sides")),
        "one_side_only": of_two & ~F.col("structural") & (F.col("hit") < 2),
    }
    found = F.explode(F.array_compact(F.array(*[F.when(bad, name) for name, bad in checks.items()])))
    return reduce(DataFrame.union, [*out, written(at.select("relation_id", found.alias("error")), "contradicted")])


def layer_parts(assign: DataFrame, evidence: DataFrame, salts: int = 8) -> DataFrame:
    """(group_id, layer, parts): how many parts the evidence of each layer leaves of each group that has some.

    evidence: draft_id, layer, key.  Groups and layers are labelled in one run: a key ties its drafts of a group to their smallest
    one, and the forest of these ties says how many parts are left."""
    at = assign.select("group_id", "draft_id").distinct().join(evidence.select("draft_id", "layer", "key").distinct(), "draft_id")
    hub = at.groupBy("group_id", "layer", "key").agg(F.min("draft_id").alias("a"))
    edges = at.join(hub, ["group_id", "layer", "key"]).where("draft_id <> a").select("group_id", "layer", F.lit(0).alias("relation_id"), "a", F.col("draft_id").alias("b")).distinct()
    part = F.pmod(F.xxhash64("a", "b"), F.lit(salts)).cast("int")
    forest = _forest(_forest(edges.withColumn("part", part), ("group_id", "layer", "part")).drop("part"), ("group_id", "layer"))
    ties = forest.groupBy("group_id", "layer").agg(F.count("*").alias("ties"))
    n = assign.select("group_id", "draft_id").distinct().groupBy("group_id").agg(F.count("*").alias("n"))
    found = at.select("group_id", "layer").distinct().join(ties, ["group_id", "layer"], "left").join(n, "group_id")
    return found.select("group_id", "layer", (F.col("n") - F.coalesce("ties", F.lit(0))).alias("parts"))


def audit_basis(assign: DataFrame, evidence: DataFrame, reasons: DataFrame, kinds: dict[str, str], scope: DataFrame | None = None, semantic: tuple[str, ...] = ("same_matter",)) -> DataFrame:
    """(group_id, reason, error): declared reasons whose own evidence does not connect the group, and groups without any basis.

    evidence: draft_id, kind (message, file or conversation), key; reasons: group_id, reason; kinds: which evidence a reason stands for.
    With reasons of messages and of files both, their evidence together has to connect.  Groups of `scope` (group_id; those held by a
    conversation alone) need messages or files that connect them, or a semantic reason, unless a declared reason has failed."""
    merged = evidence.where(F.col("kind").isin("message", "file"))
    layers = evidence.select("draft_id", F.col("kind").alias("layer"), F.concat_ws("|", "kind", F.col("key").cast("string")).alias("key"))
    layers = layers.union(merged.select("draft_id", F.lit("both").alias("layer"), F.concat_ws("|", "kind", F.col("key").cast("string")).alias("key")))
    whole = written(layer_parts(assign, layers).where("parts = 1").select("group_id", "layer"), "layers")
    many = assign.groupBy("group_id").agg(F.count_distinct("draft_id").alias("n")).where("n > 1").select("group_id")
    of = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    declared = reasons.join(many, "group_id").select("group_id", "reason", F.element_at(of, F.col("reason")).alias("kind")).where("kind is not null").distinct()
    mixed = declared.where("kind <> 'conversation'").groupBy("group_id").agg((F.count_distinct("kind") > 1).alias("mixed"))
    asked = declared.join(mixed, "group_id", "left").withColumn("layer", F.when((F.col("kind") != "conversation") & F.coalesce("mixed", F.lit(False)), "both").otherwise(F.col("kind")))
    failed = asked.join(whole, ["group_id", "layer"], "left_anti").select("group_id", "reason", F.lit("not_connected").alias("error"))
    if scope is None:
        return failed
    bare = scope.select("group_id").distinct().join(many, "group_id", "left_semi").join(failed, "group_id", "left_anti")
    bare = bare.join(whole.where("layer = 'both'"), "group_id", "left_anti").join(reasons.where(F.col("reason").isin(*semantic)), "group_id", "left_anti")
    return failed.union(bare.select("group_id", F.lit(None).cast("string").alias("reason"), F.lit("no_basis").alias("error")))


def semantic_conflicts(assign: DataFrame, evidence: DataFrame, reasons: DataFrame, hints: DataFrame, semantic: tuple[str, ...] = ("same_matter",)) -> DataFrame:
    """(group_id): groups of a semantic reason that neither messages nor files connect and whose drafts name different objects.

    evidence: draft_id, kind, key; reasons: group_id, reason; hints: draft_id, hint, compared in lower case without white space."""
    folded = F.lower(F.regexp_replace(F.coalesce("hint", F.lit("")), r"(?U)\s", ""))
    objects = assign.join(hints.select("draft_id", folded.alias("object")).where("object <> ''"), "draft_id").groupBy("group_id").agg(F.count_distinct("object").alias("objects")).where("objects > 1")
    asked = reasons.where(F.col("reason").isin(*semantic)).select("group_id").distinct()
    keys = evidence.where(F.col("kind").isin("message", "file")).select("draft_id", F.lit("both").alias("layer"), F.concat_ws("|", "kind", F.col("key").cast("string")).alias("key"))
    return objects.select("group_id").join(asked, "group_id").join(layer_parts(assign, keys).where("parts = 1"), "group_id", "left_anti")


def audit_decision(assign: DataFrame, decisions: DataFrame) -> DataFrame:
    """Scopes that say split but have one group; decisions: scope, decision; assign: scope, group_id."""
    one = assign.groupBy("scope").agg(F.count_distinct("group_id").alias("n")).where("n = 1")
    return decisions.where("decision = 'split'").join(one, "scope", "left_semi")


def audit_verdicts(batch: DataFrame, verdicts: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """(draft_id, error): drafts without or with two verdicts, unknown drafts, signal types not allowed."""
    from .audit import audit_partition

    counted = audit_partition(batch, verdicts.select("draft_id", "verdict_id").distinct())
    odd = verdicts.where(~F.col("signal").isin(*allowed)).select("draft_id", F.lit("signal_not_allowed").alias("error"))
    return counted.union(odd).distinct()


def repair_status(before: DataFrame, after: DataFrame) -> DataFrame:
    """(group_id, was_repaired): groups of `after` whose member set no group of `before` has."""
    sets = lambda df: df.groupBy("group_id").agg(F.array_join(F.sort_array(F.collect_list(F.col("draft_id").cast("string"))), ",").alias("members"))
    known = sets(before).select("members", F.lit(False).alias("was_repaired")).distinct()
    return sets(after).join(known, "members", "left").select("group_id", F.coalesce("was_repaired", F.lit(True)).alias("was_repaired"))


def discovery_outcome(discovered: DataFrame, comps: DataFrame, attempts: DataFrame) -> DataFrame:
    """(candidate, component, status): candidates and components with equal group sets, and the last attempt's
    status.  discovered: candidate, group_id; comps: component, group_id; attempts: component, attempt, status."""
    ids = F.array_join(F.sort_array(F.collect_set(F.col("group_id").cast("string"))), ",").alias("ids")
    last = attempts.groupBy("component").agg(F.max_by("status", "attempt").alias("status"))
    return discovered.groupBy("candidate").agg(ids).join(comps.groupBy("component").agg(ids), "ids", "left").join(last, "component", "left").select("candidate", "component", "status")
