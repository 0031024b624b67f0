"""Metrics, roll-ups and reports: grouped aggregations that combine before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtrail.functions.text import ratio
from evtrail.scratch import written

from .numbering import scanned


def text_metrics(df: DataFrame, field: str, keys: tuple[str, ...] = ()) -> DataFrame:
    n = F.length(F.coalesce(F.col(field), F.lit("")))
    return df.groupBy(*keys).agg(F.bround(F.avg(n), 2).alias("avg"), F.bround(F.median(n), 2).alias("median"), F.min(n).alias("min"), F.max(n).alias("max"))


def coverage(sources: DataFrame, outputs: DataFrame, words: int = 4) -> DataFrame:
    """(source_id, covered): a source counts when its ids are a subset of one output's ids.

    Both are long: (source_id, message_id) and (output_id, message_id), without repeats.  An output that covers a source has the
    source's rarest id, so only such outputs are looked at, and of these only the ones whose signature (a bit an id, of `words`
    longs) has the source's; they are then compared in full."""
    sources, outputs = written(sources.select("source_id", "message_id"), "sources"), written(outputs.select("output_id", "message_id"), "outputs")
    mark = lambda w: F.bit_or(F.expr(f"if(pmod(xxhash64(message_id), {64 * words}) div 64 = {w}, shiftleft(1L, cast(pmod(xxhash64(message_id), 64) as int)), 0L)"))
    size = sources.groupBy("source_id").agg(F.count("*").alias("n"))
    held = outputs.groupBy("message_id").agg(F.count("*").alias("outputs"))
    rarest = F.min(F.struct(F.coalesce("outputs", F.lit(0)).alias("outputs"), "message_id"))["message_id"].alias("message_id")
    asked = sources.join(held, "message_id", "left").groupBy("source_id").agg(F.count("*").alias("n"), rarest, *(mark(w).alias(f"bits{w}") for w in range(words)))
    signed = outputs.join(outputs.groupBy("output_id").agg(*(mark(w).alias(f"has{w}") for w in range(words))), "output_id")
    within = reduce(lambda x, y: x & y, [F.col(f"bits{w}").bitwiseAND(F.bitwise_not(f"has{w}")) == 0 for w in range(words)])
    near = written(asked.where("n > 1").join(signed, "message_id").where(within).select("source_id", "output_id", "n", F.col("message_id").alias("rarest")), "coverage-near")
    rest = near.join(sources, "source_id").where("message_id <> rarest").join(outputs, ["output_id", "message_id"])
    full = rest.groupBy("source_id", "output_id", "n").agg(F.count("*").alias("m")).where("m = n - 1").select("source_id")
    one = asked.where("n = 1").join(held, "message_id").select("source_id")
    met = full.union(one).distinct().withColumn("met", F.lit(True))
    return size.join(met, "source_id", "left").select("source_id", F.coalesce("met", F.lit(False)).alias("covered"))


def quality_summary(groups: DataFrame, keys: tuple[str, ...] = ("scope",)) -> DataFrame:
    """Counts and ratios per scope; groups is (scope, group_id, draft_id, owner, kept)."""
    per = groups.groupBy(*keys, "group_id").agg(F.count("*").alias("rows"), F.count_if("kept").alias("kept"), F.count_distinct("owner").alias("owners"))
    return per.groupBy(*keys).agg(
        F.sum("rows").alias("sources"), F.count("*").alias("groups"), F.sum("kept").alias("kept"), F.max("rows").alias("largest"),
        F.count_if(F.col("rows") > 1).alias("merged_groups"), F.max("owners").alias("most_owners"), ratio(F.sum("kept"), F.sum("rows")).alias("kept_ratio"),
    )


def rollup_quality(df: DataFrame, *levels: str) -> DataFrame:
    """Sums at each level and over all; the ratio is weighted by its count."""
    return df.rollup(*levels).agg(F.sum("sources").alias("sources"), F.sum("groups").alias("groups"), F.max("largest").alias("largest"), ratio(F.sum(F.col("kept_ratio") * F.col("sources")), F.sum("sources")).alias("kept_ratio"))


def source_audit(rows: DataFrame) -> DataFrame:
    """Per file: parsed, kept and rejected by kind; rows is (source_file, reject_kind)."""
    n = lambda k: F.count_if(F.col("reject_kind") == k).alias(k)
    return rows.groupBy("source_file").agg(F.count("*").alias("parsed"), n("sensitive"), n("excluded"), F.count_if(F.col("reject_kind").isNull()).alias("kept"))


def missing_evidence(events: DataFrame) -> DataFrame:
    """Files with rows that have no conversation evidence, and how many."""
    return events.where(F.size(F.coalesce("conversation_keys", F.array().cast("array<string>"))) == 0).groupBy("source_file").agg(F.count("*").alias("n"))


def missing_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row a field with the count of null or empty values, from one pass."""
    counts = df.agg(*[F.count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) == "").alias(f) for f in fields])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("missing")) for f in fields])).alias("x")).select("x.*")


def usage_summary(calls: DataFrame) -> DataFrame:
    """Count, sums, and rows with and without reported tokens: in all, by kind and by backend."""
    return calls.groupingSets([[], ["kind"], ["backend"]], "kind", "backend").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.count("tokens").alias("reported"), F.count_if(F.col("tokens").isNull()).alias("missing"))


def timing_report(log: DataFrame, parallel: tuple[str, ...] = ()) -> DataFrame:
    """Calls, seconds and share of the run for each stage; parallel stages have no share.  Where the log has `started` (seconds), also wall,
    from the first start to the last end, and ratio, the seconds that were spent in a second of it."""
    wall = [(F.max(F.col("started") + F.col("seconds")) - F.min("started")).alias("wall")] if "started" in log.columns else []
    per = log.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("seconds").alias("seconds"), F.max("seconds").alias("longest"), *wall)
    if wall:
        per = per.withColumn("ratio", ratio(F.col("seconds"), F.col("wall")))
    alone = ~F.col("stage").isin(*parallel) if parallel else F.lit(True)
    whole = F.sum(F.when(alone, F.col("seconds"))).over(Window.partitionBy())
    return per.withColumn("share", F.when(alone, F.col("seconds") / whole))


def parse_timing_log(text: Column) -> Column:
    """key=value and key="value" pairs of a line, as a map."""
    keys = F.regexp_extract_all(text, F.lit(r'(\w+)=("[^"]*"|\S+)'), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(r'(\w+)=("[^"]*"|\S+)'), F.lit(2))
    return F.map_from_arrays(keys, F.transform(values, lambda v: F.regexp_replace(v, '^"|"$', "")))


def review_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Groups of `after` from two or more groups of `before`, and the other way; both (draft_id, group_id)."""
    both = before.select("draft_id", F.col("group_id").alias("old")).join(after.select("draft_id", F.col("group_id").alias("new")), "draft_id")
    merged = both.groupBy("new").agg(F.count_distinct("old").alias("n")).where("n > 1").agg(F.count("*").alias("n")).select(F.lit("merged").alias("metric"), "n")
    split = both.groupBy("old").agg(F.count_distinct("new").alias("n")).where("n > 1").agg(F.count("*").alias("n")).select(F.lit("split").alias("metric"), "n")
    return merged.union(split)


def outcome_summary(df: DataFrame) -> DataFrame:
    """(by, name, n, hits, requests, events): rows by status and, if there, by completion mode, with the sums of the other columns that are
    there; one aggregation over both groupings."""
    sums = [c for c in ("hits", "requests", "events") if c in df.columns]
    by = [c for c in ("status", "mode") if c in df.columns]
    at = df.groupingSets([[c] for c in by], *by).agg(F.grouping_id().alias("_set"), F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sums))
    name = F.when(F.col("_set") < 2, F.col("status")).otherwise(F.col(by[-1])) if len(by) > 1 else F.col("status")
    kind = F.when(F.col("_set") < 2, "status").otherwise("mode") if len(by) > 1 else F.lit("status")
    return at.select(kind.alias("by"), name.alias("name"), "n", *sums)


def gap_quantiles(pairs: DataFrame) -> DataFrame:
    """Count, min, median, 75 % (the value at round((n - 1) * 0.75), half to even) and max by relation.

    Values are ranked within their relation by sorted ranges, so a relation with most of the pairs is no single task's work."""
    at = scanned(pairs.select("relation", "gap").where("gap is not null"), ["gap"], ["relation"], "rank")
    n = pairs.groupBy(F.col("relation").alias("_by")).agg(F.count("gap").alias("of"), F.count("*").alias("n"))
    at = n.join(at, F.col("relation").eqNullSafe(F.col("_by")), "left")
    value = lambda place: F.max(F.when(F.col("rank") == place, F.col("gap")))
    lower, upper = F.floor((F.col("of") + 1) / 2), F.floor(F.col("of") / 2) + 1
    return at.groupBy(F.col("_by").alias("relation")).agg(F.max("n").alias("n"), F.min("gap").alias("min"), ((value(lower) + value(upper)) / 2).alias("median"), value(F.bround((F.col("of") - 1) * 0.75) + 1).alias("p75"), F.max("gap").alias("max"))


def call_inputs(df: DataFrame) -> DataFrame:
    """Per call: rows, distinct messages and time span; df is (call_id, message_id, ts)."""
    return df.groupBy("call_id").agg(F.count("*").alias("rows"), F.count_distinct("message_id").alias("messages"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def fold_status(df: DataFrame, key: str) -> DataFrame:
    """failed beats warnings, warnings beat success."""
    has = lambda s: F.bool_or(F.col("status") == s)
    return df.groupBy(key).agg(F.when(has("failed"), "failed").when(has("warnings"), "warnings").when(has("success"), "success").otherwise("disabled").alias("status"))


def verdict_coverage(verdicts: DataFrame) -> DataFrame:
    """Per draft: signals, covered fields and distinct evidence; verdicts: (draft_id, field, signal, evidence)."""
    return verdicts.groupBy("draft_id").agg(F.count("signal").alias("signals"), F.count_distinct("field").alias("fields"), F.count_distinct("evidence").alias("evidence"))


def metric_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, base, current, delta, percent) of two (metric, value) tables."""
    both = a.select("metric", F.col("value").alias("base")).join(b.select("metric", F.col("value").alias("current")), "metric", "full")
    delta = F.coalesce("current", F.lit(0)) - F.coalesce("base", F.lit(0))
    return both.withColumn("delta", delta).withColumn("percent", F.when(F.coalesce("base", F.lit(0)) != 0, F.bround(100 * delta / F.col("base"), 2)))


def step_losses(steps: DataFrame) -> DataFrame:
    """Ids of a step that the next step lacks; steps is (step, draft_id)."""
    ahead = steps.select((F.col("step") - 1).alias("step"), "draft_id")
    last = steps.agg(F.max("step").alias("last"))
    return steps.join(ahead, ["step", "draft_id"], "left_anti").join(F.broadcast(last), F.col("step") < F.col("last")).select("step", "draft_id")


def merge_metrics(events: DataFrame, assign: DataFrame, rejected: DataFrame) -> DataFrame:
    """(metric, value) of a merge: events, files and distinct source ids before it, groups, references and largest
    group after it, and how often each reason was given for a rejection.

    events: draft_id, source_file, source_ids; assign: group_id, draft_id; rejected: reason."""
    ids = events.select(F.explode("source_ids").alias("x")).agg(F.count_distinct("x").alias("source_ids"))
    before = events.agg(F.count("*").alias("events"), F.count_distinct("source_file").alias("source_files"))
    after = assign.groupBy("group_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.sum("n").alias("draft_refs"), F.max("n").alias("largest_group"))
    long = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in df.columns])).alias("x")).select("x.*")
    return long(before).union(long(ids)).union(long(after)).union(rejected.groupBy(F.concat(F.lit("rejected:"), "reason").alias("metric")).agg(F.count("*").alias("value")))


def run_facts(sections: dict[str, DataFrame]) -> DataFrame:
    """(number, section, fact, value): the facts of a run, (fact, value) a section, numbered in the order given and
    by fact; a report has few of them."""
    every = None
    for place, (name, df) in enumerate(sections.items()):
        part = df.select(F.lit(place).alias("place"), F.lit(name).alias("section"), F.col("fact").cast("string").alias("fact"), F.col("value").cast("string").alias("value"))
        every = part if every is None else every.union(part)
    return every.select(F.row_number().over(Window.orderBy("place", "fact")).alias("number"), "section", "fact", "value")


def run_rollup(log: DataFrame) -> DataFrame:
    """(run_id, kind, calls, seconds, tokens, reported, hits): saved calls of runs by kind and in all of a run.

    log: run_id, kind, seconds, tokens, from_memo."""
    return log.rollup("run_id", "kind").agg(
        F.count("*").alias("calls"), F.sum("seconds").alias("seconds"), F.sum("tokens").alias("tokens"), F.count("tokens").alias("reported"), F.count_if("from_memo").alias("hits")
    ).where("run_id is not null")


def step_metrics(steps: DataFrame) -> DataFrame:
    """(step, kept, lost, avg, longest): of each step's drafts, how many the next one still has, and their texts'
    lengths; steps: step, draft_id, text."""
    at = steps.select("step", "draft_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    lost = step_losses(steps.select("step", "draft_id")).withColumn("lost", F.lit(1))
    at = at.join(lost, ["step", "draft_id"], "left")
    return at.groupBy("step").agg(F.count_if(F.col("lost").isNull()).alias("kept"), F.count("lost").alias("lost"), F.bround(F.avg("n"), 2).alias("avg"), F.max("n").alias("longest"))
