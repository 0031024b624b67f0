"""Secret scans by corpus-wide ownership frequency, in DataFrame operations only.

Patterns give candidates; the hash of each candidate's value is counted over distinct repositories
and owners.  A value that `copied_owners` owners or `copied_repositories` repositories hold is a
copied example; one that fewer hold is owner-specific and looks live.  Counting goes (value, owner)
first, then value, so that a value copied into a third of all rows is summed before it is shuffled.
Candidates are written once; the counts are written too, so that their join with the candidates has
plain shuffles on both sides and Spark can split the partition of a copied value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

#: kind, pattern, group of the value, least length of the value, what a text with such a match
#: holds; in the order of equal starts.  Runs of one kind of character are asked for at their least length: a
#: shorter run holds no longer one, so what is found is the same.
BASE = (
    ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, r"(?i)(passw|secret|token|api_?key)[a-z\"']*\x20*[:=]"),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16, r"AKIA[A-Z0-9]{12}"),
    ("hex", r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
)
#: Candidates that count only if they look live: long, mixed, in no base span, held by few owners.
EXTRA = ("token", r"[A-Za-z0-9+/_-]{20,}", 0, 20, r"[A-Za-z0-9+/_-]{20}")
_SPAN = "array<struct<start:int,end:int,kind:string,value:string>>"


def found(text: Column, kind: str, pattern: str, group: int, least: int, held: str) -> Column:
    """The leftmost non-overlapping matches in code points: what stands between two matches gives
    their places, as the pieces and the matches make up the text."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))

    def step(at: Column, x: Column) -> Column:
        start = at["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["whole"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        good = F.coalesce(F.length(x["value"]), F.lit(0)) >= least
        return F.struct(end.alias("at"), F.when(good, F.concat(at["out"], F.array(span))).otherwise(at["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    return F.when(text.rlike(held), F.aggregate(parts, start, step)["out"]).otherwise(F.array().cast(_SPAN))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    copied_owners: int = 3,
    copied_repositories: int = 10,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document row: id, text, base spans, all spans, n_live, n_example, and `rest`, a
    struct of the `carry` columns (null without any).

    Spans are structs (start, end, kind, value), ordered by start, then kind as listed.  Repository is
    the document, owner `owner_col`.  Base spans always stay; a `token` span is added only for an
    owner-specific value with letters and digits that meets no base span.  Null and empty texts have no
    spans, an empty table gives no rows; a null owner is one owner, apart from the empty name; rows
    without id are one repository; repeated rows give repeated results and count once; rows are
    matched by id and text, so equal ids with different texts stay apart.  Very long texts are
    searched whole.  Columns other than the four named are not looked at, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rank = F.create_map(*[x for i, k in enumerate((*BASE, EXTRA)) for x in (F.lit(k[0]), F.lit(i))])
    at = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(owner_col).cast("string").alias("owner"), (F.struct(*carry) if carry else F.lit(None).cast("boolean")).alias("rest"))
    at = at.withColumn("key", F.xxhash64("id", text))
    base = F.concat(*[found(text, *k) for k in BASE])

    def mixed(x: Column) -> Column:
        return x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")

    extra = F.filter(found(text, *EXTRA), mixed)
    apart = let(base, lambda b: F.struct(b.alias("base"), F.filter(extra, lambda x: ~F.exists(b, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))).alias("extra")))
    hits = (
        at.where(reduce(lambda a, b: a | b, [text.rlike(k[4]) for k in (*BASE, EXTRA)]))
        .select("id", "key", "owner", apart.alias("s"))
        .select("id", "key", "owner", F.explode(F.array_distinct(F.concat("s.base", "s.extra"))).alias("x"))
        .withColumn("hash", F.sha2("x.value", 256))
    )
    hits = written(hits, "secrets-hits")
    held = hits.groupBy("hash", "owner", "id").count().groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    counted = written(held.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories")), "secrets-counts")
    live = (F.col("owners") < copied_owners) & (F.col("repositories") < copied_repositories)
    judged = hits.join(counted, "hash").select("id", "key", "x", live.alias("live"), "owners", "repositories")
    spans = judged.groupBy("key", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("k")).agg(F.collect_set(F.struct("x.start", rank[F.col("x.kind")].alias("rank"), "x.end", "x.kind", "x.value", "live", "owners", "repositories")).alias("all"))
    kept = F.filter(F.array_sort("all"), lambda x: (x["kind"] != EXTRA[0]) | x["live"])
    none = F.array().cast(spans.schema["all"].dataType)
    out = at.withColumn("k", F.coalesce(F.col("id").cast("string"), F.lit(""))).join(spans.withColumn("all", kept), ["key", "k"], "left")
    out = out.withColumn("all", F.coalesce("all", none))
    return out.select(
        F.col("id").alias(id_col), F.col("text").alias(text_col), F.filter("all", lambda x: x["kind"] != EXTRA[0]).alias("base"), F.col("all").alias("spans"),
        F.size(F.filter("all", lambda x: x["live"])).cast("long").alias("n_live"), F.size(F.filter("all", lambda x: ~x["live"])).cast("long").alias("n_example"), "rest",
    )


def digest(scanned: DataFrame) -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *[n(k[0]) for k in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "n_live", "n_example")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with the union of the spans replaced by the mark; the text is cut, never built up anew."""
    # how far the spans before each one reach, and at last how far they all do
    reach = F.aggregate(spans, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.greatest(F.element_at(a, -1), x["end"]))))

    def cut(until: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            at = F.get(until, i)
            return F.when(x["start"] >= at, F.concat(F.substring(text, at + 1, x["start"] - at), F.lit(mark))).otherwise("")

        return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, F.element_at(until, -1) + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(reach, cut))
