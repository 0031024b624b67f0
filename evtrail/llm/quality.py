"""Quality rules: plain counts, then a hashed n-gram log-likelihood ratio, in DataFrame operations only.

Word unigrams and bigrams are hashed into `buckets`; two multinomials, one over the trusted target
rows and one over the whole corpus, give each bucket a log ratio.  A document's score is the mean
ratio of its n-grams, and a fixed threshold decides every document (nothing is sampled).  What
comes to the driver are the `buckets` counts, whatever the size of the corpus.  The corpus is not
shuffled: which rows are trusted is looked up in a broadcast table of at most `max_broadcast` ids;
only beyond that are the rows joined by a shuffle.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, let, written

SYMBOLS = "[#*$%&|<>]"
NO_SPACE = r"[^\x20\x09-\x0D]"
BUCKETS = 1 << 16
#: Which share of trusted rows that the ratios have not seen may score below the threshold; one in FOLDS is left out.
REJECTED = 0.01
FOLDS = 5


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def pair_hashes(hashes: Column) -> Column:
    """For each word, the hash of the word before and itself (of the first one, of itself alone)."""
    return F.transform(hashes, lambda x, i: F.xxhash64(F.get(hashes, i - 1), x))


def repeat_words(pairs: Column, window: int = 8) -> Column:
    """How many words (given by pair_hashes()) stand in windows of `window` words, a power of two from 4 on, that
    the text has twice or more."""
    n = F.size(pairs) - window + 1

    def hashed(i: Column, size: int) -> Column:
        """Of the `size` words from the one before i on: halves are hashed, then their hashes."""
        return F.get(pairs, i) if size == 2 else F.xxhash64(hashed(i, size // 2), hashed(i + size // 2, size // 2))

    keys = F.transform(F.sequence(F.lit(1), n), lambda i: hashed(i, window))

    def covered(k: Column) -> Column:
        by_hash = F.array_sort(F.transform(k, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(
            by_hash,
            lambda p: F.array_sort(F.transform(F.filter(
                F.transform(p, lambda x, i: F.struct(x["i"].alias("i"), (F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False))).alias("twice"))),
                lambda x: x["twice"]), lambda x: x["i"])),
        )
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + window).alias("end"), (a["n"] + i + window - F.greatest(a["end"], i)).alias("n"))
        return F.when(F.size(F.array_distinct(k)) == F.size(k), 0).otherwise(F.aggregate(places, zero, step)["n"])

    return F.when(n < 2, 0).otherwise(let(keys, covered))


def hashed_ngrams(hashes: Column, buckets: int) -> Column:
    """Bucket of each unigram and each bigram of words given by their hashes."""
    twos = F.transform(F.slice(pair_hashes(hashes), 2, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda x: F.pmod(x, F.lit(buckets)))
    return F.concat(F.transform(hashes, lambda x: F.pmod(x, F.lit(buckets))), twos)


def base_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, words and the counts of the plain rules; null and empty texts have no words and fail."""
    text = F.coalesce(F.col("text"), F.lit(""))
    at = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NO_SPACE))
    at = at.select(
        "id", words_of(text).alias("words"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return at.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))


def left_out(id_col: str | Column) -> Column:
    """Whether a trusted row is kept apart for the threshold."""
    return F.pmod(F.xxhash64(F.col(id_col) if isinstance(id_col, str) else id_col), F.lit(FOLDS)) == 0


def _trusted_ids(trusted: DataFrame, id_col: str, max_broadcast: int) -> DataFrame:
    ids = trusted.select(F.col(id_col).alias("id")).where("id is not null").distinct().withColumn("trusted", F.lit(1))
    return F.broadcast(ids) if ids.count() <= max_broadcast else ids.hint("shuffle_hash")


def ratios(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, max_broadcast: int = 1_000_000) -> list[float]:
    """log(target / raw) of each bucket, with one added to every count; the target are the trusted rows that are not left out."""
    at = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    of = F.when(left_out("id"), 0).otherwise(F.coalesce("trusted", F.lit(0)))
    grams = at.join(_trusted_ids(trusted, id_col, max_broadcast), "id", "left").select(of.alias("t"), F.explode(let(word_hashes(words_of(F.col("text"))), lambda h: hashed_ngrams(h, buckets))).alias("b"))
    counts = {r["b"]: (r["n"], r["t"]) for r in grams.groupBy("b").agg(F.count("*").alias("n"), F.sum("t").alias("t")).collect()}
    raw, target = (sum(c[i] for c in counts.values()) + buckets for i in (0, 1))
    if target == buckets:  # no trusted text: no opinion
        return [0.0] * buckets
    n = [counts.get(b, (0, 0)) for b in range(buckets)]
    return [math.log((t + 1) / target) - math.log((r + 1) / raw) for r, t in n]


def fit_threshold(scored: DataFrame, rejected: float = REJECTED) -> float:
    """The largest score, to four digits, below which at most `rejected` of the rows lie (columns score, base_failed; rows that fail the base
    rules do not count); 0 without rows.  What comes to the driver is a histogram of scores of four digits, whatever the rows."""
    held = scored.where("not base_failed").groupBy(F.floor(F.col("score") * 10_000).alias("s")).agg(F.count("*").alias("n")).collect()
    below, most = 0, rejected * sum(r["n"] for r in held)
    for r in sorted(held, key=lambda r: r["s"]):
        if below + r["n"] > most:
            return r["s"] / 10_000
        below += r["n"]
    return 0.0


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    threshold: float | None = None,
    max_broadcast: int = 1_000_000,
    min_words: int = 20,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """One row per document row: counts, base_failed, score (mean log ratio an n-gram) and kept.

    Null and empty texts have no words, score 0 and fail; repeated rows give repeated results and count
    as often as they stand there; rows that share a trusted id are all trusted; an empty or wordless
    `trusted` table scores everything 0, so only the base rules decide; an empty table gives no rows;
    very long texts are read whole; columns but the two named are not looked at.

    Without `threshold` it is fit_threshold() of the trusted rows that the ratios have left out.
    """
    # four digits do: a score is a mean of many
    log_ratios = [round(x, 4) for x in ratios(docs, trusted, id_col=id_col, text_col=text_col, buckets=buckets, max_broadcast=max_broadcast)]
    scored = lambda rows: _scored(rows, log_ratios, id_col, text_col, min_words, max_repeat_percent)
    if threshold is None:
        apart = _trusted_ids(trusted.where(left_out(id_col)), id_col, max_broadcast).select(F.col("id").alias("_trusted_id"))
        # written first: read column by column, the plan would compute a text's hashes anew for each of its words
        threshold = fit_threshold(written(scored(docs.join(apart, F.col(id_col) == F.col("_trusted_id"), "left_semi")), "quality-left-out"))
    return scored(docs).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).withColumnRenamed("id", id_col)


def _scored(docs: DataFrame, log_ratios: list[float], id_col: str, text_col: str, min_words: int, max_repeat_percent: int) -> DataFrame:
    table, buckets = F.from_json(F.lit(json.dumps(log_ratios)), "array<double>"), len(log_ratios)
    at = base_rules(docs, id_col=id_col, text_col=text_col).withColumn("h", word_hashes(F.col("words"))).withColumn("pairs", pair_hashes(F.col("h")))
    ratio = lambda x: F.get(table, F.pmod(x, F.lit(buckets)).cast("int"))
    each = F.transform("pairs", lambda p, i: ratio(F.get("h", i)) + F.when(i > 0, ratio(p)).otherwise(0.0))
    score = F.aggregate(each, F.lit(0.0), lambda a, b: a + b) / F.greatest(2 * F.size("h") - 1, F.lit(1))
    at = at.select("id", F.size("h").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeat_words(F.col("pairs")).cast("long").alias("n_repeat_words"), score.alias("score"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return at.select("*", failed.alias("base_failed"))
