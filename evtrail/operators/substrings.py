"""Which texts contain which keys, by an index of pieces instead of a comparison of all with all.

A key of LONG or more characters has a window of WINDOW pieces of PIECE characters; the smallest hash of each such window
is a minimiser, and a text that contains the key has the same minimisers at that place.  So texts give all their
minimisers, a key gives the one that the fewest keys have, and equal hashes within a scope are
compared in full.  A shorter key is looked up as a whole: texts give their substrings of the lengths that
the short keys of their scope have.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evtrail.scratch import written

PIECE, WINDOW = 6, 5
LONG = PIECE + WINDOW - 1
#: Bits of the sieve that texts drop their hashes by before they are shuffled.
SIEVE = 1 << 24


def _grams(points: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n characters in a row, as longs."""
    h = np.full(len(points) - n + 1, n, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[j : len(points) - n + 1 + j]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _minimisers(points: np.ndarray) -> np.ndarray:
    """The distinct smallest hashes of the windows of WINDOW pieces."""
    if len(points) < LONG:
        return np.zeros(0, np.int64)
    h = _grams(points, PIECE)
    at = h[: len(h) - WINDOW + 1]
    for i in range(1, WINDOW):
        at = np.minimum(at, h[i : len(h) - WINDOW + 1 + i])
    return np.unique(at)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _sieve(anchor: DataFrame) -> np.ndarray:
    """A bit for the lowest bits of each hash: SIEVE bits, whatever the number of hashes."""
    slot = F.col("hash").bitwiseAND(SIEVE - 1)
    words = anchor.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("bits")).collect()
    out = np.zeros(SIEVE // 64, np.int64)
    for word, bits in words:
        out[word] = bits
    return out.astype("<i8").view(np.uint8)


def _hashed(df: DataFrame, value: str, lengths: str | None, sieve: Broadcast | None = None) -> DataFrame:
    """df without `value`, a row for each of its hashes: kind (0 a minimiser, else how many characters) and hash. With
    `lengths` (an array column, 0 for minimisers) the value is a text, else a key as a whole.  Hashes that `sieve`, the packed bits of
    _sieve(), does not have are left out."""
    keep = [c for c in df.columns if c not in (value, lengths)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = None if sieve is None else sieve.value
        for batch in batches:
            for first in range(0, len(batch), 200):
                part = batch.slice(first, 200)
                texts = part.column(value).to_pylist()
                asked = part.column(lengths).to_pylist() if lengths else [None] * len(texts)
                rows, kinds, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
                for i, (text, kinds_of) in enumerate(zip(texts, asked, strict=True)):
                    points = _points(text)
                    for kind in kinds_of if kinds_of is not None else [0 if len(points) >= LONG else len(points)]:
                        if kind <= len(points):
                            h = np.unique(_grams(points, kind)) if kind else _minimisers(points)
                            if there is not None:
                                slot = h & (SIEVE - 1)
                                h = h[there[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1]
                            rows.append(np.full(len(h), i))
                            kinds.append(np.full(len(h), kind, np.int32))
                            hashes.append(h)
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in keep), pa.array(np.concatenate(kinds)), pa.array(np.concatenate(hashes))], names=[*keep, "kind", "hash"])

    shape = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return df.mapInArrow(run, shape + "kind int, hash long")


def matches(texts: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """(text_id, the columns of `on`, key) of the texts that contain a key of their scope, once each.

    texts: text_id, the columns of `on`, text; keys: the columns of `on`, key.  Rows with a null in a scope column, text or
    key, and empty keys, match nothing.  Equal keys of a scope are searched once.  Hashes that no key has are dropped before the shuffle."""
    distinct = keys.where("key <> ''").select(*on, "key").distinct().withColumn("_key", F.col("key"))
    own = _hashed(distinct, "key", None)
    # of a long key's minimisers the one that the fewest keys of its scope have
    held = own.groupBy(*on, "kind", "hash").agg(F.count("*").alias("n"))
    anchor = own.join(held, [*on, "kind", "hash"]).groupBy(*on, "_key").agg(F.min(F.struct("n", "kind", "hash")).alias("a")).select(*on, "_key", "a.kind", "a.hash")
    anchor = written(anchor, "anchors")
    sieve = texts.sparkSession.sparkContext.broadcast(_sieve(anchor))
    kinds = anchor.groupBy(*on).agg(F.sort_array(F.collect_set("kind")).alias("_kinds"))  # LONG at most
    asked = texts.where("text is not null").join(kinds, on)
    found = _hashed(asked.select("text_id", *on, "text", "_kinds"), "text", "_kinds", sieve).join(anchor, [*on, "kind", "hash"]).select("text_id", *on, "_key").distinct()
    return written(found.join(texts.select("text_id", "text"), "text_id").where(F.col("text").contains(F.col("_key"))).select("text_id", *on, F.col("_key").alias("key")), "matches")


def contains_join(texts: DataFrame, keys: DataFrame, on: list[str], conditions: list[tuple[Column, Column]], dealt: int = 1000) -> DataFrame:
    """The pairs of rows of texts and keys with equal `on` of which the text of one of the conditions contains its key: all
    columns of both, `on` once.  Texts are written first, so that their rows have ids.

    The pairs, which may be as many as the rows of a scope squared, are made last, once each, and are not shuffled: what a
    text contains by an earlier condition goes along with what it contains by a later one.  Rows of an equal key are dealt into
    parts of about `dealt`."""
    left = written(texts.withColumn("_text", F.monotonically_increasing_id()), "texts")
    names = [f"_key{i}" for i in range(len(conditions))]
    right = written(keys.withColumns({n: key for n, (_, key) in zip(names, conditions, strict=True)}), "keys")
    found, out = [], None
    for i, (text, _) in enumerate(conditions):
        own = names[i]
        hits = matches(left.select(F.col("_text").alias("text_id"), *on, text.alias("text")), right.select(*on, F.col(own).alias("key")), on)
        hits = hits.select(F.col("text_id").alias("_text"), *on, F.col("key").alias(own))
        found.append(hits)
        for e in names[:i]:
            tied = found[names.index(e)].join(right.where(F.col(own) != "").select(*on, e, own).distinct(), [*on, e])
            seen = tied.groupBy("_text", *on, own).agg(F.collect_set(e).alias(f"_seen{e}"))
            hits = hits.join(seen, ["_text", *on, own], "left")
        several = right.where(F.col(own) != "").groupBy(*on, own).agg(F.ceil(F.count("*") / dealt).cast("int").alias("_parts"))
        several = written(several.where("_parts > 1"), "dealt-keys")
        parts = F.coalesce("_parts", F.lit(1))
        hits = hits.join(several, [*on, own], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
        rows = right.join(several, [*on, own], "left").withColumn("_part", F.floor(F.rand(1) * parts).cast("int")).drop("_parts")
        hits = left.join(hits.drop(*on), "_text").drop("_text")
        told = [F.coalesce(F.array_contains(f"_seen{e}", F.col(f"r.{e}")), F.lit(False)) for e in names[:i]]
        same = reduce(lambda a, b: a & b, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*on, own, "_part")])
        pairs = hits.alias("l").join(rows.alias("r"), same)
        for again in told:
            pairs = pairs.where(~again)
        pairs = pairs.select(*(F.col(f"l.{c}") for c in texts.columns), *(F.col(f"r.{c}") for c in keys.columns if c not in on))
        out = pairs if out is None else out.union(pairs)
    return out
