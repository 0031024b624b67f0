"""Substring dedup: Rabin-Karp hashes of every window of `window` words, counted in Spark.

Every window that can repeat is hashed and counted; which can't is proven first:

1. Each text is hashed once.  Equal windows share the smallest hash among their `gram`-word parts,
   so a text sends on only these minima (about one in thirteen positions).  If two documents share
   a window, both send its minimum; so a minimum that one document holds alone proves all windows
   under it unique, and they need no count.  Texts with equal word sequences are summed up
   first: only the one with the smallest id goes on, a later one is covered whole.
2. For texts with shared minima all windows under them get two Rabin-Karp hashes (96 bits kept),
   Spark takes the smallest id of each, and the windows whose id is larger are repeats.
3. Repeats of a text merge into maximal intervals of words; the rest is kept.

What is joined by a hash or a digest is written first, so that the join has plain shuffles on both
sides and Spark can split the partition of a window that very many documents share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import claim, slices, written
from .rolling import BASES, window_minima, windows, word_hashes


def _minima(words: list[bytes], window: int, gram: int) -> np.ndarray:
    """For each window the smallest hash of its grams."""
    return window_minima(windows(word_hashes(words), gram), window - gram + 1)


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 26) -> DataFrame:
    """One row per document row: id, n_words, n_removed, kept_sha256 and intervals.

    intervals are the maximal runs [start, end) of removed words; the digest is that of the kept words
    joined by one blank.  Null and empty texts have no words; a text shorter than the window loses
    nothing; of rows with equal ids none is the smaller, so they do not remove each other's words;
    rows without id neither lose words nor make others lose any.  Very long texts are one row each,
    whole; an empty table gives no rows; columns but the two named are not looked at.
    """
    at = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("id", "text"))
    kind = at.schema["id"].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substring", rolling.clear)
        for batch in slices(batches):
            n_words, sha, grams = [], [], []
            for text in batch.column(2).cast(pa.binary()):
                words = (text.as_py() or b"").split()
                n_words.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).digest())
                grams.append(np.unique(_minima(words, window, gram)).view(np.int64) if len(words) >= window else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(sha, pa.binary()), pa.array(grams, pa.list_(pa.int64()))], names=["key", "id", "n_words", "sha", "grams"])

    base = written(at.select("key", "id", "text").mapInArrow(first, f"key long, id {kind}, n_words long, sha binary, grams array<long>"), "substring-base")
    # only texts of a window or more can be covered whole: others, among them all empty ones, meet nobody
    long = F.col("n_words") >= window
    leaders = written(base.where(long & F.col("id").isNotNull()).groupBy("sha").agg(F.min("id").alias("leader")).withColumnRenamed("sha", "same"), "substring-leaders")
    led = base.join(leaders, F.when(long, F.col("sha")).otherwise(F.col("key").cast("string").cast("binary")) == F.col("same"), "left").drop("same")
    grams = led.where((F.col("id") == F.col("leader")) & (F.size("grams") > 0)).select("key", "id", F.explode("grams").alias("gram"))
    shared = written(grams.groupBy("gram").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("gram"), "substring-grams")
    wanted = grams.join(shared, "gram").groupBy("key", "id").agg(F.collect_set("gram").alias("grams"))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substring", rolling.clear)
        for batch in slices(batches):
            starts, ones, twos = [], [], []
            for text, held in zip(batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
                words = text.as_py().split()
                hashes = word_hashes(words)
                low = window_minima(windows(hashes, gram), window - gram + 1).view(np.int64)
                there = np.flatnonzero(np.isin(low, held.values.to_numpy()))
                starts.append(there.astype(np.int32))
                ones.append(windows(hashes, window)[there].view(np.int64))
                twos.append((windows(hashes, window, BASES[1])[there] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(starts, pa.list_(pa.int32())), pa.array(ones, pa.list_(pa.int64())), pa.array(twos, pa.list_(pa.int32()))], names=["key", "id", "text", "start", "one", "two"])

    # one row a text: equal rows would only count the same windows twice
    texts = at.where("id is not null").join(wanted, ["key", "id"]).select("key", "id", "text", "grams")
    held = written(texts.mapInArrow(second, f"key long, id {kind}, text string, start array<int>, one array<long>, two array<int>"), "substring-windows")
    each = held.select("key", "id", F.explode(F.arrays_zip("start", "one", "two")).alias("w")).select("key", "id", "w.start", "w.one", "w.two")
    lowest = written(each.groupBy("one", "two").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("one", "two", "a"), "substring-lowest")
    repeats = each.join(lowest, ["one", "two"]).where("id > a").groupBy("key", "id").agg(F.collect_set("start").alias("starts"))

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_removed, sha, spans = [], [], []
            for text, starts in zip(batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
                words = text.as_py().split()
                edge = np.zeros(len(words) + 1, np.int32)
                at = starts.values.to_numpy()
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
                spans.append([{"start": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)])
                n_removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(~gone)])).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_removed, pa.int64()), pa.array(sha, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["key", "id", "n_removed", "kept", "spans"])

    cut = held.select("key", "id", "text").dropDuplicates(["key", "id"]).join(repeats, ["key", "id"]).mapInArrow(third, f"key long, id {kind}, n_removed long, kept binary, spans array<struct<start:int,end:int>>")
    whole = F.coalesce((F.col("leader") < F.col("id")) & (F.col("n_words") >= window), F.lit(False))
    none = F.array().cast("array<struct<start:int,end:int>>")
    all_words = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    # the cut of a leader holds for rows with its key only; a copy is another row with another id
    return led.drop("grams").join(cut, ["key", "id"], "left").select(
        F.col("id").alias(id_col), "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.lower(F.hex(F.when(whole, F.unhex(F.sha2(F.lit(""), 256))).otherwise(F.coalesce("kept", "sha")))).alias("kept_sha256"),
        F.when(whole, all_words).otherwise(F.coalesce("spans", none)).alias("intervals"),
    )
