"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark windows.

The automaton works on words: its letters are the numbers of the benchmark's words, its patterns every
window of `window` consecutive item words (an item with fewer words is one window).  Each text is scanned
once; hits map back to words and to code points of the original.

No shuffle: the benchmark is measured first and goes out in blocks of at most about `max_nodes` nodes of
the automaton, whatever its size; an item too large for a block is cut into pieces that overlap by a
window less one word.  What is broadcast and held by a worker thus has a bound; with several blocks the
texts are scanned once for each, one block after the other.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, slices, written

#: A-Z become lower case; of ASCII only digits and letters stay, all else separates words.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def normalised_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_KEEP).split() if text else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Code-point spans of the words of normalised_words()."""
    raw = text.encode()
    starts = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # code points up to each byte
    return [(int(starts[m.start()]) - 1, int(starts[m.end() - 1])) for m in _WORD.finditer(raw.translate(_KEEP))]


def joined_spans(text: str | None, hit: list[int]) -> list[dict]:
    """Spans of the hit words in the text, neighbouring words as one."""
    out: list[dict] = []
    if hit:
        where, last = word_spans(text), -2
        for w in hit:
            if w == last + 1:
                out[-1]["end"] = where[w][1]
            else:
                out.append({"start": where[w][0], "end": where[w][1]})
            last = w
    return out


class Patterns:
    """The automaton of a block of items (item, words)."""

    def __init__(self, items: tuple[tuple[str, tuple[bytes, ...]], ...], window: int):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, words in items:
            line = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words)
            for i in range(max(1, len(line) - window + 1) if line else 0):
                owners[line[i : i + window]].add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, ids in owners.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(sorted(ids))))
        if owners:
            self.automaton.make_automaton()
        self.shortest = min(map(len, owners), default=0)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Indexes of the hit words and the items found."""
        hit, items = set(), set()
        if self.shortest and len(words) >= self.shortest:
            get = self.numbers.get
            for end, (n, ids) in self.automaton.iter(tuple([get(w, 0) for w in words])):
                hit.update(range(end - n + 1, end + 1))
                items.update(ids)
        return np.array(sorted(hit), np.int64), items


@lru_cache(maxsize=1)
def _patterns(sent, window: int) -> Patterns:
    return Patterns(sent.value, window)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    max_nodes: int = 2_000_000,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document row: id, text, n_words, n_hit, items (sorted), spans of hit words, and
    `rest`, a struct of the `carry` columns (null without any).

    Null or empty texts have no words and no hits; null items have no window; repeated rows give
    repeated results; an empty benchmark hits nothing, an empty table gives no rows; very long texts
    are scanned whole.  spans are [start, end) in code points of the original text, runs of
    neighbouring hit words joined.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("t")).where("item is not null and t is not null")
    most = max(window, max_nodes // window)  # words of a piece: each begins at most one window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = normalised_words(text)
                out += [(item, words[i : i + most + window - 1]) for i in range(0, max(1, len(words) - window + 1), most) if words]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.string()), pa.array([w for _, w in out], pa.list_(pa.binary()))], names=["item", "words"])

    pieces = items.mapInArrow(cut, "item string, words array<binary>").distinct()
    nodes = pieces.agg(F.sum(window * F.greatest(F.size("words") - window + 1, F.lit(1)))).first()[0] or 0
    blocks = 1 if nodes <= max_nodes else -(-2 * nodes // max_nodes)  # dealt by hash: half full, so that none is too large
    if blocks > 1:
        pieces = written(pieces, "benchmark")
    at = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
        F.lit(None).cast("array<int>").alias("hit"), F.lit(None).cast("array<string>").alias("items"),
        (F.struct(*carry) if carry else F.lit(None).cast("boolean")).alias("rest"),
    )
    schema = at.schema
    shape = T.StructType([schema["id"], schema["text"], *T.StructType.fromDDL("n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>").fields, schema["rest"]])
    for b in range(blocks):
        part = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b) if blocks > 1 else pieces
        sent = spark.sparkContext.broadcast(tuple(sorted((r["item"], tuple(bytes(w) for w in r["words"])) for r in part.collect())))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, last=b == blocks - 1) -> Iterator[pa.RecordBatch]:
            claim("decontaminate", _patterns.cache_clear)
            patterns = _patterns(sent, window)
            for batch in slices(batches):
                ids, texts, hits, found = (batch.column(i) for i in range(4))
                new_hits, new_items, n_words = [], [], []
                for text, old, had in zip(texts, hits, found, strict=True):
                    words = normalised_words(text.as_py())
                    hit, got = patterns.scan(words)
                    if old.is_valid and len(old):
                        hit = np.union1d(hit, np.array(old.as_py(), np.int64))
                    n_words.append(len(words))
                    new_hits.append(hit.astype(np.int32))
                    new_items.append(sorted(got | set(had.as_py() or ())))
                items = pa.array(new_items, pa.list_(pa.string()))
                if last:
                    spans = pa.array([joined_spans(t.as_py(), h.tolist()) for t, h in zip(texts, new_hits, strict=True)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                    yield pa.RecordBatch.from_arrays([ids, texts, pa.array(n_words, pa.int64()), pa.array([len(h) for h in new_hits], pa.int64()), items, spans, batch.column(4)], names=["id", "text", "n_words", "n_hit", "items", "spans", "rest"])
                else:
                    yield pa.RecordBatch.from_arrays([ids, texts, pa.array(new_hits, pa.list_(pa.int32())), items, batch.column(4)], names=["id", "text", "hit", "items", "rest"])

        # the last scan reports as well; before it, one block's automaton in a worker at a time
        at = at.mapInArrow(scan, shape) if b == blocks - 1 else written(at.mapInArrow(scan, schema), "decontaminate")

    out = at
    return out.withColumnsRenamed({"id": id_col, "text": text_col} if id_col != text_col else {"id": id_col})
