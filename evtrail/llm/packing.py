"""Packing by powers of two: every document is cut into pieces of binary lengths, equal lengths share a bucket.

A document of n tokens becomes n // size pieces of `size` tokens and one piece for each bit of the rest,
longest first, so that every piece fills a sequence of its own: no padding, and no sequence crosses
documents.  Sequence ids are ordered by length, so a bucket is one range of them.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim

VOCABULARY = os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "byte_bpe_50k.json")
SIZE = 2048
END = 1
#: Bytes of text that are encoded together; a longer text is encoded block by block.
BLOCK_BYTES = 1 << 22
#: Chunks of up to so many bytes are kept with their ids, at most so many bytes of ids.
KEPT_CHUNK, KEPT_IDS = 64, 1 << 23

_ASCII = "\t\n\x0b\f\r "
_ASCII_SPACE = np.isin(np.arange(256), list(_ASCII.encode()))
# white space that only Unicode knows, or that libraries see differently; texts with it go through whole
_OTHER_SPACE = "[\x1c-\x1f\x85\xa0  -     　]"


class Encoder:
    """Ids of texts by the tokenizer, which sees each distinct chunk once.

    A chunk is a run of ASCII white space and what follows up to the next run.  The pre-tokens of a byte-level BPE
    never go on from a letter to white space, and what they look ahead at lies in the chunk, so the ids of a
    text are those of its chunks.  That holds for tokenizers of the kind ByteLevel with its own pattern,
    without prefix blank or normaliser; with any other, texts are chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not kind.get("normalizer")
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        special = {t["content"] for t in kind.get("added_tokens", [])}
        for token, n in self.tokenizer.get_vocab().items():  # a letter of a byte-level vocabulary is a byte
            self.bytes_of[n] = len(token.encode()) if token in special else len(token)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _coded(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of each chunk.  Chunks that neither begin nor end with white space that could run together with that of
        others are encoded a thousand at once and told apart by the bytes of their ids."""
        out: list[np.ndarray] = [None] * len(chunks)
        joined = [i for i, c in enumerate(chunks) if self.cuts and not c[-1].isspace() and (c[0] in _ASCII or not c[0].isspace())]
        alone = sorted(set(range(len(chunks))).difference(joined))
        for i, e in zip(alone, self.tokenizer.encode_batch([chunks[i] for i in alone], add_special_tokens=False) if alone else [], strict=True):
            out[i] = np.array(e.ids, np.uint32)
        for k in range(0, len(joined), 1000):
            part = joined[k : k + 1000]
            texts = ["" if chunks[i][0] in _ASCII else "\n" for i in part]  # a line break is a token of its own
            lead = np.array([len(t) for t in texts], np.int64)
            ids = np.array(self.tokenizer.encode("".join(t + chunks[i] for t, i in zip(texts, part, strict=True)), add_special_tokens=False).ids, np.uint32)
            at = np.append(0, np.cumsum(self.bytes_of[ids]))
            to = np.cumsum(lead + np.array([len(chunks[i].encode()) for i in part], np.int64))
            ends = np.searchsorted(at, to)
            for i, a, b in zip(part, (np.append(0, ends[:-1]) + lead).tolist(), ends.tolist(), strict=True):
                out[i] = ids[a:b]
        return out

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        """Where the ids of each of the distinct chunks are; encodes those that are new."""
        if self.flat.nbytes > KEPT_IDS:
            self.clear()
        found = list(map(self.number.get, chunks))
        new = [c for c, n in zip(chunks, found, strict=True) if n is None]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            coded = self._coded(new)
            lengths = np.array([len(c) for c in coded], np.int64)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths, self.flat = np.concatenate([self.lengths, lengths]), np.concatenate([self.flat, *coded])
            found = list(map(self.number.get, chunks))
        return np.array(found, np.int64)

    def _forget(self, chunks: list[str]) -> None:
        """Long chunks are rare and large: nothing of them is kept beyond their block."""
        if any(len(c) > KEPT_CHUNK for c in chunks):
            kept = [(c, n) for c, n in self.number.items() if len(c) <= KEPT_CHUNK]
            at = np.array([n for _, n in kept], np.int64)
            self.flat, ends = self._gather(at)
            self.number = {c: i for i, (c, _) in enumerate(kept)}
            self.lengths = np.diff(ends, prepend=0)
            self.starts = ends - self.lengths

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks one after the other, and where each ends."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[at] - (ends - lengths), lengths)
        return self.flat[shift + np.arange(len(shift))], ends

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (none null) one after the other, and where each text ends in them."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        if offsets[-1] == offsets[0]:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        cut = np.zeros(len(data) + 1, bool)
        if self.cuts:
            space = _ASCII_SPACE[data]
            cut[1:-1] = space[1:] & ~space[:-1]
            for i in np.flatnonzero(pc.match_substring_regex(texts, _OTHER_SPACE).to_numpy(zero_copy_only=False)):
                cut[offsets[i] : offsets[i + 1]] = False
        cut[offsets] = True
        cut[-1] = False
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(data)).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        distinct = chunks.dictionary.to_pylist()
        ids, ends = self._gather(self._numbers(distinct)[chunks.indices.to_numpy()])
        self._forget(distinct)
        return ids, np.append(0, ends)[np.searchsorted(starts, offsets[1:])]

    def blocks(self, text: str) -> np.ndarray:
        """Ids of one long text, which is cut before white space about every BLOCK_BYTES bytes."""
        if not self.cuts or re.search(_OTHER_SPACE, text):
            return self.encode(pa.array([text], pa.string()))[0]
        parts, begin, step, run = [], 0, BLOCK_BYTES // 4, re.compile(f"(?<=[^{_ASCII}])[{_ASCII}]")
        while begin < len(text):
            found = run.search(text, begin + step)
            end = found.start() if found else len(text)
            parts.append(self.encode(pa.array([text[begin:end]], pa.string()))[0])
            begin = end
        return np.concatenate(parts)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Encoder(path)


def decompose(n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of the pieces of documents of n tokens: whole sequences, then the bits of the rest."""
    bits = size.bit_length() - 1
    whole, rest = n >> bits, n & (size - 1)
    powers = 1 << np.arange(bits - 1, -1, -1)
    has = (rest[:, None] & powers) > 0
    count = whole + has.sum(1)
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    length = np.full(len(row), size, np.int64)
    length[at >= whole[row]] = np.broadcast_to(powers, has.shape)[has]
    start = np.cumsum(length) - length
    return row, start - np.repeat(np.cumsum(n) - n, count), length


def _ids_in_blocks(column: pa.Array, e: Encoder) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, where each row ends) of about BLOCK_BYTES of text each."""
    texts = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset + 1 : texts.offset + len(texts) + 1]
    first, begin = 0, int(ends[0]) - len(texts[0].as_buffer()) if len(texts) else 0
    while first < len(texts):
        last = max(int(np.searchsorted(ends, begin + BLOCK_BYTES, "right")), first + 1)
        if last == first + 1:
            ids = e.blocks(texts[first].as_py())
            yield first, ids, np.array([len(ids)])
        else:
            yield first, *e.encode(texts.slice(first, last - first).cast(pa.string()))
        first, begin = last, int(ends[last - 1])


def pack(docs: DataFrame, *, path: str = VOCABULARY, size: int = SIZE, end: int = END, ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id, start (tokens of its document before it), length (a power of two, `size` at
    most), ids (little-endian unsigned 32-bit integers; left out without `ids`), ids_crc32 of these, doc_tokens (with the
    end token that every document gets), sequence_id and offset (always 0: a piece is a sequence).

    Narrow, one pass, no shuffle: sequence_id is made of the length's rank (longest first), the task and a
    count within both, so ids are unique and those of a bucket lie side by side.  They follow from the partitions of
    docs: the same files give the same ids.

    A null or empty text has the end token only; null ids and repeated rows are documents like others, ties do not
    matter; an empty table gives none; a very long text is encoded block by block, and of it a task holds
    the text and its ids; other columns are not looked at.
    """
    if size < 2 or size & (size - 1):
        raise ValueError("size must be a power of two")
    at = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    bits = size.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim("packing", encoder.cache_clear)
        e = encoder(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(bits + 1, np.int64)
        for batch in batches:
            for first, flat, ends in _ids_in_blocks(batch.column(1), e):
                rows = len(ends)
                out = np.insert(flat, ends, np.uint32(end)).astype("<u4")
                n = np.diff(ends, prepend=0) + 1
                row, start, length = decompose(n, size)
                rank = bits - np.log2(length).astype(np.int64)
                count = np.empty(len(row), np.int64)
                for k in range(bits + 1):
                    here = np.flatnonzero(rank == k)
                    count[here] = seen[k] + np.arange(len(here))
                    seen[k] += len(here)
                raw = memoryview(out.tobytes())
                to = 4 * np.cumsum(length)
                pieces = [raw[a:b] for a, b in zip((to - 4 * length).tolist(), to.tolist(), strict=True)]
                columns = [
                    batch.column(0).slice(first, rows).take(pa.array(row)), pa.array(start), pa.array(length),
                    *([pa.array(pieces, pa.binary())] if ids else []),
                    pa.array(np.fromiter(map(zlib.crc32, pieces), np.int64, len(pieces))), pa.array(n[row]), pa.array(rank << 59 | task << 32 | count), pa.array(np.zeros(len(row), np.int64)),
                ]
                for i in range(0, len(row), 20_000):
                    yield pa.RecordBatch.from_arrays([c.slice(i, 20_000) for c in columns], names=names)

    shape = [("start", "long"), ("length", "long"), *([("ids", "binary")] if ids else []), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long")]
    names = ["id", *(name for name, _ in shape)]
    kind = at.schema["id"].dataType.simpleString()
    return at.mapInArrow(run, f"id {kind}, " + ", ".join(f"{a} {b}" for a, b in shape)).withColumnRenamed("id", id_col)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes pack()'s sequences as one folder a length, so that a reader takes batches of one shape from a folder."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
