"""Byte-level BPE encoding and decoding through a sentencepiece model made from the vocabulary.

The model is serialised directly: one piece per rank, its bytes mapped to printable characters,
scored by the negative rank, with identity normalisation.  The best-scored pair merges first, so
merges follow the ranks.  Each pre-token is encoded alone; ids map back to ranks, and decoding is
the inverse mapping of ids to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, slices

VOCABULARY = os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it prints, else from 256 upward."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _field(number: int, kind: int, payload: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(payload)) if kind == 2 else b"") + payload


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: piece 0 is <unk>, piece r + 1 the bytes of the r-th rank in order."""
    letters = byte_letters()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, 2, _field(1, 2, text.encode()) + _field(2, 5, struct.pack("<f", score)) + _field(3, 0, _varint(kind)))

    pieces = [piece("<unk>", 0.0, 2)] + [piece("".join(letters[b] for b in token), -float(rank), 1) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _field(3, 0, _varint(2))  # BPE
    normalizer = _field(1, 2, b"identity") + b"".join(_field(n, 0, b"\0") for n in (3, 4, 5))  # no prefix, no white-space changes
    return b"".join(pieces) + _field(2, 2, trainer) + _field(3, 2, normalizer)


_KEPT_CHARS = 64


def _known_pattern() -> str | None:
    try:
        from public_tokenizers import PATTERN
    except ImportError:
        return None
    return PATTERN


class Codec:
    """Encodes and decodes whole texts; keeps the codes of recent chunks, at most `kept`, none longer than
    `_KEPT_CHARS` characters.

    With the pattern of `public_tokenizers` a single blank between two non-blank characters always starts
    a pre-token, so texts are cut there first and each distinct chunk is split by the pattern once; with
    any other pattern texts go through it whole.  A text with any other blank
    (next to white space, or at an end) goes through the pattern whole.
    """

    def __init__(self, path: str, pattern: str, kept: int = 200_000):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.ids = np.array([-1, *sorted(self.ranks.values())], np.int64)
        self.by_id = {rank: token for token, rank in self.ranks.items()}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.find = regex.compile(pattern).findall
        self.cuts = pattern == _known_pattern()
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.cache: dict[str, bytes | None] = {}
        self.kept = kept

    def _codes(self, words: list[str]) -> list[bytes]:
        """Of pre-tokens, each alone."""
        raw = [w.encode() for w in words]
        coded = self.model.encode([r.decode("latin-1").translate(self.letters) for r in raw], num_threads=1)
        flat = self.ids[[i for pieces in coded for i in pieces]].astype("<u4").tobytes()
        ends = (4 * np.cumsum([len(pieces) for pieces in coded])).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for i, r in enumerate(raw):  # a pre-token that is a token itself is that token
            if len(out[i]) > 4 and (rank := self.ranks.get(r)) is not None:
                out[i] = struct.pack("<I", rank)
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Chunks with a blank before them; None marks one that the fast way can't take."""
        clean = [c for c in chunks if c and not c[0].isspace() and not c[-1].isspace()]
        self.cache.update(dict.fromkeys(chunks))
        parts = [self.find(" " + c) for c in clean]
        words = list({w for ws in parts for w in ws})
        codes = dict(zip(words, self._codes(words), strict=True)) if words else {}
        self.cache.update((c, b"".join([codes[w] for w in ws])) for c, ws in zip(clean, parts, strict=True))

    def encode(self, *texts: str) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if not self.cuts:
            return [b"".join(self._codes(self.find(t))) if t else b"" for t in texts]
        cut = [t.split(" ") for t in texts]
        seen = set().union(*cut)
        missing = seen.difference(self.cache)
        if missing and len(self.cache) + len(missing) > self.kept:
            self.cache.clear()
            missing = seen
        if missing:
            self._learn(list(missing))
        out = []
        for text, chunks in zip(texts, cut, strict=True):
            codes = [self.cache[c] for c in chunks]
            if None in codes or not chunks[0]:
                out.append(b"".join(self._codes(self.find(text))) if text else b"")
            else:
                codes[0] = b"".join(self._codes(self.find(chunks[0])))
                out.append(b"".join(codes))
        for c in missing:
            if len(c) > _KEPT_CHARS:
                self.cache.pop(c, None)
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=1)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, *, path: str = VOCABULARY, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per document row: id, ids array<int> and the decoded text, or with `digests` the
    figures and SHA-256 of both instead.  A null text counts as empty: no ids, empty decoded text;
    repeated rows give repeated results, an empty table none; very long texts go whole; columns but the
    two named are not looked at.
    Narrow: no shuffle; each worker builds the model once from the vocabulary file at `path`."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    at = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", codec.cache_clear)
        c = codec(path, pattern)
        for batch in slices(batches):
            coded = []
            for i in range(0, len(batch), 64):
                coded += c.encode(*(t or "" for t in batch.column(1)[i : i + 64].to_pylist()))
            if digests:
                columns = [
                    pa.array([len(x) // 4 for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                    pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in coded]),
                ]
            else:
                columns = [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in coded], pa.list_(pa.int32())), pa.array([c.decode(x).decode() for x in coded])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["id", "ids", "decoded"])

    kind = at.schema["id"].dataType.simpleString()
    shape = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return at.mapInArrow(run, f"id {kind}, {shape}").withColumnRenamed("id", id_col)
