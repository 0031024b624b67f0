"""WARC: write pages as archives, normalise monolithic gzip archives, read records by their index.

`write_archives` writes each task's records as archives of one gzip stream each, as a whole-file
compressor leaves them.  `normalise` inflates each such stream once, front to back, rewrites every
record as its own gzip member and writes a sidecar index of offsets.  `read_records` seeks by the
index.  Archives roll over at `max_bytes` of content, so a task holds one record, never an archive.
Files get fresh names, and only those that a finished stage lists (a written manifest) are read on,
so a task that runs twice leaves at most an unused file.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:page:"
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)", re.I)


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1))


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record; payload None makes a revisit, whose HTTP header tells the full length."""
    revisit = payload is None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    head = [
        VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        f"WARC-Record-ID: <{RECORD}{'' if page_id is None else page_id}>".encode(), b"WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}".encode(), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block),
    ]
    if url:
        head.append(b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode()))
    if revisit:
        head += [f"WARC-Profile: {REVISIT}".encode(), f"WARC-Refers-To: <{RECORD}{refers_to}>".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers by lower-case name, the HTTP header and the payload of one record; of a record that is no HTTP
    message, no HTTP header and the whole block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    if not headers.get("content-type", "").startswith("application/http"):
        return headers, b"", block
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def described(headers: dict[str, str], http: bytes, payload: bytes, where: str) -> tuple[int, str]:
    """Size and digest of a record's payload: a revisit's from its headers, any other's from its bytes, which must
    agree with the digest and length that the headers give, if they do."""
    length, given = _LENGTH.search(http), headers.get("warc-payload-digest", "").removeprefix("sha256:")
    if headers.get("warc-type") == "revisit":
        return int(length[1]) if length else 0, given
    digest = hashlib.sha256(payload).hexdigest()
    if (re.fullmatch("[0-9a-f]{64}", given) and given != digest) or (length and b"content-encoding" not in http.lower() and headers.get("warc-type") == "response" and int(length[1]) != len(payload)):
        raise ValueError(f"{where}: the payload does not match its digest or length")
    return len(payload), digest


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from pieces of an inflated archive; holds one record and one piece."""
    held, need = bytearray(), 0
    for chunk in chunks:
        held += chunk
        while len(held) >= need:
            if not need:
                if (cut := held.find(b"\r\n\r\n")) < 0:
                    break
                need = cut + 4 + int(_LENGTH.search(held[:cut])[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError(f"an archive ends within a record ({len(held)} bytes left)")


def inflate(file, piece: int = 1 << 20) -> Iterator[bytes]:
    """A gzip file once from front to back, its members one after the other."""
    d, begun = zlib.decompressobj(31), False
    while raw := file.read(piece):
        while raw:
            begun = True
            yield d.decompress(raw, piece)
            raw = d.unconsumed_tail
            if d.eof:
                raw, d, begun = d.unused_data, zlib.decompressobj(31), False
    if begun:
        raise ValueError("an archive ends within a gzip member")


def write_archives(records: DataFrame, folder: str, *, max_bytes: int = 64 << 20) -> DataFrame:
    """Writes (page_id, url, payload, digest, size, refers_to) and returns the manifest (path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        paths, out, held = [], None, 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                data = record(*(x.as_py() for x in row))
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    paths.append(f"{folder}/{name}")
                    out, deflate, held = files.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0
                out.write(deflate.compress(data))
                held += len(data)
                if held >= max_bytes:
                    out.write(deflate.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(deflate.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    shaped = records.select("page_id", "url", "payload", "digest", "size", "refers_to")
    return shaped.mapInArrow(run, "path string")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive of column `path`, a gzip member a record, beside a sidecar index file
    (offset, length and record id a line); returns (path, offsets, lengths)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                theirs, at = _files(source)
                name, offsets, lengths, ids, place = f"{uuid.uuid4().hex}.warc.gz", [], [], [], 0
                with theirs.open_input_stream(at, compression=None) as raw, files.open_output_stream(f"{root}/{name}", compression=None) as out:
                    for data in split_records(inflate(raw)):
                        member = zlib.compressobj(1, zlib.DEFLATED, 31)
                        packed = member.compress(data) + member.flush()
                        out.write(packed)
                        offsets.append(place)
                        lengths.append(len(packed))
                        ids.append(parse(data)[0].get("warc-record-id", "-"))
                        place += len(packed)
                with files.open_output_stream(f"{root}/{name}.idx", compression=None) as index:
                    index.write("".join(f"{o} {n} {i}\n" for o, n, i in zip(offsets, lengths, ids, strict=True)).encode())
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([offsets], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64()))], names=["path", "offsets", "lengths"])

    return archives.select("path").mapInArrow(run, "path string, offsets array<long>, lengths array<long>")


def read_records(index: DataFrame) -> DataFrame:
    """The records of indexed archives: each is sought and inflated alone.  Records of other makers (warcinfo,
    request, responses without a length) are read as well; their page_id is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, at = _files(path)
                rows = []
                with files.open_input_file(at) as f:
                    for offset, length in zip(offsets, lengths, strict=True):
                        f.seek(offset)
                        headers, http, payload = parse(zlib.decompress(f.read(length), 31))
                        size, digest = described(headers, http, payload, f"{path} at {offset}")
                        number = lambda x: int(m[1]) if (m := re.fullmatch(rf"<{RECORD}(-?\d+)>", x)) else None
                        rows.append((number(headers.get("warc-record-id", "")), headers.get("warc-target-uri"), size, digest, headers.get("warc-type"), number(headers.get("warc-refers-to", ""))))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return index.select("path", "offsets", "lengths").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def with_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> DataFrame:
    """Rows to write: of equal payloads of `least` bytes or more the one with the smallest id keeps
    its payload (all rows that share that id do), the others refer to it.  Null html is empty; a
    null id stays null and is never referred to; repeated rows give a record each, under the same record id.
    Very long payloads are whole records, an empty table gives no archive; columns but the three named are
    not looked at.  Digests are summed per task before the shuffle, and
    a payload that many pages hold is a hot join key whose partition Spark splits."""
    at = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    at = at.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    # small payloads have no partner: their key is their own, so that they spread out
    at = at.withColumn("key", F.when(F.col("size") >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    first = at.where(F.col("size") >= least).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("key", "first")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return at.join(first, "key", "left").select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "digest", "size", F.when(again, F.col("first")).alias("refers_to"))


def archive(spark: SparkSession, pages: DataFrame, *, folder: str | None = None, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Writes pages as monolithic archives, normalises them and returns (index, records read back)."""
    folder = folder or new_path(spark, "warc")
    manifest = written(write_archives(with_revisits(pages, **columns), f"{folder}/raw"), "warc-manifest")
    n = max(1, manifest.count())  # a row an archive
    index = written(normalise(manifest.repartition(n), f"{folder}/normal"), "warc-index")
    return index, read_records(index.repartition(n))
