"""Identifiers and fingerprints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_url, strip


def stable_event_id(date: Column, ids: Column, content: Column) -> Column:
    """First 16 hex digits of the SHA-1 of date, comma-joined ids and content, joined by |."""
    return F.substring(F.sha1(F.concat_ws("|", date, F.array_join(ids, ","), content)), 1, 16)


def fingerprint(namespace: str, c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(f"{namespace}:"), c), 256))


def evidence_fingerprint(message_id: Column) -> Column:
    return fingerprint("evtrail:evidence:v1", message_id)


def conversation_fingerprint(date: Column, conversation_id: Column) -> Column:
    d, c = strip(date), strip(conversation_id)
    return F.when((d == "") | (c == ""), "").otherwise(fingerprint("evtrail:conversation:v1", F.concat_ws(":", d, c)))


def file_key(url: Column) -> Column:
    u = normalize_url(url)
    return F.when(u == "", "").otherwise(fingerprint("evtrail:file-url:v1", u))


def attachment_key(attachment_id: Column) -> Column:
    a = strip(attachment_id)
    return F.when(a == "", "").otherwise(fingerprint("evtrail:attachment:v1", a))


def is_fingerprint(c: Column) -> Column:
    return c.rlike("^sha256:[0-9a-f]{64}$")


def content_fingerprint(*fields: Column) -> Column:
    return fingerprint("evtrail:event-content:v1", F.to_json(F.struct(*fields)))
