"""Scalar text functions as column expressions (no shuffle, no Python)."""

from __future__ import annotations

import html
import html.entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that results depend on.
URL = r"https?://[^\s)>\]]+"
URL_TRAILING_TAGS = r"(?:</?[A-Za-z][^>]*)+$"
URL_TRAILING_MARKS = r"[)>\]}\"'，。！？、；;]+$"
FINAL_MA = "(?m)妈([\"'”’」』）)\\]】》>\\s。！？；!?;….]*)$"
FILE_NAME_MARKS = r"[\\/:*?\"<>|\r\n]+"
PUNCTUATION = "[\\s，。！？、,.!?:：；;（）()【】\\[\\]《》<>\"'“”‘’`~\\-_/]+"
#: A character reference with its semicolon, its name as the group.
REFERENCE = re.compile(r"&(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|([A-Za-z][A-Za-z0-9]*;))")
DOC_HOSTS = ("feishu", "larksuite")
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SECRET_PARAMETERS = ("token", "access_token", "key", "secret", "signature", "ticket", "code")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(v) with value computed once a row and its code generated once."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column | str) -> Column:
    """Unicode white space off both ends, by the native trim."""
    return F.btrim(_c(c), F.lit(WHITE))


def clean_text(c: Column | str) -> Column:
    """Line ends to \\n, trailing white space off each line, a sentence-final particle mended, ends stripped."""
    lines = F.regexp_replace(strip(c), r"\R", "\n")
    lines = F.regexp_replace(lines, r"(?U)(?<![^\S\n])[^\S\n]++\n", "\n")
    return strip(F.regexp_replace(lines, FINAL_MA, "吗$1"))


def collapse(c: Column | str) -> Column:
    """Runs of white space to one blank."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def compact(c: Column | str, strip_punct: bool = False) -> Column:
    """Lower case of the clean text; without white space and punctuation on request."""
    text = clean_text(c)
    return F.lower(F.regexp_replace(text, PUNCTUATION, "") if strip_punct else text)


def extract_urls(c: Column | str) -> Column:
    """Distinct URLs in order, without trailing tags and punctuation."""
    found = F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(URL), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, trim_url), lambda u: u != ""))


def trim_url(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, URL_TRAILING_TAGS, ""), URL_TRAILING_MARKS, "")


def link_type(url: Column | str) -> Column:
    host = F.lower(F.coalesce(F.try_parse_url(_c(url), F.lit("HOST")), F.lit("")))
    doc = F.lit(False)
    for h in DOC_HOSTS:
        doc = doc | host.contains(h)
    return F.when(doc, "doc").otherwise("normal")


def normalize_url(url: Column | str) -> Column:
    """Lower-case scheme and authority, the path or /, no query and fragment; '' if not a full URL."""
    u = strip(url)
    part = lambda n: F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)", n)
    path = F.when(part(3) == "", "/").otherwise(part(3))
    return F.when(part(1) == "", "").otherwise(F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path))


def dedupe_paragraphs(c: Column | str) -> Column:
    parts = F.transform(F.split(F.coalesce(_c(c), F.lit("")), r"\n\s*\n"), clean_text)
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), "\n\n")


def combine_titles(titles: Column | str) -> Column:
    clean = F.transform(_c(titles), clean_text)
    return F.array_join(F.array_distinct(F.filter(clean, lambda t: t != "")), "；")


def output_name(day: Column, owner: Column | str, merged: Column | bool = False, extension: str = "md") -> Column:
    """Name of a day's file: date, safe owner name and, of a merged one, the mark."""
    mark = F.when(merged if isinstance(merged, Column) else F.lit(merged), "-merged").otherwise("")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("-"), safe_file_name(owner), mark, F.lit(f".{extension}"))


def format_time(ts: Column, pattern: str = "HH:mm") -> Column:
    return F.coalesce(F.date_format(ts, pattern), F.lit(""))


def safe_file_name(c: Column | str) -> Column:
    name = F.regexp_replace(F.regexp_replace(strip(c), FILE_NAME_MARKS, "_"), r"\s+", "_")
    return F.regexp_replace(name, r"^[ ._]+|[ ._]+$", "")


def ascii_count(c: Column | str) -> Column:
    return F.length(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"[^\x00-\x7F]", ""))


def tokens_of_counts(ascii_chars: Column, other_chars: Column, base: int = 200) -> Column:
    """The estimate is not additive over rows: sum the counts, then apply it once."""
    return F.greatest(F.lit(1), F.floor((ascii_chars * 5 + 11) / 12) + other_chars + base).cast("long")


def estimate_tokens(c: Column | str) -> Column:
    a = ascii_count(c)
    return tokens_of_counts(a, F.length(F.coalesce(_c(c), F.lit(""))) - a)


def trim_text(c: Column | str, n: int, tail: str = "...") -> Column:
    """The clean text, or its first n characters without white space behind them, and the tail."""
    return let(clean_text(c), lambda t: F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(n)), F.lit(WHITE)), F.lit(tail))))


def preview(c: Column | str, limit: int = 400) -> Column:
    """What a relation shows of a text: 120 characters at most."""
    return trim_text(c, min(limit, 120))


def redact_query(url: Column | str, names: tuple[str, ...] = SECRET_PARAMETERS) -> Column:
    return F.regexp_replace(_c(url), rf"(?i)([?&](?:{'|'.join(names)})=)[^&#]*", "$1***")


def redact_ids(c: Column | str, pattern: str = r"\b(?:ou|oc|om|on)_[0-9a-zA-Z]{8,}\b", mark: str = "[id]") -> Column:
    return F.regexp_replace(_c(c), pattern, mark)


def ratio(n: Column, d: Column) -> Column:
    return F.when(d <= 0, F.lit(0.0)).otherwise(F.bround(n / d, 4))


def conversation_mode(c: Column | str) -> Column:
    mode = F.lower(strip(c))
    return F.when(mode.isin("p2p", "group", "topic"), mode).otherwise("")


def doc_token(url: Column | str) -> Column:
    """The last path part of 6 letters or more, by which a document link is known."""
    return F.regexp_extract(normalize_url(url), r"/([A-Za-z0-9_-]{6,})/?$", 1)


def link_tokens(title: Column | str, url: Column | str, stop: tuple[str, ...] = ("http", "https", "www", "com", "docs", "wiki")) -> Column:
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", _c(title), doc_token(url))), F.lit(r"([\p{L}\p{N}_-]{2,})"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*stop)))


def unescape(c: Column | str, closed: bool = False) -> Column:
    """Character references back to characters, as HTML names and numbers them; Python has the table, batch by batch.

    HTML also reads some names without a semicolon (&amp as &), `closed` leaves these as they are."""

    def one(m: re.Match) -> str:
        return html.unescape(m[0]) if m[1] is None or m[1] in html.entities.html5 else m[0]

    @F.pandas_udf("string")
    def back(texts: pd.Series) -> pd.Series:
        return texts.map((lambda t: REFERENCE.sub(one, t)) if closed else html.unescape, na_action="ignore")

    c = _c(c)
    return F.when(c.contains("&"), back(c)).otherwise(c)


def markup_to_text(c: Column | str, closed: bool = False) -> Column:
    """Text of HTML or XML: scripts and styles out, tags to blanks, character references back."""
    text = F.regexp_replace(_c(c), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return collapse(unescape(text, closed))


def markup_title(c: Column | str, closed: bool = False) -> Column:
    return collapse(unescape(F.regexp_extract(_c(c), r"(?is)<title[^>]*>(.*?)</title>", 1), closed))


def contains_any(c: Column, keywords: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for k in keywords:
        found = found | c.contains(k)
    return found


def file_name_parts(c: Column | str) -> Column:
    """Date, owner and merged flag of a log file name such as 2026-07-10-name-merged.md."""
    stem = F.regexp_replace(_c(c), r"\.[^.]*$", "")
    day = F.regexp_extract(stem, r"(?<!\d)(\d{4}-\d{2}-\d{2})(?!\d)", 1)
    rest = F.regexp_replace(stem, r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)", " ")
    merged = rest.rlike(r"(?i)(?:^|[-_\s])merged(?:$|[-_\s])")
    owner = F.regexp_replace(rest, r"(?i)(?:^|[-_\s])merged(?=$|[-_\s])", " ")
    return F.struct(day.alias("day"), F.regexp_replace(owner, r"^[-_\s]+|[-_\s]+$", "").alias("owner"), merged.alias("merged"))


def front_matter(c: Column | str) -> Column:
    """key: value lines between the first two --- lines, as a map."""
    block = F.regexp_extract(_c(c), r"(?s)\A---\n(.*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)), strip(F.regexp_replace(x, r"^[^:]*:", "")))))
