"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evtrail.scratch import drop_written, new_path, written

__all__ = ["SPACES", "SPACE_RUN", "bucket_of", "claim", "drop_written", "let", "new_path", "release", "slices", "table", "written"]

#: White space between words: the six ASCII white-space characters, as bytes.split() cuts them.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % modulus


def let(value: Column, body) -> Column:
    """body(v) with value computed once a row: a lambda body would compute it for each element."""
    return F.transform(F.array(value), body)[0]


def slices(batches: Iterator, rows: int = 500) -> Iterator:
    """Record batches cut small, so that what a task makes of one stays small whatever Spark sends."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


_held: dict[str, tuple[Callable[[], object], ...]] = {}


def claim(owner: str, *clear: Callable[[], object]) -> None:
    """Called in tasks, at the start of an operator's work: drops what other operators keep in this Python
    worker, which Spark uses again for later stages, and gives the memory back.  `clear` drops what the
    caller will keep."""
    others = [f for name, fs in _held.items() if name != owner for f in fs]
    if others:
        for f in others:
            f()
        _held.clear()
        release()
    _held[owner] = clear


def release() -> None:
    """Gives back the memory of what this Python worker has dropped."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library
