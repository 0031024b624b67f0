"""Order-preserving packing into batches under a token target.

The fold is sequential within a group, as each batch begins where the one before ends.  Rows are
sorted by group and place within their partition and pass by once, with the state of the fold carried
on from batch to batch: no task holds a group.  The estimate is taken of the summed character
counts, as it is not additive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evtrail.functions.text import WHITE, clean_text, let, tokens_of_counts


def estimate(ascii_chars: int, other_chars: int, base: int) -> int:
    """tokens_of_counts() for numbers."""
    return max(1, (ascii_chars * 5 + 11) // 12 + other_chars + base)


def fold_rows(df: DataFrame, group: tuple[str, ...], order: tuple[str, ...], make: Callable[[], Callable], adds: str) -> DataFrame:
    """df with the columns `adds`: make() begins a group and returns the step, which takes a row (a named
    tuple) and returns its values."""
    names, rows = df.columns, df.repartition(*group).sortWithinPartitions(*group, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, step = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                row = dict(zip(names, row, strict=True))
                key = tuple(str(row[g]) for g in group)
                if key != last:
                    last, step = key, make()
                out.append(step(row))
            added = [x.split(" ")[0] for x in adds.split(", ")]
            yield pd.concat([batch, pd.DataFrame(out, columns=added, index=batch.index)], axis=1)

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + adds)


def pack(df: DataFrame, group: tuple[str, ...], order: str, ascii_chars: str, other_chars: str, target: int, max_rows: int = 1 << 30, base: int = 200) -> DataFrame:
    """Adds batch (from 1) and oversized: a row alone that is over the target."""

    def make() -> Callable:
        a = x = n = batch = 0

        def step(row: dict) -> tuple[int, bool]:
            nonlocal a, x, n, batch
            ra, rx = int(row[ascii_chars]), int(row[other_chars])
            if n and n < max_rows and estimate(a + ra, x + rx, base) <= target:
                a, x, n = a + ra, x + rx, n + 1
            else:
                a, x, n, batch = ra, rx, 1, batch + 1
            return batch, estimate(ra, rx, base) > target

        return step

    rows = df.select(*group, F.col(order).cast("long").alias(order), F.col(ascii_chars).cast("long").alias(ascii_chars), F.col(other_chars).cast("long").alias(other_chars))
    return fold_rows(rows, group, (order, ascii_chars, other_chars), make, "batch long, oversized boolean")


def shard_content(text: Column, limit: int, marks: str = "。！？!?;；\n.") -> Column:
    """Pieces of at most `limit` characters; a cut goes behind the last sentence mark of the second half."""
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length(text) / (limit / 2)).cast("int")))

    def step(s: Column, _: Column) -> Column:
        def cut(piece: Column) -> Column:
            back = F.regexp_extract(F.substring(piece, limit // 2 + 1, limit), rf"(?s)^(.*[{marks}])", 1)
            n = F.when(F.length(s["rest"]) <= limit, F.length(s["rest"])).when(F.length(back) > 0, limit // 2 + F.length(back)).otherwise(limit)
            done = F.length(s["rest"]) == 0
            return F.struct(F.substring(s["rest"], n + 1, F.length(s["rest"])).alias("rest"), F.when(done, s["out"]).otherwise(F.concat(s["out"], F.array(F.substring(s["rest"], F.lit(1), n)))).alias("out"))

        return let(F.substring(s["rest"], 1, limit), cut)

    zero = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(steps, zero, step)["out"]


_SENTENCE = r"(?s).+?(?:[。！？!?；;]+|\n+|$)"


def excerpt(text: Column, limit: int, gap: str = "...") -> Column:
    """Whole sentences from both ends of a text that is over the limit: half of what is left beside the gap
    for the head, the rest for the tail; characters where no sentence fits."""
    room = limit - len(gap)

    def first_fitting(parts: Column, budget: Column) -> Column:
        """How many parts fit, each on a line, and how many characters they take."""

        def step(s: Column, p: Column) -> Column:
            n = s["n"] + F.length(p) + F.when(s["k"] > 0, 1).otherwise(0)
            fits = s["open"] & (n <= budget)
            return F.struct(F.when(fits, n).otherwise(s["n"]).alias("n"), F.when(fits, s["k"] + 1).otherwise(s["k"]).alias("k"), fits.alias("open"))

        return F.aggregate(parts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(True).alias("open")), step)

    def of(t: Column) -> Column:
        parts = F.filter(F.transform(F.regexp_extract_all(t, F.lit(_SENTENCE), F.lit(0)), clean_text), lambda p: p != "")

        def cut(p: Column) -> Column:
            head = first_fitting(p, F.lit(room // 2))
            return let(head, lambda h: let(F.reverse(F.slice(p, h["k"] + 1, F.greatest(F.size(p) - h["k"], F.lit(0)))), lambda rest: let(first_fitting(rest, room - h["n"]), lambda e: F.concat(
                F.array_join(F.slice(p, F.lit(1), h["k"]), "\n"), F.lit(gap), F.array_join(F.reverse(F.slice(rest, F.lit(1), e["k"])), "\n")))))

        ends = F.concat(F.rtrim(F.left(t, F.lit(room // 2)), F.lit(WHITE)), F.lit(gap), F.ltrim(F.right(t, F.lit(room - room // 2)), F.lit(WHITE)))
        whole = let(let(parts, cut), lambda x: F.when((x != gap) & (F.length(x) <= limit), x).otherwise(F.left(ends, F.lit(limit))))
        return F.when(F.length(t) <= limit, t).otherwise(whole)

    if limit <= len(gap):
        return F.left(clean_text(text), F.lit(max(limit, 0)))
    return let(clean_text(text), of)


def pack_components(rows: DataFrame, group: tuple[str, ...], target: int, base: int = 200) -> DataFrame:
    """Packs whole components in the order of their first row; one over the target goes by its locked sets (column
    locked, if there; null for none), and a locked set over the target, like a row in none, row by row.

    rows: the group columns, pos, component, ascii, other; adds batch."""
    from pyspark.sql import Window

    def over(w) -> Column:
        return tokens_of_counts(F.sum("ascii").over(w), F.sum("other").over(w), base) > target

    w, part = Window.partitionBy(*group, "component"), F.col("pos")
    if "locked" in rows.columns:
        v = Window.partitionBy(*group, "component", "locked")
        part = F.when(F.col("locked").isNull() | over(v), F.col("pos")).otherwise(F.min("pos").over(v))
    at = rows.withColumn("unit", F.when(over(w), part).otherwise(F.min("pos").over(w)))
    units = at.groupBy(*group, "unit").agg(F.sum("ascii").alias("ascii"), F.sum("other").alias("other"))
    packed = pack(units, group, "unit", "ascii", "other", target, base=base).select(*group, "unit", "batch")
    return at.join(packed, [*group, "unit"]).drop("unit")
