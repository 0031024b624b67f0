"""Numbers over a whole table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtrail.scratch import written


#: So many values of `within` go out whole.
MAX_STARTS = 10_000


def numbered(df: DataFrame, order: list[str], name: str, within: list[str] | None = None) -> DataFrame:
    """df with `name`, from 1 by `order`, beginning anew with each value of `within`.

    Rows are dealt into sorted ranges and written; what a range begins with is the sum of the ranges before
    it, which takes one row a range, and what a value of `within` begins with is its smallest number."""
    keys = [*(within or []), *order]
    at = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    at = written(at, "numbered").withColumn("_range", F.shiftright("_at", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = at.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = at.join(F.broadcast(ranges), "_range").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1)
    if within:
        start = written(at.groupBy(*within).agg((F.min(name) - 1).alias("_start")), "numbered-starts")
        # few starts go out whole, else the join would shuffle all rows
        at = at.join(F.broadcast(start) if start.limit(MAX_STARTS + 1).count() <= MAX_STARTS else start, within).withColumn(name, F.col(name) - F.col("_start")).drop("_start")
    return at.drop("_range", "_at", "_before")


def scanned(df: DataFrame, order: list[str], within: list[str], rank: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """df with its number from 1 by `order` in each value of `within`, and for each name of `sums` the sum of the column over
    the rows up to and with this one.

    As numbered(), for values of `within` that hold very many rows: sorted ranges are written, each (range, value) is
    counted and summed in its rows, and what comes before it is the sum over the ranges before, one row a range and value."""
    sums = sums or {}
    at = df.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order).withColumn("_at", F.monotonically_increasing_id())
    at = written(at, "scanned").withColumn("_range", F.shiftright("_at", 33))
    total = at.groupBy("_range", *within).agg(F.count("*").alias("_count"), *(F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c)
    total = total.select(F.col("_range").alias("_r"), *(F.col(c).alias(f"_by{i}") for i, c in enumerate(within)), *(earlier(c) for c in ("_count", *(f"_sum_{name}" for name in sums))))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    own = Window.partitionBy("_range", *within).orderBy("_at")
    at = at.withColumn(rank, F.row_number().over(own)).withColumns({name: F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, 0)) for name, c in sums.items()})
    at = at.join(total, same)
    return at.select(*df.columns, (F.col(rank) + F.col("_count")).alias(rank), *((F.coalesce(name, F.lit(0)) + F.col(f"_sum_{name}")).alias(name) for name in sums))
