"""A row's place in a stated order, as a column that survives shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written


def ordinal(rows: DataFrame, *order: str | Column, into: str = "ordinal") -> DataFrame:
    """rows with their place (from 0) in the order of columns; rows that tie in all of them are placed in any order.

    Rows are dealt in ranges, sorted and written with their place in the range; counts of the ranges tell where each starts, so only these are gathered. Names that rows
    have may not begin with _at or _range.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "ordered").withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", (before - F.col("_first")).alias("_start"))
    return placed.join(starts, "_range").withColumn(into, (F.col("_at") + F.col("_start")).cast("long")).drop("_at", "_range", "_start")
