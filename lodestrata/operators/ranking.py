"""Row numbers over a whole table without putting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import cut


def numbered(rows: DataFrame, *order: str | Column, name: str = "n") -> DataFrame:
    """The rows with their place in an order, from 1: rows are dealt out by ranges of it, and a
    row's place is its place in its range after the sizes of those before.  Ties are numbered in
    any way, within a range."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    held = cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = held.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__range", before.alias("__before"))  # one row for each range
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return held.withColumn("__place", place).join(F.broadcast(starts), "__range").withColumn(name, F.col("__before") + F.col("__place")).drop("__range", "__before", "__place")
