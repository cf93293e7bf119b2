"""Numbering of rows along an order, without one task for a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: A table of starts (a row for each written partition and group in it) is broadcast up to so many rows, else joined.
BROADCAST_ROWS = 20_000


def numbered(rows: DataFrame, order: list[str], group: str | None = None, weight: str | None = None) -> DataFrame:
    """rows with _position (from 0 along the order, nulls first) and _size (number of rows), both within their group; with a
    weight (not null), also _before (sum of the weights of earlier rows) and _total. Columns of these names are replaced.

    Rows are dealt by range over (group, order) and written once, sorted. Only the number of rows (and the weight) of each
    written partition goes through a window, so neither a group with a third of all rows nor one value that many rows
    share is a single task: rows that tie are dealt too, in any order among themselves."""
    tied = rows.drop("_position", "_size", "_before", "_total").withColumns({"_group": F.struct(F.col(group) if group else F.lit(0)), "_tie": F.monotonically_increasing_id()})
    keys = ["_group", *order, "_tie"]
    written = materialize(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).drop("_tie"), "numbered")
    # The upper bits of that number are the partition, the lower ones the row in it.
    held = written.withColumn("_part", F.shiftright("_at", 33))
    sums = {"_n": F.count("*"), "_w": F.sum(F.col(weight).cast("decimal(20,0)")).cast("decimal(38,0)") if weight else F.lit(None).cast("decimal(38,0)")}
    runs = held.groupBy("_part", "_group").agg(F.min("_at").alias("_first"), *[c.alias(k) for k, c in sums.items()])
    whole = Window.partitionBy("_group")
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    since = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    starts = runs.select("_part", "_group", (since("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("_size"), since("_w").cast("decimal(38,0)").alias("_base"), F.sum("_w").over(whole).cast("decimal(38,0)").alias("_total"))
    starts = materialize(starts, "starts")
    if starts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    met = held.join(starts, ["_part", "_group"]).withColumn("_position", F.col("_at") + F.col("_shift"))
    if weight:
        own = F.sum(F.col(weight).cast("decimal(20,0)")).over(Window.partitionBy("_part", "_group").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
        met = met.withColumn("_before", (F.coalesce(own, F.lit(0)) + F.col("_base")).cast("decimal(38,0)"))
    return met.drop("_part", "_group", "_at", "_shift", "_base", *([] if weight else ["_total"]))
