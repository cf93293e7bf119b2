"""Rows beside their predecessors along a track, without one task per track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(rows: DataFrame, key: str, order: list[str], carried: list[str], chunk: Column, name: str = "previous") -> DataFrame:
    """rows with a struct of the carried columns of the row before (by order, within a key); null for a key's first row.

    A track is cut into chunks (a column that never falls along the order, such as an hour), so that a key with very
    many rows is many tasks. Only the last row of each chunk goes to the next one, by a join on chunks; `rows` is read twice."""
    row = F.struct(*carried)
    # As structs, nulls are equal to each other, in the window and in the join alike.
    keyed = rows.withColumn("_key", F.struct(key)).withColumn("_chunk", F.struct(chunk.alias("c")))
    last = keyed.groupBy("_key", "_chunk").agg(F.max_by(row, F.struct(*order)).alias("_last"))
    edges = last.select("_key", "_chunk", F.lag("_last").over(Window.partitionBy("_key").orderBy("_chunk")).alias("_edge"))
    own = F.lag(row).over(Window.partitionBy("_key", "_chunk").orderBy(*order))
    met = keyed.withColumn("_own", own).join(edges, ["_key", "_chunk"])
    return met.withColumn(name, F.coalesce("_own", "_edge")).drop("_own", "_edge", "_key", "_chunk")
