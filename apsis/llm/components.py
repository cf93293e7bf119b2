"""Connected components of a link table in DataFrame functions: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b. Links neighbours of a node to its least neighbour (or to itself if less): those above it in a
    large step, itself and those below it in a small one. The neighbours of a hub are dealt over salts."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        both = beside(both, "u", "v", m=("min", F.least("u", "v")))
        linked = both.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        both = beside(both, "u", "v", m=("min", F.col("v")))
        linked = both.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return linked.where("a <> b")


def _settled(edges: DataFrame) -> bool:
    """Whether the links are stars already: each upper end has one link, and no lower end is an upper one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
    each = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("low"))
    return each.where("up > 1 or (up > 0 and low = 0)").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: a, b (any order, not null). Per node that has a link: node, label (the least node of its component).

    Every round writes its links; it ends when all are stars (a logarithmic number of rounds)."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        if _settled(now):
            nodes = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
            return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        now = materialize(_star(_star(now, large=True), large=False).distinct(), "links")
    raise RuntimeError("components did not settle")
