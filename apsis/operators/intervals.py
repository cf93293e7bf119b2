"""Points against intervals by equality on dyadic cells: lengths of 2 ** level granules, each inside one of the level above."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of the smallest cell, and the highest level: 2 ** 30 granules are over 139,000 years.
GRANULE, TOP_LEVEL = 4096, 30


def _granule(at: Column) -> Column:
    return F.floor(F.unix_seconds(at) / GRANULE)


def cells(first: Column, last: Column, top: int = TOP_LEVEL) -> Column:
    """The least cells (level, cell) that cover the time from first to last: at most two a level, so that a span has as many as its
    logarithm. Empty where last comes before first or either is null. Cells are a superset: the times are to be compared too."""
    lo, hi = _granule(first), _granule(last) + 1

    def on(k: Column) -> Column:
        # A cover from below: at each level an odd left end and an odd right end stick out of what the level above can take.
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        left, right = F.ceil(lo / size), F.floor(hi / size)
        whole = F.struct(k.alias("level"), left.alias("cell"), right.alias("end"))
        return F.when(left < right, F.array(whole))

    def odd(c: Column) -> Column:
        return F.pmod(c, F.lit(2)) == 1

    def cut(w: Column) -> Column:
        cell = lambda at: F.struct(w["level"].alias("level"), at.alias("cell"))
        inner = F.array_compact(F.array(F.when(odd(w["cell"]), cell(w["cell"])), F.when(odd(w["end"]), cell(w["end"] - 1))))
        # The top level takes all that is left of it.
        rest = F.transform(F.sequence(w["cell"], w["end"] - 1), cell)
        return F.when(w["level"] == top, rest).otherwise(inner)

    found = F.transform(F.flatten(F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(top)), on))), cut)
    return F.when(first <= last, F.flatten(found)).otherwise(F.array().cast("array<struct<level: int, cell: bigint>>"))


def cells_of_point(at: Column, levels: list[int]) -> Column:
    """The cell of a time on each of the levels."""
    return F.transform(F.array(*[F.lit(k) for k in levels]), lambda k: F.struct(k.alias("level"), F.floor(_granule(at) / F.call_function("shiftleft", F.lit(1).cast("bigint"), k)).alias("cell")))


def within(points: DataFrame, at: str, spans: DataFrame, first: str, last: str) -> DataFrame:
    """Pairs of a point and a span that holds it, ends included. Which levels the spans use (at most 31 numbers) is asked first, so
    points meet no level in vain. An endless span costs what a short one does, and no pair is met twice, as the cells of a span
    do not overlap. Column names of the two sides must differ."""
    covered = spans.where(F.col(first).isNotNull() & F.col(last).isNotNull()).withColumn("_cell", F.explode(cells(F.col(first), F.col(last))))
    levels = sorted(r[0] for r in covered.select("_cell.level").distinct().collect())
    if not levels:
        levels = [0]
    placed = points.where(F.col(at).isNotNull()).withColumn("_cell", F.explode(cells_of_point(F.col(at), levels)))
    return placed.join(covered, "_cell").where(F.col(at).between(F.col(first), F.col(last))).drop("_cell")
