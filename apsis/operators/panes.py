"""Sliding statistics from panes: every row goes to one slide-long pane, and windows are put together from panes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S

_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}


def seconds(duration: str) -> int:
    """Seconds of a duration such as "10 seconds" or "2 days"."""
    found = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day|week)s?\s*", duration)
    if not found or not int(found[1]):
        raise ValueError(f"not a duration of whole seconds: {duration}")
    return int(found[1]) * _SECONDS[found[2]]


#: Speeds count in whole millimetres a second: sums of whole numbers are exact up to 2 ** 53, in whatever order they are taken.
UNITS = 1_000_000
_EXPECTED = round(S.EXPECTED_VELOCITY_KM_S * UNITS)


def partials() -> list[Column]:
    """Mergeable figures of a pane. Squares are of the distance from the expected speed, so that they keep their digits. The first and the last
    speed and the times are for windows of three speeds (figures)."""
    velocity = F.col("velocity_km_s")
    off = F.rint(velocity * UNITS) - _EXPECTED
    at = F.when(velocity.isNotNull(), F.unix_seconds("event_time"))
    return [
        F.count("*").alias("samples"), F.count("altitude_km").alias("_altitudes"), F.sum("altitude_km").alias("_altitude"), F.min("altitude_km").alias("min_altitude"), F.max("altitude_km").alias("max_altitude"),
        F.count(velocity).alias("_velocities"), F.sum(off).alias("_off"), F.sum(off * off).alias("_squares"), F.min(velocity).alias("_slowest"), F.max(velocity).alias("_fastest"),
        F.min(at).alias("_since"), F.max(at).alias("_until"), F.sum(at).alias("_times"), F.min_by(off, at).alias("_first"), F.max_by(off, at).alias("_last"),
    ]


def _merged() -> list[Column]:
    total = lambda c: F.sum(c).alias(c)
    return [
        total("samples"), total("_altitudes"), total("_altitude"), F.min("min_altitude").alias("min_altitude"), F.max("max_altitude").alias("max_altitude"),
        total("_velocities"), total("_off"), total("_squares"), F.min("_slowest").alias("_slowest"), F.max("_fastest").alias("_fastest"),
        F.min("_since").alias("_since"), F.max("_until").alias("_until"), total("_times"), F.min_by("_first", "_since").alias("_first"), F.max_by("_last", "_until").alias("_last"),
    ]


def _three_in_order() -> tuple[Column, Column, Column]:
    """(whether a window has three speeds at three times, their mean, their spread), both running, in order of time. The one between is
    what the sums leave. Three speeds in equal steps can lie exactly two deviations off, where the order in which a sum is
    rounded decides: it is the SQL's, that of the rows, however they are dealt."""
    between = F.col("_times") - F.col("_since") - F.col("_until")
    known = (F.col("samples") == 3) & (F.col("_velocities") == 3) & (F.col("_since") < between) & (between < F.col("_until"))
    a, b, c = ((off + _EXPECTED) / UNITS for off in (F.col("_first"), F.col("_off") - F.col("_first") - F.col("_last"), F.col("_last")))
    two = a + (b - a) / 2
    three = two + (c - two) / 3
    return F.coalesce(known, F.lit(False)), (a + b + c) / 3, F.sqrt(((b - two) * (b - a) + (c - three) * (c - two)) / 2)


def figures(*keys: Column | str) -> list[Column | str]:
    """The columns of sliding statistics from merged figures. Equal speeds have a spread of exactly 0, whatever was rounded. in_order: whether
    mean and spread are those of three speeds in order of time."""
    n = F.col("_velocities")
    known, mean, running = _three_in_order()
    spread = F.when(known, running).otherwise(F.sqrt(F.greatest(F.col("_squares") - F.col("_off") * F.col("_off") / n, F.lit(0.0)) / (n - 1)) / UNITS)
    return [
        *keys, (F.col("_altitude") / F.col("_altitudes")).alias("avg_altitude"), "min_altitude", "max_altitude", F.when(known, mean).otherwise((F.col("_off") / n + _EXPECTED) / UNITS).alias("avg_velocity"),
        F.when(n > 1, F.when(F.col("_slowest") == F.col("_fastest"), 0.0).otherwise(spread)).alias("stddev_velocity"), "samples", known.alias("in_order"),
    ]


def pane_stats(flat: DataFrame, slide: str = "10 seconds", watermark: str | None = None) -> DataFrame:
    """Partial figures of every satellite and slide-long pane that has rows: one row in, no row out but a pane's. They can be stored and merged later."""
    rows = flat.withWatermark("event_time", watermark) if watermark else flat
    return rows.groupBy(F.window("event_time", slide).alias("pane"), "satellite_id", "satellite_name").agg(*partials())


def sliding_panes(flat: DataFrame, size: str = "60 seconds", slide: str = "10 seconds", watermark: str | None = None) -> DataFrame:
    """The rows of anomaly.sliding_stats, for a size that is a multiple of the slide.

    Rows are aggregated into panes before anything is repeated. A table's panes go by (satellite, chunk of time) to one task,
    those at a chunk's beginning to the chunk before as well, and are repeated by window only there: how many rows are
    shuffled does not depend on size / slide. On a stream (with a watermark) windows of panes are a second stateful
    aggregation behind the first; rows have one entry of state, and windows are fed by panes."""
    per = seconds(size) // seconds(slide)
    if seconds(size) % seconds(slide):
        raise ValueError("the size must be a multiple of the slide")
    panes = pane_stats(flat, slide, watermark)
    keys = ["satellite_id", "satellite_name"]
    if watermark or flat.isStreaming:
        merged = panes.groupBy(F.window(F.window_time("pane"), size, slide), *keys).agg(*_merged())
        return merged.select(*figures("window", *keys))
    step, reach = seconds(slide), seconds(size) - seconds(slide)
    chunk = 64 * per * step
    start = F.unix_seconds("pane.start")
    of = lambda at: F.floor(at / chunk)
    spread = panes.withColumn("_at", start).withColumn("_chunk", F.explode(F.array_distinct(F.array(of(start), of(start - reach)))))
    dealt = spread.repartition(*keys, "_chunk")
    begins = F.filter(F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda k: F.col("_at") - k * step), lambda w: of(w) == F.col("_chunk"))
    merged = dealt.withColumn("_begin", F.explode(begins)).groupBy(*keys, "_chunk", "_begin").agg(*_merged())
    window = F.struct(F.timestamp_seconds("_begin").alias("start"), F.timestamp_seconds(F.col("_begin") + seconds(size)).alias("end")).alias("window")
    return merged.select(*figures(window, *keys))
