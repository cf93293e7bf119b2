"""Alerts joined with space weather, both as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import anomaly, intervals


def correlated(alerts: DataFrame, events: DataFrame, hours: int = 72, longest: str = "30 days", alerts_late: str = "2 hours", events_late: str = "2 hours") -> DataFrame:
    """SPACE_WEATHER_CORRELATION alerts of a stream of alerts (window, satellite_id, satellite_name) and one of severe events
    (event_id, severity, start_time, end_time as texts), each pair once, whichever comes first.

    The join is on cells of time and on the event's span. Both sides have a watermark, and no event is taken to last beyond
    `longest` (it is cut there), so Spark drops an alert's state when no event of its time can come any more, and an event's
    when its alerts have all come. A repeated event id counts once within the look-back of its watermark; an alert's window counts
    once for each satellite."""
    level = F.when(F.col("_severity") == "extreme", "CRITICAL").otherwise("WARNING")
    severe = events.where(F.col("severity").isin(*S.SEVERE) & F.col("event_id").isNotNull()).select(
        F.col("event_id").alias("_event"), F.col("severity").alias("_severity"), F.try_to_timestamp("start_time").alias("_from"), F.try_to_timestamp("end_time").alias("_to")
    )
    once = severe.where("_from is not null").withWatermark("_from", events_late).dropDuplicatesWithinWatermark(["_event"])
    last = F.least(F.coalesce("_to", F.col("_from") + F.make_interval(hours=F.lit(hours))), F.col("_from") + F.expr(f"interval {longest}"))
    spans = once.withColumn("_last", last).withColumn("_cell", F.explode(intervals.cells(F.col("_from"), F.col("_last"))))
    seconds = int(alerts.sparkSession.sql(f"SELECT unix_seconds(timestamp_seconds(0) + interval {longest})").first()[0])
    levels = list(range((seconds // intervals.GRANULE + 2).bit_length() + 1))
    # Windows end after they start; the join needs the start as the time of the watermark.
    windows = alerts.select("satellite_id", "satellite_name", "window", F.col("window.start").alias("_at")).withWatermark("_at", alerts_late)
    seen = windows.dropDuplicatesWithinWatermark(["satellite_id", "_at"]).withColumn("_cell", F.explode(intervals.cells_of_point(F.col("_at"), levels)))
    cell = lambda side, of: F.concat_ws(":", F.col("_cell.level"), F.col("_cell.cell")).alias(side)
    a = seen.select("satellite_id", "satellite_name", "window", "_at", cell("_a", seen))
    b = spans.select("_event", "_severity", "_from", "_last", cell("_b", spans))
    bounds = F.expr(f"_a = _b AND _at >= _from AND _at <= _last AND _at <= _from + interval {longest}")
    return a.join(b, bounds).select(
        anomaly.alert_id(F.concat_ws("|", F.lit("SPACE_WEATHER_CORRELATION"), "_event"), F.col("satellite_id"), F.col("window.start").cast("string")).alias("alert_id"),
        F.lit("SPACE_WEATHER_CORRELATION").alias("alert_type"), level.alias("severity"), "satellite_id", "satellite_name", F.col("_event").alias("event_id"), "_at",
    )
