"""Sliding statistics, the two anomaly rules, and their relation to space weather. Batch and stream share the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import calendar
from . import intervals, panes

DETAILS = "average double, spread double, low double, high double, samples bigint, z_score double, event_id string"
EVENTS_PER_BLOCK, SATELLITE_PARTS = 1000, 8


def sliding_stats(flat: DataFrame, size: str = "60 seconds", slide: str = "10 seconds", watermark: str | None = None) -> DataFrame:
    """Per window and satellite: altitude and velocity statistics. flat: event_time, satellite_id, satellite_name,
    altitude_km, velocity_km_s. A watermark makes it a bounded stream. Speeds are summed as whole numbers: how the
    rows are dealt moves no window over a limit, their order none but one of three speeds, and equal speeds have no spread."""
    rows = flat.withWatermark("event_time", watermark) if watermark else flat
    keys = ["window", "satellite_id", "satellite_name"]
    return rows.groupBy(F.window("event_time", size, slide), *keys[1:]).agg(*panes.partials()).select(*panes.figures(*keys))


def expected_velocity(mode: str) -> Column:
    """The constant of the rule, or the circular speed at the window's mean altitude."""
    if mode == "constant":
        return F.lit(S.EXPECTED_VELOCITY_KM_S)
    return F.sqrt(F.lit(S.EARTH_GM) / ((F.lit(S.EARTH_RADIUS_KM) + F.col("avg_altitude")) * 1000)) / 1000


def z_score(mode: str, in_order: Column | None = None) -> Column:
    """in_order: whether the window's figures were taken in order of time (panes.figures), rounded as the SQL's."""
    distance = F.abs(F.col("avg_velocity") - expected_velocity(mode))
    # Others are without the last digits of the subtraction, so that a mean at exactly the limit is not beyond it.
    exact = F.round(distance, 12)
    return F.try_divide(exact if in_order is None else F.when(in_order, distance).otherwise(exact), F.col("stddev_velocity"))


def velocity_rule(mode: str = "constant", sigma: float = S.VELOCITY_SIGMA, in_order: Column | None = None) -> Column:
    """Null-safe: fewer than three samples, no spread or a zero one never alerts."""
    return F.coalesce((F.col("samples") >= S.MIN_SAMPLES) & (z_score(mode, in_order) > sigma), F.lit(False))


def altitude_rule(limit: float = S.ALTITUDE_RANGE_KM) -> Column:
    return F.coalesce((F.col("samples") >= S.MIN_SAMPLES) & (F.col("max_altitude") - F.col("min_altitude") > limit), F.lit(False))


def alert_id(kind: Column | str, satellite: Column, start: Column) -> Column:
    """The same alert has the same id on every evaluation and replay."""
    return F.sha2(F.concat_ws("|", F.lit(kind) if isinstance(kind, str) else kind, satellite.cast("string"), start.cast("string")), 256)


def _details(**given: Column) -> Column:
    parts = [p.split(" ") for p in DETAILS.split(", ")]
    return F.struct(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in parts])


def detect_anomalies(stats: DataFrame, expected: str = "constant", detected_at: Column | None = None) -> DataFrame:
    """Alerts of both rules from one aggregation (one state store on a stream): each window gives at most two rows."""
    spread = F.col("max_altitude") - F.col("min_altitude")
    in_order = F.col("in_order") if "in_order" in stats.columns else None
    fast = velocity_rule(expected, in_order=in_order)
    velocity = F.struct(
        F.lit("VELOCITY_ANOMALY").alias("alert_type"), F.lit("WARNING").alias("severity"),
        _details(average=F.col("avg_velocity"), spread=F.col("stddev_velocity"), samples=F.col("samples"), z_score=F.round(z_score(expected, in_order), 2)).alias("details"),
    )
    altitude = F.struct(
        F.lit("ALTITUDE_ANOMALY").alias("alert_type"), F.when(spread < S.ALTITUDE_CRITICAL_KM, "WARNING").otherwise("CRITICAL").alias("severity"),
        _details(average=F.col("avg_altitude"), spread=spread, low=F.col("min_altitude"), high=F.col("max_altitude"), samples=F.col("samples")).alias("details"),
    )
    found = F.array_compact(F.array(F.when(fast, velocity), F.when(altitude_rule(), altitude)))
    rows = stats.where(fast | altitude_rule()).withColumn("a", F.explode(found))
    at = detected_at if detected_at is not None else F.current_timestamp()
    return rows.select(
        alert_id(F.col("a.alert_type"), F.col("satellite_id"), F.col("window.start")).alias("alert_id"), "a.alert_type", "a.severity", "satellite_id", "satellite_name",
        calendar.utc_iso(at).alias("detected_at"), "a.details", F.lit("anomaly-detection").alias("source"), "window",
    )


def severe_events(events: DataFrame) -> DataFrame:
    """High and extreme events, each id once: that with the earliest ingestion. Only the columns that correlation needs."""
    severe = events.select("event_id", "severity", "start_time", "end_time", "ingestion_time").where(F.col("severity").isin(*S.SEVERE) & F.col("event_id").isNotNull())
    row = F.struct(*severe.columns)
    return severe.groupBy("event_id").agg(F.min_by(row, F.struct("ingestion_time", "start_time")).alias("e")).select("e.*")


def _spans(events: DataFrame, hours: int) -> DataFrame:
    """Severe events as _event, _severity, _from and _last: the end or, without one, so many hours after the start."""
    severe = severe_events(events).select(F.col("event_id").alias("_event"), F.col("severity").alias("_severity"), F.try_to_timestamp("start_time").alias("_from"), F.try_to_timestamp("end_time").alias("_to"))
    return severe.select("_event", "_severity", "_from", F.coalesce("_to", F.col("_from") + F.make_interval(hours=F.lit(hours))).alias("_last"))


def correlate_space_weather(alerts: DataFrame, events: DataFrame, mode: str = "all", hours: int = 72, detected_at: Column | None = None, max_events: int | None = None) -> DataFrame:
    """SPACE_WEATHER_CORRELATION alerts for alerting satellites.

    mode "all": every severe event with every alerting satellite, whatever the time, for any number of either. Events are
    dealt by hash into blocks of about EVENTS_PER_BLOCK and satellites into SATELLITE_PARTS parts; a join on both
    numbers brings each pair together once. Only a caller's own max_events raises an error, when there are more.
    mode "overlap": events active at the time of an alert's window (an event covers start to end, or `hours` after its start),
    by an equality join on dyadic cells of time: an event has twice the logarithm of its length as rows at most, so one that
    ends in the year 9999 is no burden.
    """
    severe = _spans(events, hours)
    level = F.when(F.col("_severity") == "extreme", "CRITICAL").otherwise("WARNING")
    at = detected_at if detected_at is not None else F.current_timestamp()
    if mode == "all":
        count = severe.count()
        if max_events is not None and count > max_events:
            raise ValueError(f"over {max_events} severe events; use mode='overlap'")
        blocks = max(1, -(-count // EVENTS_PER_BLOCK))
        dealt = lambda n, *keys: F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        sats = alerts.select("satellite_id", "satellite_name").distinct().withColumn("_part", dealt(SATELLITE_PARTS, "satellite_id", "satellite_name")).withColumn("_block", every(blocks))
        blocked = severe.withColumn("_block", dealt(blocks, "_event")).withColumn("_part", every(SATELLITE_PARTS))
        met = sats.join(blocked, ["_block", "_part"]).withColumn("window", F.lit(None).cast("struct<start: timestamp, end: timestamp>"))
    else:
        sats = alerts.select("satellite_id", "satellite_name", "window", F.col("window.start").alias("_at")).distinct()
        met = intervals.within(sats, "_at", severe, "_from", "_last")
    return met.select(
        alert_id(F.concat_ws("|", F.lit("SPACE_WEATHER_CORRELATION"), "_event"), F.col("satellite_id"), F.coalesce(F.col("window.start").cast("string"), F.lit(""))).alias("alert_id"),
        F.lit("SPACE_WEATHER_CORRELATION").alias("alert_type"), level.alias("severity"), "satellite_id", "satellite_name", calendar.utc_iso(at).alias("detected_at"),
        _details(event_id=F.col("_event")).alias("details"), F.lit("anomaly-detection").alias("source"), "window",
    )


def _level(severity: str) -> Column:
    return F.when(F.col(severity) == "extreme", "CRITICAL").otherwise("WARNING").alias("severity")


def count_space_weather(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """How many correlations of mode "all" each satellite and severity has: satellites and events are counted apart, and no pair
    is made."""
    counts = severe_events(events).groupBy(_level("severity")).agg(F.count("*").alias("_events"))
    names = alerts.select("satellite_id", "satellite_name").distinct().groupBy("satellite_id").agg(F.count("*").alias("_names"))
    return names.crossJoin(F.broadcast(counts)).select("satellite_id", "severity", (F.col("_names") * F.col("_events")).alias("correlations"))


def count_overlaps(points: DataFrame, spans: DataFrame) -> DataFrame:
    """How many pairs of a point and a span that holds it each satellite and severity has, and with how many spans it meets at all,
    without making the pairs.

    points: satellite_id, _at, _times (how many windows begin then). spans: each once, with _severity, _from, _last. Spans meet the distinct times of
    points, not the points, and become counts by the time they hold and the first time of all that they hold: a span is new to a satellite at the
    first of its own times in the span, which is where its time before comes before the span's first."""
    times = points.select("_at").distinct()
    held = intervals.within(times, "_at", spans.withColumn("_span", F.monotonically_increasing_id()), "_from", "_last")
    return count_held(points, held.select("_span", _level("_severity"), "_at"))


def count_held(points: DataFrame, held: DataFrame) -> DataFrame:
    """The same from what spans (_span, severity) hold which of the times of points (_at), each once."""
    first = held.withColumn("_first", F.min("_at").over(Window.partitionBy("_span")))
    counts = first.groupBy("_at", "_first", "severity").agg(F.count("*").alias("_n"))
    before = F.lag("_at").over(Window.partitionBy("satellite_id").orderBy("_at"))
    met = points.withColumn("_before", before).join(counts, "_at")
    new = F.when(F.col("_before").isNull() | (F.col("_before") < F.col("_first")), F.col("_n")).otherwise(0)
    return met.groupBy("satellite_id", "severity").agg(F.sum(F.col("_times") * F.col("_n")).alias("correlations"), F.sum(new).alias("events"))


def weather_by_window(alerts: DataFrame, events: DataFrame, hours: int = 72) -> DataFrame:
    """The correlations of mode "overlap" without a row for every satellite: window, event_id, severity, for each window of alerts and each
    event active when it begins. What alerts in a window correlates with all of its events, so a join on `window` gives every pair."""
    windows = alerts.select("window", F.col("window.start").alias("_at")).distinct()
    met = intervals.within(windows, "_at", _spans(events, hours), "_from", "_last")
    return met.select("window", F.col("_event").alias("event_id"), _level("_severity"))


def count_by_window(alerts: DataFrame, weather: DataFrame) -> DataFrame:
    """How many pairs the rows of weather_by_window stand for, of each satellite and severity, without making them."""
    counts = weather.groupBy("window", "severity").agg(F.count_distinct("event_id").alias("_n"))
    windows = alerts.select("satellite_id", "satellite_name", "window").distinct()
    return windows.join(counts, "window").groupBy("satellite_id", "severity").agg(F.sum("_n").alias("correlations"))


def count_overlapping_weather(alerts: DataFrame, events: DataFrame, hours: int = 72) -> DataFrame:
    """How many correlations of mode "overlap" each satellite and severity has, and with how many events."""
    spans = _spans(events, hours).select("_severity", "_from", "_last")
    windows = alerts.select("satellite_id", "satellite_name", "window").distinct()
    points = windows.groupBy("satellite_id", F.col("window.start").alias("_at")).agg(F.count("*").alias("_times"))
    return count_overlaps(points, spans)


def all_alerts(*branches: DataFrame) -> DataFrame:
    """A bag union of alert branches, matched by name."""
    out = branches[0]
    for branch in branches[1:]:
        out = out.unionByName(branch)
    return out
