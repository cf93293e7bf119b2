"""Keyed views: what a hot store would hold, as queries over tables. `now` is a parameter, so a view is repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S


def alive(at: Column, now: Column, ttl: str) -> Column:
    return at >= now - F.expr(f"interval {ttl}")


def with_ids(messages: DataFrame) -> DataFrame:
    """Messages whose id and name may come under either spelling (satellite_id or satelliteId, satellite_name or
    satelliteName): both under the first, those without any id left out. An id of 0 or an empty name counts as none."""
    out = messages
    for name, alias in (("satellite_id", "satelliteId"), ("satellite_name", "satelliteName")):
        given = [F.when(F.col(c).cast("string").isin("", "0"), None).otherwise(F.col(c)) for c in (name, alias) if c in messages.columns]
        if given:
            out = out.withColumn(name, F.coalesce(*given)).drop(alias)
    return out.where(F.col("satellite_id").isNotNull())


def latest_position(flat: DataFrame, now: Column, ttl: str = S.POSITION_TTL, tie: str | None = None) -> DataFrame:
    """The latest row per satellite, if it is younger than the time to live. Aggregates; no sort."""
    rows = flat.where(F.col("satellite_id").isNotNull() & alive(F.col("event_time"), now, ttl) & (F.col("event_time") <= now))
    return rows.groupBy("satellite_id").agg(F.max_by(F.struct(*[c for c in flat.columns if c != "satellite_id"]), F.struct("event_time", *([tie] if tie else []))).alias("r")).select("satellite_id", "r.*")


def satellite_metadata(rows: DataFrame, now: Column, fields: list[str], ttl: str = S.META_TTL, tie: str | None = None) -> DataFrame:
    """Per satellite the last value of each field that is not null, and last_seen."""
    order = F.struct("event_time", *([tie] if tie else []))
    kept = rows.where(F.col("satellite_id").isNotNull() & alive(F.col("event_time"), now, ttl) & (F.col("event_time") <= now))
    return kept.groupBy("satellite_id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields], F.max("event_time").alias("last_seen"))


def satellites(metadata: DataFrame, live: DataFrame) -> DataFrame:
    """Every known satellite with its live position, if it has one."""
    return metadata.join(live, "satellite_id", "left")


def recent_alerts(alerts: DataFrame, now: Column, per_satellite: int = S.ALERTS_PER_SATELLITE, ttl: str = S.ALERT_TTL) -> DataFrame:
    """The last alerts of each satellite, newest first by rank. alerts: detected_time (timestamp), alert_id, ..."""
    rank = F.row_number().over(Window.partitionBy("satellite_id").orderBy(F.desc("detected_time"), "alert_id"))
    rows = alerts.where(F.col("alert_id").isNotNull() & F.col("satellite_id").isNotNull() & alive(F.col("detected_time"), now, ttl) & (F.col("detected_time") <= now))
    return rows.withColumn("rank", rank).where(F.col("rank") <= per_satellite)


def alert_details(ids: DataFrame, alerts: DataFrame) -> DataFrame:
    """Details of listed ids; missing ones are skipped."""
    return ids.join(alerts, "alert_id")


def newest(rows: DataFrame, by: str, tie: str, n: int = S.RECENT) -> DataFrame:
    """The n newest rows of a table: a top-k, never a whole sort."""
    if not 1 <= n <= 100_000:
        raise ValueError("n must be between 1 and 100000")
    return rows.orderBy(F.desc_nulls_last(by), tie).limit(n)


def active_events(events: DataFrame, now: Column, ttl: str = S.EVENT_TTL) -> DataFrame:
    """Events ingested within the time to live, each id once (the latest ingestion). events: ingested (timestamp)."""
    rows = events.where(F.col("event_id").isNotNull() & alive(F.col("ingested"), now, ttl) & (F.col("ingested") <= now))
    order = F.struct("ingested", "start_time")
    return rows.groupBy("event_id").agg(F.max_by(F.struct(*[c for c in events.columns if c != "event_id"]), order).alias("r")).select("event_id", "r.*")


def listed_events(active: DataFrame) -> DataFrame:
    """Active events as a list shows them: the latest start first, ties by id; those without a start last."""
    return active.orderBy(F.desc_nulls_last("start_time"), "event_id")


def active_count(events: DataFrame, now: Column) -> DataFrame:
    return active_events(events, now).agg(F.count("*").alias("active_events"))


def first_seen(events: DataFrame) -> DataFrame:
    """One row per event id over overlapping polls: the earliest ingestion."""
    rest = [c for c in events.columns if c != "event_id"]
    return events.where("event_id is not null").groupBy("event_id").agg(F.min_by(F.struct(*rest), F.struct("ingestion_time", F.to_json(F.struct(*rest)))).alias("r")).select("event_id", "r.*")


def merged_position(live: DataFrame, batch: DataFrame) -> DataFrame:
    """The live row of each satellite, else its latest batch row; both have the same columns."""
    columns = [c for c in live.columns if c != "satellite_id"]
    a = live.select("satellite_id", F.struct(*columns).alias("_live"))
    b = batch.select("satellite_id", F.struct(*columns).alias("_batch"))
    both = a.join(b, "satellite_id", "full_outer").withColumn("_r", F.coalesce("_live", "_batch"))
    return both.select("satellite_id", "_r.*", F.when(F.col("_live").isNotNull(), "live").otherwise("batch").alias("layer"))


def display(rows: DataFrame, drop: list[str] | None = None, rename: dict[str, str] | None = None, times: list[str] | None = None) -> DataFrame:
    """A table for display: columns dropped, renamed, texts turned into times."""
    out = rows.drop(*(drop or []))
    for name in times or []:
        out = out.withColumn(name, F.try_to_timestamp(name))
    return out.withColumnsRenamed(rename or {})
