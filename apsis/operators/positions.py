"""Positions: decode, validate, enrich, project. Every operator is a projection or filter and serves streams as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import calendar, orbit


def decode(messages: DataFrame, schema: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON messages: columns of the schema; undecodable messages as (source, reason, raw)."""
    body = F.from_json(F.col(value).cast("string"), f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    # A generator of one row, so that a message is decoded once, however many of its fields are looked at.
    parsed = messages.select("*", F.inline(F.array(F.struct(body.alias("_d")))))
    bad = F.col("_d").isNull() | F.col("_d._bad").isNotNull()
    rejects = parsed.where(bad).select(F.lit("decode").alias("source"), F.lit("malformed JSON").alias("reason"), F.col(value).cast("string").alias("raw"))
    return parsed.where(~bad).select("_d.*").drop("_bad"), rejects


def position_faults() -> Column:
    """What is wrong with a position: an array of reasons."""
    c = F.col
    checks = [
        ("missing satellite_id", c("satellite_id").isNull()),
        ("missing satellite_name", c("satellite_name").isNull()),
        ("latitude out of bounds", ~F.coalesce(c("latitude").between(-90, 90), F.lit(False))),
        ("longitude out of bounds", ~F.coalesce(c("longitude").between(-180, 180), F.lit(False))),
        ("missing timestamp", c("timestamp").isNull()),
    ]
    return F.array_compact(F.array(*[F.when(bad, reason) for reason, bad in checks]))


def validate_positions(positions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with source, reason, raw)."""
    marked = positions.withColumn("_faults", position_faults())
    rejects = marked.where(F.size("_faults") > 0).select(F.lit("position").alias("source"), F.array_join("_faults", "; ").alias("reason"), F.to_json(F.struct(*positions.columns)).alias("raw"))
    return marked.where(F.size("_faults") == 0).drop("_faults"), rejects


def enrich_positions(positions: DataFrame, processing_time: Column | None = None) -> DataFrame:
    """Adds event_time, geo, orbit, lighting, date and processing_time; fills missing altitudes. All native columns."""
    out = positions.withColumn("event_time", F.timestamp_seconds("timestamp")).withColumn("altitude_km", orbit.filled_altitude(F.col("altitude_km")))
    return out.withColumns(
        {
            "geo": orbit.geo(F.col("latitude"), F.col("longitude")),
            "orbit": orbit.orbit(F.col("altitude_km")),
            "lighting": F.struct(orbit.in_sunlight(F.col("latitude"), F.col("longitude"), F.col("timestamp")).alias("in_sunlight")),
            "date": F.to_date("event_time"),
            "processing_time": processing_time if processing_time is not None else F.current_timestamp(),
        }
    )


def to_enriched_message(enriched: DataFrame) -> DataFrame:
    """The nested message form."""
    return enriched.select(
        "satellite_id", "satellite_name", F.struct("latitude", "longitude", "altitude_km").alias("position"), "geo", "orbit", "lighting",
        "timestamp", "source", "ingestion_time", calendar.utc_iso(F.col("processing_time").cast("timestamp")).alias("processing_time"),
    )


def to_archive(enriched: DataFrame) -> DataFrame:
    """The flatter form of the archive, with its partition columns last."""
    return enriched.select("satellite_name", "latitude", "longitude", "altitude_km", "geo", "orbit", "lighting", "timestamp", "source", "ingestion_time", "processing_time", "date", "satellite_id")


def flatten_message(messages: DataFrame) -> DataFrame:
    """Nested messages to flat columns, with event time."""
    return messages.select(
        "satellite_id", "satellite_name", "position.latitude", "position.longitude", "position.altitude_km", "geo.country_code", "geo.country_name", "geo.region", "geo.over_ocean",
        F.col("orbit.type").alias("orbit_type"), "orbit.velocity_km_s", "orbit.period_minutes", "lighting.in_sunlight", "timestamp", "source", F.timestamp_seconds("timestamp").alias("event_time"),
    )


def to_messages(rows: DataFrame, key: str) -> DataFrame:
    """(key, value) messages: the key as text, the row as JSON."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def position_flat(messages: DataFrame) -> DataFrame:
    """Thirteen text fields for serving; absent ones are empty."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    fields = {
        "satellite_id": "satellite_id", "satellite_name": "satellite_name", "latitude": "position.latitude", "longitude": "position.longitude", "altitude_km": "position.altitude_km",
        "country_code": "geo.country_code", "country_name": "geo.country_name", "region": "geo.region", "orbit_type": "orbit.type", "velocity_km_s": "orbit.velocity_km_s",
        "period_minutes": "orbit.period_minutes", "in_sunlight": "lighting.in_sunlight",
    }
    seen = F.coalesce(calendar.utc_text(F.timestamp_seconds("timestamp")), F.lit(""))
    return messages.select(*[text(path).alias(name) for name, path in fields.items()], seen.alias("last_seen"))


def geo_join(points: DataFrame, regions: DataFrame, latitude: str = "latitude", longitude: str = "longitude", cell: float = 10.0) -> DataFrame:
    """points with the first region (least priority) that holds each, by an equality join on grid cells.

    regions: priority, lat_min, lat_max, lon_min, lon_max, code, name, region. Boxes are spread over the cells they touch, and
    each cell is one row with its boxes in order of priority: a point meets one row, so it is neither multiplied nor
    grouped again. Spark broadcasts the cells if it finds them small. Use this for large region tables, orbit.geo for
    small ones. A point that no box holds keeps null region columns.
    """
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell).cast("int"), F.floor(F.col(hi) / cell).cast("int")))
    box = F.struct("priority", "lat_min", "lat_max", "lon_min", "lon_max", "code", "name", "region")
    touched = regions.withColumn("_y", span("lat_min", "lat_max")).withColumn("_x", span("lon_min", "lon_max"))
    cells = touched.groupBy("_y", "_x").agg(F.array_sort(F.collect_list(box)).alias("_boxes"))
    at = lambda c: F.floor(F.col(c) / cell).cast("int")
    keyed = points.withColumn("_y", at(latitude)).withColumn("_x", at(longitude))
    inside = lambda b: F.col(latitude).between(b["lat_min"], b["lat_max"]) & F.col(longitude).between(b["lon_min"], b["lon_max"])
    met = keyed.join(cells, ["_y", "_x"], "left").withColumn("_hit", F.get(F.filter("_boxes", inside), F.lit(0)))
    return met.select(*points.columns, F.col("_hit.code").alias("country_code"), F.col("_hit.name").alias("country_name"), F.col("_hit.region").alias("region"))


def tracked_satellites(lists: DataFrame, catalogue: DataFrame, column: str = "satellites") -> DataFrame:
    """Comma lists of ids to (satellite_id, satellite_name): no numbers are skipped, unknown ones are called SAT-id."""
    ids = lists.select(F.explode(F.split(column, ",")).alias("t")).select(F.trim("t").try_cast("int").alias("satellite_id")).where("satellite_id is not null").distinct()
    return ids.join(catalogue, "satellite_id", "left").select("satellite_id", F.coalesce("satellite_name", calendar.message_key("SAT", F.col("satellite_id"))).alias("satellite_name"))
