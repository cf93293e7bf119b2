"""Feed payloads (a `payload` JSON column and an `ingestion_time`) to canonical rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import calendar, events, tle


def _decoded(payloads: DataFrame, schema: str) -> DataFrame:
    """payloads with p, the decoded payload. A generator of one row, so that it is decoded once, however often p is used."""
    body = F.from_json("payload", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return payloads.select("*", F.inline(F.array(F.struct(body.alias("p")))))


def _parsed(payloads: DataFrame, schema: str) -> DataFrame:
    return _decoded(payloads, schema).where(F.col("p").isNotNull() & F.col("p._bad").isNull())


def rejected(payloads: DataFrame, feed: str) -> DataFrame:
    """The payloads of a feed (iss, n2yo, donki, tle) that its normaliser leaves out because they are no JSON of its kind:
    source, reason, raw."""
    schema = {"iss": S.ISS_PAYLOAD, "n2yo": S.N2YO_PAYLOAD, "donki": S.DONKI_PAYLOAD, "tle": S.TLE_PAYLOAD}[feed]
    bad = _decoded(payloads, schema).where(F.col("p").isNull() | F.col("p._bad").isNotNull())
    return bad.select(F.lit(feed).alias("source"), F.when(F.col("payload").isNull(), "no payload").otherwise("malformed JSON").alias("reason"), F.col("payload").alias("raw"))


def _position(**given: Column) -> list[Column]:
    """The columns of POSITION, null where nothing is given."""
    columns = [c.split(" ") for c in S.POSITION.split(", ")]
    return [(given.get(name, F.lit(None)).cast(kind)).alias(name) for name, kind in columns]


def normalize_iss(payloads: DataFrame) -> DataFrame:
    """Only successful answers; the coordinates come as texts."""
    p = F.col("p")
    return _parsed(payloads, S.ISS_PAYLOAD).where(p["message"] == "success").select(
        *_position(
            satellite_id=F.lit(25544), satellite_name=F.lit("ISS"), latitude=p["iss_position"]["latitude"].try_cast("double"), longitude=p["iss_position"]["longitude"].try_cast("double"),
            timestamp=p["timestamp"], source=F.lit("open-notify"), ingestion_time=F.col("ingestion_time"),
        )
    )


def normalize_n2yo(payloads: DataFrame) -> DataFrame:
    """The first position of an answer; payloads has satellite_id and default_name too. An altitude of 0 is unknown."""
    first = F.get(F.col("p.positions"), F.lit(0))
    return _parsed(payloads, S.N2YO_PAYLOAD).withColumn("f", first).where(F.col("f").isNotNull()).select(
        *_position(
            satellite_id=F.col("satellite_id"), satellite_name=F.coalesce(events.some(F.trim("p.info.satname")), F.col("default_name")), latitude=F.col("f.satlatitude"), longitude=F.col("f.satlongitude"),
            altitude_km=F.nullif(F.col("f.sataltitude"), F.lit(0.0)), azimuth=F.col("f.azimuth"), elevation=F.col("f.elevation"), ra=F.col("f.ra"), dec=F.col("f.dec"),
            eclipsed=F.coalesce("f.eclipsed", F.lit(False)), timestamp=F.col("f.timestamp"), source=F.lit("n2yo"), ingestion_time=F.col("ingestion_time"),
        )
    )


def normalize_events(payloads: DataFrame) -> DataFrame:
    """payloads has event_type too. The full payload is kept as raw_data."""
    p, kind = F.col("p"), F.col("event_type")
    return _parsed(payloads, S.DONKI_PAYLOAD).select(
        events.event_id(kind, p).alias("event_id"),
        kind,
        F.coalesce(events.some(p["startTime"]), events.some(p["beginTime"])).alias("start_time"),
        events.some(p["peakTime"]).alias("peak_time"),
        events.some(p["endTime"]).alias("end_time"),
        F.coalesce(events.some(p["sourceLocation"]), p["activeRegionNum"].cast("string")).alias("source_location"),
        events.instruments(p).alias("instruments"),
        events.linked_events(p).alias("linked_events"),
        events.severity(kind, p).alias("severity"),
        F.coalesce(events.some(p["note"]), events.some(p["catalog"])).alias("note"),
        F.col("payload").alias("raw_data"),
        F.lit("donki").alias("source"),
        "ingestion_time",
    )


def normalize_tle(payloads: DataFrame) -> DataFrame:
    """payloads has satellite_id and default_name too; rows with an empty line are dropped. Epochs are cut to seconds."""
    one, two = F.trim("p.line1"), F.trim("p.line2")
    epoch = calendar.utc_iso(tle.epoch_timestamp(F.substring(one, 19, 14)))
    return _parsed(payloads, S.TLE_PAYLOAD).where((one != "") & (two != "")).select(
        "satellite_id", F.coalesce(events.some(F.trim("p.name")), F.col("default_name")).alias("satellite_name"), one.alias("tle_line1"), two.alias("tle_line2"), epoch.alias("epoch"), F.lit("tle-api").alias("source"), "ingestion_time"
    )


def unify_positions(*feeds: DataFrame) -> DataFrame:
    """Several position feeds as one table; columns that a feed lacks are null."""
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out
