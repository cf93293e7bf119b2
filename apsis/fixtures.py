"""Telemetry derived from the `events` table: positions, feed payloads, space-weather payloads and two-line elements.

Everything is a projection of the table, so the work of a query grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from .functions import tle


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with at (a UTC timestamp), seconds and k."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.col("ts").cast("timestamp")
    return table.select("event_id", "user_id", "event_type", "value", at.alias("at"), F.unix_seconds(at).alias("seconds"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """POSITION rows, with event_id to order equal times."""
    c, kind, value = F.col, F.col("event_type"), F.col("value")
    altitude = F.when(kind == "click", 400 + value / 10).when(kind == "purchase", 20000 + value).when(kind == "signup", 35786 + value / 50).when(kind == "view", 36000 + value)
    return events_table(spark, sf_dir).select(
        c("user_id").cast("int").alias("satellite_id"), F.concat(F.lit("SAT-"), c("user_id").cast("string")).alias("satellite_name"),
        (((c("event_id") * 7919) % 18001).cast("double") / 100 - 90).alias("latitude"), (((c("event_id") * 10007) % 36001).cast("double") / 100 - 180).alias("longitude"),
        altitude.alias("altitude_km"), *[F.lit(None).cast("double").alias(n) for n in ("azimuth", "elevation", "ra", "dec")], F.lit(False).alias("eclipsed"),
        c("seconds").alias("timestamp"), F.when(kind == "error", "open-notify").otherwise("n2yo").alias("source"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ingestion_time"), "event_id",
    )


def iss_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-notify answers; those of click events report a failure."""
    p = positions(spark, sf_dir).join(events_table(spark, sf_dir).select("event_id", "event_type"), "event_id")
    body = F.to_json(F.struct(F.when(F.col("event_type") == "click", "failure").otherwise("success").alias("message"), "timestamp", F.struct(F.col("latitude").cast("string").alias("latitude"), F.col("longitude").cast("string").alias("longitude")).alias("iss_position")))
    return p.select("event_id", body.alias("payload"), "ingestion_time")


def n2yo_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-satellite answers; those of open-notify rows have no position."""
    one = F.struct(F.col("latitude").alias("satlatitude"), F.col("longitude").alias("satlongitude"), F.coalesce("altitude_km", F.lit(0.0)).alias("sataltitude"), F.col("eclipsed").alias("eclipsed"), F.col("timestamp").alias("timestamp"))
    several = F.when(F.col("source") == "n2yo", F.array(one)).otherwise(F.array(one).cast("array<struct<satlatitude: double, satlongitude: double, sataltitude: double, eclipsed: boolean, timestamp: bigint>>"))
    several = F.filter(several, lambda x: F.col("source") == "n2yo")
    body = F.to_json(F.struct(F.struct(F.concat(F.lit("  "), F.col("satellite_name"), F.lit(" ")).alias("satname"), F.col("satellite_id").alias("satid")).alias("info"), several.alias("positions")))
    return positions(spark, sf_dir).select("satellite_id", F.lit("unnamed").alias("default_name"), body.alias("payload"), "ingestion_time")


EVENT_TYPE = {"error": "FLR", "purchase": "CME", "signup": "GST", "click": "HSS", "view": "IPS"}


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Space-weather answers; one hour long. View events are IPS, which have no id of their own."""
    kind = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in EVENT_TYPE.items()])
    own = F.concat(F.lit("ID-"), F.col("event_id").cast("string"))
    fields = {"FLR": "flrID", "CME": "activityID", "GST": "gstID", "HSS": "hssID"}
    iso = lambda at: F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    letter = F.element_at(F.array(*[F.lit(x) for x in "ABCMX"]), F.col("k") % 5 + 1)
    body = F.struct(
        *[F.when(F.col("event_kind") == name, own).alias(key) for name, key in fields.items()],
        iso(F.col("at")).alias("startTime"), iso(F.col("at") + F.expr("interval 1 hour")).alias("endTime"), F.lit("").alias("sourceLocation"), F.col("event_id").alias("activeRegionNum"),
        F.when(F.col("event_kind") == "FLR", F.concat(letter, F.lit("1.2"))).alias("classType"),
        F.when(F.col("event_kind") == "GST", F.array(F.struct((F.col("k") % 10).cast("double").alias("kpIndex")), F.struct(F.lit(0.0).alias("kpIndex")))).alias("allKpIndex"),
        F.when(F.col("event_kind") == "CME", F.array(F.struct((F.col("value") * 6).alias("speed")))).alias("cmeAnalyses"),
        F.array(F.struct(F.lit("").alias("displayName"), F.lit("SDO").alias("instrumentType")), F.struct(F.lit("GOES").alias("displayName"), F.lit(None).cast("string").alias("instrumentType"))).alias("instruments"),
        F.array(F.struct(F.lit("L-1").alias("activityID"))).alias("linkedEvents"), F.lit("M2M_CATALOG").alias("catalog"),
    )
    return events_table(spark, sf_dir).withColumn("event_kind", kind).select(F.col("event_kind").alias("event_type"), F.to_json(body).alias("payload"), iso(F.col("at")).alias("ingestion_time"))


def tle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One two-line element set per event, with right checksums."""
    e = events_table(spark, sf_dir)
    number = F.lpad((F.col("user_id") % 100000).cast("string"), 5, "0")
    fraction = F.substring(F.format_string("%.8f", F.pmod(F.col("seconds"), F.lit(86400)) / 86400), 2, 9)
    epoch = F.concat(F.date_format("at", "yy"), F.lpad(F.dayofyear("at").cast("string"), 3, "0"), fraction)
    angle = lambda m: F.format_string("%8.4f", (F.col("event_id") * m % 36000) / F.lit(100.0))
    one = F.concat(F.lit("1 "), number, F.lit("U 98067A   "), epoch, F.lit("  .00001000  00000-0  10270-3 0  999"))
    two = F.concat(F.lit("2 "), number, F.lit(" "), F.format_string("%8.4f", 51 + F.col("k") / 100), F.lit(" "), angle(7), F.lit(" "), F.lpad((F.col("event_id") % 9999).cast("string"), 7, "0"), F.lit(" "), angle(11), F.lit(" "), angle(13), F.lit(" "), F.format_string("%11.8f", 15 + F.col("k") / 1000), F.lpad((F.col("event_id") % 99999).cast("string"), 5, " "))  # noqa: E501
    # A generator of one row, so that the checksums look at finished lines.
    lines = e.select("user_id", "at", "event_type", epoch.alias("epoch"), F.inline(F.array(F.struct(one.alias("one"), two.alias("two")))))
    closed = lambda line: F.concat(line, tle.checksum(F.col(line)).cast("string"))
    return lines.select(
        F.col("user_id").cast("int").alias("satellite_id"), F.concat(F.lit("SAT-"), F.col("user_id").cast("string")).alias("satellite_name"), closed("one").alias("tle_line1"), closed("two").alias("tle_line2"),
        "epoch", F.lit("tle-api").alias("source"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ingestion_time"), "event_type",
    )


def region_table(spark: SparkSession) -> DataFrame:
    """The region list as a small dimension table."""
    return spark.createDataFrame([(k, *map(float, r[:4]), *r[4:]) for k, r in enumerate(S.GEO_REGIONS)], "priority int, lat_min double, lat_max double, lon_min double, lon_max double, code string, name string, region string")
