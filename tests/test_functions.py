"""Golden values of the column functions."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from apsis.functions import calendar, events, orbit, tle
from apsis import schemas as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("altitude", "kind"), [(None, "LEO"), (-5.0, "LEO"), (0.0, "LEO"), (1999.9, "LEO"), (2000.0, "MEO"), (35785.9, "MEO"), (35786.0, "GEO"), (35800.0, "GEO"), (35800.1, "HEO")])
def test_orbit_type(spark, altitude, kind):
    assert one(spark, orbit.orbit_type(F.lit(altitude).cast("double"))) == kind


def test_velocity_and_period_of_the_default_altitude(spark):
    assert one(spark, orbit.velocity_km_s(F.lit(None).cast("double"))) == 7.668
    assert one(spark, orbit.period_minutes(F.lit(408.0))) == pytest.approx(92.57, abs=0.02)


@pytest.mark.parametrize(("lat", "lon", "code"), [(40.0, 30.0, "EU"), (40.0, 42.0, "TR"), (35.0, 128.0, "CN"), (35.0, 140.0, "JP"), (None, 1.0, "??"), (0.0, -150.0, "--"), (36.0, 40.0, "EU")])
def test_geo_takes_the_first_region(spark, lat, lon, code):
    found = one(spark, orbit.geo(F.lit(lat).cast("double"), F.lit(lon).cast("double")))
    assert found["country_code"] == code
    assert found["over_ocean"] == (code in ("??", "--"))


def test_sunlight(spark):
    noon = int(dt.datetime(2024, 6, 21, 12, tzinfo=dt.UTC).timestamp())
    assert one(spark, orbit.in_sunlight(F.lit(0.0), F.lit(0.0), F.lit(noon))) is True
    assert one(spark, orbit.in_sunlight(F.lit(0.0), F.lit(180.0), F.lit(noon))) is False
    assert one(spark, orbit.in_sunlight(F.lit(None).cast("double"), F.lit(0.0), F.lit(noon))) is True


@pytest.mark.parametrize(("text", "value"), [(" 10270-3", 1.027e-4), ("-11606-4", -1.1606e-5), (" 00000-0", 0.0), ("        ", 0.0), ("-", 0.0), (" 12345", 0.12345)])
def test_packed_decimal(spark, text, value):
    assert one(spark, tle.packed_decimal(F.lit(text))) == pytest.approx(value, rel=1e-12)


def test_epochs(spark):
    at = one(spark, tle.epoch_timestamp(F.lit("24015.45678901")))
    assert at == dt.datetime(2024, 1, 15, 10, 57, 46, 570464)
    assert one(spark, F.year(tle.epoch_timestamp(F.lit("57001.0")))) == 1957
    assert one(spark, F.year(tle.epoch_timestamp(F.lit("56001.0")))) == 2056
    assert one(spark, tle.epoch_timestamp(F.lit("xx"))) is None


def test_checksum_counts_digits_and_minus_signs(spark):
    line = "1 25544U 98067A   08264.51782528 -.00002182  00000-0 -11606-4 0  2927"
    assert one(spark, tle.checksum(F.lit(line))) == 7
    assert one(spark, tle.right_checksum(F.lit(line))) is True


def payload(spark, kind, body):
    return spark.createDataFrame([(kind, body)], "kind string, body string").select("kind", F.from_json("body", S.DONKI_PAYLOAD).alias("p"))


@pytest.mark.parametrize(
    ("kind", "body", "level"),
    [
        ("FLR", '{"classType": " m1.2"}', "high"), ("FLR", '{"classType": "X9"}', "extreme"), ("FLR", '{"classType": "B5"}', "low"), ("FLR", "{}", "low"), ("FLR", '{"classType": "C1"}', "moderate"),
        ("GST", '{"allKpIndex": []}', "low"), ("GST", '{"allKpIndex": [{"kpIndex": 4.67}]}', "moderate"), ("GST", '{"allKpIndex": [{"kpIndex": 5}]}', "high"), ("GST", '{"allKpIndex": [{"kpIndex": 7}]}', "extreme"),
        ("CME", "{}", "low"), ("CME", '{"cmeAnalyses": [{"speed": 499}, {"speed": 500}]}', "moderate"), ("CME", '{"cmeAnalyses": [{"speed": 1000}]}', "high"), ("CME", '{"cmeAnalyses": [{"speed": 2000}]}', "extreme"), ("HSS", "{}", "unknown"),
    ],
)
def test_severity(spark, kind, body, level):
    assert payload(spark, kind, body).select(events.severity(F.col("kind"), F.col("p")).alias("s")).first()["s"] == level


def test_event_ids(spark):
    rows = payload(spark, "IPS", "{}").select(events.event_id(F.col("kind"), F.col("p")).alias("i"))
    assert rows.first()["i"] == "IPS-115e55cf9c6c"
    rows = payload(spark, "FLR", '{"flrID": "F-1"}').select(events.event_id(F.col("kind"), F.col("p")).alias("i"))
    assert rows.first()["i"] == "F-1"


@pytest.mark.parametrize(("day", "label", "monday", "sunday"), [("2024-12-30", "2025-01", "2024-12-30", "2025-01-05"), ("2024-01-17", "2024-03", "2024-01-15", "2024-01-21"), ("2024-01-01", "2024-01", "2024-01-01", "2024-01-07"), ("2024-06-15", "2024-24", "2024-06-10", "2024-06-16")])
def test_iso_week(spark, day, label, monday, sunday):
    week = one(spark, calendar.iso_week(F.lit(day).cast("date")))
    assert (week["label"], str(week["monday"]), str(week["sunday"])) == (label, monday, sunday)


def test_text_helpers(spark):
    assert [one(spark, calendar.numeric_id(F.lit(x))) for x in ("25544", "x1", "")] == [25544, None, None]
    assert one(spark, calendar.message_key("SAT", F.lit(7))) == "SAT-7"
    assert one(spark, calendar.shortened(F.lit("x" * 600))) == "x" * 500
    assert one(spark, calendar.utc_text(F.lit("2024-01-02 03:04:05").cast("timestamp"))) == "2024-01-02 03:04:05 UTC"
