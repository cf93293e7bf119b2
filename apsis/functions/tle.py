"""Two-line element fields as column expressions over the two lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def field(line: Column, place: tuple[int, int]) -> Column:
    return F.trim(F.substring(line, *place))


def checksum(line: Column) -> Column:
    """Digits of the first 68 characters, each minus sign as 1, modulo 10."""
    body = F.substring(line, 1, S.TLE_LENGTH - 1)
    # Each digit as the sum of its binary places: how often those with a place occur is what leaving them out takes away.
    places = {1: "13579-", 2: "2367", 4: "4567", 8: "89"}
    times = [value * (F.length(body) - F.length(F.translate(body, digits, ""))) for value, digits in places.items()]
    return sum(times[1:], times[0]) % 10


def right_checksum(line: Column) -> Column:
    return F.coalesce(checksum(line) == field(line, S.TLE_LINE1["checksum"]).try_cast("int"), F.lit(False))


def epoch_timestamp(text: Column) -> Column:
    """`YYDDD.ffffffff`: years below 57 are in this century. Microseconds, rounded half to even. Null if it is no number."""
    year = F.substring(text, 1, 2).try_cast("int")
    whole = F.substring_index(F.substring(F.trim(text), 3, 12), ".", 1).try_cast("int")
    fraction = F.coalesce(F.concat(F.lit("0."), F.nullif(F.regexp_extract(text, r"\.([0-9]+)", 1), F.lit(""))).try_cast("double"), F.lit(0.0))
    start = F.make_date(F.when(year < 57, year + 2000).otherwise(year + 1900), F.lit(1), F.lit(1))
    micros = F.unix_micros(F.date_add(start, whole - 1).cast("timestamp")) + F.rint(fraction * 86_400_000_000).cast("bigint")
    return F.timestamp_micros(micros)


def packed_decimal(text: Column) -> Column:
    """`+-XXXXX+-Y` as 0.XXXXX * 10^Y; blank or a sign alone is 0."""
    t = F.trim(text)
    sign = F.when(t.startswith("-"), -1.0).otherwise(1.0)
    parts = r"^[+-]?\s*([0-9.]+)(?:([+-][0-9]+))?$"
    digits = F.regexp_extract(t, parts, 1)
    power = F.coalesce(F.nullif(F.regexp_extract(t, parts, 2), F.lit("")).try_cast("int"), F.lit(0))
    value = sign * F.concat(F.lit("0."), F.nullif(digits, F.lit(""))).try_cast("double") * F.pow(F.lit(10.0), power)
    return F.when(t.isin("", "+", "-"), 0.0).otherwise(value)


def elements(line1: Column, line2: Column) -> dict[str, Column]:
    """All elements by name; a field that is no number gives null."""
    one, two = lambda k: field(line1, S.TLE_LINE1[k]), lambda k: field(line2, S.TLE_LINE2[k])
    number = lambda c: c.try_cast("double")
    epoch = epoch_timestamp(F.concat(F.substring(line1, *S.TLE_LINE1["epoch_year"]), F.substring(line1, *S.TLE_LINE1["epoch_day"])))
    return {
        "norad_id": one("norad_id").try_cast("int"),
        "classification": one("classification"),
        "intl_designator": one("intl_designator"),
        "epoch": F.concat(F.substring(line1, *S.TLE_LINE1["epoch_year"]), one("epoch_day")),
        "epoch_time": epoch,
        "bstar": packed_decimal(F.substring(line1, *S.TLE_LINE1["bstar"])),
        "mean_motion_dot": number(one("mean_motion_dot")),
        "inclination": number(two("inclination")),
        "raan": number(two("raan")),
        "eccentricity": number(F.concat(F.lit("0."), two("eccentricity"))),
        "arg_perigee": number(two("arg_perigee")),
        "mean_anomaly": number(two("mean_anomaly")),
        "mean_motion": number(two("mean_motion")),
        "rev_number": F.coalesce(F.nullif(two("rev_number"), F.lit("")), F.lit("0")).try_cast("int"),
    }
