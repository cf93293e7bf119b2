"""Orbit, light and region of a position, as column expressions (inside whole-stage code generation)."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def filled_altitude(altitude: Column) -> Column:
    """Null altitudes take the default; zero and negative ones stay."""
    return F.coalesce(altitude, F.lit(S.DEFAULT_ALTITUDE_KM))


def _sane(altitude: Column) -> Column:
    """The altitude that physics uses: the default where it is null or not positive."""
    return F.when(altitude > 0, altitude).otherwise(S.DEFAULT_ALTITUDE_KM)


def orbit_type(altitude: Column) -> Column:
    low, mid, geo = S.ORBIT_BANDS
    a = _sane(altitude)
    return F.when(a < low, "LEO").when(a < mid, "MEO").when(a <= geo, "GEO").otherwise("HEO")


def _velocity(altitude: Column) -> Column:
    return F.sqrt(F.lit(S.EARTH_GM) / ((F.lit(S.EARTH_RADIUS_KM) + _sane(altitude)) * 1000)) / 1000


def velocity_km_s(altitude: Column) -> Column:
    """Speed on a circular orbit."""
    return F.round(_velocity(altitude), 3)


def period_minutes(altitude: Column) -> Column:
    return F.round(F.lit(2 * pi) * (F.lit(S.EARTH_RADIUS_KM) + _sane(altitude)) / _velocity(altitude) / 60, 2)


def orbit(altitude: Column) -> Column:
    return F.struct(orbit_type(altitude).alias("type"), velocity_km_s(altitude).alias("velocity_km_s"), period_minutes(altitude).alias("period_minutes"))


def in_sunlight(latitude: Column, longitude: Column, timestamp: Column) -> Column:
    """Whether the sun stands above -6 degrees at a place and an epoch second; true where any of them is null."""
    at = F.timestamp_seconds(timestamp)
    declination = F.radians(F.lit(23.45) * F.sin(F.radians(F.lit(360 / 365) * (F.dayofyear(at) - 81))))
    hour = F.hour(at) + F.minute(at) / 60 + F.second(at) / 3600
    angle = F.radians(longitude + (hour - 12) * 15)
    lat = F.radians(latitude)
    height = F.sin(lat) * F.sin(declination) + F.cos(lat) * F.cos(declination) * F.cos(angle)
    lit = F.degrees(F.asin(F.least(F.greatest(height, F.lit(-1.0)), F.lit(1.0)))) > -6
    unknown = latitude.isNull() | longitude.isNull() | timestamp.isNull()  # greatest and least pass over nulls
    return F.when(unknown, True).otherwise(lit)


def _region(code: str, name: str, region: str, ocean: bool) -> Column:
    return F.struct(F.lit(code).alias("country_code"), F.lit(name).alias("country_name"), F.lit(region).alias("region"), F.lit(ocean).alias("over_ocean"))


def geo(latitude: Column, longitude: Column, regions: list[tuple] | None = None) -> Column:
    """The first region that holds a point, as a CASE chain: no join, so it serves streams too."""
    found = F.when(latitude.isNull() | longitude.isNull(), _region(*S.NO_COORDINATE, True))
    for lat0, lat1, lon0, lon1, code, name, area in regions or S.GEO_REGIONS:
        found = found.when(latitude.between(lat0, lat1) & longitude.between(lon0, lon1), _region(code, name, area, False))
    return found.otherwise(_region(*S.NO_REGION, True))
