"""The scalar functions for SQL text: temporary functions whose bodies are SQL expressions, so nothing runs in Python and the
optimiser sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import schemas as S

_HEIGHT = f"IF(altitude > 0, altitude, {S.DEFAULT_ALTITUDE_KM}D)"
_SPEED = f"sqrt({S.EARTH_GM:.0f}D / (({S.EARTH_RADIUS_KM}D + {_HEIGHT}) * 1000)) / 1000"
_REGION = "struct<country_code: string, country_name: string, region: string, over_ocean: boolean>"


def _region(code: str, name: str, region: str, ocean: bool) -> str:
    return f"named_struct('country_code', '{code}', 'country_name', '{name}', 'region', '{region}', 'over_ocean', {str(ocean).lower()})"


def _functions() -> dict[str, tuple[str, str, str]]:
    """Name to (parameters, type, body)."""
    low, mid, geo = S.ORBIT_BANDS
    boxes = " ".join(f"WHEN latitude BETWEEN {a} AND {b} AND longitude BETWEEN {c} AND {d} THEN {_region(code, name, area, False)}" for a, b, c, d, code, name, area in S.GEO_REGIONS)
    at = "timestamp_seconds(epoch)"
    declination = f"radians(23.45D * sin(radians({360 / 365!r}D * (dayofyear({at}) - 81))))"
    angle = f"radians(longitude + (hour({at}) + minute({at}) / 60D + second({at}) / 3600D - 12) * 15)"
    height = f"sin(radians(latitude)) * sin({declination}) + cos(radians(latitude)) * cos({declination}) * cos({angle})"
    body = f"substring(line, 1, {S.TLE_LENGTH - 1})"
    places = " + ".join(f"{value} * (length({body}) - length(translate({body}, '{digits}', '')))" for value, digits in ((1, "13579-"), (2, "2367"), (4, "4567"), (8, "89")))
    parts = r"r'^[+-]?\s*([0-9.]+)(?:([+-][0-9]+))?$'"
    digits = f"nullif(regexp_extract(trim(text), {parts}, 1), '')"
    power = f"coalesce(try_cast(nullif(regexp_extract(trim(text), {parts}, 2), '') AS INT), 0)"
    year = "try_cast(substring(text, 1, 2) AS INT)"
    day = "try_cast(substring_index(substring(trim(text), 3, 12), '.', 1) AS INT)"
    fraction = r"coalesce(try_cast(concat('0.', nullif(regexp_extract(text, r'\.([0-9]+)', 1), '')) AS DOUBLE), 0D)"
    epoch = f"timestamp_micros(unix_micros(CAST(date_add(make_date(IF({year} < 57, {year} + 2000, {year} + 1900), 1, 1), {day} - 1) AS TIMESTAMP)) + CAST(rint({fraction} * 86400000000D) AS BIGINT))"
    return {
        "filled_altitude": ("altitude DOUBLE", "DOUBLE", f"coalesce(altitude, {S.DEFAULT_ALTITUDE_KM}D)"),
        "orbit_type": ("altitude DOUBLE", "STRING", f"CASE WHEN {_HEIGHT} < {low}D THEN 'LEO' WHEN {_HEIGHT} < {mid}D THEN 'MEO' WHEN {_HEIGHT} <= {geo}D THEN 'GEO' ELSE 'HEO' END"),
        "velocity_km_s": ("altitude DOUBLE", "DOUBLE", f"round({_SPEED}, 3)"),
        "period_minutes": ("altitude DOUBLE", "DOUBLE", f"round(2 * pi() * ({S.EARTH_RADIUS_KM}D + {_HEIGHT}) / ({_SPEED}) / 60, 2)"),
        "in_sunlight": ("latitude DOUBLE, longitude DOUBLE, epoch BIGINT", "BOOLEAN", f"CASE WHEN latitude IS NULL OR longitude IS NULL OR epoch IS NULL THEN true ELSE degrees(asin(least(greatest({height}, -1D), 1D))) > -6 END"),
        "geo_region": ("latitude DOUBLE, longitude DOUBLE", _REGION, f"CASE WHEN latitude IS NULL OR longitude IS NULL THEN {_region(*S.NO_COORDINATE, True)} {boxes} ELSE {_region(*S.NO_REGION, True)} END"),
        "tle_checksum": ("line STRING", "INT", f"({places}) % 10"),
        "tle_epoch": ("text STRING", "TIMESTAMP", epoch),
        "tle_decimal": ("text STRING", "DOUBLE", f"CASE WHEN trim(text) IN ('', '+', '-') THEN 0D ELSE IF(startswith(trim(text), '-'), -1D, 1D) * try_cast(concat('0.', {digits}) AS DOUBLE) * pow(10D, {power}) END"),
    }


def register(spark: SparkSession) -> list[str]:
    """Creates or replaces the functions in the session; their names."""
    made = _functions()
    for name, (parameters, kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(made)
