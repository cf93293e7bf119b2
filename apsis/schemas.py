"""Declared schemas (DDL) and fixed values; nothing is inferred but partition columns."""

from __future__ import annotations

#: A normalised position message.
POSITION = "satellite_id int, satellite_name string, latitude double, longitude double, altitude_km double, azimuth double, elevation double, ra double, dec double, eclipsed boolean, timestamp bigint, source string, ingestion_time string"

#: A two-line element message.
TLE = "satellite_id int, satellite_name string, tle_line1 string, tle_line2 string, epoch string, source string, ingestion_time string"

#: A space-weather event.
EVENT = "event_id string, event_type string, start_time string, peak_time string, end_time string, source_location string, instruments array<string>, linked_events array<string>, severity string, note string, raw_data string, source string, ingestion_time string"

#: An enriched position message.
ENRICHED = (
    "satellite_id int, satellite_name string, position struct<latitude: double, longitude: double, altitude_km: double>, "
    "geo struct<country_code: string, country_name: string, region: string, over_ocean: boolean>, "
    "orbit struct<type: string, velocity_km_s: double, period_minutes: double>, lighting struct<in_sunlight: boolean>, "
    "timestamp bigint, source string, ingestion_time string, processing_time string"
)

#: An alert. Details stay typed; they are not lost on the way to a sink.
ALERT = (
    "alert_id string, alert_type string, severity string, satellite_id int, satellite_name string, detected_at string, "
    "details struct<average: double, spread: double, low: double, high: double, samples: bigint, z_score: double, event_id: string>, "
    "source string, window struct<start: timestamp, end: timestamp>"
)

#: Payloads of the four feeds, as far as the normalisers read them.
ISS_PAYLOAD = "message string, timestamp bigint, iss_position struct<latitude: string, longitude: string>"
N2YO_PAYLOAD = "info struct<satname: string, satid: int>, positions array<struct<satlatitude: double, satlongitude: double, sataltitude: double, azimuth: double, elevation: double, ra: double, dec: double, eclipsed: boolean, timestamp: bigint>>"
DONKI_PAYLOAD = (
    "activityID string, flrID string, gstID string, sepID string, hssID string, startTime string, beginTime string, peakTime string, endTime string, "
    "sourceLocation string, activeRegionNum bigint, instruments array<struct<displayName: string, instrumentType: string>>, linkedEvents array<struct<activityID: string>>, "
    "classType string, allKpIndex array<struct<kpIndex: double>>, cmeAnalyses array<struct<speed: double>>, note string, catalog string"
)
TLE_PAYLOAD = "name string, line1 string, line2 string"

# --- Fixed values -------------------------------------------------------------------------------------------------

#: Regions in order of priority, edges inclusive: lat_min, lat_max, lon_min, lon_max, code, name, region.
GEO_REGIONS = [
    (49, 60, -140, -60, "CA", "Canada", "North America"),
    (24, 49, -125, -66, "US", "United States", "North America"),
    (14, 32, -92, -86, "MX", "Mexico", "North America"),
    (36, 71, -10, 40, "EU", "Europe", "Europe"),
    (36, 47, 26, 45, "TR", "Turkey", "Europe"),
    (-5, 37, -17, 51, "AF", "Africa", "Africa"),
    (-35, -22, -70, -35, "AR", "Argentina", "South America"),
    (-23, 5, -74, -34, "BR", "Brazil", "South America"),
    (-55, -22, -75, -53, "SA", "South America", "South America"),
    (8, 37, 68, 97, "IN", "India", "Asia"),
    (18, 53, 73, 135, "CN", "China", "Asia"),
    (30, 46, 26, 77, "ME", "Middle East", "Asia"),
    (51, 77, 37, 180, "RU", "Russia", "Europe"),
    (-45, -10, 110, 155, "AU", "Australia", "Oceania"),
    (30, 45, 129, 145, "JP", "Japan", "Asia"),
    (33, 38, 124, 131, "KR", "South Korea", "Asia"),
    (-55, -20, -80, -65, "CL", "Chile", "South America"),
]
NO_COORDINATE = ("??", "Unknown", "Unknown")
NO_REGION = ("--", "Ocean / Unclaimed", "Ocean")

#: Known satellites.
CATALOGUE = {25544: "ISS", 20580: "HUBBLE", 43013: "STARLINK-24", 27607: "ENVISAT", 39634: "NOAA-19", 44713: "STARLINK-1007"}

#: Physics.
EARTH_RADIUS_KM = 6371.0
EARTH_GM = 3.986004418e14
DEFAULT_ALTITUDE_KM = 408.0

#: Orbit bands in km: below the first LEO, below the second MEO, up to the third GEO, above it HEO.
ORBIT_BANDS = (2000.0, 35786.0, 35800.0)

#: Anomaly rules.
EXPECTED_VELOCITY_KM_S = 7.66
VELOCITY_SIGMA = 2.0
ALTITUDE_RANGE_KM = 5.0
ALTITUDE_CRITICAL_KM = 10.0
MIN_SAMPLES = 3
DESCENT_KM = 0.01

#: Drift rules, on rounded rates per day.
MEAN_MOTION_LIMIT, INCLINATION_LIMIT, ECCENTRICITY_LIMIT = 0.001, 0.01, 0.0001

#: Times to live.
POSITION_TTL, ALERT_TTL, EVENT_TTL, META_TTL = "60 seconds", "24 hours", "72 hours", "1 hour"
ALERTS_PER_SATELLITE, RECENT = 100, 50

#: Feed health in seconds.
HEALTHY_S, LAGGING_S = 30, 120

#: Columns of the two lines, (first character from 1, length).
TLE_LINE1 = {"norad_id": (3, 5), "classification": (8, 1), "intl_designator": (10, 8), "epoch_year": (19, 2), "epoch_day": (21, 12), "mean_motion_dot": (34, 10), "bstar": (54, 8), "checksum": (69, 1)}
TLE_LINE2 = {"inclination": (9, 8), "raan": (18, 8), "eccentricity": (27, 7), "arg_perigee": (35, 8), "mean_anomaly": (44, 8), "mean_motion": (53, 11), "rev_number": (64, 5), "checksum": (69, 1)}
TLE_LENGTH = 69

#: Id field of an event's payload, by type.
EVENT_ID_FIELD = {"CME": "activityID", "FLR": "flrID", "GST": "gstID", "SEP": "sepID", "HSS": "hssID"}
SEVERE = ("high", "extreme")
