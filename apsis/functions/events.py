"""Space-weather payload fields as column expressions over a decoded payload struct `p` and its type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def some(text: Column) -> Column:
    """Empty text counts as absent."""
    return F.nullif(text, F.lit(""))


def _graded(value: Column, moderate: float, high: float, extreme: float) -> Column:
    return F.when(value >= extreme, "extreme").when(value >= high, "high").when(value >= moderate, "moderate").otherwise("low")


def largest(values: Column, of: str) -> Column:
    """The maximum of a field over an array; 0 for an empty or missing one."""
    return F.coalesce(F.array_max(F.transform(values, lambda x: x[of])), F.lit(0.0))


def severity(kind: Column, p: Column) -> Column:
    """Flares by class letter, storms by Kp, ejections by speed; other types are unknown."""
    letter = F.substring(F.upper(F.trim(F.coalesce(p["classType"], F.lit("")))), 1, 1)
    flare = F.when(letter == "X", "extreme").when(letter == "M", "high").when(letter == "C", "moderate").otherwise("low")
    storm = _graded(largest(p["allKpIndex"], "kpIndex"), 3, 5, 7)
    ejection = _graded(largest(p["cmeAnalyses"], "speed"), 500, 1000, 2000)
    return F.when(kind == "FLR", flare).when(kind == "GST", storm).when(kind == "CME", ejection).otherwise("unknown")


def event_id(kind: Column, p: Column) -> Column:
    """The payload's own id, else TYPE- and the first 12 digits of an MD5 of type, start and begin time."""
    own = F.lit(None).cast("string")
    for name, key in S.EVENT_ID_FIELD.items():
        own = F.when(kind == name, some(p[key])).otherwise(own)
    text = F.concat_ws("|", kind, F.coalesce(p["startTime"], F.lit("")), F.coalesce(p["beginTime"], F.lit("")))
    return F.coalesce(own, F.concat(kind, F.lit("-"), F.substring(F.md5(text.cast("binary")), 1, 12)))


def instruments(p: Column) -> Column:
    names = F.transform(p["instruments"], lambda x: F.coalesce(some(x["displayName"]), some(x["instrumentType"])))
    return F.coalesce(F.filter(names, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def linked_events(p: Column) -> Column:
    return F.coalesce(F.filter(F.transform(p["linkedEvents"], lambda x: some(x["activityID"])), lambda x: x.isNotNull()), F.array().cast("array<string>"))
