"""Weeks, times and small text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_week(day: Column) -> Column:
    """struct(label `YYYY-WW`, monday, sunday, year, week) of the ISO week of a date."""
    year, week = F.date_part(F.lit("YEAROFWEEK"), day).cast("int"), F.weekofyear(day)
    monday = F.date_trunc("week", day.cast("timestamp")).cast("date")
    number = F.lpad(week.cast("string"), 2, "0")
    return F.struct(F.concat(year.cast("string"), F.lit("-"), number).alias("label"), monday.alias("monday"), F.date_add(monday, 6).alias("sunday"), year.alias("year"), number.alias("week"))


def utc_iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_text(at: Column) -> Column:
    return F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def message_key(kind: str, column: Column) -> Column:
    """SAT-id, TLE-id or EVT-type."""
    return F.concat(F.lit(f"{kind}-"), column.cast("string"))


def shortened(text: Column, most: int = 500) -> Column:
    return F.substring(text, 1, most)


def numeric_id(text: Column) -> Column:
    """The number of an id that is all digits, else null; the text stays beside it."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
