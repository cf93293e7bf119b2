"""The weekly job: TLE archive to drift report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import drift
from ..sources import readers, writers


def run_weekly(spark: SparkSession, tles: str, out: str, day: str, scope: str = "week", wrap: bool = False) -> tuple[DataFrame, DataFrame]:
    """(report, rejects) for the ISO week of a date. scope "year" takes the whole year's archive into each report."""
    week = spark.range(1).select(calendar.iso_week(F.lit(day).cast("date")).alias("w")).first()["w"]
    start, end = (str(week["monday"]), str(week["sunday"])) if scope == "week" else (f"{day[:4]}-01-01", f"{day[:4]}-12-31")
    rows, malformed = readers.read_tles(spark, tles, start, end)
    elements, rejects = drift.parse_tle(rows, strict=False)
    # Decoded once; the report reads its elements twice.
    elements.write.mode("overwrite").parquet(f"{out}/elements/week={week['label']}")
    report = drift.drift_report(spark.read.schema(elements.schema).parquet(f"{out}/elements/week={week['label']}"), wrap)
    writers.write_weekly_report(report, out, week["label"])
    return report, malformed.unionByName(rejects)
