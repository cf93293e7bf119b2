"""Freshness and consistency of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import calendar


def partition_ready(table: DataFrame, day: str) -> bool:
    """Whether a day's partition has a row; stops at the first."""
    return not table.where(F.col("date") == F.lit(day).cast("date")).limit(1).isEmpty()


def partition_counts(table: DataFrame, files: bool = False) -> DataFrame:
    """Rows (and files, for a table read from files) per date."""
    extra = [F.count_distinct("_file").alias("files")] if files else []
    return (table.withColumn("_file", F.input_file_name()) if files else table).groupBy("date").agg(F.count("*").alias("rows"), *extra)


def missing_partitions(table: DataFrame, start: str, end: str) -> DataFrame:
    """Dates of a range without any row."""
    spine = table.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return spine.join(table.select("date").distinct(), "date", "left_anti")


def freshness_alerts(table: DataFrame, start: str, end: str, task: str, at: Column) -> DataFrame:
    """Missing dates in the schema of operations alerts."""
    found = missing_partitions(table, start, end)
    text = F.concat(F.lit(f"{task}: no rows for "), F.col("date").cast("string"))
    return found.select(F.lit("PIPELINE_FRESHNESS").alias("alert_type"), F.lit("WARNING").alias("severity"), F.lit(task).alias("task"), "date", calendar.shortened(text).alias("message"), calendar.utc_iso(at).alias("detected_at"))


def feed_health(rows: DataFrame, now: Column, key: str = "source") -> DataFrame:
    """Age of the last row per feed: healthy to 30 s, lagging to 120 s, stalled beyond."""
    last = rows.groupBy(key).agg(F.max("event_time").alias("last_seen"))
    age = (F.unix_micros(now) - F.unix_micros("last_seen")) / 1_000_000
    return last.withColumn("age_seconds", age).withColumn("status", F.when(age <= S.HEALTHY_S, "healthy").when(age <= S.LAGGING_S, "lagging").otherwise("stalled"))


def consistency_check(live: DataFrame, daily: DataFrame, limit_km: float = 3.0) -> DataFrame:
    """Live altitude against the daily mean of the same satellite."""
    gap = F.abs(F.col("altitude_km") - F.col("avg_altitude_km"))
    return live.select("satellite_id", "altitude_km").join(daily.groupBy("satellite_id").agg((F.sum(F.col("avg_altitude_km") * F.col("position_count")) / F.sum("position_count")).alias("avg_altitude_km")), "satellite_id").withColumn("gap_km", gap).withColumn("consistent", gap <= limit_km)
