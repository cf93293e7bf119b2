"""The daily job: one pruned scan, three marts, a summary from the written mart, a completion row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import marts
from ..sources import readers, writers


def run_daily(spark: SparkSession, archive: str, out: str, day: str) -> DataFrame:
    """Writes satellite_stats (by orbit type), country_stats and orbit_health as ORC, the satellites of the day as keyed JSON rows, then returns the daily summary.

    The day's rows are read three times from pruned, column-pruned Parquet rather than cached: each mart needs few columns.
    """
    positions = readers.read_archive(spark, archive, day)
    writers.write_mart(marts.satellite_stats(positions), f"{out}/satellite_stats/date={day}", partition_by=["orbit_type"])
    writers.write_mart(marts.country_stats(positions), f"{out}/country_stats/date={day}")
    writers.write_mart(marts.orbit_health(positions), f"{out}/orbit_health/date={day}")
    stats = spark.read.orc(f"{out}/satellite_stats/date={day}")
    summary = marts.daily_summary(stats).withColumn("date", F.lit(day))
    summary.write.mode("overwrite").json(f"{out}/summary/date={day}")
    marts.summary_document(stats, day).write.mode("overwrite").json(f"{out}/summary_document/date={day}")
    writers.write_trigger(spark, f"{out}/batch_trigger", "daily_aggregation", day, "run_daily")
    return spark.read.json(f"{out}/summary/date={day}")
