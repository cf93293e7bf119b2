"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.positions import to_archive


def in_key_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of one key in one partition and in order, as a keyed log wants them. Use it right before a keyed sink."""
    return rows.repartition(key).sortWithinPartitions(key, order)


def write_messages(messages: DataFrame, where: str, kind: str = "files", servers: str = "localhost:9092") -> None:
    """Keyed messages (key, value) to a JSON folder or a topic."""
    if kind == "kafka":
        messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", where).save()
    else:
        messages.write.mode("append").json(where)


def write_positions_archive(enriched: DataFrame, root: str, batch_id: int | None = None, by: tuple[str, ...] = ("date", "satellite_id"), tasks: int = 1) -> None:
    """Appends to the archive by date and satellite; the rows of one folder are dealt over at most `tasks` tasks, and so files. With a batch id, a replayed
    micro-batch replaces its own folder instead of appending twice. With many satellites, partition by date alone: their
    rows are then sorted by satellite within the files, and row-group statistics prune instead of folders."""
    rows = to_archive(enriched).repartition(*by, F.pmod(F.xxhash64("satellite_id", "timestamp"), F.lit(tasks))).sortWithinPartitions(*by, "satellite_id", "timestamp")
    if batch_id is None:
        rows.write.mode("append").partitionBy(*by).parquet(root)
    else:
        rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch").parquet(root)


def compact_day(table: DataFrame, day: str, root: str, files: int = 1) -> None:
    """Rewrites one day of an archive into few files per satellite at another root."""
    rows = table.where(F.col("date") == F.lit(day).cast("date"))
    spread = F.pmod(F.xxhash64("timestamp"), F.lit(files))
    rows.repartition("date", "satellite_id", spread).sortWithinPartitions("satellite_id", "timestamp").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "satellite_id").parquet(root)


def write_mart(mart: DataFrame, path: str, fmt: str = "orc", partition_by: list[str] | None = None) -> None:
    """Replaces a mart; with partitions, only those it has rows for."""
    writer = mart.write.mode("overwrite").format(fmt)
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.save(path)


def write_trigger(spark, root: str, job: str, day: str, by: str) -> None:
    """Appends one completion row."""
    spark.range(1).select(F.lit(job).alias("job_type"), F.lit(day).alias("date"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("triggered_at"), F.lit(by).alias("triggered_by"), F.lit("completed").alias("status")).write.mode("append").json(root)


def write_weekly_report(report: DataFrame, root: str, week: str) -> None:
    """Replaces one week's report; an empty one becomes a placeholder row."""
    path = f"{root}/week={week}"
    if report.isEmpty():
        report.sparkSession.range(1).select(F.lit("no_input_data").alias("warning"), F.lit(week).alias("week")).write.mode("overwrite").json(path)
    else:
        report.write.mode("overwrite").json(path)
