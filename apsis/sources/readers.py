"""Sources: declared schemas, pruned partitions, files or message topics, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S


def read_stream(spark: SparkSession, where: str, kind: str = "files", fmt: str = "json", schema: str = "key string, value string", starting: str = "latest", fail_on_loss: bool = False, servers: str = "localhost:9092", most_per_trigger: int | None = None) -> DataFrame:
    """A stream of messages. kind "files": a landing folder (the tested form); "kafka": a topic (needs the connector)."""
    if kind == "kafka":
        reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", where).option("startingOffsets", starting).option("failOnDataLoss", str(fail_on_loss).lower())
        return (reader.option("maxOffsetsPerTrigger", most_per_trigger) if most_per_trigger else reader).load()
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", most_per_trigger) if most_per_trigger else reader).load(where)


def read_log(spark: SparkSession, where: str, kind: str = "files", fmt: str = "json", schema: str = "key string, value string", servers: str = "localhost:9092") -> DataFrame:
    """The whole bounded log, from the earliest to the latest message."""
    if kind == "kafka":
        return spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", where).option("startingOffsets", "earliest").option("endingOffsets", "latest").load()
    return spark.read.format(fmt).schema(schema).load(where)


def read_archive(spark: SparkSession, root: str, day: str | None = None) -> DataFrame:
    """The position archive, or one day of it by partition pruning (the date column stays)."""
    table = spark.read.parquet(root)
    return table if day is None else table.where(F.col("date") == F.lit(day).cast("date"))


def read_tles(spark: SparkSession, root: str, start: str | None = None, end: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(TLE rows of a date range, undecodable lines as rejects) from JSON lines in date= folders. The scan decodes each line
    once. No folder of the range: no rows."""
    lines = spark.read.schema(f"{S.TLE}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(root)  # with the date of the folder
    lines = lines.where(F.col("date") >= F.lit(start).cast("date")) if start else lines
    lines = lines.where(F.col("date") <= F.lit(end).cast("date")) if end else lines
    # Both sides look at every field, so that the scan decodes all of them and finds the same lines bad (and since a JSON scan
    # refuses to read the column of bad lines alone).
    fields = [c for c in lines.columns if c not in ("_bad", "date")]
    known = F.length(F.concat_ws("", *fields)) >= 0
    rejects = lines.where(F.col("_bad").isNotNull() & known).select(F.lit("tle").alias("source"), F.lit("malformed JSON").alias("reason"), F.col("_bad").alias("raw"))
    return lines.where(F.col("_bad").isNull() & known).drop("_bad"), rejects


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without the undecodable ones."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_payloads(spark: SparkSession, root: str, stream: bool = False) -> DataFrame:
    """Landed feed answers: one JSON body per line as `payload`, with its file's time as ingestion_time."""
    reader = spark.readStream if stream else spark.read
    return reader.format("text").load(root).select(F.col("value").alias("payload"), F.date_format("_metadata.file_modification_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ingestion_time"))
