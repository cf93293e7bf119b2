"""Tables that readers see whole: batches over several sinks behind one marker, and day folders behind one manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _fs(spark, folder)
    return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []


def _create(spark: SparkSession, name: str, text: str) -> bool:
    """Writes a small file that must not exist: beside its place first, then moved there in one step. False: another was first."""
    fs, path = _fs(spark, name)
    _, beside = _fs(spark, f"{name}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    # Which of two writers was first is settled by a folder's creation, which only one of them can do.
    _, lock = _fs(spark, f"{name}.lock")
    won = not fs.exists(path) and not fs.exists(lock) and fs.mkdirs(lock) and fs.rename(beside, path)
    if not won:
        fs.delete(beside, False)
    return bool(won)


# --- One commit over several sinks --------------------------------------------------------------------------------


def commit_batch(spark: SparkSession, root: str, batch_id: int, sinks: dict[str, Callable[[str], None]]) -> None:
    """Writes every sink of a micro-batch to {root}/{sink}/batch={id}, then the batch's marker. Each sink gets its folder and must
    replace it. A batch that was committed before is left alone; one that broke off is written again."""
    fs, marker = _fs(spark, f"{root}/_commits/{batch_id}")
    if fs.exists(marker):
        return
    for name, write in sinks.items():
        write(f"{root}/{name}/batch={batch_id}")
    fs.mkdirs(marker.getParent())
    out = fs.create(marker, True)
    out.write(bytearray(str(batch_id).encode()))
    out.close()


def committed(spark: SparkSession, root: str, sink: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """The rows of a sink in committed batches, with their batch. A batch whose marker is missing is not seen in any sink. Markers
    are read as a table and joined on the batch, a partition column, so that folders of other batches are not read."""
    fs, folder = _fs(spark, f"{root}/_commits")
    reader = spark.read.format(fmt)
    rows = (reader.schema(schema) if schema is not None else reader).load(f"{root}/{sink}")
    if not fs.exists(folder):
        return rows.where("false")
    done = spark.read.schema("batch int").csv(f"{root}/_commits")
    return rows.join(done, "batch", "left_semi")


# --- Days behind a manifest ---------------------------------------------------------------------------------------


def _versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n.split(".")[0]) for n in _names(spark, f"{root}/_manifests") if n.endswith(".json"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict[str, list[str]]]:
    """(version, folders of each day) of a table; version 0 is the empty one. A manifest grows with days, not with files or rows."""
    known = _versions(spark, root)
    version = version if version is not None else (known[-1] if known else 0)
    if not version:
        return 0, {}
    text = "".join(r[0] for r in spark.read.text(f"{root}/_manifests/{version:08d}.json", wholetext=True).collect())
    return version, json.loads(text)


def _publish(spark: SparkSession, root: str, seen: int, days: dict[str, list[str]]) -> int:
    """The next version, if the table still is at the one seen."""
    fs, folder = _fs(spark, f"{root}/_manifests")
    fs.mkdirs(folder)
    if not _create(spark, f"{root}/_manifests/{seen + 1:08d}.json", json.dumps(days)):
        raise RuntimeError(f"{root} has changed since version {seen}; read it again and retry")
    return seen + 1


def append_days(rows: DataFrame, root: str) -> int:
    """Adds rows (with a date) to a table: a folder for each of their days, seen by readers from the new manifest on."""
    spark = rows.sparkSession
    seen, days = manifest(spark, root)
    part = uuid.uuid4().hex
    rows.repartition("date").sortWithinPartitions("date", "satellite_id", "timestamp").write.partitionBy("date").parquet(f"{root}/data/{part}")
    for name in _names(spark, f"{root}/data/{part}"):
        if name.startswith("date="):
            days.setdefault(name[5:], []).append(f"data/{part}/{name}")
    return _publish(spark, root, seen, days)


def compact_days(spark: SparkSession, root: str, schema, start: str, end: str, files: int = 1) -> int:
    """Rewrites days of several folders into one folder of `files` files each. Readers of the old manifest keep its folders, which
    stay until `vacuum`; a writer that was faster makes this raise, and nothing is lost."""
    seen, days = manifest(spark, root)
    many = {d: f for d, f in days.items() if start <= d <= end and len(f) > 1}
    if not many:
        return seen
    part = uuid.uuid4().hex
    rows = _load(spark, root, many, schema)
    spread = F.pmod(F.xxhash64("satellite_id", "timestamp"), F.lit(files))
    rows.repartition("date", spread).sortWithinPartitions("date", "satellite_id", "timestamp").write.partitionBy("date").parquet(f"{root}/data/{part}")
    return _publish(spark, root, seen, days | {d: [f"data/{part}/date={d}"] for d in many})


def _load(spark: SparkSession, root: str, days: dict[str, list[str]], schema) -> DataFrame:
    folders = [f"{root}/{f}" for found in days.values() for f in found]
    if not folders:
        return spark.createDataFrame([], schema)
    inner = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*folders)
    day = F.regexp_extract("_metadata.file_path", "/date=([0-9-]+)/", 1).cast("date")
    return inner.withColumn("date", day)


def read_days(spark: SparkSession, root: str, schema, start: str | None = None, end: str | None = None, version: int | None = None) -> DataFrame:
    """The table as of its newest manifest or a given version; days outside the range are not listed at all. schema includes date."""
    _, days = manifest(spark, root, version)
    return _load(spark, root, {d: f for d, f in days.items() if (not start or d >= start) and (not end or d <= end)}, schema)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Removes folders that none of the newest `keep` manifests names, and older manifests; how many folders went. Not to be run while
    a writer is at work."""
    known = _versions(spark, root)
    live = {f.split("/")[1] for v in known[-keep:] for found in manifest(spark, root, v)[1].values() for f in found}
    gone = [p for p in _names(spark, f"{root}/data") if p not in live]
    for p in gone:
        fs, path = _fs(spark, f"{root}/data/{p}")
        fs.delete(path, True)
    for v in known[:-keep]:
        fs, path = _fs(spark, f"{root}/_manifests/{v:08d}.json")
        fs.delete(path, False)
    return len(gone)
