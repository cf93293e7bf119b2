"""Content-addressed WARC archive (operator 9), in DataFrame functions only.

The archive is two tables. `payloads` holds each distinct payload once under its SHA-256; `records` holds the exact
header text of every record, the key of its payload, and no payload. Reading checks every stored payload against
its key and joins the two again. Payload bytes are shuffled once, when they are stored: that table is bucketed by
key, so the join that rebuilds records moves headers only. A payload that more than PER_PART records share is read
apart: its records are dealt over parts and it is copied to each part.

Cases: null payload counts as empty; equal payloads under min_revisit_bytes are each a response, though stored once;
rows that repeat the largest page id of a payload are all responses; a null page id is written as no id, read back as null, and
never chosen as the response unless no other row has that payload (an empty id reads back as null too); an empty table
gives two empty tables; a very long payload is one binary value (up to Spark's 2 GB); extra columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir
from .common import beside, materialize

#: Fixed value: end of line of a WARC header.
EOL = "\r\n"
#: Records of one payload that are rebuilt beside one copy of it.
PER_PART = 1000


@dataclass
class Archive:
    """records: header, payload_key, part, parts. payloads: payload_key, payload, parts."""

    records: DataFrame
    payloads: DataFrame


def _header(date: str) -> Column:
    """The exact header block of one record, from the columns _id, _url, _sha1, _bytes, _type and _refers."""
    revisit = F.col("_type") == "revisit"
    name = lambda c: F.concat(F.lit("<urn:page:"), F.url_encode(F.coalesce(c.cast("string"), F.lit(""))), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(EOL))
    profile = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        line("WARC-Type", F.col("_type")),
        line("WARC-Record-ID", name(F.col("_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(F.col("_url"), F.lit("")), "[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("_refers"))), line("WARC-Profile", profile))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("_bytes").cast("string"))),
        F.lit(EOL),
    )


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> Archive:
    """Write one record per row. Of rows with equal payloads of min_revisit_bytes or more, the largest id is the
    response and the others are revisits that refer to it."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), payload.alias("_payload"))
    # Digests are taken once and stored without the payload: all role decisions use these narrow rows.
    sizes = F.sha1("_payload").alias("_sha1"), F.octet_length("_payload").cast("bigint").alias("_bytes")
    meta = materialize(rows.select("_id", "_url", F.sha2("_payload", 256).alias("payload_key"), *sizes), "warc-meta")
    known = beside(meta.withColumn("_row", F.xxhash64("_id", "_url")), "payload_key", "_row", _refers=("max", F.col("_id")), _n=("count", F.lit(1)))
    role = F.when((F.col("_bytes") < min_revisit_bytes) | F.col("_id").eqNullSafe(F.col("_refers")), "response").otherwise("revisit")
    parts = F.ceil(F.col("_n") / PER_PART).cast("int")
    part = F.pmod(F.col("_row"), parts).cast("int")
    records = known.withColumn("_type", role).select("payload_key", part.alias("part"), parts.alias("parts"), _header(date).alias("header"))
    records = materialize(records, "warc-records")
    # One row per distinct payload; the map side keeps one copy per task, so a hot payload is not gathered.
    stored = meta.groupBy("payload_key").agg(F.ceil(F.count("*") / PER_PART).cast("int").alias("parts"))
    bodies = rows.select(F.sha2("_payload", 256).alias("payload_key"), F.col("_payload").alias("payload")).groupBy("payload_key").agg(F.first("payload").alias("payload"))
    name = f"warc_payloads_{uuid.uuid4().hex}"
    spark = pages.sparkSession
    # As many buckets as the shuffle has partitions: each task writes buckets of its own.
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    bodies.join(stored, "payload_key").write.bucketBy(buckets, "payload_key").option("path", f"{scratch_dir(spark)}/apsis/{name}").saveAsTable(name)
    return Archive(records, spark.table(name))


def read_payloads(archive: Archive) -> DataFrame:
    """The payload table with every payload checked against its key: payload_key, payload, parts."""
    right = F.sha2("payload", 256) == F.col("payload_key")
    payload = F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), "payload_key")))
    return archive.payloads.select("payload_key", payload.alias("payload"), "parts")


def read_records(archive: Archive) -> DataFrame:
    """Every record as the exact bytes a WARC file would hold, rebuilt from header and payload by a join: record, payload.
    A revisit's own block is empty; its payload is that of the response it refers to."""
    end = F.encode(F.lit(EOL + EOL), "utf-8")
    block = F.when(F.col("header").contains(f"WARC-Type: revisit{EOL}"), F.encode(F.lit(""), "utf-8")).otherwise(F.col("payload"))
    payloads = read_payloads(archive)
    usual = archive.records.where("parts = 1").select("payload_key", "header").join(payloads.where("parts = 1"), "payload_key")
    spread = payloads.where("parts > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    hot = archive.records.where("parts > 1").select("payload_key", "part", "header").join(spread, ["payload_key", "part"])
    both = usual.select("header", "payload").unionByName(hot.select("header", "payload"))
    return both.select(F.concat(F.encode("header", "utf-8"), block, end).alias("record"), "payload")


def read_fields(records: DataFrame) -> DataFrame:
    """What rebuilt records say and hold: page_id and refers_to (text), record_type, declared_digest, and payload_digest and
    payload_bytes of the whole payload. A response whose block is not its payload raises an error."""
    head = F.substring_index(F.decode("record", "utf-8"), EOL + EOL, 1)
    line = lambda key, value: F.regexp_extract("_head", rf"(?md)^{key}: {value}(?:\r|$)", 1)
    page = lambda key: F.url_decode(F.nullif(line(key, "<urn:page:([^>\r]*)>"), F.lit("")))
    at = F.octet_length("_head") + 2 * len(EOL)
    block = F.expr("substring(record, _at + 1, octet_length(record) - _at - 4)")
    whole = (F.col("record_type") == "revisit") & (F.octet_length("_block") == 0) | (F.col("_block") == F.col("payload"))
    parsed = records.withColumn("_head", head).withColumn("_at", at).select("payload", line("WARC-Type", "([a-z]+)").alias("record_type"), page("WARC-Record-ID").alias("page_id"), page("WARC-Refers-To").alias("refers_to"), line("WARC-Payload-Digest", "sha1:([0-9a-f]+)").alias("declared_digest"), block.alias("_block"))
    digest = F.when(whole, F.sha1("payload")).otherwise(F.raise_error(F.concat(F.lit("record without its payload: "), F.coalesce("page_id", F.lit("no id")))))
    return parsed.select("page_id", "record_type", "refers_to", "declared_digest", digest.alias("payload_digest"), F.octet_length("payload").cast("bigint").alias("payload_bytes"))
