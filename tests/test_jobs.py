"""Batch and streaming jobs end to end, in temporary folders."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from apsis import fixtures as X
from apsis import schemas as S
from apsis.operators import anomaly, positions
from apsis.plans import daily, weekly
from apsis.sources import readers, writers
from apsis.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_daily_job(spark, tmp_path):
    enriched = positions.enrich_positions(X.positions(spark, SF))
    writers.write_positions_archive(enriched, f"{tmp_path}/archive", by=("date",))
    day = str(enriched.select(F.max("date")).first()[0])
    summary = daily.run_daily(spark, f"{tmp_path}/archive", f"{tmp_path}/out", day).first()
    want = enriched.where(F.col("date") == day)
    assert summary["total_positions"] == want.count()
    assert summary["satellites_tracked"] == want.select("satellite_id").distinct().count()
    plan = readers.read_archive(spark, f"{tmp_path}/archive", day)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    writers.compact_day(spark.read.parquet(f"{tmp_path}/archive"), day, f"{tmp_path}/compact")
    assert spark.read.parquet(f"{tmp_path}/compact").count() == want.count()


def test_weekly_job_and_its_placeholder(spark, tmp_path):
    rows = X.tle_rows(spark, SF).withColumn("date", F.to_date("ingestion_time"))
    rows.write.partitionBy("date").json(f"{tmp_path}/tle")
    with open(f"{tmp_path}/tle/date=2024-01-10/bad.json", "w") as f:
        f.write("{broken\n")
    report, rejects = weekly.run_weekly(spark, f"{tmp_path}/tle", f"{tmp_path}/out", "2024-01-10")
    week = rows.where("date between '2024-01-08' and '2024-01-14'")
    assert report.agg(F.sum("tle_count")).first()[0] == week.count()
    assert rejects.count() == 1
    weekly.run_weekly(spark, f"{tmp_path}/tle", f"{tmp_path}/out", "2023-01-10")
    assert readers.read_report(spark, f"{tmp_path}/out/week=2023-02", "warning string").first()["warning"] == "no_input_data"


def test_enrichment_stream_files_rejects(spark, tmp_path):
    good = positions.to_messages(X.positions(spark, SF).drop("event_id").limit(20), "satellite_id")
    good.unionByName(spark.createDataFrame([("x", "{broken")], "key string, value string")).write.json(f"{tmp_path}/in")
    query = jobs.start_enrichment(readers.read_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/archive", f"{tmp_path}/topic", f"{tmp_path}/rejects", f"{tmp_path}/cp", by=("date",))
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/archive").count() == 20
    assert spark.read.json(f"{tmp_path}/topic").count() == 20
    assert spark.read.json(f"{tmp_path}/rejects").count() == 1


def test_alert_stream(spark, tmp_path):
    base = int(dt.datetime(2024, 1, 15, 12, tzinfo=dt.UTC).timestamp())
    rows = spark.createDataFrame([(1, "A", 1.0, 2.0, 400.0 + 10 * k, base + k, "x", "t") for k in range(4)] + [(1, "A", 1.0, 2.0, 400.0, base + 600, "x", "t")], "satellite_id int, satellite_name string, latitude double, longitude double, altitude_km double, timestamp bigint, source string, ingestion_time string")
    positions.to_messages(positions.to_enriched_message(positions.enrich_positions(rows)), "satellite_id").write.json(f"{tmp_path}/in")
    spark.createDataFrame([("e1", "FLR", "2024-01-15T11:00:00Z", "extreme", "t")], "event_id string, event_type string, start_time string, severity string, ingestion_time string").write.json(f"{tmp_path}/events")
    with open(f"{tmp_path}/in/bad.json", "w") as f:
        f.write('{"key": "1", "value": "{broken"}\n')
    query = jobs.start_alerts(readers.read_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/cp", topic=f"{tmp_path}/topic")
    query.awaitTermination()
    jobs.start_rejects(readers.read_stream(spark, f"{tmp_path}/in"), S.ENRICHED, f"{tmp_path}/rejects", f"{tmp_path}/cp2").awaitTermination()
    assert [r["raw"] for r in spark.read.json(f"{tmp_path}/rejects").collect()] == ["{broken"]
    found = spark.read.parquet(f"{tmp_path}/out")
    kinds = {r["alert_type"]: r["count"] for r in found.groupBy("alert_type").count().collect()}
    assert kinds["ALTITUDE_ANOMALY"] == 6 and kinds["SPACE_WEATHER_CORRELATION"] == 1
    assert found.where("alert_type = 'ALTITUDE_ANOMALY'").first()["details"]["samples"] == 4
    messages = spark.read.schema("key string, value string").json(f"{tmp_path}/topic").select("key", F.from_json("value", S.ALERT).alias("a")).collect()
    assert len(messages) == found.count() and {m["key"] for m in messages} == {"1"} and {m["a"]["alert_id"] for m in messages} == {r["alert_id"] for r in found.collect()}


def test_correlations_by_window_hold_every_pair_and_do_not_grow_with_satellites(spark, tmp_path):
    base = int(dt.datetime(2024, 1, 15, 12, tzinfo=dt.UTC).timestamp())
    satellites = range(1, 21)
    rows = [(s, f"S{s}", 1.0, 2.0, 400.0 + 10 * k, base + k, "x", "t") for s in satellites for k in range(4)] + [(1, "S1", 1.0, 2.0, 400.0, base + 600, "x", "t")]
    rows = spark.createDataFrame(rows, "satellite_id int, satellite_name string, latitude double, longitude double, altitude_km double, timestamp bigint, source string, ingestion_time string")
    positions.to_messages(positions.to_enriched_message(positions.enrich_positions(rows)), "satellite_id").write.json(f"{tmp_path}/in")
    iso = lambda k: dt.datetime.fromtimestamp(base + k, dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    # All windows, those that begin until 12:00:00, one polled twice, one that ends before they begin, one of low severity.
    events = [("e1", iso(-3600), None, "extreme"), ("e2", iso(-3600), iso(0), "high"), ("e2", iso(-3600), iso(0), "high"), ("e3", iso(-3600), iso(-60), "high"), ("e4", iso(-3600), None, "low")]
    known = spark.createDataFrame([(*e, f"t{k}") for k, e in enumerate(events)], "event_id string, start_time string, end_time string, severity string, ingestion_time string")
    known.write.json(f"{tmp_path}/events")
    spark.createDataFrame([], S.EVENT).unionByName(known, allowMissingColumns=True).write.parquet(f"{tmp_path}/events-parquet")
    start = lambda name, at, **more: jobs.start_alerts(readers.read_stream(spark, f"{tmp_path}/in"), at, f"{tmp_path}/{name}", f"{tmp_path}/cp-{name}", mode="overlap", **more).awaitTermination()
    start("pairs", f"{tmp_path}/events")
    start("alerts", f"{tmp_path}/events-parquet", weather=f"{tmp_path}/weather", events_format="parquet")
    every, alerts, weather = (spark.read.parquet(f"{tmp_path}/{n}").drop("batch") for n in ("pairs", "alerts", "weather"))
    kind = F.col("alert_type") == "SPACE_WEATHER_CORRELATION"
    ids = lambda df: sorted(r["alert_id"] for r in df.collect())
    assert ids(every.where(~kind)) == ids(alerts) and weather.count() == 6 + 6
    pair = lambda df, event: sorted((r["satellite_id"], r["window"]["start"], r["e"], r["severity"]) for r in df.select("satellite_id", "window", F.col(event).alias("e"), "severity").collect())
    want = pair(every.where(kind), "details.event_id")
    assert len(want) == 12 * len(satellites) and want == pair(alerts.drop("severity").join(weather, "window"), "event_id")
    counts = {(r["satellite_id"], r["severity"]): r["correlations"] for r in anomaly.count_by_window(alerts, weather.unionByName(weather)).collect()}
    assert counts == {(s, level): 6 for s in satellites for level in ("CRITICAL", "WARNING")}
    with pytest.raises(ValueError, match="overlap"):
        jobs.start_alerts(None, "", "", "", weather="x")


def test_late_rows_are_left_out_of_closed_windows(spark, tmp_path):
    """A row behind the watermark of an earlier batch joins no window; one within it does."""
    base = int(dt.datetime(2024, 1, 15, 12, tzinfo=dt.UTC).timestamp())
    schema = "satellite_id int, satellite_name string, latitude double, longitude double, altitude_km double, timestamp bigint, source string, ingestion_time string"
    (tmp_path / "in").mkdir()
    source = readers.read_stream(spark, f"{tmp_path}/in", most_per_trigger=1)
    for batch in ([400.0, 410.0], None, [420.0, 430.0], None):
        rows = [(1, "A", 1.0, 2.0, a, base + k, "x", "t") for k, a in enumerate(batch)] if batch else [(2, "B", 1.0, 2.0, 400.0, base + (200 if len(list((tmp_path / "in").glob("*.json"))) < 2 else 900), "x", "t")]
        messages = positions.to_messages(positions.to_enriched_message(positions.enrich_positions(spark.createDataFrame(rows, schema))), "satellite_id")
        messages.coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        query = jobs.alert_stream(source).writeStream.format("json").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    # Two samples in time and two late ones: never the three that an alert needs.
    assert spark.read.schema(S.ALERT).json(f"{tmp_path}/out").where("satellite_id = 1").count() == 0


def run(query_frame, tmp_path, name):
    query = query_frame.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    query.awaitTermination()


def test_new_events_stream(spark, tmp_path):
    rows = spark.createDataFrame([("e1", dt.datetime(2024, 1, 1)), ("e1", dt.datetime(2024, 1, 2)), ("e2", dt.datetime(2024, 1, 2))], "event_id string, event_time timestamp")
    rows.write.parquet(f"{tmp_path}/in")
    run(jobs.new_events(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")), tmp_path, "fresh")
    assert spark.table("fresh").count() == 2


def test_changed_lines_stream(spark, tmp_path):
    schema = "satellite_id int, tle_line1 string, ingestion_time string"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).json(f"{tmp_path}/in")
    for k, line in enumerate("AABA"):
        spark.createDataFrame([(1, line, str(k))], schema).write.mode("append").json(f"{tmp_path}/in")
        query = jobs.changed_lines(source).writeStream.format("json").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    assert [r["tle_line1"] for r in spark.read.schema(schema).json(f"{tmp_path}/out").orderBy("ingestion_time").collect()] == ["A", "B", "A"]


def test_latest_positions_stream(spark, tmp_path):
    schema = "satellite_id int, latitude double, longitude double, altitude_km double, timestamp bigint"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).json(f"{tmp_path}/in")
    for rows in ([(1, 0.0, 0.0, 400.0, 10), (1, 0.0, 0.0, 401.0, 20)], [(1, 0.0, 0.0, 402.0, 15)], [(1, 0.0, 0.0, 403.0, 30), (2, 0.0, 0.0, 1.0, 5)]):
        spark.createDataFrame(rows, schema).write.mode("append").json(f"{tmp_path}/in")
        query = jobs.latest_positions(source, 3600).writeStream.format("json").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
        # Times to live run on processing time, so the query has no end of its own.
        for _ in range(120):
            if any(p.numInputRows for p in query.recentProgress):
                break
            time.sleep(0.25)
        query.stop()
    assert sorted((r["satellite_id"], r["altitude_km"]) for r in spark.read.schema(schema).json(f"{tmp_path}/out").collect()) == [(1, 401.0), (1, 403.0), (2, 1.0)]


def test_sources(spark, tmp_path):
    with open(f"{tmp_path}/p.txt", "w") as f:
        f.write('{"message": "success"}\n')
    assert readers.read_payloads(spark, f"{tmp_path}/p.txt").first()["payload"] == '{"message": "success"}'
    writers.write_messages(spark.createDataFrame([("1", "{}")], "key string, value string"), f"{tmp_path}/log")
    assert readers.read_log(spark, f"{tmp_path}/log").count() == 1
    assert len(S.GEO_REGIONS) == 17


def until_read(query):
    for _ in range(240):
        if any(p.numInputRows for p in query.recentProgress):
            break
        time.sleep(0.25)
    query.stop()


def test_metadata_and_event_streams(spark, tmp_path):
    schema = "satellite_id int, timestamp bigint, satellite_name string, orbit_type string"
    events = "event_id string, ingested bigint, event_type string, severity string, start_time string, end_time string"
    batches = [
        ([(1, 10, "A", None), (None, 11, "x", "x")], [("e", 10, "FLR", "low", "s", None)]),
        ([(1, 20, None, "LEO")], [("e", 9, "FLR", "old", "s", None), (None, 12, "FLR", "x", "s", None)]),
        ([(1, 15, "late", None), (2, 5, "B", "GEO")], [("e", 30, "FLR", "high", "s", "t")]),
    ]
    for name in ("m", "e"):
        (tmp_path / name).mkdir()
    for meta, weather in batches:
        for name, kind, rows, make in (("m", schema, meta, jobs.latest_metadata), ("e", events, weather, jobs.live_events)):
            spark.createDataFrame(rows, kind).write.mode("append").json(f"{tmp_path}/{name}")
            stream = make(spark.readStream.schema(kind).json(f"{tmp_path}/{name}"))
            until_read(stream.writeStream.format("json").option("path", f"{tmp_path}/out-{name}").option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(processingTime="1 second").start())
    found = spark.read.schema(schema).json(f"{tmp_path}/out-m").collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, 10, "A", None), (1, 20, "A", "LEO"), (2, 5, "B", "GEO")], key=str)
    found = spark.read.schema(events).json(f"{tmp_path}/out-e").collect()
    assert sorted((r["event_id"], r["ingested"], r["severity"]) for r in found) == [("e", 10, "low"), ("e", 30, "high")]
