"""Edge cases of the operators on small tables."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from apsis import fixtures as X
from apsis import schemas as S
from apsis.functions import tle
from apsis.operators import anomaly, drift, feeds, health, marts, panes, positions, tracks, views
from apsis.sources import readers, writers
from apsis.sources.scratch import scratch_dir

SF = "/root/testdata/sf0.001"

T0 = dt.datetime(2024, 1, 15, 12)


def position(spark, rows):
    return spark.createDataFrame(rows, "satellite_id int, satellite_name string, latitude double, longitude double, altitude_km double, timestamp bigint, source string, ingestion_time string")


def test_decode_and_validate_split_rejects(spark):
    messages = spark.createDataFrame([('{"satellite_id": 1, "satellite_name": "A", "latitude": 1, "longitude": 2, "timestamp": 5}',), ("{broken",), ('{"satellite_name": "B", "latitude": 91, "longitude": 2, "timestamp": 5}',), (None,)], "value string")
    rows, malformed = positions.decode(messages, S.POSITION)
    good, bad = positions.validate_positions(rows)
    assert [r["satellite_id"] for r in good.collect()] == [1]
    assert malformed.count() == 2
    assert bad.first()["reason"] == "missing satellite_id; latitude out of bounds"


def test_enrich_keeps_rows_and_fills_altitude(spark):
    rows = position(spark, [(1, "A", 40.0, 42.0, None, 5, "x", ""), (1, "A", None, None, -3.0, 6, "x", "")])
    out = positions.enrich_positions(rows).orderBy("timestamp").collect()
    assert (out[0]["altitude_km"], out[0]["geo"]["country_code"], out[0]["orbit"]["type"]) == (408.0, "TR", "LEO")
    assert (out[1]["altitude_km"], out[1]["geo"]["country_code"], out[1]["lighting"]["in_sunlight"]) == (-3.0, "??", True)
    assert positions.enrich_positions(rows.limit(0)).count() == 0


def test_feeds_skip_what_they_should(spark):
    iss = spark.createDataFrame([('{"message": "success", "timestamp": 5, "iss_position": {"latitude": "1.5", "longitude": "x"}}', "t"), ('{"message": "failure"}', "t"), ("nonsense", "t")], "payload string, ingestion_time string")
    found = feeds.normalize_iss(iss).collect()
    assert [(r["latitude"], r["longitude"], r["altitude_km"]) for r in found] == [(1.5, None, None)]
    n2yo = spark.createDataFrame([(9, "D", '{"info": {"satname": " "}, "positions": [{"satlatitude": 1, "satlongitude": 2, "sataltitude": 0, "timestamp": 5}]}', "t"), (9, "D", '{"info": {}, "positions": []}', "t")], "satellite_id int, default_name string, payload string, ingestion_time string")
    found = feeds.normalize_n2yo(n2yo).collect()
    assert [(r["satellite_name"], r["altitude_km"], r["eclipsed"]) for r in found] == [("D", None, False)]


def windows(spark, rows):
    return spark.createDataFrame(rows, "satellite_id int, satellite_name string, avg_altitude double, min_altitude double, max_altitude double, avg_velocity double, stddev_velocity double, samples bigint").withColumn("window", F.struct(F.lit(T0).alias("start"), F.lit(T0).alias("end")))


@pytest.mark.parametrize(
    ("spread", "sd", "n", "want"),
    [(5.0, None, 3, []), (5.1, 0.0, 3, [("ALTITUDE_ANOMALY", "WARNING")]), (10.0, 0.0, 3, [("ALTITUDE_ANOMALY", "CRITICAL")]), (10.0, 0.001, 2, []), (0.0, 0.001, 3, [("VELOCITY_ANOMALY", "WARNING")]), (9.0, 0.001, 3, [("ALTITUDE_ANOMALY", "WARNING"), ("VELOCITY_ANOMALY", "WARNING")])],
)
def test_anomaly_rules(spark, spread, sd, n, want):
    stats = windows(spark, [(1, "A", 400.0, 400.0, 400.0 + spread, 7.67, sd, n)])
    found = anomaly.detect_anomalies(stats)
    assert sorted((r["alert_type"], r["severity"]) for r in found.collect()) == want
    assert found.select("alert_id").distinct().count() == len(want)


def test_one_sample_is_in_six_windows(spark):
    rows = spark.createDataFrame([(1, "A", 400.0, 7.6, T0)], "satellite_id int, satellite_name string, altitude_km double, velocity_km_s double, event_time timestamp")
    assert anomaly.sliding_stats(rows).count() == 6


def test_correlation_modes(spark):
    alerts = anomaly.detect_anomalies(windows(spark, [(1, "A", 400.0, 400.0, 420.0, 7.6, 0.0, 3), (2, "B", 400.0, 400.0, 420.0, 7.6, 0.0, 3)]))
    event = lambda i, level, start, end: (i, "FLR", start, end, level, "t")
    events = spark.createDataFrame([event("e1", "extreme", "2024-01-15T11:00:00Z", None), event("e1", "extreme", "2024-01-15T11:00:00Z", None), event("e2", "high", "2024-01-01T00:00:00Z", "2024-01-01T01:00:00Z"), event("e3", "low", "2024-01-15T11:00:00Z", None)], "event_id string, event_type string, start_time string, end_time string, severity string, ingestion_time string")
    every = anomaly.correlate_space_weather(alerts, events, "all")
    assert every.count() == 4
    assert {(r["details"]["event_id"], r["severity"]) for r in every.collect()} == {("e1", "CRITICAL"), ("e2", "WARNING")}
    assert {r["details"]["event_id"] for r in anomaly.correlate_space_weather(alerts, events, "overlap").collect()} == {"e1"}
    with pytest.raises(ValueError):
        anomaly.correlate_space_weather(alerts, events, "all", max_events=1)
    assert anomaly.all_alerts(alerts, every).count() == 6


def test_all_events_are_correlated_beyond_ten_thousand(spark):
    alerts = anomaly.detect_anomalies(windows(spark, [(k, "A", 400.0, 400.0, 420.0, 7.6, 0.0, 3) for k in (1, 2, 3)] + [(3, None, 400.0, 400.0, 420.0, 7.6, 0.0, 3)]))
    events = spark.range(10_500).selectExpr("concat('e', id) AS event_id", "'FLR' AS event_type", "'2024-01-15T11:00:00Z' AS start_time", "CAST(NULL AS string) AS end_time", "CASE WHEN id % 3 = 0 THEN 'extreme' ELSE 'high' END AS severity", "'t' AS ingestion_time")
    every = anomaly.correlate_space_weather(alerts, events, "all")
    assert "BroadcastNestedLoop" not in (plan := every._jdf.queryExecution().toString()) and "CartesianProduct" not in plan
    found = every.groupBy("satellite_id", "satellite_name", "severity").agg(F.count("*").alias("n"), F.count_distinct("details.event_id").alias("events")).collect()
    assert {(r["satellite_id"], r["satellite_name"], r["severity"], r["n"], r["events"]) for r in found} == {(k, name, level, n, n) for k, name in ((1, "A"), (2, "A"), (3, "A"), (3, None)) for level, n in (("CRITICAL", 3500), ("WARNING", 7000))}
    assert anomaly.correlate_space_weather(alerts, events.limit(0), "all").count() == 0


def lines(spark, rows):
    """TLE rows with right checksums: (satellite, epoch, inclination, mean motion)."""
    base = spark.createDataFrame(rows, "satellite_id int, epoch string, inc string, mm string")
    one = F.concat(F.lit("1 25544U 98067A   "), "epoch", F.lit("  .00001000  00000-0  10270-3 0  999"))
    two = F.concat(F.lit("2 25544 "), F.lpad("inc", 8, " "), F.lit(" 130.5360 0006703  30.2776 325.0288 "), F.lpad("mm", 11, " "), F.lit("56353"))
    closed = lambda c: F.concat(c, tle.checksum(c).cast("string"))
    return base.select("satellite_id", F.lit("ISS").alias("satellite_name"), closed(one).alias("tle_line1"), closed(two).alias("tle_line2"), F.col("epoch").alias("ingestion_time"))


def test_tle_rejects(spark):
    rows = lines(spark, [(1, "24015.50000000", "51.6400", "15.50000000")])
    broken = rows.withColumn("tle_line1", F.substring("tle_line1", 1, 68)).unionByName(rows.withColumn("tle_line2", F.lit(" "))).unionByName(rows.withColumn("tle_line1", F.concat(F.substring("tle_line1", 1, 68), F.lit("x")))).unionByName(rows.withColumn("tle_line1", F.lit(None).cast("string")))
    good, bad = drift.parse_tle(rows.unionByName(broken))
    assert good.count() == 1
    assert sorted(r["reason"] for r in bad.collect()) == ["checksum", "incomplete", "incomplete", "length"]
    assert drift.parse_tle(rows.unionByName(broken), strict=False)[0].count() == 2


def test_drift_and_report(spark):
    rows = lines(spark, [(1, "24015.50000000", "51.6400", "15.50000000"), (1, "24016.50000000", "51.6800", "15.50000000"), (1, "24016.50000000", "51.6900", "15.50000000"), (2, "24015.50000000", "51.6400", "15.50000000")])
    elements = drift.parse_tle(rows)[0]
    found = drift.tle_drift(elements).collect()
    assert [(r["satellite_id"], r["dt_days"], r["inclination_drift"]) for r in found] == [(1, 1.0, 0.04)]
    report = {r["satellite_id"]: r for r in drift.drift_report(elements).collect()}
    assert report[1]["anomaly_flags"] == ["INCLINATION_CHANGE at 2024-01-16T12:00:00Z"]
    assert report[1]["tle_count"] == 3 and report[1]["anomaly_detected"]
    assert report[2]["drift_analysis"] == [] and not report[2]["anomaly_detected"]
    assert drift.in_week(elements, "2024-03").count() == 4 and drift.in_week(elements, "2024-04").count() == 0


def test_angles_wrap_only_on_request(spark):
    rows = spark.createDataFrame([(1, T0, 15.5, 51.0, 0.001, 359.0, 10.0, 0.0), (1, T0 + dt.timedelta(days=1), 15.5, 51.0, 0.001, 1.0, 10.0, 0.0)], "satellite_id int, epoch_time timestamp, mean_motion double, inclination double, eccentricity double, raan double, arg_perigee double, bstar double")
    assert drift.tle_drift(rows).first()["raan_drift"] == -358.0
    assert drift.tle_drift(rows, wrap=True).first()["raan_drift"] == 2.0


def test_changed_lines(spark):
    rows = spark.createDataFrame([(1, x, "b", str(k)) for k, x in enumerate("AABA")], "satellite_id int, tle_line1 string, tle_line2 string, ingestion_time string")
    assert [r["tle_line1"] for r in drift.changed_tles(rows).orderBy("ingestion_time").collect()] == ["A", "B", "A"]


def test_views(spark):
    rows = spark.createDataFrame([(1, 400.0, T0, 1), (1, 410.0, T0 + dt.timedelta(seconds=5), 2), (2, 300.0, T0 - dt.timedelta(hours=1), 3), (None, 1.0, T0, 4)], "satellite_id int, altitude_km double, event_time timestamp, n int")
    now = F.lit(T0 + dt.timedelta(seconds=10))
    live = views.latest_position(rows, now)
    assert [(r["satellite_id"], r["altitude_km"]) for r in live.collect()] == [(1, 410.0)]
    batch = views.latest_position(rows, now, "10 days")
    assert {(r["satellite_id"], r["layer"]) for r in views.merged_position(live, batch).collect()} == {(1, "live"), (2, "batch")}
    alerts = spark.createDataFrame([(f"a{k}", 1, T0 + dt.timedelta(seconds=k)) for k in range(5)] + [(None, 1, T0)], "alert_id string, satellite_id int, detected_time timestamp")
    found = views.recent_alerts(alerts, now, per_satellite=2)
    assert sorted(r["alert_id"] for r in found.collect()) == ["a3", "a4"]
    assert views.alert_details(spark.createDataFrame([("a1",), ("gone",)], "alert_id string"), alerts).count() == 1
    with pytest.raises(ValueError):
        views.newest(alerts, "detected_time", "alert_id", 0)
    known = views.satellite_metadata(rows, now, ["altitude_km"], "10 days")
    assert views.satellites(known.select("satellite_id", "last_seen"), live).count() == 2


def test_active_and_first_seen_events(spark):
    events = spark.createDataFrame([("e1", "2024-01-15T08:00:00Z", T0, "t1"), ("e1", "2024-01-15T08:00:00Z", T0, "t2"), ("old", None, T0 - dt.timedelta(days=4), "t0"), (None, None, T0, "t0")], "event_id string, start_time string, ingested timestamp, ingestion_time string")
    now = F.lit(T0 + dt.timedelta(seconds=1))
    assert [r["event_id"] for r in views.active_events(events, now).collect()] == ["e1"]
    assert views.active_count(events, now).first()["active_events"] == 1
    assert {(r["event_id"], r["ingestion_time"]) for r in views.first_seen(events).collect()} == {("e1", "t1"), ("old", "t0")}


def test_marts_on_an_empty_day(spark):
    empty = positions.enrich_positions(position(spark, []))
    assert marts.satellite_stats(empty).count() == 0
    assert marts.orbit_health(empty).count() == 0
    assert marts.daily_summary(marts.satellite_stats(empty)).first()["satellites_tracked"] == 0


def test_health(spark):
    rows = position(spark, [(1, "A", 1.0, 2.0, 400.0, int(T0.replace(tzinfo=dt.UTC).timestamp()), "x", "")])
    table = positions.enrich_positions(rows)
    assert health.partition_ready(table, "2024-01-15") and not health.partition_ready(table, "2024-01-16")
    assert [str(r["date"]) for r in health.missing_partitions(table, "2024-01-14", "2024-01-16").orderBy("date").collect()] == ["2024-01-14", "2024-01-16"]
    status = lambda s: health.feed_health(table, F.lit(T0 + dt.timedelta(seconds=s))).first()["status"]
    assert [status(30), status(31), status(121)] == ["healthy", "lagging", "stalled"]
    assert health.freshness_alerts(table, "2024-01-15", "2024-01-16", "positions", F.lit(T0)).first()["severity"] == "WARNING"


def test_tracked_satellites(spark):
    lists = spark.createDataFrame([("25544, x,,99999",)], "satellites string")
    catalogue = spark.createDataFrame(list(S.CATALOGUE.items()), "satellite_id int, satellite_name string")
    assert {tuple(r) for r in positions.tracked_satellites(lists, catalogue).collect()} == {(25544, "ISS"), (99999, "SAT-99999")}


def test_previous_rows_over_chunks(spark):
    rows = [(k % 3 if k % 5 else None, k, float(k * 7 % 11)) for k in range(90)] + [(1, None, 0.5), (1, None, 0.25), (7, 5, None)]
    table = spark.createDataFrame(rows, "k int, t int, v double")
    got = tracks.with_previous(table, "k", ["t", "v"], ["v"], F.floor(F.col("t") / 10), "before").select("k", "t", "v", F.col("before.v").alias("before"), F.col("before").isNull().alias("first"))
    track = Window.partitionBy("k").orderBy("t", "v")
    want = table.select("k", "t", "v", F.lag("v").over(track).alias("before"), (F.row_number().over(track) == 1).alias("first"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_lines_are_decoded_once_a_row(spark, tmp_path):
    rows = X.tle_rows(spark, SF).drop("event_type").withColumn("date", F.to_date("ingestion_time"))
    rows.write.partitionBy("date").json(f"{tmp_path}/tle")
    elements = drift.parse_tle(readers.read_tles(spark, f"{tmp_path}/tle")[0])[0]
    plan = drift.drift_report(elements)._jdf.queryExecution().optimizedPlan().toString()
    # Two scans of what is read twice; each decodes a line's checksums and fields once.
    assert plan.count("from_json") == 0 and plan.count("_fault") and plan.count("Generate inline") == 2
    assert plan.count("translate(") <= 2 * 2 * 4
    weather = feeds.normalize_events(X.event_payloads(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert weather.count("from_json(") == 1


def test_feeds_file_what_is_no_json(spark):
    payloads = spark.createDataFrame([(1, "A", '{"name": " ", "line1": " 1 x ", "line2": "2 y"}', "t"), (2, "B", '{"name": "b", "line1": "", "line2": "2"}', "t"), (3, "C", "{broken", "t"), (4, "D", None, "t"), (5, "E", '{"line1": "1"}', "t")], "satellite_id int, default_name string, payload string, ingestion_time string")
    good = feeds.normalize_tle(payloads).collect()
    assert [(r["satellite_id"], r["satellite_name"], r["tle_line1"], r["tle_line2"]) for r in good] == [(1, "A", "1 x", "2 y")]
    assert sorted((r["reason"], r["raw"]) for r in feeds.rejected(payloads, "tle").collect()) == [("malformed JSON", "{broken"), ("no payload", None)]
    events = spark.createDataFrame([("FLR", '{"flrID": "f", "startTime": "2024-01-01T00:00Z"}', "t"), ("FLR", "[1, 2", "t")], "event_type string, payload string, ingestion_time string")
    assert feeds.normalize_events(events).count() == 1 and feeds.rejected(events, "donki").count() == 1


def test_ids_may_come_under_an_alias(spark):
    rows = spark.read.json(spark.sparkContext.parallelize(['{"satellite_id": 1, "satelliteName": "A"}', '{"satelliteId": 2, "satellite_name": "B"}', '{"satellite_id": 0, "satelliteId": 3, "satellite_name": "", "satelliteName": "C"}', '{"satellite_name": "none"}']))
    assert sorted(tuple(r) for r in views.with_ids(rows).select("satellite_id", "satellite_name").collect()) == [(1, "A"), (2, "B"), (3, "C")]


def test_active_events_are_listed_by_start(spark):
    events = spark.createDataFrame([("a", "2024-01-01"), ("b", None), ("c", "2024-01-03"), ("d", "2024-01-03")], "event_id string, start_time string")
    assert [r["event_id"] for r in views.listed_events(events).collect()] == ["c", "d", "a", "b"]


def test_points_meet_the_first_of_overlapping_boxes_once(spark):
    points = spark.createDataFrame([(1, 5.0, 5.0), (1, 5.0, 5.0), (2, 50.0, 50.0), (3, None, 1.0), (4, 10.0, -10.0)], "p int, latitude double, longitude double").withColumn("name", F.lit("own"))
    boxes = spark.createDataFrame([(2, 0.0, 20.0, -20.0, 20.0, "B", "b", "r"), (1, 4.0, 6.0, 4.0, 6.0, "A", "a", "r")], "priority int, lat_min double, lat_max double, lon_min double, lon_max double, code string, name string, region string")
    got = positions.geo_join(points, boxes)
    assert sorted((r["p"], r["country_code"]) for r in got.collect()) == [(1, "A"), (1, "A"), (2, None), (3, None), (4, "B")]
    assert "Exchange hashpartitioning(_n" not in got._jdf.queryExecution().executedPlan().toString()


def test_archive_folders_are_dealt_over_tasks(spark, tmp_path):
    enriched = positions.enrich_positions(X.positions(spark, SF))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # which would join such small tasks again
    try:
        writers.write_positions_archive(enriched, f"{tmp_path}/a", by=("date",), tasks=3)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    table = spark.read.parquet(f"{tmp_path}/a")
    counts = health.partition_counts(table, files=True).collect()
    assert sum(r["rows"] for r in counts) == enriched.count() and 1 < max(r["files"] for r in counts) <= 3


def test_scratch_folder_must_be_shared_on_a_cluster():
    class Fake:
        def __init__(self, master, folder):
            self.sparkContext = type("C", (), {"master": master})
            self.conf = type("C", (), {"get": staticmethod(lambda key, default: folder)})

    assert scratch_dir(Fake("spark://x", "file:///s/")) == "file:///s" and scratch_dir(Fake("local[4]", None)).startswith("file:")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(Fake("spark://x", None))


def test_window_figures_do_not_depend_on_how_rows_are_dealt(spark):
    # Satellite 1 has one speed in many partial sums, satellite 2 a mean at exactly two standard deviations, satellite 3 one just beyond.
    at = dt.datetime(2024, 1, 15)
    same, tied, over = [7.669] * 120, [7.664, 7.668, 7.672], [7.664, 7.669, 7.672]
    for order in itertools.permutations(range(3)):
        rows = [(1, v) for v in same] + [(2, tied[k]) for k in order] + [(3, over[k]) for k in order]
        for tasks in (1, 7):
            flat = spark.createDataFrame([(k, "A", at, 408.0, v) for k, v in rows], "satellite_id int, satellite_name string, event_time timestamp, altitude_km double, velocity_km_s double").repartition(tasks)
            for stats in (anomaly.sliding_stats(flat, "2 days", "2 days"), panes.sliding_panes(flat, "2 days", "2 days")):
                found = {r["satellite_id"]: r for r in stats.collect()}
                assert found[1]["stddev_velocity"] == 0 and (found[2]["avg_velocity"], found[2]["stddev_velocity"]) == (7.668, 0.004)
                assert [r["satellite_id"] for r in anomaly.detect_anomalies(stats).collect()] == [3]


def test_three_speeds_at_the_limit_are_judged_in_order_of_time(spark):
    # Exactly two deviations above or below 7.66; which orders alert is what the SQL says of rows in that order, read by one thread.
    duck = duckdb.connect(config={"threads": 1})
    orders = [o for speeds in ((7.664, 7.668, 7.672), (7.648, 7.652, 7.656)) for o in itertools.permutations(speeds)]
    rows = [(k, j, v) for k, o in enumerate(orders) for j, v in enumerate(o)]
    duck.execute("CREATE TABLE speeds (k INTEGER, j INTEGER, v DOUBLE)")
    duck.executemany("INSERT INTO speeds VALUES (?, ?, ?)", rows)
    want = {k for (k,) in duck.execute("SELECT k FROM speeds GROUP BY k HAVING stddev_samp(v) > 0 AND abs(avg(v) - 7.66) / stddev_samp(v) > 2").fetchall()}
    assert 0 in want and 0 < len(want) < len(orders)
    for tasks in (1, 5):
        flat = spark.createDataFrame([(k, "A", T0 + dt.timedelta(hours=j), 408.0, v) for k, j, v in rows], "satellite_id int, satellite_name string, event_time timestamp, altitude_km double, velocity_km_s double").orderBy(F.rand(tasks)).repartition(tasks)
        for stats in (anomaly.sliding_stats(flat, "2 days", "2 days"), panes.sliding_panes(flat, "2 days", "12 hours"), panes.sliding_panes(flat, "4 hours", "1 hour")):
            whole = stats.where("samples = 3")
            assert whole.count() >= len(orders)
            assert {r["satellite_id"] for r in anomaly.detect_anomalies(whole).collect()} == want


def test_correlations_are_counted_without_pairs(spark):
    r = random.Random(5)
    hour = lambda h: T0 + dt.timedelta(hours=h)
    iso = lambda h: hour(h).strftime("%Y-%m-%dT%H:%M:%SZ")
    alerts = spark.createDataFrame([(s, f"{s}{n}" if n else None, (hour(h), hour(h + 48))) for s in range(6) for n in range(3) for h in r.sample(range(0, 200, 4), 9)] * 2 + [(None, "X", (hour(8), hour(56)))], "satellite_id int, satellite_name string, window struct<start: timestamp, end: timestamp>")
    spans = [(k, b, b + r.choice([0, 1, 3, 40, 90])) for k, b in enumerate(r.choices(range(-20, 210), k=80))]
    events = spark.createDataFrame([(f"E{k}", r.choice(["high", "extreme", "low"]), iso(b), None if k % 9 == 0 else "9999-12-31T23:59:59Z" if k % 11 == 0 else iso(e), "t") for k, b, e in spans] * 2 + [("none", "high", None, None, "t")], "event_id string, severity string, start_time string, end_time string, ingestion_time string")
    got = lambda rows: sorted((r["satellite_id"] or -1, r["severity"], r["correlations"], r["events"] if "events" in rows.columns else 0) for r in rows.collect())
    for mode, count in (("overlap", anomaly.count_overlapping_weather), ("all", anomaly.count_space_weather)):
        pairs = anomaly.correlate_space_weather(alerts, events, mode).groupBy("satellite_id", "severity").agg(F.count("*").alias("correlations"), *[F.count_distinct("details.event_id").alias("events")] * (mode == "overlap"))
        assert got(count(alerts, events)) == got(pairs) and got(pairs)
        assert count(alerts, events.limit(0)).count() == count(alerts.limit(0), events).count() == 0
