"""Pane windows, intervals, keyed state, commits and manifests, and the SQL functions."""

from __future__ import annotations

import collections
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from apsis import fixtures as X
from apsis import stream_queries as SQ
from apsis.functions import orbit, tle
from apsis.functions import sql as sql_functions
from apsis.operators import anomaly, drift, intervals, marts, panes, positions
from apsis.sources import commits
from apsis.streaming import correlate, jobs, state

SF = "/root/testdata/sf0.001"
BASE = int(dt.datetime(2024, 1, 15, 12, tzinfo=dt.UTC).timestamp())


# --- Panes --------------------------------------------------------------------------------------------------------


def flat_rows(spark):
    r = random.Random(2)
    rows = [(k % 3, f"S{k % 3}", None if k % 11 == 0 else 400.0 + r.random() * 9, 7.66 if k % 3 == 0 else r.choice([None, 7.5, 7.7, 7.9]), BASE + r.randrange(4000)) for k in range(500)]
    return spark.createDataFrame(rows, "satellite_id int, satellite_name string, altitude_km double, velocity_km_s double, s bigint").withColumn("event_time", F.timestamp_seconds("s"))


def figures(rows):
    shown = lambda x: None if x is None else round(x, 9) if isinstance(x, float) and math.isfinite(x) else x
    return sorted((str(r["window"]), r["satellite_id"], *[shown(r[c]) for c in ("avg_altitude", "min_altitude", "max_altitude", "avg_velocity", "stddev_velocity", "samples")]) for r in rows.collect())


@pytest.mark.parametrize(("size", "slide"), [("60 seconds", "10 seconds"), ("1 hour", "5 minutes"), ("10 seconds", "10 seconds")])
def test_panes_give_the_same_windows(spark, size, slide):
    rows = flat_rows(spark)
    got = panes.sliding_panes(rows, size, slide)
    want = anomaly.sliding_stats(rows, size, slide)
    assert figures(got) == figures(want)
    # Satellite 0 has one speed: its spread is 0 here, where a running variance may leave a rounding error to alert on.
    alerts = lambda stats: sorted(r["alert_id"] for r in anomaly.detect_anomalies(stats.where("satellite_id > 0")).collect())
    assert alerts(got) == alerts(want)
    assert got.where("satellite_id = 0 AND stddev_velocity > 0").count() == 0
    assert panes.sliding_panes(rows.limit(0), size, slide).count() == 0


def test_windows_are_repeated_behind_the_last_shuffle(spark):
    plan = panes.sliding_panes(flat_rows(spark), "60 seconds", "10 seconds")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = lambda *words: [k for k, line in enumerate(plan) if all(w in line for w in words)]
    repeated, dealt, counted = at("Generate", "filter"), at("RepartitionByExpression"), at("Aggregate")
    # From the top: windows, their repetition, the shuffle, panes. Rows are aggregated before any of it.
    assert len(repeated) == 1 and counted[0] < repeated[0] < dealt[0] < counted[-1]
    assert not [k for k in at("Generate") if k > counted[-1]]
    with pytest.raises(ValueError):
        panes.sliding_panes(flat_rows(spark), "25 seconds", "10 seconds")


def test_panes_of_a_stream(spark, tmp_path):
    rows = flat_rows(spark)
    for k in range(4):
        rows.where((F.col("s") >= BASE + 1000 * k) & (F.col("s") < BASE + 1000 * (k + 1))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows.limit(1).withColumn("event_time", F.timestamp_seconds(F.lit(BASE + 10**6))).withColumn("satellite_id", F.lit(99)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = panes.sliding_panes(stream, "60 seconds", "10 seconds", watermark="30 seconds")
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out")
    assert figures(got) == figures(anomaly.sliding_stats(rows, "60 seconds", "10 seconds"))


# --- Intervals ----------------------------------------------------------------------------------------------------


def test_cells_cover_a_span_once(spark):
    r = random.Random(7)
    spans = [(a, a + r.choice([0, 1, 4095, 4096, 5000, 10**5, 10**7, 10**9])) for a in [0, 1, 4095, 4096, -4096, -1, *[r.randrange(2 * 10**9) for _ in range(60)]]]
    df = spark.createDataFrame(spans, "a bigint, b bigint").select("a", "b", intervals.cells(F.timestamp_seconds("a"), F.timestamp_seconds("b")).alias("c"))
    for row in df.collect():
        lo, hi = row["a"] // 4096, row["b"] // 4096
        covered = sorted((c["cell"] << c["level"], (c["cell"] + 1) << c["level"]) for c in row["c"])
        assert covered[0][0] == lo and covered[-1][1] == hi + 1 and all(x[1] == y[0] for x, y in zip(covered, covered[1:], strict=False))
        assert len(covered) <= 2 * max(1, (hi - lo + 1).bit_length())


def test_points_within_spans(spark):
    r = random.Random(8)
    points = [(k, BASE + r.randrange(10**6)) for k in range(200)] + [(900, None)]
    spans = [(k, BASE + r.randrange(10**6), r.choice([0, 10, 5000, 10**5])) for k in range(60)] + [(901, None, 5), (902, BASE, -10)]
    p = spark.createDataFrame(points, "p int, s bigint").select("p", F.timestamp_seconds("s").alias("at"))
    q = spark.createDataFrame(spans, "q int, s bigint, n bigint").select("q", F.timestamp_seconds("s").alias("lo"), F.timestamp_seconds(F.col("s") + F.col("n")).alias("hi"))
    got = sorted((x["p"], x["q"]) for x in intervals.within(p, "at", q, "lo", "hi").collect())
    assert got == sorted((a, b) for a, s in points for b, t, n in spans if s is not None and t is not None and t <= s <= t + n) and got
    assert intervals.within(p, "at", q.limit(0), "lo", "hi").count() == 0


def test_an_endless_event_is_no_burden(spark):
    cells = spark.range(1).select(F.explode(intervals.cells(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("9999-12-31 23:59:59").cast("timestamp"))))
    assert cells.count() < 64
    alerts = spark.createDataFrame([(1, "A", (dt.datetime(2030, 5, 1), dt.datetime(2030, 5, 2)))], "satellite_id int, satellite_name string, window struct<start: timestamp, end: timestamp>")
    events = spark.createDataFrame([(f"E{k}", "high", "2024-01-01T00:00:00Z", "9999-12-31T23:59:59Z", "t") for k in range(50)], "event_id string, severity string, start_time string, end_time string, ingestion_time string")
    assert anomaly.correlate_space_weather(alerts, events, mode="overlap").count() == 50


# --- Streams with state -------------------------------------------------------------------------------------------


def run(rows, where, mode="append"):
    got = []
    query = rows.writeStream.outputMode(mode).foreachBatch(lambda b, k: got.extend((k, r) for r in b.collect())).option("checkpointLocation", f"{where}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    return got


def files(spark, rows, schema, where):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)


def test_correlation_of_two_streams_waits_and_forgets(spark, tmp_path):
    window, event = "satellite_id int, satellite_name string, window struct<start: timestamp, end: timestamp>", "event_id string, severity string, start_time string, end_time string"
    at = lambda h: dt.datetime(2024, 1, 15) + dt.timedelta(hours=h)
    iso = lambda h: at(h).strftime("%Y-%m-%dT%H:%M:%SZ")
    alert = lambda s, h: (s, f"S{s}", (at(h), at(h + 1)))
    files(spark, [alert(1, 1), alert(1, 1)], window, f"{tmp_path}/a")
    files(spark, [alert(2, 5), alert(3, 30)], window, f"{tmp_path}/a")
    files(spark, [("B", "extreme", iso(4), None), ("C", "low", iso(0), iso(50))], event, f"{tmp_path}/e")
    files(spark, [("A", "high", iso(0), iso(2)), ("A", "high", iso(0), iso(2)), ("B", "extreme", iso(4), None), (None, "high", iso(0), iso(9))], event, f"{tmp_path}/e")  # A comes after its alert, and late
    read = lambda s, p: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{p}")
    met = correlate.correlated(read(window, "a"), read(event, "e"), hours=72, longest="4 days", alerts_late="1 day", events_late="1 day")
    got = run(met, tmp_path)
    assert sorted((r["event_id"], r["satellite_id"], r["severity"]) for _, r in got) == [("A", 1, "WARNING"), ("B", 2, "CRITICAL"), ("B", 3, "CRITICAL")]
    # Far later rows move both watermarks; the state of what has passed goes.
    files(spark, [alert(9, 2000)], window, f"{tmp_path}/a")
    files(spark, [("Z", "low", iso(2000), None), ("Y", "high", iso(2000), iso(2001))], event, f"{tmp_path}/e")
    query = met.writeStream.foreachBatch(lambda b, k: b.collect() and None).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    joined = [o["numRowsTotal"] for o in query.lastProgress["stateOperators"] if o["operatorName"] == "symmetricHashJoin"]
    assert joined and joined[0] < 20


def test_recent_lists_are_bounded_and_restart(spark, tmp_path):
    schema = "k int, at bigint, id string"
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    lists = lambda: state.recent_lists(read(), "k", "at", "id", most=3, ttl_seconds=None)
    files(spark, [(1, k, f"a{k}") for k in range(20)] + [(2, 5, "x"), (2, 5, "b"), (None, 1, "n"), (3, None, "n")], schema, f"{tmp_path}/in")
    first = run(lists(), tmp_path, "update")
    assert sorted((r["k"], r["rank"], r["id"], r["version"]) for _, r in first) == [(1, 1, "a19", 1), (1, 2, "a18", 1), (1, 3, "a17", 1), (2, 1, "b", 1), (2, 2, "x", 1)]
    files(spark, [(1, 3, "old"), (2, 9, "x"), (2, 1, "c")], schema, f"{tmp_path}/in")  # key 1 does not change; x is newer now
    second = run(lists(), tmp_path, "update")
    assert sorted((r["k"], r["rank"], r["id"], r["at"], r["version"]) for _, r in second) == [(2, 1, "x", 9, 2), (2, 2, "b", 5, 2), (2, 3, "c", 1, 2)]
    pushed = spark.createDataFrame([r for _, r in first + second])
    newest = sorted((r["k"], r["rank"], r["id"]) for r in state.latest_lists(pushed, "k").collect())
    assert newest == [(1, 1, "a19"), (1, 2, "a18"), (1, 3, "a17"), (2, 1, "x"), (2, 2, "b"), (2, 3, "c")]
    held = sorted((r["k"], r["id"]) for r in state.read_lists(spark, f"{tmp_path}/cp").collect())
    assert held == sorted((k, i) for k, _, i in newest)


def test_state_starts_from_a_table(spark, tmp_path):
    schema = "k int, at bigint, v double"
    old = spark.createDataFrame([(1, 10, 1.0), (2, 10, None), (3, 50, 3.0), (None, 1, 0.0)], schema)
    files(spark, [(1, 20, 1.5), (3, 40, 9.0), (4, 5, 4.0), (4, 5, None)], schema, f"{tmp_path}/in")
    files(spark, [(1, 15, 0.0), (2, 10, 2.0)], schema, f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run(state.latest_since(stream, "k", "at", ("v",), initial=old), tmp_path, "update")
    got = {r["k"]: (r["at"], r["v"]) for r in state.read_state(spark, f"{tmp_path}/cp").collect()}
    assert got == {1: (20, 1.5), 2: (10, 2.0), 3: (50, 3.0), 4: (5, 4.0)}
    before = {r["k"]: (r["at"], r["v"]) for r in state.read_state(spark, f"{tmp_path}/cp", batch=0).collect()}
    assert before[2] == (10, None)


# --- Commits ------------------------------------------------------------------------------------------------------


def test_half_a_batch_is_not_seen(spark, tmp_path):
    rows = X.positions(spark, SF).drop("event_id").where("satellite_id = 1")
    n = rows.count()
    positions.to_messages(rows, "satellite_id").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("key string, value string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    go = lambda: jobs.start_committed_enrichment(stream(), f"{tmp_path}/live", f"{tmp_path}/cp").awaitTermination()
    go()
    seen = lambda sink: commits.committed(spark, f"{tmp_path}/live", sink).count()
    assert seen("archive") == seen("topic") == n and seen("rejects") == 0

    def broken(folder):
        raise RuntimeError("the sink went away")

    folder = f"{tmp_path}/live"
    more = spark.read.parquet(f"{folder}/archive/batch=0")
    sinks = {"archive": lambda f: more.write.mode("overwrite").parquet(f)}
    with pytest.raises(RuntimeError):
        commits.commit_batch(spark, folder, 1, sinks | {"topic": broken})
    assert spark.read.parquet(f"{folder}/archive").count() == 2 * n  # written, but
    assert seen("archive") == n and seen("topic") == n
    topic = spark.read.parquet(f"{folder}/topic/batch=0")
    for _ in range(2):  # written again after the restart, and only once however often it is tried
        commits.commit_batch(spark, folder, 1, sinks | {"topic": lambda f: topic.write.mode("overwrite").parquet(f)})
    assert seen("archive") == seen("topic") == 2 * n


def test_days_behind_a_manifest(spark, tmp_path):
    root, schema = str(tmp_path), "satellite_id int, timestamp bigint, date date"
    day = lambda d, n, s: spark.range(n).select(F.lit(s).alias("satellite_id"), F.col("id").alias("timestamp"), F.lit(d).cast("date").alias("date"))
    assert commits.read_days(spark, root, schema).count() == 0
    assert commits.append_days(day("2024-01-01", 10, 1).unionByName(day("2024-01-02", 5, 1)), root) == 1
    assert commits.append_days(day("2024-01-01", 7, 2), root) == 2
    old = commits.read_days(spark, root, schema)
    assert commits.compact_days(spark, root, schema, "2024-01-01", "2024-01-31") == 3
    counts = lambda df: {str(r["date"]): r["count"] for r in df.groupBy("date").count().collect()}
    assert counts(old) == counts(commits.read_days(spark, root, schema)) == {"2024-01-01": 17, "2024-01-02": 5}  # a reader that began before
    assert commits.read_days(spark, root, schema, start="2024-01-02").count() == 5
    assert commits.read_days(spark, root, schema, version=1).count() == 15
    assert commits.compact_days(spark, root, schema, "2024-01-01", "2024-01-31") == 3  # nothing left to do
    seen, days = commits.manifest(spark, root)
    commits.append_days(day("2024-01-03", 1, 1), root)
    with pytest.raises(RuntimeError):  # a writer that read before that
        commits._publish(spark, root, seen, days)
    assert commits.vacuum(spark, root, keep=2) == 1
    assert commits.read_days(spark, root, schema).count() == 23


# --- SQL functions, drift partials, sketches ----------------------------------------------------------------------


def test_sql_functions(spark):
    sql_functions.register(spark)
    points = [(a, o, h, t) for a in (None, -95.0, 0.0, 41.3, 52.0) for o in (None, -80.0, 12.5, 100.0) for h in (None, -3.0, 0.0, 408.0, 35786.0, 35800.0, 9e4) for t in (None, BASE)]
    df = spark.createDataFrame(points, "a double, o double, h double, t bigint")
    got = df.selectExpr("filled_altitude(h)", "orbit_type(h)", "velocity_km_s(h)", "period_minutes(h)", "in_sunlight(a, o, t)", "geo_region(a, o)")
    c = F.col
    want = df.select(orbit.filled_altitude(c("h")), orbit.orbit_type(c("h")), orbit.velocity_km_s(c("h")), orbit.period_minutes(c("h")), orbit.in_sunlight(c("a"), c("o"), c("t")), orbit.geo(c("a"), c("o")))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    texts = spark.createDataFrame([(x,) for x in ("24015.50000000", "57001.0", "56366.99999999", "bad", "", " 10270-3", "-11606-4", "+", "-", "00000+0", "1 25544U 98067A   24015.5-", None)], "x string")
    got = texts.selectExpr("tle_epoch(x)", "tle_decimal(x)", "tle_checksum(x)").collect()
    want = texts.select(tle.epoch_timestamp(c("x")), tle.packed_decimal(c("x")), tle.checksum(c("x"))).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_weekly_partials_add_up(spark):
    elements = drift.parse_tle(X.tle_rows(spark, SF))[0]
    whole = {r["satellite_id"]: r for r in drift.drift_report(elements).collect()}
    parts = drift.drift_partials(elements)
    merged = {r["satellite_id"]: r for r in drift.merged_report(parts).collect()}
    assert merged.keys() == whole.keys()
    weeks = collections.defaultdict(list)
    for r in sorted(parts.collect(), key=lambda r: (r["satellite_id"], r["week"])):
        weeks[r["satellite_id"]] += [(r["drift_analysis"], r["anomaly_flags"])]
        assert len(r["drift_analysis"]) <= r["tle_count"]
    for s, r in whole.items():
        assert [d for ds, _ in weeks[s] for d in ds] == r["drift_analysis"] and [f for _, fs in weeks[s] for f in fs] == r["anomaly_flags"]
        assert merged[s]["analysis_period"] == r["analysis_period"] and merged[s]["tle_count"] == r["tle_count"] and merged[s]["anomaly_detected"] == r["anomaly_detected"]
        assert merged[s]["summary"]["mean_mean_motion"] == pytest.approx(r["summary"]["mean_mean_motion"], abs=2e-6)


def test_sketches_unite(spark):
    rows = spark.range(40_000).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 7).cast("int")).alias("date"), F.lit(1).alias("satellite_id"), (F.col("id") % 9000).alias("v"))
    got = marts.united_counts(marts.distinct_sketches(rows, F.col("v")), "satellite_id").first()["distinct"]
    assert abs(got - 9000) <= 9000 * 0.065



# --- Landing, polls, decoding -------------------------------------------------------------------------------------


def test_slices_of_a_landing_are_several_files_and_one_trigger(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(SQ, "ROWS_PER_FILE", 50)
    # Most rows lie in the first slice, two in the third and none in the last but one row.
    rows = spark.createDataFrame([(k, k % 100) for k in range(700)] + [(700, 250), (701, 260), (702, 400)], "id bigint, at bigint")
    folder, schema, _ = SQ.landed(rows, "test", "at")
    assert SQ._files(spark, folder) == 4 * 4
    got = run(SQ.replayed(spark, folder, schema), tmp_path)
    slices = {}
    for batch, r in got:
        slices.setdefault(batch, []).append(r["id"])
    assert sorted(i for ids in slices.values() for i in ids) == list(range(703))
    assert {b: (min(i), max(i)) for b, i in slices.items()} == {0: (0, 699), 2: (700, 701), 3: (702, 702)}


def test_events_of_one_id_and_two_places_are_two(spark, tmp_path):
    schema = "event_id string, source_location string, event_time timestamp"
    at = dt.datetime(2024, 1, 15)
    files(spark, [("A", "1", at), ("A", "2", at)], schema, f"{tmp_path}/in")
    files(spark, [("A", "2", at), ("A", "1", at), ("B", None, at), ("B", None, at)], schema, f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = run(jobs.new_events(stream, identity=("event_id", "source_location")), tmp_path)
    assert sorted((r["event_id"], r["source_location"] or "") for _, r in got) == [("A", "1"), ("A", "2"), ("B", "")]


def test_messages_are_decoded_once(spark):
    rows, _ = positions.decode(spark.createDataFrame([("{}",)], "value string"), "satellite_id int, satellite_name string, latitude double, longitude double, timestamp bigint")
    good, _ = positions.validate_positions(rows)
    assert good._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
