"""Chat format, mixing, WARC store, registered SQL and the pipeline."""

from __future__ import annotations

import glob
import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from apsis.llm import chat_format, common, mixing, queries, warc_store

SF = "/root/testdata/sf0.001"
ROWS = [(1, 1, "assistant", "b </turn>\n<turn x>"), (1, 0, "user", "\\l \\b <a>\\"), (1, 2, "assistant", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, 0, "assistant", "é🙂\\"), (3, 0, "user", "")]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("clash"))
    made = chat_format.format_conversations(rows)
    back = made.select("conv_id", "formatted", "loss_spans", chat_format.parse_turns(F.col("formatted")).alias("t"), chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r["conv_id"]: r for r in back.collect()}
    assert [tuple(t) for t in got[1]["t"]] == [("user", "\\l \\b <a>\\"), ("assistant", "b </turn>\n<turn x>"), ("assistant", "")]
    assert [tuple(t) for t in got[2]["t"]] == [("", "x"), ("", "x")]
    assert (got[1]["loss"], got[None]["loss"], got[3]["loss"]) == ("b </turn>\n<turn x>", "é🙂\\", "")
    assert got[1]["formatted"].count("</turn>") == 3
    for r in got.values():
        assert all(0 <= s["start"] <= s["end"] <= len(r["formatted"]) for s in r["loss_spans"])
    assert chat_format.format_conversations(rows.limit(0)).count() == 0


def test_chat_parts_become_placeholders(spark):
    part = lambda kind, text=None, uri=None, size=None: (kind, text, uri, size)
    parts = [part("text", "see <image>: "), part("image", None, "s3://a.png", 784.0 * 10 + 1), part("audio", None, "b.wav", 2.0), part("text", None), part("document", None, "c.pdf", None), part("other", "odd")]
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [part("image", None, "d.png", 784.0)]), (2, 0, "user", None), (2, 1, "user", [])], f"conv_id bigint, turn int, role string, parts array<{chat_format.PART}>")
    got = {r["conv_id"]: r for r in chat_format.format_conversations(rows, parts_col="parts").collect()}
    assert got[1]["formatted"] == "<turn user>\nsee \\limage\\g: <image><audio><document>odd</turn>\n<turn assistant>\n<image></turn>\n"
    assert [tuple(a) for a in got[1]["attachments"]] == [("image", "s3://a.png", 11), ("audio", "b.wav", 50), ("document", "c.pdf", 0), ("image", "d.png", 1)]
    assert got[1]["attachment_tokens"] == 62 and got[2]["attachments"] == []


def brute_rake(cells, targets, iterations):
    weight = dict(cells)
    for _ in range(iterations):
        for k in range(3):
            held = {}
            for c, w in weight.items():
                held[c[k]] = held.get(c[k], 0) + w
            weight = {c: w / held[c[k]] * targets[k].get(c[k], 0) if held[c[k]] else 0.0 for c, w in weight.items()}
    return weight


def mix_docs(spark):
    rows = []
    for k in range(600):
        source, lang = f"s{k % 3}", "en" if k % 4 else "de"
        text = " ".join(["w"] * (5 + k % 50)) + (" | |" * 20 if k % 5 == 0 else "")
        rows.append((k, text, lang, source if k % 3 or k % 2 else None, 0, "clash"))
    rows += [(1000, None, None, None, None, None), (1001, "", "en", "s1", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, tokens int, topic string")


def test_mixing_meets_the_marginals(spark):
    docs = mix_docs(spark)
    targets = {"source": {"s0": 0.2, "s1": 0.5, "s2": 0.2, "none": 0.1}, "lang": {"en": 0.6, "de": 0.4}}
    rows = mixing.mix(docs, mixing.Mixer(targets=targets, keep=0.05, iterations=12)).collect()
    assert len(rows) == 602
    cells = {}
    for r in rows:
        c = (r["source"], r["lang"], r["topic"])
        cells[c] = cells.get(c, 0) + r["n_tokens"]
    total = sum(cells.values())
    topics = {}
    for (_, _, t), n in cells.items():
        topics[t] = topics.get(t, 0) + n**1.0
    raised = {t: n**0.5 for t, n in topics.items() if n}
    share = {t: v / sum(raised.values()) for t, v in raised.items()}
    want = brute_rake({c: float(n) for c, n in cells.items()}, [targets["source"], {**targets["lang"], "none": 0.0}, share], 12)
    for r in rows:
        c = (r["source"], r["lang"], r["topic"])
        p = min(1.0, 0.05 * total * want[c] / cells[c]) if cells[c] else 0.0
        assert r["probability"] == pytest.approx(p, abs=1e-9)
    drawn = sum(r["n_tokens"] * r["probability"] for r in rows if r["source"] == "s1") / sum(r["n_tokens"] * r["probability"] for r in rows)
    assert drawn == pytest.approx(0.5, abs=0.02)


def test_mixing_keeps_its_budget_and_marginals_with_the_defaults(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    total = sum(r["n_tokens"] for r in rows)
    assert sum(r["n_tokens"] * r["probability"] for r in rows) == pytest.approx(0.5 * total, rel=1e-6)
    for name in mixing.MARGINS:
        have, got = {}, {}
        for r in rows:
            have[r[name]] = have.get(r[name], 0) + r["n_tokens"]
            got[r[name]] = got.get(r[name], 0) + r["n_tokens"] * r["probability"]
        # A value that runs out of tokens is sampled whole; the others share the rest in proportion to their targets.
        want, left = {}, {v: n**0.5 for v, n in have.items() if n}
        while True:
            each = (0.5 * total - sum(want.values())) / sum(left.values())
            short = [v for v in left if each * left[v] > have[v]]
            if not short:
                break
            want |= {v: have[v] for v in short if left.pop(v)}
        want |= {v: each * t for v, t in left.items()}
        for v in want:
            assert got[v] / total == pytest.approx(want[v] / total, abs=1e-4)


def test_mixing_pools_small_values_and_keeps_columns(spark):
    docs = mix_docs(spark)
    rows = mixing.mix(docs, mixing.Mixer(most=(1, 1, 1))).collect()
    assert len(rows) == 602
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < 602
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.sample(docs.limit(0)).count() == 0
    ids = {r["doc_id"] for r in mixing.mix(docs).where("sampled").collect()}
    assert {r["doc_id"] for r in kept.collect()} == ids


def test_warc_records_are_rebuilt(spark, monkeypatch):
    monkeypatch.setattr(warc_store, "PER_PART", 3)  # so that the shared payloads are read in parts
    big = "é" * 600
    rows = [(1, "http://a\r\nb\u2028WARC-Payload-Digest: sha1:00", big), (2, "u", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", "x" * 1000), (7, "u", "y" * 999), (8, "u", "y" * 999), (9, "u", "\r\n\r\nz" * 300)]
    rows += [(100 + k, "u", "w" * 2_000_000) for k in range(8)] + [(107, "v", "w" * 2_000_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("header", F.lit(1)).withColumn("parts", F.lit(1))
    archive = warc_store.write_archive(pages)
    assert archive.payloads.count() == 7
    records = warc_store.read_records(archive)
    found = {int(r["page_id"] or -1): r for r in warc_store.read_fields(records).collect()}
    assert [(k, found[k]["record_type"], found[k]["refers_to"]) for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, -1)] == [(1, "revisit", "3"), (2, "revisit", "3"), *((k, "response", None) for k in (3, 4, 5, 6, 7, 8, 9, -1))]
    assert [(k, found[k]["record_type"], found[k]["refers_to"]) for k in range(100, 108)] == [*((k, "revisit", "107") for k in range(100, 107)), (107, "response", None)]
    assert all(r["declared_digest"] == r["payload_digest"] for r in found.values()) and found[1]["payload_bytes"] == 1200 and found[100]["payload_bytes"] == 2_000_000
    written = [bytes(r["record"]) for r in records.collect()]
    assert len(written) == len(rows) and sum(b"WARC-Type: response" in r for r in written) == 10  # both rows of page 107
    for record in written:
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        body = rest[: int(fields[b"Content-Length"])]
        assert rest[len(body) :] == b"\r\n\r\n"
        if fields[b"WARC-Type"] == b"response":
            assert fields[b"WARC-Payload-Digest"] == b"sha1:" + hashlib.sha1(body).hexdigest().encode()
    assert warc_store.read_records(warc_store.write_archive(pages.limit(0))).count() == 0


def test_warc_ids_may_be_texts(spark):
    pages = spark.createDataFrame([("a b>\r\nc", "u", "p" * 1200), ("é", "u", "p" * 1200)], "page_id string, url string, html string")
    found = warc_store.read_fields(warc_store.read_records(warc_store.write_archive(pages))).collect()
    assert sorted((r["page_id"], r["refers_to"]) for r in found) == [("a b>\r\nc", "é"), ("é", None)]


def test_rebuilding_records_shuffles_headers_and_shared_payloads_only(spark):
    archive = warc_store.write_archive(spark.read.parquet(f"{SF}/pages.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = warc_store.read_records(archive)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(payload_key") == 3  # headers, and the two sides of the shared payloads


def test_a_damaged_payload_is_noticed(spark):
    archive = warc_store.write_archive(spark.createDataFrame([(1, "u", "body")], "page_id bigint, url string, html string"))
    broken = warc_store.Archive(archive.records, archive.payloads.withColumn("payload", F.encode(F.lit("other"), "utf-8")))
    with pytest.raises(Exception, match="does not match its digest"):
        warc_store.read_records(broken).collect()
    cut = warc_store.read_records(archive).withColumn("record", F.expr("concat(substring(record, 1, octet_length(record) - 6), encode('\r\n\r\n', 'utf-8'))"))
    with pytest.raises(Exception, match="record without its payload"):
        warc_store.read_fields(cut).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_registered_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(str(r[k]) for k in at) for r in want.fetchall())


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from apsis.llm import near_duplicates, quality_classifier
    from apsis.llm.common import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), f"test-{name}")
        if name == "quality":
            want = quality_classifier.classify(before, labels).where("predicted = 1").select("doc_id")
        elif name == "near_dedup":
            want = near_duplicates.near_duplicates(before).where("doc_id = class_id").select("doc_id")
        elif name == "mixture":
            want = mixing.mix(before).where("sampled").select("doc_id")
        elif name == "secrets":
            want = before.select("doc_id")
            assert docs.where(F.col("text").rlike("token = .[0-9a-f]{40}")).count() == 0
        else:
            want = None
            assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
            assert docs.select("doc_id").distinct().count() == before.count()
        if want is not None:
            assert docs.columns == columns
            assert sorted(r[0] for r in docs.select("doc_id").collect()) == sorted(r[0] for r in want.collect())


def test_pipeline_stages_take_odd_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", None, None), (3, "a b c", None, "s", 5), (3, "a b c", None, "s", 5), (4, "word " * 30000, "en", "s", 150000)], schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= 7 * docs.count() + 200


def test_pipeline_leaves_the_rows_of_its_stages_only(spark, tmp_path, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(common, "scratch_dir", lambda spark: f"file://{tmp_path}")
    rows = pipeline.run(spark, SF)
    assert sorted(name.rsplit("-", 1)[0] for name in os.listdir(f"{tmp_path}/apsis")) == sorted(f"pipeline-{name}" for name, _ in pipeline.STAGES)
    assert rows.count() > 100
