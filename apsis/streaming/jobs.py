"""Streaming jobs. Sinks are written per micro-batch, keyed by batch id, so a replay does not write twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import schemas as S
from ..operators import anomaly, positions
from ..sources import commits, writers


def enrichment(messages: DataFrame) -> DataFrame:
    """Raw position messages (value) to enriched rows, with a watermark for what follows. Undecodable and invalid messages
    are left out here; enrichment_sink files them as rejects."""
    rows, _ = positions.decode(messages, S.POSITION)
    good, _ = positions.validate_positions(rows)
    return positions.enrich_positions(good).withWatermark("event_time", "30 seconds")


def _trigger(writer: DataStreamWriter, seconds: int | None) -> DataStreamWriter:
    return writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)


def start_enrichment(messages: DataFrame, archive: str, topic: str, rejects: str, checkpoint: str, seconds: int | None = None, by: tuple[str, ...] = ("date", "satellite_id")):
    """Enriches every message; writes messages, archive and rejects in each micro-batch (the batch is cached once)."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            rows, malformed = positions.decode(batch, S.POSITION)
            good, invalid = positions.validate_positions(rows)
            enriched = positions.enrich_positions(good)
            ordered = writers.in_key_order(positions.to_enriched_message(enriched), "satellite_id", "timestamp")
            positions.to_messages(ordered, "satellite_id").write.mode("overwrite").json(f"{topic}/batch={batch_id}")
            writers.write_positions_archive(enriched, archive, batch_id, by)
            malformed.unionByName(invalid).write.mode("overwrite").json(f"{rejects}/batch={batch_id}")
        finally:
            batch.unpersist()

    return _trigger(messages.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint), seconds).start()


def start_committed_enrichment(messages: DataFrame, root: str, checkpoint: str, seconds: int | None = None):
    """Enriches every message into {root}/topic, archive and rejects as one commit a micro-batch: `commits.committed` shows a batch in
    all three or in none, also when a sink failed between two writes."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            rows, malformed = positions.decode(batch, S.POSITION)
            good, invalid = positions.validate_positions(rows)
            enriched = positions.enrich_positions(good)
            ordered = writers.in_key_order(positions.to_enriched_message(enriched), "satellite_id", "timestamp")
            into = lambda df: lambda folder: df.write.mode("overwrite").parquet(folder)
            sinks = {"topic": into(positions.to_messages(ordered, "satellite_id")), "archive": into(positions.to_archive(enriched).sortWithinPartitions("date", "satellite_id", "timestamp")), "rejects": into(malformed.unionByName(invalid))}
            commits.commit_batch(batch.sparkSession, root, batch_id, sinks)
        finally:
            batch.unpersist()

    return _trigger(messages.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint), seconds).start()


def alert_stream(enriched_messages: DataFrame, watermark: str = "30 seconds", expected: str = "constant", size: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Enriched messages (value) to alerts: one stateful aggregation for both rules, appended when a window closes."""
    rows, _ = positions.decode(enriched_messages, S.ENRICHED)
    flat = positions.flatten_message(rows)
    return anomaly.detect_anomalies(anomaly.sliding_stats(flat, size, slide, watermark), expected)


def start_alerts(enriched_messages: DataFrame, events: str, out: str, checkpoint: str, seconds: int | None = None, mode: str = "all", topic: str | None = None, size: str = "60 seconds", slide: str = "10 seconds", weather: str | None = None, events_format: str = "json"):
    """Alerts and their space-weather correlations, as rows and, with a topic, as messages keyed by satellite. The event
    table is read anew in each micro-batch. Undecodable messages are filed by start_rejects.

    weather: a folder for the correlations of mode "overlap" as anomaly.weather_by_window has them, in place of rows for each satellite
    and event (and of their messages): what is written then grows with the alerts and the events, not with their product."""
    if weather and mode != "overlap":
        raise ValueError("correlations by window are those of mode 'overlap'")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            known = batch.sparkSession.read.schema(S.EVENT).format(events_format).load(events)
            if weather:
                anomaly.weather_by_window(batch, known).write.mode("overwrite").parquet(f"{weather}/batch={batch_id}")
                every = batch
            else:
                every = anomaly.all_alerts(batch, anomaly.correlate_space_weather(batch, known, mode))
            every.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            if topic:
                written = batch.sparkSession.read.parquet(f"{out}/batch={batch_id}")
                positions.to_messages(writers.in_key_order(written, "satellite_id", "detected_at"), "satellite_id").write.mode("overwrite").json(f"{topic}/batch={batch_id}")
        finally:
            batch.unpersist()

    return _trigger(alert_stream(enriched_messages, size=size, slide=slide).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint), seconds).start()


def start_rejects(messages: DataFrame, schema: str, rejects: str, checkpoint: str, seconds: int | None = None):
    """Files the messages of a stream that a schema cannot decode: source, reason, raw."""
    _, bad = positions.decode(messages, schema)
    return _trigger(bad.writeStream.format("json").option("path", rejects).option("checkpointLocation", checkpoint), seconds).start()


def new_events(events: DataFrame, column: str = "event_time", look_back: str = "7 days", identity: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Each event once over overlapping polls, within the look-back: by its id or, where ids are not unique, by more columns."""
    return events.withWatermark(column, look_back).dropDuplicatesWithinWatermark(list(identity))


def changed_lines(rows: DataFrame) -> DataFrame:
    """TLE rows whose first line differs from the satellite's last emitted one: keyed value state, one line per key."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    columns = [c for c in rows.columns if c != "satellite_id"]

    class LastLine(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.line = handle.getValueState("line", "line string")

        def handleInputRows(self, key, batches, timerValues):
            import pandas as pd

            got = pd.concat(list(batches)).sort_values(["ingestion_time", "tle_line1"], kind="stable")
            last = self.line.get()[0] if self.line.exists() else None
            new = got["tle_line1"].ne(got["tle_line1"].shift(fill_value=last if last is not None else ""))
            if len(got):
                self.line.update((got["tle_line1"].iloc[-1],))
            yield got[new][["satellite_id", *columns]]

        def close(self) -> None:
            pass

    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in ["satellite_id", *columns])
    return rows.groupBy("satellite_id").transformWithStateInPandas(LastLine(), schema, "append", "none")


def keyed_state(rows: DataFrame, key: str, order: str, columns: list[str], ttl_seconds: int, merge: bool = False) -> DataFrame:
    """Keeps the latest row per key (by order, a bigint) and emits it whenever it changes; its state is dropped after the time
    to live. merge: of each column the last value that is not null, as a record that several messages fill in."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    types = dict(rows.dtypes)
    kept = ", ".join(f"{c} {types[c]}" for c in [order, *columns])

    class Latest(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getValueState("seen", kept, ttlDurationMs=ttl_seconds * 1000)

        def handleInputRows(self, key_values, batches, timerValues):
            import pandas as pd

            plain = lambda v: None if pd.isna(v) else v.item() if hasattr(v, "item") else v
            got = pd.concat(list(batches)).sort_values(order, kind="stable")
            held = dict(zip([order, *columns], self.seen.get(), strict=True)) if self.seen.exists() else None
            now = dict(held or {})
            for row in got[[order, *columns]].to_dict("records"):
                row = {c: plain(v) for c, v in row.items()}
                newer = not now or row[order] > now[order]
                if merge:
                    now = {c: (row[c] if newer and row[c] is not None or now.get(c) is None else now[c]) for c in row} | {order: max(row[order], now.get(order, row[order]))}
                elif newer:
                    now = row
            if now and now != held:
                self.seen.update(tuple(now[c] for c in [order, *columns]))
                yield pd.DataFrame({key: [key_values[0]], **{c: pd.Series([now[c]], dtype=object if now[c] is None else None) for c in [order, *columns]}})

        def close(self) -> None:
            pass

    chosen = rows.select(key, order, *columns).where(F.col(key).isNotNull() & F.col(order).isNotNull())
    return chosen.groupBy(key).transformWithStateInPandas(Latest(), f"{key} {types[key]}, {kept}", "append", "processingTime")


def latest_positions(flat: DataFrame, ttl_seconds: int = 60) -> DataFrame:
    """The latest position per satellite, pushed whenever a newer one comes."""
    return keyed_state(flat, "satellite_id", "timestamp", ["latitude", "longitude", "altitude_km"], ttl_seconds)


def latest_metadata(flat: DataFrame, ttl_seconds: int = 3600, columns: tuple[str, ...] = ("satellite_name", "orbit_type")) -> DataFrame:
    """What is known of each satellite: the last value of every field that has one, and when it was last seen."""
    return keyed_state(flat, "satellite_id", "timestamp", list(columns), ttl_seconds, merge=True)


def live_events(events: DataFrame, ttl_seconds: int = 72 * 3600) -> DataFrame:
    """Active space-weather events by id, pushed when they come or change. events: event_id, ingested (epoch seconds), ..."""
    return keyed_state(events, "event_id", "ingested", ["event_type", "severity", "start_time", "end_time"], ttl_seconds)
