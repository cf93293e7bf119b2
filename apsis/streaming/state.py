"""Keyed state: bounded lists, a start from a table, and state read as a table.

State stores must be those of RocksDB (`use_keyed_state` sets it on a session)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _plain(value):
    import pandas as pd

    return None if value is None or (not isinstance(value, (list, dict)) and pd.isna(value)) else value.item() if hasattr(value, "item") else value


def _frame(rows: list[dict], types: dict[str, str]):
    """Rows as pandas, whole numbers with gaps kept whole."""
    import pandas as pd

    kinds = {"int": "Int32", "bigint": "Int64", "boolean": "boolean"}
    return pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=kinds.get(t, None if t == "double" else object)) for c, t in types.items()})


def recent_lists(rows: DataFrame, key: str, order: str, identity: str, columns: tuple[str, ...] = (), most: int = 100, ttl_seconds: int | None = 86_400) -> DataFrame:
    """The last rows of each key, kept as a list in its state and emitted whole, with rank from 1, whenever the list changes.

    order: a bigint, the newest first; identity orders ties and stands once in a list however often it comes. A list never holds
    over `most` rows, and an entry is dropped that long after it was written (ttl_seconds; with it, use a processing-time trigger:
    one that stops when all input is taken never stops, as Spark goes on to look for entries to drop). A key's rows of one batch are merged in
    pieces, so that a flood of one key needs no memory beyond a piece and the list. version rises with each emission of a key."""
    types = dict(rows.dtypes)
    kept = [order, identity, *columns]
    held = ", ".join(f"{c} {types[c]}" for c in kept)
    out = {key: types[key], "version": "bigint", "rank": "int"} | {c: types[c] for c in kept}

    class Recent(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            ttl = ttl_seconds * 1000 if ttl_seconds else None
            self.rows = handle.getListState("recent", held, ttl)
            self.version = handle.getValueState("version", "version bigint")

        def handleInputRows(self, key_values, batches, timerValues):
            before = [dict(zip(kept, map(_plain, r), strict=True)) for r in self.rows.get()] if self.rows.exists() else []
            now = {r[identity]: r for r in before}
            for batch in batches:
                for r in batch[kept].to_dict("records"):
                    r = {c: _plain(v) for c, v in r.items()}
                    old = now.get(r[identity])
                    if old is None or r[order] > old[order]:
                        now[r[identity]] = r
                ranked = sorted(now.values(), key=lambda r: (-r[order], str(r[identity])))[:most]
                now = {r[identity]: r for r in ranked}
            ranked = sorted(now.values(), key=lambda r: (-r[order], str(r[identity])))
            if ranked == before:
                return
            version = (self.version.get()[0] if self.version.exists() else 0) + 1
            self.version.update((version,))
            self.rows.put([tuple(r[c] for c in kept) for r in ranked])
            yield _frame([{key: _plain(key_values[0]), "version": version, "rank": k} | r for k, r in enumerate(ranked, 1)], out)

        def close(self) -> None:
            pass

    chosen = rows.select(key, *kept).where(F.col(key).isNotNull() & F.col(order).isNotNull() & F.col(identity).isNotNull())
    schema = ", ".join(f"{c} {t}" for c, t in out.items())
    return chosen.groupBy(key).transformWithStateInPandas(Recent(), schema, "update", "processingTime" if ttl_seconds else "none")


def latest_lists(pushed: DataFrame, key: str) -> DataFrame:
    """Of pushed lists the newest of each key. A list has at most as many rows as it was bounded to."""
    columns = [c for c in pushed.columns if c not in (key, "version")]
    lists = pushed.groupBy(key, "version").agg(F.collect_list(F.struct(*columns)).alias("_rows"))
    newest = lists.groupBy(key).agg(F.max_by("_rows", "version").alias("_rows"))
    return newest.select(key, F.inline("_rows"))


def latest_since(rows: DataFrame, key: str, order: str, columns: tuple[str, ...], initial: DataFrame | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """The latest row of each key by order (a bigint), emitted whenever it changes; starts from the rows of a table, such as
    yesterday's view, as if the stream had seen them."""
    types = dict(rows.dtypes)
    kept = [order, *columns]
    held = ", ".join(f"{c} {types[c]}" for c in kept)
    out = {key: types[key]} | {c: types[c] for c in kept}

    class Latest(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getValueState("seen", held, ttl_seconds * 1000 if ttl_seconds else None)

        def _merge(self, batches) -> dict | None:
            """The newer row, if there is one; ties go to the greatest by the other columns, so that batches do not matter."""
            now = dict(zip(kept, map(_plain, self.seen.get()), strict=True)) if self.seen.exists() else None
            rank = lambda r: [r[order], *[(r[c] is not None, r[c] if r[c] is not None else 0) for c in columns]]
            changed = False
            for batch in batches:
                for r in batch[kept].to_dict("records"):
                    r = {c: _plain(v) for c, v in r.items()}
                    if now is None or rank(r) > rank(now):
                        now, changed = r, True
            if changed:
                self.seen.update(tuple(now[c] for c in kept))
            return now if changed else None

        def handleInputRows(self, key_values, batches, timerValues):
            now = self._merge(batches)
            if now:
                yield _frame([{key: _plain(key_values[0])} | now], out)

        def handleInitialState(self, key_values, initialState, timerValues) -> None:
            self._merge([initialState])

        def close(self) -> None:
            pass

    chosen = lambda df: df.select(key, *kept).where(F.col(key).isNotNull() & F.col(order).isNotNull())
    schema = ", ".join(f"{c} {t}" for c, t in out.items())
    start = chosen(initial).groupBy(key) if initial is not None else None
    return chosen(rows).groupBy(key).transformWithStateInPandas(Latest(), schema, "update", "processingTime" if ttl_seconds else "none", start)


def read_state(spark: SparkSession, checkpoint: str, variable: str = "seen", batch: int | None = None) -> DataFrame:
    """A value variable of a query's keyed state as a table: key columns, then the value's. It is the state after the last
    finished batch (or a given one): what a hot store would serve, without one."""
    reader = spark.read.format("statestore").option("stateVarName", variable)
    table = (reader.option("batchId", batch) if batch is not None else reader).load(checkpoint)
    value: Column = F.col("value.value") if "ttlExpirationMs" in str(table.schema["value"].dataType) else F.col("value")
    return table.select("key.*", value.alias("_value")).select(*[c for c in table.select("key.*").columns], "_value.*")


def read_lists(spark: SparkSession, checkpoint: str, variable: str = "recent", batch: int | None = None) -> DataFrame:
    """A list variable of a query's keyed state as a table: key columns, then an entry's."""
    reader = spark.read.format("statestore").option("stateVarName", variable).option("flattenCollectionTypes", "true")
    table = (reader.option("batchId", batch) if batch is not None else reader).load(checkpoint)
    entry = F.col("list_element.value") if "ttlExpirationMs" in str(table.schema["list_element"].dataType) else F.col("list_element")
    return table.select("key.*", entry.alias("_value")).select(*[c for c in table.select("key.*").columns], "_value.*")
