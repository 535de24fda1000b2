"""Streams with state variables: windows that close, late rows beside them, ids seen once, the newest outcomes; and their state read back as tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from tessera.operators.selection import WINDOW

#: State variables need this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that a stream takes over when it starts; the session has its own again afterwards."""
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def drained(spark: SparkSession, writer: DataStreamWriter, place: str, one_batch: bool = False) -> StreamingQuery:
    """Runs a stream over what is there now, with its log in place; run again with the same place, it goes on where it ended. One batch is for streams
    whose state runs out by the clock, which never end otherwise."""
    with settings(spark, STORE):
        query = writer.option("checkpointLocation", place).trigger(**({"once": True} if one_batch else {"availableNow": True})).start()
    query.awaitTermination()
    return query


def state_table(spark: SparkSession, place: str, variable: str) -> DataFrame:
    """What a stream's state holds now under a variable, as a table: the key's columns and the value's; a list has a row for each of its elements."""
    rows = spark.read.format("statestore").option("path", place).option("stateVarName", variable).load()
    value = next(c for c in ("value", "list_element") if c in rows.columns)
    inner = rows.schema[value].dataType
    value = f"{value}.value" if inner.fieldNames() == ["value", "ttlExpirationMs"] else value
    return rows.select("key.*", f"{value}.*")


class Windows(StatefulProcessor):
    """Count and total of a window, given out when the watermark has passed its end; what comes afterwards is given out at once, as late."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n long, total long")

    def _row(self, key: tuple, kind: str, n: int, total: int) -> pd.DataFrame:
        return pd.DataFrame({"event_type": [key[0]], "ends": [key[1]], "kind": [kind], "n": [n], "total": [total]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n = total = 0
        for batch in rows:
            n, total = n + int(batch["n"].sum()), total + int(batch["total"].sum())
        if key[1] <= timerValues.getCurrentWatermarkInMs():
            yield self._row(key, "late", n, total)
            return
        had = self.sums.get() if self.sums.exists() else None
        if had is None:
            self.handle.registerTimer(key[1])
        self.sums.update((n + (had[0] if had else 0), total + (had[1] if had else 0)))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        n, total = self.sums.get()
        self.sums.clear()
        yield self._row(key, "closed", n, total)

    def close(self) -> None:
        pass


def windows(events: DataFrame, late: str, width_ms: int) -> DataFrame:
    """Stream of (event_type, ends, kind, n, total): windows of events (ts, event_type, value) by tumbling window and type, once the watermark (the newest ts less `late`) has
    passed their end (kind 'closed'), and sums of rows that came after that, batch by batch (kind 'late'). ends is in milliseconds. Open windows are in the state variable `sums`.

    State holds open windows only. Rows are summed by window before they reach the state, so a hot window is one row a task.
    """
    marked = events.withWatermark("ts", late)
    at = F.unix_millis(F.col("ts"))  # without the mark, so that late rows reach the processor
    one = marked.select("event_type", (at - F.pmod(at, F.lit(width_ms)) + width_ms).alias("ends"), F.lit(1).cast("long").alias("n"), F.col("value").cast("long").alias("total"))
    return one.groupBy("event_type", "ends").transformWithStateInPandas(Windows(), "event_type string, ends long, kind string, n long, total long", "append", "EventTime")


def corrected(written: DataFrame, open_: DataFrame) -> DataFrame:
    """event_type, ends, n, total of all windows: closed ones, corrected by what came late, and open ones."""
    both = written.select("event_type", "ends", "n", "total").unionByName(open_.select("event_type", "ends", "n", "total"))
    return both.groupBy("event_type", "ends").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


class Newest(StatefulProcessor):
    """The newest outcomes of a task by ord, as a list that is dropped when nothing has come for a time."""

    def __init__(self, window: int, days: int):
        self.window, self.days = window, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getListState("newest", "ord long, solved boolean", self.days * 86_400_000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        had = [tuple(x) for x in self.newest.get()] if self.newest.exists() else []
        for batch in rows:
            had = sorted([*had, *zip(batch["ord"].tolist(), batch["solved"].tolist(), strict=True)])[-self.window :]
        self.newest.put([(int(o), bool(s)) for o, s in had])
        yield pd.DataFrame({"task_id": [key[0]], "n": [len(had)], "solve_rate": [sum(s for _, s in had) / len(had)]})

    def close(self) -> None:
        pass


def newest_outcomes(outcomes: DataFrame, window: int = WINDOW, days: int = 30) -> DataFrame:
    """Stream of (task_id, n, solve_rate) with every batch of outcomes (task_id, ord, solved); the state variable `newest` has the outcomes, for so many days after the task's last one."""
    kind = dict(outcomes.dtypes)["task_id"]
    return outcomes.groupBy("task_id").transformWithStateInPandas(Newest(window, days), f"task_id {kind}, n long, solve_rate double", "update", "ProcessingTime")


def keep_newest(outcomes: DataFrame, place: str, window: int = WINDOW, days: int = 30) -> StreamingQuery:
    """Brings the state of newest_outcomes in place/log up to date with what is there now, in one batch, and writes the rates that changed under place/out."""

    def keep(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch_={i}")

    return drained(outcomes.sparkSession, newest_outcomes(outcomes, window, days).writeStream.outputMode("update").foreachBatch(keep), f"{place}/log", one_batch=True)


def rates(state: DataFrame) -> DataFrame:
    """task_id, n, solve_rate of a state table of outcomes."""
    return state.groupBy("task_id").agg(F.count("*").alias("n"), F.avg(F.col("solved").cast("int")).alias("solve_rate"))


def once(rows: DataFrame, key: str, ts: str, within: str) -> DataFrame:
    """Rows of a stream whose key has not come in the time `within` before them, by ts; the state forgets a key after that time."""
    return rows.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def take_once(rows: DataFrame, key: str, ts: str, within: str, place: str) -> StreamingQuery:
    """Writes the rows that `once` lets through under place, with the number of their batch; a batch that runs again replaces its own rows."""

    def keep(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch_={i}")

    return drained(rows.sparkSession, once(rows, key, ts, within).writeStream.foreachBatch(keep), f"{place}/log")


def taken(spark: SparkSession, place: str, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Of what take_once wrote: the first row of each key, and the rows of keys that returned after their state was forgotten, which are set aside."""
    rows = spark.read.schema(f"{schema}, batch_ int").option("basePath", f"{place}/out").parquet(f"{place}/out")
    first = rows.groupBy(key).agg(F.min("batch_").alias("first_"))
    marked = rows.join(first, key)
    return marked.where("batch_ = first_").drop("batch_", "first_"), marked.where("batch_ > first_").drop("batch_", "first_")
