"""Structured Streaming: append and resume, metric windows, the newest outcomes of a task as state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.folders import work_folder
from tessera.operators.selection import WINDOW
from tessera.streaming.state import settings


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns the table that it wrote; with another mode than append, batch_ tells the batch.

    Rows that came too late for a watermark would be missing, so any such row is an error.
    """
    spark, place = stream.sparkSession, work_folder(stream.sparkSession, "stream")
    started = stream.writeStream.option("checkpointLocation", f"{place}/log").trigger(availableNow=True)
    if mode == "append":
        writer = started.format("parquet").option("path", f"{place}/out")
    else:

        def keep(batch: DataFrame, i: int) -> None:
            batch.withColumn("batch_", F.lit(i).cast("long")).write.mode("overwrite").parquet(f"{place}/out/part={i}")

        writer = started.outputMode(mode).foreachBatch(keep)
    with settings(spark, {"spark.sql.streaming.numRecentProgressUpdates": "100000"}):
        query = writer.start()
        query.awaitTermination()
    late = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    if late:
        raise ValueError(f"{late} rows came later than the watermark allows")
    return spark.read.schema(stream.schema).parquet(f"{place}/out") if mode == "append" else spark.read.parquet(f"{place}/out").drop("part")


def topped_up(stream: DataFrame, key: str, target: int) -> DataFrame:
    """Rows of a stream, one for each key, until there are target of them: batch by batch as they come, within a batch by key. A batch that runs again replaces its own rows."""
    spark, place = stream.sparkSession, work_folder(stream.sparkSession, "topped")

    def take(batch: DataFrame, i: int) -> None:
        done = spark.read.schema(f"{key} {dict(batch.dtypes)[key]}, part int").parquet(f"{place}/out").where(F.col("part") < i).select(key)
        need = max(0, target - done.count())
        new = batch.dropDuplicates([key]).join(done, key, "left_anti").orderBy(key).limit(need)
        new.select(batch.columns).write.mode("overwrite").parquet(f"{place}/out/part={i}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{place}/out/part=-1")
    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out").select(stream.columns)


def top_up(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a stream whose key has not been seen: each is taken once, restarts included."""
    return rows.dropDuplicates([key])


def metric_windows(events: DataFrame, late: str, width: str = "1 hour") -> DataFrame:
    """n and total of events (ts, event_type, value) by tumbling window and type.

    late must be at least how far events are out of order between batches: state is dropped by it, and `finished` fails on rows that come later.
    """
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def newest(window: int = WINDOW):
    """Function for applyInPandasWithState: the newest outcomes of each task by ord, over batches."""

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        had = list(zip(*state.get, strict=True)) if state.exists else []
        for batch in batches:
            had += list(zip(batch["ord"].tolist(), batch["solved"].tolist(), strict=True))
        had = sorted(had)[-window:]
        state.update(([o for o, _ in had], [s for _, s in had]))
        yield pd.DataFrame({"task_id": [key[0]], "n": [len(had)], "solve_rate": [sum(s for _, s in had) / len(had)]})

    return run


def newest_rates(outcomes: DataFrame, window: int = WINDOW) -> DataFrame:
    """Stream of (task_id, n, solve_rate), updated with every batch of outcomes (task_id, ord, solved)."""
    return outcomes.groupBy("task_id").applyInPandasWithState(newest(window), "task_id long, n long, solve_rate double", "ords array<long>, outcomes array<boolean>", "update", GroupStateTimeout.NoTimeout)


def since_promotion(patience: int):
    """Function for applyInPandasWithState: cycles since the last promotion of each run, in order of cycles within a batch."""

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, newest = state.get if state.exists else (0, None)
        rows = sorted(x for b in batches for x in zip(b["cycle"].tolist(), b["promoted"].tolist(), strict=True))
        if rows and newest is not None and rows[0][0] <= newest:
            raise ValueError("cycles of a run came out of order")
        for cycle, promoted in rows:
            since, newest = 0 if promoted else since + 1, cycle
        state.update((since, newest))
        yield pd.DataFrame({"run": [key[0]], "cycle": [newest], "since": [since], "stop": [since >= patience]})

    return run


def plateaus(ledger: DataFrame, patience: int = 5) -> DataFrame:
    """Stream of (run, cycle, since, stop), updated with every batch of a ledger (run, cycle, promoted); cycles of a run must come in order."""
    return ledger.groupBy("run").applyInPandasWithState(since_promotion(patience), "run long, cycle long, since long, stop boolean", "since long, newest long", "update", GroupStateTimeout.NoTimeout)
