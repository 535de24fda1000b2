"""Stages one after another, each written; a run that begins again goes on behind the last complete one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.folders import exists, written

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def complete(spark: SparkSession, folder: str, stages: list[Stage]) -> list[str]:
    """Names of the stages at the beginning whose tables are whole in a folder; a table counts from the moment its commit has ended."""
    out = []
    for i, (name, _) in enumerate(stages):
        if not exists(spark, f"{folder}/{i}-{name}/_SUCCESS"):
            break
        out.append(name)
    return out


def dispatched(rows: DataFrame, stages: list[Stage], folder: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The result of stages over rows, each written in folder and read again. Complete stages are not run again, but for those from `first` on; nothing runs after `last`.

    A stage that starts anew makes all behind it start anew. An unknown name, and a `first` whose predecessors aren't complete, are errors.
    """
    spark, names = rows.sparkSession, [name for name, _ in stages]
    for name in (first, last):
        if name is not None and name not in names:
            raise ValueError(f"no stage {name}")
    done = len(complete(spark, folder, stages))
    begin = done if first is None else names.index(first)
    if begin > done:
        raise ValueError(f"the stages before {first} aren't complete")
    end = len(names) if last is None else names.index(last) + 1
    place = lambda i: f"{folder}/{i}-{names[i]}"
    begin = min(begin, end)
    if begin:
        rows = spark.read.parquet(place(begin - 1))
    for i in range(begin, end):
        rows = written(stages[i][1](rows), place(i))
    return rows
