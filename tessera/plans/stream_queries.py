"""Queries that run as streams over what is there and return the table that the stream wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.folders import work_folder
from tessera.plans.corpus_queries import table
from tessera.plans.registry import register
from tessera.plans.selection_queries import RECENT
from tessera.streaming import state, streams


def stream(spark, sf_dir, name: str) -> DataFrame:
    """A driver's table as a stream; its file or folder is the source."""
    path = f"{sf_dir}/{name}.parque[t]"  # as a pattern, so that a single file will do
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(path)


@register("stream_topup_dedup", "SELECT DISTINCT user_id FROM events")
def stream_topup_dedup(spark, sf_dir):
    return streams.finished(streams.top_up(stream(spark, sf_dir, "events").select("user_id"), "user_id"))


@register("stream_metric_tumbling", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL")
def stream_metric_tumbling(spark, sf_dir):
    own = stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round(F.col("value") * 100).cast("long").alias("value"))
    span = table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp").cast("long") - F.min("ts").cast("timestamp").cast("long")).first()[0] or 0  # files may come in any order
    done = streams.finished(streams.metric_windows(own, late=f"{span + 1} seconds"), "update")
    newest = done.groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "batch_").alias("x"))
    return newest.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "x.n", F.col("x.total").alias("cents"))


@register("stream_last10_state", f"WITH {RECENT} SELECT task_id, n, round(rate, 9) AS solve_rate FROM recent")
def stream_last10_state(spark, sf_dir):
    own = stream(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("ord"), (F.col("event_type") == "purchase").alias("solved"))
    done = streams.finished(streams.newest_rates(own), "update")
    newest = done.groupBy("task_id").agg(F.max_by(F.struct("n", "solve_rate"), "batch_").alias("x"))
    return newest.select("task_id", "x.n", F.round("x.solve_rate", 9).alias("solve_rate"))


@register("stream_topup_target", "SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 40")
def stream_topup_target(spark, sf_dir):
    return streams.topped_up(stream(spark, sf_dir, "events").select("user_id"), "user_id", 40)


@register("stream_plateau", "WITH p AS (SELECT user_id AS run, max(event_id) AS cycle, coalesce(max(event_id) FILTER (event_type = 'purchase'), -1) AS won FROM events GROUP BY user_id) SELECT run, p.cycle, count(e.event_id) AS since, count(e.event_id) >= 5 AS stop FROM p LEFT JOIN events e ON e.user_id = run AND e.event_id > won GROUP BY ALL")
def stream_plateau(spark, sf_dir):
    own = stream(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("cycle"), (F.col("event_type") == "purchase").alias("promoted"))
    done = streams.finished(streams.plateaus(own), "update")
    newest = done.groupBy("run").agg(F.max_by(F.struct("cycle", "since", "stop"), "batch_").alias("x"))
    return newest.select("run", "x.*")


DAY = 86_400_000


def in_files(rows: DataFrame, part, n: int, spark) -> DataFrame:
    """rows as a stream that gets them in n batches, by the number that part gives each of them."""
    place = work_folder(spark, "files")
    for i in range(n):
        rows.where(part == i).coalesce(1).write.mode("append").parquet(f"{place}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")


def by_time(rows: DataFrame, n: int = 4):
    """The number of a row's stretch of time, of n with as many rows; every fiftieth event comes with the last stretch, late."""
    at = F.unix_millis("ts")
    cuts = rows.agg(F.percentile_approx(at, F.array(*[F.lit(i / n) for i in range(1, n)]))).first()[0] or []  # n - 1 numbers
    stretch = sum((F.when(at >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    return F.when(F.col("event_id") % 50 == 0, n - 1).otherwise(stretch)


def timed_events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round(F.col("value") * 100).cast("long").alias("value"))


@register("stream_closed_windows", f"SELECT event_type, (epoch_ms(ts) // {DAY} + 1) * {DAY} AS ends, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM events GROUP BY ALL")
def stream_closed_windows(spark, sf_dir):
    """Days close as time goes on; late events are put beside them, and the days are corrected by them."""
    own, place = timed_events(spark, sf_dir), work_folder(spark, "windows")
    found = state.windows(in_files(own, by_time(own), 4, spark).select("ts", "event_type", "value"), "1 hour", DAY)
    state.drained(spark, found.writeStream.format("parquet").option("path", f"{place}/out"), f"{place}/log")
    return state.corrected(spark.read.schema(found.schema).parquet(f"{place}/out"), state.state_table(spark, f"{place}/log", "sums"))


@register("stream_exactly_once", "SELECT DISTINCT user_id FROM events")
def stream_exactly_once(spark, sf_dir):
    """Users are forgotten two hours after they were seen; those that return are set aside."""
    own, place = timed_events(spark, sf_dir).select("event_id", "user_id", "ts"), work_folder(spark, "once")
    state.take_once(in_files(own, by_time(own), 4, spark).select("user_id", "ts"), "user_id", "ts", "2 hours", place)
    return state.taken(spark, place, "user_id long, ts timestamp", "user_id")[0].select("user_id")


@register("stream_state_variables", f"WITH {RECENT} SELECT task_id, n, round(rate, 9) AS solve_rate FROM recent")
def stream_state_variables(spark, sf_dir):
    """The newest outcomes as a list in the state, which is read back as a table after a restart with more of them."""
    place, own = work_folder(spark, "newest"), table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("ord"), (F.col("event_type") == "purchase").alias("solved"))
    for half in (0, 1):
        own.where(F.col("ord") % 2 == half).write.mode("append").parquet(f"{place}/in")
        state.keep_newest(spark.readStream.schema(own.schema).parquet(f"{place}/in"), place)
    return state.rates(state.state_table(spark, f"{place}/log", "newest")).withColumn("solve_rate", F.round("solve_rate", 9))


@register("stream_topup_batches", "SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY user_id % 3, user_id LIMIT 80")
def stream_topup_batches(spark, sf_dir):
    """Three batches, of which the target ends within one."""
    own = table(spark, sf_dir, "events").select("user_id")
    return streams.topped_up(in_files(own, F.col("user_id") % 3, 3, spark), "user_id", 80)
