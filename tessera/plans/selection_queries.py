"""Queries on curricula, retention and champions. Events stand for outcomes, suppliers for checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import selection
from tessera.plans.corpus_queries import table
from tessera.plans.registry import register

RECENT = "recent AS (SELECT user_id AS task_id, count(*) AS n, avg((event_type = 'purchase')::INT) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 10 GROUP BY user_id)"
REGISTRY = "registry AS (SELECT s_suppkey AS cycle, s_suppkey AS ord, s_acctbal AS solve_rate, s_nationkey % 2 = 0 AS promoted, CASE WHEN s_nationkey % 3 > 0 THEN s_nationkey::DOUBLE END AS score, s_suppkey % 10 / 10 AS second FROM supplier)"


def outcomes(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("ord"), (F.col("event_type") == "purchase").alias("solved"))


def registry(spark, sf_dir):
    score = F.when(F.col("s_nationkey") % 3 > 0, F.col("s_nationkey").cast("double"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cycle"), F.col("s_suppkey").alias("ord"), F.col("s_acctbal").alias("solve_rate"), (F.col("s_nationkey") % 2 == 0).alias("promoted"), score.alias("score"), (F.col("s_suppkey") % 10 / 10).alias("second"))


@register("rolling10_rate", "SELECT user_id AS task_id, event_id AS ord, event_type = 'purchase' AS solved, round(avg((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 9) AS rate FROM events")
def rolling10_rate(spark, sf_dir):
    return selection.rolling_rates(outcomes(spark, sf_dir)).withColumn("rate", F.round("rate", 9))


@register("curriculum_classify", f"WITH {RECENT} SELECT c_custkey AS task_id, CASE WHEN coalesce(rate, 0) < 0.2 THEN 'sft_on_gold' WHEN rate > 0.8 THEN 'graduated' ELSE 'rl_eligible' END AS class FROM customer LEFT JOIN recent ON c_custkey = task_id")
def curriculum_classify(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id")).join(selection.recent_rates(outcomes(spark, sf_dir)), "task_id", "left")
    return own.select("task_id", selection.classify(F.col("solve_rate")).alias("class"))


@register("capped_batch", "SELECT task_id, ord, is_capped FROM (SELECT c_custkey AS task_id, c_custkey AS ord, c_nationkey % 4 = 0 AS is_capped, row_number() OVER (PARTITION BY c_nationkey % 4 = 0 ORDER BY c_custkey) AS r FROM customer) WHERE r <= CASE WHEN is_capped THEN 30 ELSE 70 END")
def capped_batch(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.col("c_custkey").alias("ord"), (F.col("c_nationkey") % 4 == 0).alias("is_capped"))
    return selection.capped_batch(own, 100)


@register("harvest", "SELECT task_id, fingerprint, ord, reward FROM (SELECT user_id AS task_id, event_type AS fingerprint, event_id AS ord, value / 100 AS reward, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events WHERE value / 100 >= 1) WHERE r = 1")
def harvest(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("fingerprint"), F.col("event_id").alias("ord"), (F.col("value") / 100).alias("reward"))
    return selection.harvest(own, spark.createDataFrame([(-1,)], "task_id long"))


KEEP = "keep AS (SELECT DISTINCT cycle FROM (SELECT cycle, row_number() OVER (ORDER BY solve_rate DESC, ord) AS a, row_number() OVER (ORDER BY ord DESC) AS b FROM registry) WHERE a <= 5 OR b = 1)"


@register("registry_keepers", f"WITH {REGISTRY}, {KEEP} SELECT cycle FROM keep")
def registry_keepers(spark, sf_dir):
    return selection.keepers(registry(spark, sf_dir))


@register("registry_prunable", f"WITH {REGISTRY}, {KEEP} SELECT cycle FROM registry WHERE cycle NOT IN (SELECT cycle FROM keep)")
def registry_prunable(spark, sf_dir):
    return selection.prunable(registry(spark, sf_dir)).select("cycle")


@register("champion", f"WITH {REGISTRY} SELECT cycle, solve_rate FROM registry ORDER BY promoted DESC, solve_rate DESC, ord LIMIT 1")
def champion(spark, sf_dir):
    return selection.champion(registry(spark, sf_dir)).select("cycle", "solve_rate")


@register("select_best", f"WITH {REGISTRY} SELECT cycle, score FROM registry WHERE score IS NOT NULL AND coalesce(second, 0) >= 0.5 ORDER BY score DESC, solve_rate DESC, ord LIMIT 1")
def select_best(spark, sf_dir):
    return selection.select_best(registry(spark, sf_dir), 0.5).select("cycle", "score")


@register("select_best_fallback", f"WITH {REGISTRY} SELECT cycle, solve_rate FROM registry ORDER BY promoted DESC, solve_rate DESC, ord LIMIT 1")
def select_best_fallback(spark, sf_dir):
    return selection.select_best(registry(spark, sf_dir), 9.0).select("cycle", "solve_rate")


@register("crown_fallback", f"WITH {REGISTRY} SELECT cycle, score FROM registry WHERE score IS NOT NULL ORDER BY score DESC, solve_rate DESC, ord LIMIT 1")
def crown_fallback(spark, sf_dir):
    return selection.crown(registry(spark, sf_dir), 9.0).select("cycle", "score")


@register("plateau", f"WITH {REGISTRY}, i AS (SELECT cycle, promoted, sum(promoted::INT) OVER (ORDER BY cycle) AS island FROM registry), s AS (SELECT *, sum((NOT promoted)::INT) OVER (PARTITION BY island ORDER BY cycle)::BIGINT AS since FROM i) SELECT cycle, promoted, since, since >= 3 AS stop FROM s")
def plateau(spark, sf_dir):
    return selection.plateau(registry(spark, sf_dir).select("cycle", "promoted"), 3)


RUNS = "i AS (SELECT user_id AS run, event_id AS cycle, event_type = 'purchase' AS promoted, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS promotions FROM events)"


def ledger(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("cycle"), (F.col("event_type") == "purchase").alias("promoted"))


@register("plateau_by_run", f"WITH {RUNS}, s AS (SELECT run, cycle, promoted, sum((NOT promoted)::INT) OVER (PARTITION BY run, promotions ORDER BY cycle)::BIGINT AS since FROM i) SELECT *, since >= 5 AS stop FROM s")
def plateau_by_run(spark, sf_dir):
    return selection.plateau(ledger(spark, sf_dir), 5, "run")


@register("running_promotions", f"WITH {RUNS} SELECT run, cycle, promoted, promotions FROM i")
def running_promotions(spark, sf_dir):
    return selection.promotions(ledger(spark, sf_dir), "run")


@register("systematic_sample", "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, greatest(1, count(*) OVER () // 10) AS step FROM customer) SELECT c_custkey FROM r WHERE i % step = 0 AND i < step * 10")
def systematic_sample(spark, sf_dir):
    return selection.systematic(table(spark, sf_dir, "customer").select("c_custkey"), 10, "c_custkey")


@register("head_sample", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 25")
def head_sample(spark, sf_dir):
    return selection.head(table(spark, sf_dir, "customer").select("c_custkey"), 25, "c_custkey")


@register("seeded_sample")
def seeded_sample(spark, sf_dir):
    return selection.seeded(table(spark, sf_dir, "customer").select("c_custkey"), 25, "c_custkey", seed=3)


@register("promote", f"WITH {REGISTRY} SELECT cycle, promoted, true AS was FROM registry UNION ALL SELECT 0, (SELECT count(*) FILTER (quality = 1 AND toxic = 1) > count(*) FILTER (quality = 0 AND toxic = 0) FROM labels), false")
def promote(spark, sf_dir):
    """A candidate of cycle 0, added with what the gate of two result tables says."""
    old = registry(spark, sf_dir).withColumn("was", F.lit(True))
    gate = table(spark, sf_dir, "labels").agg((F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)) > F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0))).alias("promote"))
    candidate = spark.range(1).select(F.lit(0).cast("long").alias("cycle"), F.lit(False).alias("was"))
    return selection.promote(old, candidate, gate).select("cycle", "promoted", "was")
