"""Queries on results: intervals, gates, rewards, health. Events stand for rollouts, orders for suite results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.operators import evaluation
from tessera.plans.corpus_queries import table
from tessera.plans.registry import register

WILSON = """CASE WHEN n > 0 THEN round(greatest(0.0, (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((k / n) * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 9) ELSE 0 END AS low,
CASE WHEN n > 0 THEN round(least(1.0, (k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt((k / n) * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 9) ELSE 0 END AS high"""


@register("wilson_by_group", f"WITH g AS (SELECT lang, count(*)::DOUBLE AS n, count(*) FILTER (quality = 1)::DOUBLE AS k FROM documents JOIN labels USING (doc_id) GROUP BY lang) SELECT lang, n::BIGINT AS n, k::BIGINT AS k, {WILSON} FROM g")
def wilson_by_group(spark, sf_dir):
    own = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    w = stats.wilson(F.col("k"), F.col("n"))
    return own.select("lang", "n", "k", F.round(w["low"], 9).alias("low"), F.round(w["high"], 9).alias("high"))


@register(
    "mcnemar_gate",
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 1) AS b, count(*) FILTER (quality = 0 AND toxic = 0) AS c FROM labels),
p AS (SELECT *, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, (SELECT 2 * sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0))) FROM range(0, 100000) t(i) WHERE i <= least(b, c))) END AS p FROM c)
SELECT n, b, c, round(p, 9) AS p_value, p < 0.05 AND b > c AS promote, round((1.959963984540054 + 0.8416212335729143) / sqrt(greatest(n, 1)) * 100, 2) AS mde_pp FROM p""",
)
def mcnemar_gate(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "task_id")
    out = evaluation.gate(labels.select("task_id", (F.col("quality") == 1).alias("solved")), labels.select("task_id", (F.col("toxic") == 0).alias("solved")))
    return out.withColumn("p_value", F.round("p_value", 9))


@register(
    "pass_at_k",
    """WITH p AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS c FROM events GROUP BY user_id),
k AS (SELECT *, unnest([1, 5, 10]) AS k FROM p), s AS (SELECT k, CASE WHEN n - c < k THEN 1.0 ELSE 1 - list_reduce(list_transform(range(0, k), lambda i: (n - c - i)::DOUBLE / (n - i)), lambda a, x: a * x, 1.0::DOUBLE) END AS v FROM k)
SELECT k, round(avg(v), 9) AS pass_at_k FROM s GROUP BY k""",
)
def pass_at_k(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("c"))
    own = own.select("*", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10))).alias("k"))
    return own.groupBy("k").agg(F.round(F.avg(stats.pass_at_k(F.col("n"), F.col("c"), F.col("k"))), 9).alias("pass_at_k"))


@register("weighted_perplexity", "SELECT event_type, round(exp(coalesce(sum(value / 100 * (event_id % 50 - 1)) FILTER (event_id % 50 >= 2), 0) / greatest(1, coalesce(sum(event_id % 50 - 1) FILTER (event_id % 50 >= 2), 0))), 9) AS ppl FROM events GROUP BY event_type")
def weighted_perplexity(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(stats.perplexity(F.col("value") / 100, F.col("event_id") % 50), 9).alias("ppl"))


SUITE = "suite AS (SELECT c_mktsegment AS model, o_orderstatus = 'F' AS solved, o_orderkey % 30 AS steps, o_custkey AS tokens, round(o_totalprice * 100)::BIGINT AS cents FROM orders JOIN customer ON o_custkey = c_custkey)"


@register("comparison_table", f"WITH {SUITE} SELECT model, round(avg(solved::INT), 9) AS solve_rate, round(avg(steps), 6) AS avg_steps, round(avg(tokens), 6) AS avg_tokens, round(sum(cents) / 100, 2) AS usd, round(avg(cents), 4) AS latency_s FROM suite GROUP BY model")
def comparison_table(spark, sf_dir):
    own = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    own = own.select(F.col("c_mktsegment").alias("model"), (F.col("o_orderstatus") == "F").alias("solved"), (F.col("o_orderkey") % 30).alias("steps"), F.col("o_custkey").alias("tokens"), cents.alias("usd"), cents.alias("latency_s"))
    out = evaluation.comparison(own)
    return out.select("model", F.round("solve_rate", 9).alias("solve_rate"), F.round("avg_steps", 6).alias("avg_steps"), F.round("avg_tokens", 6).alias("avg_tokens"), F.round(F.col("usd") / 100, 2).alias("usd"), F.round("latency_s", 4).alias("latency_s"))


@register("forgetting_delta", "WITH b AS (SELECT user_id, avg(value) FILTER (event_id % 2 = 0) AS x, avg(value) FILTER (event_id % 2 = 1) AS y FROM events GROUP BY user_id) SELECT user_id, round(100 * (y - x) / greatest(x, 1e-9), 6) AS pct FROM b")
def forgetting_delta(spark, sf_dir):
    half = lambda i: F.avg(F.when(F.col("event_id") % 2 == i, F.col("value")))
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(half(0).alias("x"), half(1).alias("y"))
    return own.select("user_id", F.round(stats.forgetting(F.col("x"), F.col("y")), 6).alias("pct"))


@register("cost_by_model", "SELECT c_mktsegment AS model, round(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 5 ELSE 0 END * c_custkey) / 1e6, 9) AS usd FROM customer GROUP BY model")
def cost_by_model(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("model"), evaluation.cost(F.col("c_mktsegment"), F.col("c_custkey"), {"BUILDING": 5.0}).alias("usd"))
    return own.groupBy("model").agg(F.round(F.sum("usd"), 9).alias("usd"))


@register(
    "suite_summary",
    f"""WITH {SUITE}, g AS (SELECT model, count(*)::DOUBLE AS n, count(*) FILTER (solved)::DOUBLE AS k, sum(cents) AS s FROM suite GROUP BY model), w AS (SELECT *, {WILSON} FROM g)
SELECT model, n::BIGINT AS n, k::BIGINT AS solved, round(k / greatest(1, n), 4) AS solve_rate, format('[{{:.2f}},{{:.2f}}]', low, high) AS ci95, round(s / greatest(1, n), 1) AS mean_latency_s, round(s / 100, 2) AS usd_total FROM w""",
)
def suite_summary(spark, sf_dir):
    own = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    own = own.select(F.col("c_mktsegment").alias("model"), (F.col("o_orderstatus") == "F").alias("solved"), cents.alias("latency_s"), (cents / 100).cast("decimal(20,2)").alias("usd"))
    return evaluation.suite_summary(own, ["model"]).withColumn("usd_total", F.col("usd_total").cast("double"))


@register("shard_stats", "WITH {ROLLOUTS} SELECT cycle, count(*) AS rollouts, count(*) FILTER (tests = 1) AS solved, round(avg(tests), 9) AS solve_rate, round(sum(cents) / count(*), 6) AS mean_reward FROM rollouts GROUP BY cycle".replace("{ROLLOUTS}", "rollouts AS (SELECT event_id % 10 AS cycle, round(value * 100)::BIGINT AS cents, (event_type = 'purchase')::INT AS tests FROM events)"))
def shard_stats(spark, sf_dir):
    out = evaluation.shard_stats(rollouts(spark, sf_dir))
    return out.withColumns({"solve_rate": F.round("solve_rate", 9), "mean_reward": F.round("mean_reward", 6)})


CURVE = "curve AS (SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 7 = 0 THEN 'base' ELSE 't' || s_suppkey % 5 END AS tag, 'm' || s_nationkey AS model, s_suppkey / 4 + 1 AS perplexity, CASE WHEN s_suppkey % 3 > 0 THEN 'f' || s_suppkey % 3 END AS weights_fp FROM supplier)"


def curve(spark, sf_dir):
    i = F.col("s_suppkey")
    tag, fp = F.when(i % 7 == 0, "base").otherwise(F.concat(F.lit("t"), (i % 5).cast("string"))), F.when(i % 3 > 0, F.concat(F.lit("f"), (i % 3).cast("string")))
    return table(spark, sf_dir, "supplier").select(i.alias("ord"), tag.alias("tag"), F.concat(F.lit("m"), F.col("s_nationkey").cast("string")).alias("model"), (i / 4 + 1).alias("perplexity"), fp.alias("weights_fp"))


@register("eval_pending", f"WITH {CURVE}, wanted AS (SELECT DISTINCT 't' || c_custkey % 6 AS tag, 'm' || c_nationkey AS model, 'f' || c_custkey % 4 AS weights_fp FROM customer) SELECT * FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM curve c WHERE c.tag = w.tag AND c.model = w.model AND coalesce(c.weights_fp, w.weights_fp) = w.weights_fp)")
def eval_pending(spark, sf_dir):
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    own = table(spark, sf_dir, "customer").select(name("t", F.col("c_custkey") % 6).alias("tag"), name("m", F.col("c_nationkey")).alias("model"), name("f", F.col("c_custkey") % 4).alias("weights_fp")).distinct()
    return evaluation.pending(own, curve(spark, sf_dir))


@register("base_delta", f"WITH {CURVE}, b AS (SELECT perplexity AS base FROM curve WHERE tag = 'base' ORDER BY ord LIMIT 1) SELECT ord, tag, CASE WHEN tag <> 'base' THEN round(100 * (perplexity - base) / greatest(base, 1e-9), 6) END AS delta_pct FROM curve LEFT JOIN b ON true")
def base_delta(spark, sf_dir):
    return evaluation.against_base(curve(spark, sf_dir)).select("ord", "tag", F.round("delta_pct", 6).alias("delta_pct"))


@register(
    "eval_result_gate",
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 1) AS b, count(*) FILTER (quality = 0 AND toxic = 0) AS c FROM labels) SELECT n, b, c FROM c""",
)
def eval_result_gate(spark, sf_dir):
    """Result documents of fifty tasks each, taken apart and held against each other."""
    labels = table(spark, sf_dir, "labels").withColumn("document", F.expr("doc_id div 50"))
    task = lambda good: F.struct(F.col("doc_id").alias("task_id"), good.alias("solved"))
    results = lambda good: labels.groupBy("document").agg(F.collect_list(task(good)).alias("per_task"))
    return evaluation.gate(evaluation.solved(results(F.col("quality") == 1)), evaluation.solved(results(F.col("toxic") == 0))).select("n", "b", "c")


@register(
    "reward_execution",
    """WITH s AS (SELECT event_id, event_id % 11 = 0 AS tampered, event_id % 2 = 0 AS fmt, event_id % 3 = 0 AS clippy, event_id % 5 <> 0 AS compiles, event_id % 4 AS e, event_id % 7 AS p, event_id % 13 = 0 AS bad FROM events),
r AS (SELECT event_id, tampered, (fmt::INT + clippy::INT) / 2 AS lint, compiles::INT AS c, CASE WHEN compiles AND e > 0 THEN least(e, p) / e ELSE 0 END AS dense, CASE WHEN compiles AND e > 0 AND p >= e AND NOT bad THEN 1 ELSE 0 END AS tests FROM s)
SELECT event_id, round(CASE WHEN tampered THEN 0 ELSE tests + 0.3 * dense + 0.1 * c + 0.05 * lint END, 9) AS total, CASE WHEN tampered THEN 0 ELSE tests END::DOUBLE AS tests FROM r""",
)
def reward_execution(spark, sf_dir):
    names = lambda n: F.transform(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>")), lambda i: F.concat(F.lit("t"), i.cast("string")))
    i = F.col("event_id")
    failed = F.when(i % 13 == 0, F.array(F.lit("z"))).otherwise(F.array().cast("array<string>"))
    r = evaluation.execution_reward(i % 11 == 0, i % 2 == 0, i % 3 == 0, i % 5 != 0, names(i % 4), names(i % 7), failed)
    return table(spark, sf_dir, "events").select("event_id", r.alias("r")).select("event_id", F.round("r.total", 9).alias("total"), "r.tests")


@register("reward_pattern", "SELECT event_id, round(CASE WHEN event_id % 11 = 0 THEN 0 ELSE 0.1 * (event_id % 5 <> 0)::INT + 0.05 * ((event_id % 2 = 0)::INT + (event_id % 3 = 0)::INT) / 2 + 1.3 * ((event_id % 100) / 100) END, 9) AS total FROM events")
def reward_pattern(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(evaluation.pattern_reward(i % 11 == 0, i % 2 == 0, i % 3 == 0, i % 5 != 0, (i % 100) / 100), 9).alias("total"))


ROLLOUTS = "rollouts AS (SELECT user_id AS task_id, event_id % 10 AS cycle, round(value * 100)::BIGINT AS cents, (event_type = 'purchase')::INT AS tests, (props->>'k')::INT AS k FROM events)"
HEALTH = f"""{ROLLOUTS}, g AS (SELECT cycle, task_id, count(*) AS n, sum(tests) AS s, sum(cents) AS cents, sum(k) AS k FROM rollouts GROUP BY ALL),
h AS (SELECT cycle, sum(n)::BIGINT AS n_rollouts, count(*) AS n_groups, round(count(*) FILTER (s = 0 OR s = n) / count(*), 9) AS degenerate_group_rate, round(sum(k) / sum(n), 6) AS policy_entropy, round(sum(cents) / sum(n), 6) AS mean_reward, round(sum(s) / sum(n), 9) AS solve_rate FROM g GROUP BY cycle)"""


def rollouts(spark, sf_dir):
    """Events as rollouts; counts stay whole, so that sums don't depend on their order."""
    k = F.get_json_object("props", "$.k").cast("int")
    tests = (F.col("event_type") == "purchase").cast("double")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), (F.col("event_id") % 10).alias("cycle"), F.round(F.col("value") * 100).alias("reward"), tests.alias("tests"), tests.alias("dense"), tests.alias("compile"), F.lit(1.0).alias("fmt_clippy"), k.cast("double").alias("entropy"))


def health_rows(spark, sf_dir):
    h = evaluation.health(rollouts(spark, sf_dir), ["cycle"])
    return h.withColumns({c: F.round(c, d) for c, d in (("degenerate_group_rate", 9), ("policy_entropy", 6), ("mean_reward", 6), ("solve_rate", 9))})


@register("batch_health", f"WITH {HEALTH} SELECT * FROM h")
def batch_health(spark, sf_dir):
    return health_rows(spark, sf_dir).select("cycle", "n_rollouts", "n_groups", "degenerate_group_rate", "policy_entropy", "mean_reward", "solve_rate")


@register("degenerate_groups", f"WITH {ROLLOUTS} SELECT cycle, task_id, count(*) AS n FROM rollouts GROUP BY ALL HAVING sum(tests) = 0 OR sum(tests) = count(*)")
def degenerate_groups(spark, sf_dir):
    return evaluation.degenerate(rollouts(spark, sf_dir), ["cycle"]).select("cycle", "task_id", "n")


@register("health_fields", f"WITH {ROLLOUTS} SELECT cycle, round(avg(tests), 3) AS r_tests, round(avg(tests), 3) AS r_dense, 1.0::DOUBLE AS r_fmt_clippy FROM rollouts GROUP BY cycle")
def health_fields(spark, sf_dir):
    return evaluation.log_fields(evaluation.health(rollouts(spark, sf_dir), ["cycle"])).select("cycle", "r_tests", "r_dense", "r_fmt_clippy")


@register(
    "health_alerts",
    f"""WITH {HEALTH}, l AS (SELECT *, lag(policy_entropy) OVER (ORDER BY cycle) AS prev FROM h)
SELECT cycle, concat_ws(',', CASE WHEN degenerate_group_rate > 0.6 THEN 'degenerate_groups' END, CASE WHEN prev > 0 AND policy_entropy < 0.5 * prev THEN 'entropy_collapse' END, CASE WHEN solve_rate < 0.05 THEN 'reward_hack' END) AS alerts FROM l""",
)
def health_alerts(spark, sf_dir):
    from pyspark.sql import Window

    previous = F.lag("policy_entropy").over(Window.orderBy("cycle"))  # a row for each cycle
    own = health_rows(spark, sf_dir).withColumn("prev", previous)
    return evaluation.alerts(own, F.col("prev")).select("cycle", F.array_join("alerts", ",").alias("alerts"))


@register("lesson_class", "SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'tampered' WHEN event_type = 'purchase' THEN CASE WHEN event_id % 20 <= 10 THEN 'solved' ELSE 'solved_slowly' END WHEN event_type = 'click' THEN 'tests_failed' WHEN event_type = 'error' THEN 'compile_error' ELSE 'other' END AS lesson FROM events")
def lesson_class(spark, sf_dir):
    i = F.col("event_id")
    is_ = lambda t: (F.col("event_type") == t).cast("double")
    tool = F.concat(F.col("event_type"), F.lit("[E1]: bad\nmore"))
    messages = F.array(F.struct(F.lit("tool").alias("role"), tool.alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("error: x").alias("content")))
    return table(spark, sf_dir, "events").select("event_id", evaluation.lesson_class(i % 17 == 0, is_("purchase"), is_("click"), evaluation.last_error(messages), i % 20).alias("lesson"))


SCORED = "s AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN 'p' ELSE '' END AS parent, event_id % 7 > 0 AS applied, event_id % 3 = 0 AS fault, event_id % 2 = 0 AS ok, CASE WHEN event_id % 4 = 0 THEN 'pattern' ELSE 'execution' END AS mode, value AS v FROM events)"


@register("trainer_score", f"WITH {SCORED} SELECT event_id, round(CASE WHEN parent = '' OR NOT applied THEN 0 WHEN fault THEN ok::INT WHEN mode = 'pattern' THEN v / 2 ELSE v END, 9) AS score FROM s")
def trainer_score(spark, sf_dir):
    i, v = F.col("event_id"), F.col("value")
    score = evaluation.trainer_score(F.when(i % 5 > 0, "p").otherwise(""), i % 7 > 0, F.when(i % 3 == 0, "d"), i % 2 == 0, F.when(i % 4 == 0, "pattern").otherwise("execution"), v / 2, v)
    return table(spark, sf_dir, "events").select("event_id", F.round(score, 9).alias("score"))


@register("reward_udf", "SELECT conv_id, turn, CASE WHEN text = '' THEN 0 WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END::DOUBLE AS reward FROM conversations WHERE text IS NOT NULL")
def reward_udf(spark, sf_dir):
    """The registered function in SQL, on texts that are equal or have nothing in common."""
    evaluation.register(spark)
    table(spark, sf_dir, "conversations").createOrReplaceTempView("tessera_conversations")
    return spark.sql("SELECT conv_id, turn, patch_similarity(IF(conv_id % 2 = 0, text, ''), text) AS reward FROM tessera_conversations WHERE text IS NOT NULL")


@register(
    "insight_blocks",
    """SELECT event_id, '=== cycle ' || event_id % 10 || ' | ' || user_id || ' | model=m ===' || chr(10) || 'outcome: ' || CASE WHEN event_type = 'purchase' THEN 'SOLVED' ELSE 'FAILED' END || ' | reward=' || format('{:.2f}', event_id % 8 / 4) || ' | turns=' || event_id % 20 || ' | mode=execution' || chr(10)
  || 'tiers: fmt/clippy=0.5 compile=1 dense=0.25 tests=' || (event_type = 'purchase')::INT || chr(10) || 'lesson: ' || CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 20 <= 10 THEN 'Solved in few turns.' ELSE 'Solved, but slowly (' || event_id % 20 || ' turns): steps could cost something.' END
  ELSE 'It builds, yet tests fail: the logic is off.' || CASE WHEN event_id % 3 = 0 THEN ' Failing: a, b, c' ELSE '' END END || chr(10) || chr(10) AS block FROM events""",
)
def insight_blocks(spark, sf_dir):
    i, won = F.col("event_id"), (F.col("event_type") == "purchase").cast("double")
    parts = F.struct(F.lit(0.5).alias("fmt_clippy"), F.lit(1.0).alias("compile"), F.lit(0.25).alias("dense"), won.alias("tests"), F.lit(None).cast("string").alias("mode"))
    failed = F.when(i % 3 == 0, F.array(*[F.lit(x) for x in "abcd"])).otherwise(F.array().cast("array<string>"))
    kind = evaluation.lesson_class(F.lit(False), won, F.lit(1.0), F.lit(""), i % 20)
    said = evaluation.lesson(kind, i % 20, failed, F.lit(""), F.lit(0.5), F.lit(1.0))
    return table(spark, sf_dir, "events").select("event_id", evaluation.insight(F.col("user_id").cast("string"), F.lit("m"), i % 10, i % 8 / 4, i % 20, parts, said).alias("block"))
