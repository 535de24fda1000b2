"""Rewards, result tables, gates and the health of rollout batches."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import matching, stats


@dataclass(frozen=True)
class Weights:
    tests: float = 1.0
    dense: float = 0.3
    compile: float = 0.1
    fmt_clippy: float = 0.05


def execution_reward(tampered: Column, fmt: Column, clippy: Column, compiles: Column, expected: Column, passed: Column, failed: Column, w: Weights = Weights()) -> Column:
    """Struct (fmt_clippy, compile, dense, tests, total): tests count only where it compiles and something is expected."""
    num = lambda c: F.when(c, 1.0).otherwise(0.0)
    e = F.array_distinct(expected)
    runs = compiles & (F.size(e) > 0)
    lint = (num(fmt) + num(clippy)) / 2
    dense = F.when(runs, F.size(F.array_intersect(e, passed)) / F.greatest(F.size(e), F.lit(1))).otherwise(0.0)
    tests = num(runs & (F.size(F.array_except(e, passed)) == 0) & (F.size(failed) == 0))
    total = w.tests * tests + w.dense * dense + w.compile * num(compiles) + w.fmt_clippy * lint
    free = lambda c: F.when(tampered, 0.0).otherwise(c)
    return F.struct(free(lint).alias("fmt_clippy"), free(num(compiles)).alias("compile"), free(dense).alias("dense"), free(tests).alias("tests"), free(total).alias("total"))


def pattern_reward(tampered: Column, fmt: Column, clippy: Column, compiles: Column, similarity: Column, w: Weights = Weights()) -> Column:
    """Total where likeness to the known patch stands for the tests."""
    num = lambda c: F.when(c, 1.0).otherwise(0.0)
    total = w.compile * num(compiles) + w.fmt_clippy * (num(fmt) + num(clippy)) / 2 + (w.tests + w.dense) * F.coalesce(similarity, F.lit(0.0))
    return F.when(tampered, 0.0).otherwise(total)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two texts by matching blocks of code points (see functions.matching); 0 where there is no second one. Equal texts, and pairs that come
    again within a batch, cost nothing."""
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a.fillna(""), b.fillna(""), strict=True):
        if pair not in known:
            known[pair] = 0.0 if not pair[1] else matching.ratio(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def register(spark) -> None:
    """Makes the likeness of patches a function of SQL: patch_similarity(candidate, gold)."""
    spark.udf.register("patch_similarity", similarity)


def execution_free_reward(candidate: Column, gold: Column) -> Column:
    """Struct (dense, total): likeness to the known patch stands for everything."""
    like = similarity(candidate, gold)
    return F.struct(like.alias("dense"), like.alias("total"))


def trainer_score(parent: Column, applied: Column, setup_patch: Column, verified: Column, mode: Column, pattern: Column, execution: Column) -> Column:
    """The reward that a trainer gets: 0 without a parent or an applied patch; pass or fail for injected faults; else by mode."""
    has = lambda c: F.coalesce(c != "", F.lit(False))
    return F.when(~has(parent) | ~F.coalesce(applied, F.lit(False)), 0.0).when(has(setup_patch), F.when(verified, 1.0).otherwise(0.0)).when(mode == "pattern", pattern).otherwise(execution)


def solved(results: DataFrame) -> DataFrame:
    """task_id, solved of result documents (per_task: array of (task_id, solved, ...))."""
    return results.select(F.explode("per_task").alias("t")).select("t.task_id", F.coalesce("t.solved", F.lit(False)).alias("solved"))


def paired(candidate: DataFrame, incumbent: DataFrame) -> DataFrame:
    """task_id, cand, inc of the tasks (task_id, solved) that both have."""
    return candidate.select("task_id", F.col("solved").alias("cand")).join(incumbent.select("task_id", F.col("solved").alias("inc")), "task_id")


def cost(model: Column, tokens: Column, rates: dict[str, float]) -> Column:
    """Dollars for tokens by a table of rates a million; models that aren't in it cost nothing."""
    rate = F.lit(0.0)
    for name, dollars in rates.items():
        rate = F.when(model == name, float(dollars)).otherwise(rate)
    return rate * tokens / 1e6


def suite_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """By suite of results (solved, latency_s, usd): n, solved, solve_rate, Wilson interval, mean_latency_s, usd_total; rounded as they are shown."""
    one = results.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("solved").alias("solved"), F.coalesce(F.sum("latency_s"), F.lit(0.0)).alias("s"), F.coalesce(F.sum("usd"), F.lit(0.0)).alias("d"))
    w = stats.wilson(F.col("solved"), F.col("n"))
    shown = F.format_string("[%.2f,%.2f]", w["low"], w["high"])
    return one.select(*by, "n", "solved", F.round(F.col("solved") / F.greatest(F.lit(1), "n"), 4).alias("solve_rate"), shown.alias("ci95"), F.round(F.col("s") / F.greatest(F.lit(1), "n"), 1).alias("mean_latency_s"), F.round("d", 2).alias("usd_total"))


def shard_stats(rollouts: DataFrame) -> DataFrame:
    """By cycle of rollouts (cycle, tests, reward): rollouts, solved, solve_rate, mean_reward; a missing reward is 0."""
    good = F.coalesce("tests", F.lit(0.0)) >= 1
    return rollouts.groupBy("cycle").agg(F.count("*").alias("rollouts"), F.count_if(good).alias("solved"), F.avg(F.when(good, 1.0).otherwise(0.0)).alias("solve_rate"), F.avg(F.coalesce("reward", F.lit(0.0))).alias("mean_reward"))


def pending(wanted: DataFrame, curve: DataFrame) -> DataFrame:
    """Evaluations (tag, model, weights_fp) that curve doesn't have yet; a row of curve without weights_fp has any."""
    done = curve.select(F.col("tag").alias("t_"), F.col("model").alias("m_"), F.col("weights_fp").alias("f_")).distinct()
    same = (F.col("tag") == F.col("t_")) & (F.col("model") == F.col("m_")) & (F.coalesce("f_", "weights_fp") == F.col("weights_fp"))
    return wanted.join(done, same, "left_anti")


def against_base(curve: DataFrame) -> DataFrame:
    """curve (ord, tag, perplexity, ...) with delta_pct against its first row of tag base; null for that tag, or without such a row."""
    base = curve.where("tag = 'base'").agg(F.min_by("perplexity", "ord").alias("base_"))  # one row
    return curve.crossJoin(base).withColumn("delta_pct", F.when(F.col("tag") != "base", stats.forgetting(F.col("base_"), F.col("perplexity")))).drop("base_")


def gate(candidate: DataFrame, incumbent: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row comparing two result tables (task_id, solved) on their common tasks: n, b, c, p_value, promote, mde_pp."""
    pairs = paired(candidate, incumbent)
    counts = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("cand") & ~F.col("inc")).alias("b"), F.count_if(~F.col("cand") & F.col("inc")).alias("c"))
    return counts.withColumn("p_value", stats.mcnemar_p(F.col("b"), F.col("c"))).withColumn("promote", (F.col("p_value") < alpha) & (F.col("b") > F.col("c"))).withColumn("mde_pp", stats.detectable(F.col("n"), alpha))


def comparison(results: DataFrame) -> DataFrame:
    """By model, of rows (model, solved, steps, tokens, usd, latency_s): rate, means, total cost, and a line of a Markdown table."""
    out = results.groupBy("model").agg(F.avg(F.col("solved").cast("int")).alias("solve_rate"), F.avg("steps").alias("avg_steps"), F.avg("tokens").alias("avg_tokens"), F.sum("usd").alias("usd"), F.avg("latency_s").alias("latency_s"))
    return out.withColumn("line", F.format_string("| %s | %.1f%% | %.1f | %.0f | $%.2f | %.1fs |", "model", F.col("solve_rate") * 100, "avg_steps", "avg_tokens", "usd", "latency_s"))


def health(rollouts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Health of batches of rollouts (task_id, reward, tests, dense, compile, fmt_clippy, entropy), one row for each value of by."""
    n = F.greatest(F.lit(1), F.sum("n"))
    mean = lambda c: F.coalesce(F.sum(c), F.lit(0.0)) / n
    solved = F.coalesce("tests", F.lit(0.0)) >= 1
    parts = ("tests", "dense", "compile", "fmt_clippy", "reward", "entropy")
    groups = rollouts.groupBy(*by, "task_id").agg(F.count("*").alias("n"), F.count_if(solved).alias("solved"), *[F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in parts])
    flat = (F.col("solved") == 0) | (F.col("solved") == F.col("n"))
    out = groups.groupBy(*by) if by else groups.groupBy()
    return out.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rollouts"), F.count("*").alias("n_groups"), (F.count_if(flat) / F.greatest(F.lit(1), F.count("*"))).alias("degenerate_group_rate"), mean("entropy").alias("policy_entropy"), mean("reward").alias("mean_reward"), (F.coalesce(F.sum("solved"), F.lit(0)) / n).alias("solve_rate"), *[mean(c).alias(f"r_{c}") for c in parts[:4]])


def degenerate(rollouts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Groups (task_id, n) of rollouts (task_id, tests) that are all solved or all not."""
    good = F.coalesce("tests", F.lit(0.0)) >= 1
    groups = rollouts.groupBy(*by, "task_id").agg(F.count("*").alias("n"), F.bool_and(good).alias("all"), F.bool_or(good).alias("any"))
    return groups.where("all OR NOT any").drop("all", "any")


def log_fields(h: DataFrame) -> DataFrame:
    """h as it is logged: the reward's parts to three decimals."""
    return h.withColumns({c: F.round(c, 3) for c in h.columns if c.startswith("r_")})


def alerts(h: DataFrame, previous: Column) -> DataFrame:
    """h with alerts: names of the rules that a batch breaks; previous is the entropy of the batch before."""
    rules = F.array(
        F.when(F.col("degenerate_group_rate") > 0.6, "degenerate_groups"),
        F.when((previous > 0) & (F.col("policy_entropy") < 0.5 * previous), "entropy_collapse"),
        F.when((F.col("r_tests") < 0.05) & (F.col("r_fmt_clippy") > 0.5), "reward_hack"),
    )
    return h.withColumn("alerts", F.filter(rules, lambda x: x.isNotNull()))


#: Fixed list: what marks a tool's output as an error.
ERRORS = ("ERROR", "error[", "error:", "FAILED", "panicked")


def last_error(messages: Column) -> Column:
    """First line, of at most 300 characters, of the newest tool message that shows an error; empty if none."""
    bad = F.filter(messages, lambda m: (m["role"] == "tool") & F.exists(F.array(*[F.lit(e) for e in ERRORS]), lambda e: F.contains(m["content"], e)))
    line = F.element_at(F.split(F.regexp_replace(F.element_at(bad, -1)["content"], r"(?U)^\s+|\s+\z", ""), r"\r\n|[\n\r]", -1), 1)
    return F.when(F.size(bad) > 0, F.substring(line, 1, 300)).otherwise("")


def lesson_class(tampered: Column, tests: Column, compiled: Column, error: Column, turns: Column) -> Column:
    """Kind of lesson of a rollout."""
    return F.when(tampered, "tampered").when(tests >= 1, F.when(turns <= 10, "solved").otherwise("solved_slowly")).when(compiled >= 1, "tests_failed").when(error.startswith("error:") | error.contains("error["), "compile_error").otherwise("other")


#: What is said of each kind of lesson; {turns}, {failed}, {error}, {fmt} and {compile} are filled in.
LESSONS = {
    "tampered": "Protected files were changed, so the reward is void: tighten the sandbox.", "solved": "Solved in few turns.", "solved_slowly": "Solved, but slowly ({turns} turns): steps could cost something.",
    "tests_failed": "It builds, yet tests fail: the logic is off.{failed}", "compile_error": "It does not build. First error: {error}", "other": "No test passed; style {fmt}, build {compile}.",
}


def lesson(kind: Column, turns: Column, failed: Column, error: Column, fmt: Column, compiled: Column, says: dict[str, str] = LESSONS) -> Column:
    """What a rollout teaches, by the kind of lesson: with up to three failing tests, or the first 160 characters of the error."""
    names = F.when(F.size(failed) > 0, F.concat(F.lit(" Failing: "), F.array_join(F.slice(failed, 1, 3), ", "))).otherwise("")
    values = {"turns": turns.cast("string"), "failed": names, "error": F.substring(error, 1, 160), "fmt": F.format_string("%.1f", fmt), "compile": F.format_string("%.1f", compiled)}
    out = F.lit(says["other"])
    for name, said in says.items():
        out = F.when(kind == name, F.lit(said)).otherwise(out)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def insight(task: Column, model: Column, cycle: Column, reward: Column, turns: Column, parts: Column, lesson_: Column) -> Column:
    """A block of text about one rollout; parts is a struct (fmt_clippy, compile, dense, tests, mode)."""
    outcome = F.when(parts["tests"] >= 1, "SOLVED").otherwise("FAILED")
    tiers = F.format_string("fmt/clippy=%.1f compile=%.0f dense=%.2f tests=%.0f", parts["fmt_clippy"], parts["compile"], parts["dense"], parts["tests"])
    head = F.format_string("=== cycle %d | %s | model=%s ===\noutcome: %s | reward=%.2f | turns=%d | mode=%s\n", cycle, task, model, outcome, reward, turns, F.coalesce(parts["mode"], F.lit("execution")))
    return F.concat(head, F.lit("tiers: "), tiers, F.lit("\nlesson: "), lesson_, F.lit("\n\n"))
