"""Chat records with a loss mask, and what goes into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_chat(turns: Column) -> tuple[Column, Column]:
    """messages and loss_mask of an array of (role, content, loss)."""
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))), F.transform(turns, lambda t: t["loss"])


def instruction(problem: Column, snippet: Column, solution: Column, system: str) -> Column:
    """Turns of one exercise: system, problem with the code, solution; only the last is learnt."""
    turn = lambda role, content, loss: F.struct(F.lit(role).alias("role"), content.alias("content"), F.lit(loss).alias("loss"))
    ask = F.concat(problem, F.lit("\n\nRelevant code:\n```rust\n"), snippet, F.lit("\n```"))
    return F.array(turn("system", F.lit(system), False), turn("user", ask, False), turn("assistant", solution, True))


def complete(raw: DataFrame) -> DataFrame:
    """Rows (problem, snippet, solution) with nothing blank; the snippet is the solution where there is one."""
    solution = F.coalesce(F.nullif("snippet", F.lit("")), "solution")
    full = lambda c: F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))
    return raw.withColumn("solution", solution).where(full(F.col("snippet")) & full(F.col("problem")) & full(F.col("solution")))


def sft(raw: DataFrame, trajectories: DataFrame, system: str, least: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Instruction records (messages, loss_mask) of raw rows (problem, snippet, solution), chats of accepted trajectories (chat, reward), and
    one row of counts: kept and skipped instructions, kept and all trajectories, and the share of those that were rejected."""
    messages, mask = to_chat(instruction(F.col("problem"), F.col("snippet"), F.col("solution"), system))
    records, chats = complete(raw).select(messages.alias("messages"), mask.alias("loss_mask")), accepted(trajectories, least).select("chat.*")
    counts = raw.agg(F.count("*").alias("n")).crossJoin(complete(raw).agg(F.count("*").alias("kept"))).crossJoin(trajectories.agg(F.count("*").alias("trajectories"), F.count_if(F.coalesce("reward", F.lit(0.0)) >= least).alias("accepted")))
    return records, chats, counts.select("kept", (F.col("n") - F.col("kept")).alias("skipped"), "accepted", "trajectories", (1 - F.col("accepted") / F.greatest(F.lit(1), "trajectories")).alias("rejected"))


def accepted(trajectories: DataFrame, least: float = 1.0) -> DataFrame:
    """Trajectories of at least that reward; a missing one is 0."""
    return trajectories.where(F.coalesce("reward", F.lit(0.0)) >= least)


def dialogues(turns: DataFrame, longest: int = 100_000) -> DataFrame:
    """conv_id, turns (role, content, loss) of rows (conv_id, turn, role, text) in order; assistants' turns are learnt.

    One row holds a dialogue, so one of more than `longest` turns is an error, not a cut.
    """
    one = F.struct(F.col("turn"), F.col("role"), F.coalesce("text", F.lit("")).alias("content"), (F.col("role") == "assistant").alias("loss"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    sized = F.when(F.size("t") <= longest, F.col("t")).otherwise(F.raise_error(F.lit("a dialogue has too many turns for one row")))
    return grouped.select("conv_id", F.transform(sized, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"), t["loss"].alias("loss"))).alias("turns"))


def rollout_fingerprint(messages: Column) -> Column:
    """16 hex digits of all that assistants say."""
    own = F.transform(F.filter(messages, lambda m: m["role"] == "assistant"), lambda m: F.coalesce(m["content"], F.lit("")))
    return F.substring(F.sha2(F.array_join(own, ""), 256), 1, 16)


def prompts(path: Column, snippet: Column, template: str) -> Column:
    """A prompt template with {path} and {snippet} filled in."""
    return F.replace(F.replace(F.lit(template), F.lit("{path}"), path), F.lit("{snippet}"), snippet)


def trajectory_jobs(tasks: DataFrame, samples: int, have: DataFrame | None = None) -> DataFrame:
    """task_id, sample for every task and sample number that is not had yet."""
    out = tasks.select("task_id", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample"))
    return out if have is None else out.join(have.select("task_id", "sample").distinct(), ["task_id", "sample"], "left_anti")


def captured(logprobs: Column) -> tuple[Column, Column]:
    """Token ids (missing: -1) and log probabilities (missing: 0) of one turn's tokens, an array of (token_id, logprob); none of null."""
    own = F.coalesce(logprobs, F.filter(logprobs, lambda t: F.lit(False)), F.array().cast("array<struct<token_id:bigint,logprob:double>>"))
    return F.transform(own, lambda t: F.coalesce(t["token_id"], F.lit(-1))), F.transform(own, lambda t: F.coalesce(t["logprob"], F.lit(0.0)))


def steps(messages: Column) -> Column:
    """How many messages are the assistant's."""
    return F.size(F.filter(messages, lambda m: m["role"] == "assistant")).cast("long")


def n_tokens(token_ids: Column) -> Column:
    """Tokens of all turns (array of arrays)."""
    return F.aggregate(token_ids, F.lit(0).cast("long"), lambda a, t: a + F.coalesce(F.size(t), F.lit(0)))


def shortfall(snippets: DataFrame, done: DataFrame, target: int, spare: int, order: str = "ord") -> DataFrame:
    """Snippets (ord, snippet) to ask a teacher for, so that done grows to target: those not done yet among the first max(2 * target, 3 * need),
    at most 1.6 * need and a few to spare. None if there are enough."""
    need = max(0, target - done.count())
    if not need:
        return snippets.limit(0)
    pool = snippets.orderBy(order).limit(max(2 * target, 3 * need))
    return pool.join(done.select("snippet").distinct(), "snippet", "left_anti").orderBy(order).limit(int(need * 1.6) + spare)
