"""Stateful selection: curriculum, harvest, retention, champions, plateaus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.corpus import first_by
from tessera.operators.scan import ranked, since_last

WINDOW, BAND, CAP = 10, (0.2, 0.8), 0.3


def recent_rates(outcomes: DataFrame, window: int = WINDOW) -> DataFrame:
    """task_id, n, solve_rate over the newest outcomes (task_id, ord, solved) of each task."""
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy(F.col("ord").desc()))
    return outcomes.withColumn("r_", rank).where(F.col("r_") <= window).groupBy("task_id").agg(F.count("*").alias("n"), F.avg(F.col("solved").cast("int")).alias("solve_rate"))


def rolling_rates(outcomes: DataFrame, window: int = WINDOW) -> DataFrame:
    """outcomes with the rate over each row and those before it, as it was then."""
    frame = Window.partitionBy("task_id").orderBy("ord").rowsBetween(1 - window, 0)
    return outcomes.withColumn("rate", F.avg(F.col("solved").cast("int")).over(frame))


def classify(rate: Column, band: tuple[float, float] = BAND, unseen: float = 0.0) -> Column:
    """Where a task belongs by its rate; tasks without outcomes have the rate `unseen`."""
    r = F.coalesce(rate, F.lit(unseen))
    return F.when(r < band[0], "sft_on_gold").when(r > band[1], "graduated").otherwise("rl_eligible")


def capped_batch(tasks: DataFrame, n: int, fraction: float = CAP) -> DataFrame:
    """Of tasks (task_id, ord, is_capped): int(n * fraction) capped ones at most, and the rest of n from the others, by ord; no refill. Tasks keep
    the first n of what they hold, so that what is put together is a batch a task."""
    cap = int(n * fraction)
    return tasks.where("is_capped").orderBy("ord").limit(cap).union(tasks.where("NOT is_capped").orderBy("ord").limit(n - cap))


def harvest(rollouts: DataFrame, held: DataFrame, least: float = 1.0) -> DataFrame:
    """First of each (task_id, fingerprint) among rollouts (task_id, ord, reward, fingerprint) of at least that reward; a rollout of a
    held task among them is an error."""
    good = rollouts.where(F.coalesce("reward", F.lit(0.0)) >= least)
    marked = good.join(held.select("task_id", F.lit(True).alias("held_")).distinct(), "task_id", "left")
    clean = marked.withColumn("task_id", F.when(F.col("held_"), F.raise_error(F.concat(F.lit("held-out task in the harvest: "), F.col("task_id").cast("string")))).otherwise(F.col("task_id"))).drop("held_")
    return first_by(clean, ["task_id", "fingerprint"], ["ord"])


def best_of(rows: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first k rows in order, by bounded heaps: each task keeps the k best of its rows, and the heaps are merged once."""
    return rows.orderBy(*order).limit(k)


def keepers(registry: DataFrame, k: int = 5) -> DataFrame:
    """Cycles to keep of registry (cycle, ord, solve_rate): the best, the newest, and the k best; earlier ones win ties. Only heaps of k rows leave
    the tasks; the table is never sorted."""
    own = registry.select("cycle", "ord", "solve_rate")
    best = best_of(own, max(k, 1), [F.col("solve_rate").desc(), F.col("ord")])
    return best.union(best_of(own, 1, [F.col("ord").desc()])).select("cycle").distinct()


def prunable(registry: DataFrame, k: int = 5) -> DataFrame:
    """Rows of registry whose cycle is not kept; the keepers are k + 1 rows at most."""
    return registry.join(F.broadcast(keepers(registry, k)), "cycle", "left_anti")


def champion(registry: DataFrame) -> DataFrame:
    """Row of the best solve rate among promoted ones, or among all if none is; the first on ties."""
    order = F.struct(F.coalesce("promoted", F.lit(False)), "solve_rate", -F.col("ord"))
    return registry.agg(F.max_by(F.struct(*registry.columns), order).alias("x")).where("x IS NOT NULL").select("x.*")


def best_scored(registry: DataFrame, floor: float) -> DataFrame:
    """The highest (score, solve_rate) of scored rows whose second score is at least floor."""
    fit = registry.where(F.col("score").isNotNull() & (F.coalesce("second", F.lit(0.0)) >= floor))
    return fit.agg(F.max_by(F.struct(*registry.columns), F.struct("score", "solve_rate", -F.col("ord"))).alias("x")).where("x IS NOT NULL").select("x.*")


def select_best(registry: DataFrame, floor: float) -> DataFrame:
    """best_scored, or the champion if none reaches the floor."""
    best = best_scored(registry, floor)
    return best.unionByName(champion(registry).join(best.select(F.lit(1).alias("one")).limit(1), F.lit(True), "left_anti"))


def crown(registry: DataFrame, floor: float) -> DataFrame:
    """best_scored, or the best of all scored rows if none reaches the floor."""
    best = best_scored(registry, floor)
    return best.unionByName(best_scored(registry.withColumn("second", F.lit(float("inf"))), 0.0).drop("second").join(registry.select("cycle", "second"), "cycle").select(*registry.columns).join(best.select(F.lit(1).alias("one")).limit(1), F.lit(True), "left_anti"))


def plateau(ledger: DataFrame, patience: int = 5, run: str | None = None) -> DataFrame:
    """ledger (cycle, promoted) with the number of cycles since the last promotion, and whether that is a plateau; each run for itself, if named."""
    return since_last(ledger, F.col("promoted"), "cycle", run).drop("so_far").withColumn("stop", F.col("since") >= patience)


def promotions(ledger: DataFrame, run: str | None = None) -> DataFrame:
    """ledger (cycle, promoted) with the number of promotions up to each cycle."""
    return since_last(ledger, F.col("promoted"), "cycle", run).drop("since").withColumnRenamed("so_far", "promotions")


def systematic(rows: DataFrame, k: int, order: str) -> DataFrame:
    """Every (n div k)-th row in order, k at most."""
    n = max(1, rows.count() // k)
    return ranked(rows, order).where((F.col("rank_") % n == 0) & (F.col("rank_") < n * k)).drop("rank_")


def head(rows: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows in order."""
    return rows.orderBy(order).limit(n)


def promote(registry: DataFrame, candidate: DataFrame, gate: DataFrame | None) -> DataFrame:
    """registry with the candidate's row added: promoted if there is no incumbent (gate None) or the gate (one row with promote) says so."""
    says = candidate.withColumn("promoted", F.lit(True)) if gate is None else candidate.drop("promoted").crossJoin(gate.select(F.col("promote").alias("promoted")))
    return registry.unionByName(says, allowMissingColumns=True)


def seeded(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows in an order that the seed gives."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
