"""Mixing sources to target weights: temperature mixing, realised as block permutations within budgets. DataFrame functions only.

A source's weight is its share of tokens to the power of an exponent between 1 (as they are) and 0 (all alike). The exponent is bisected until
the weights' entropy, or the largest number of repetitions, meets its target. The total is the smallest at which no source falls below one
whole pass, so no document is dropped; a source's budget is its weight of that. A source is passed over whole as often as its budget
allows; the rest of the budget takes blocks in the order of a seeded permutation, and rows of the last block in such an order.

Only one row for each source, and one for each block of about `block_tokens` tokens, is ever brought together; rows of a hot source stay where
they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.folders import work_folder, written

BLOCK_TOKENS = 1 << 20
#: Bisections of the exponent, and how many of them one job settles.
STEPS, STEPS_EACH = 40, 5
MOST = 2**63 - 1


def tokens(text: str = "text") -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: str = "source") -> Column:
    """Rows without a source are a source of their own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def measures(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """Entropy of the weights in nats, and most repetitions, at each exponent. shares: p, one row for each source with tokens."""
    top = shares.agg(F.max("p").alias("top"))
    tried = shares.crossJoin(F.broadcast(top)).select("p", "top", F.posexplode(F.array(*[F.lit(float(x)) for x in exponents])).alias("i", "e"))
    w = F.pow("p", "e")
    rows = tried.groupBy("i").agg(F.sum(w).alias("z"), F.sum(w * F.log(w)).alias("l"), F.max(F.pow(F.col("p") / F.col("top"), F.col("e") - 1)).alias("r"))
    return [(float(x["h"]), float(x["r"])) for x in rows.select("i", (F.log("z") - F.col("l") / F.col("z")).alias("h"), "r").orderBy("i").collect()]  # a row for each exponent


def exponent(shares: DataFrame, entropy: float | None, repetitions: float | None) -> float:
    """The smallest exponent with at most so much entropy, or at most so many repetitions. Both fall as it grows."""
    low, high = 0.0, 1.0

    def meets(m: tuple[float, float]) -> bool:
        return m[0] <= entropy if entropy is not None else m[1] <= repetitions

    at_ends = measures(shares, [low, high])
    if not at_ends or meets(at_ends[0]):
        return low
    if not meets(at_ends[1]):
        return high
    for _ in range(STEPS // STEPS_EACH):
        n = 2**STEPS_EACH
        grid = [low + (high - low) * i / n for i in range(1, n)]
        known = dict(zip(grid, measures(shares, grid), strict=True))
        for _ in range(STEPS_EACH):  # the next bisections fall on the grid
            middle = min(grid, key=lambda x: abs(x - (low + high) / 2))
            low, high = (low, middle) if meets(known[middle]) else (middle, high)
    return high


def plan(counted: DataFrame, entropy: float | None, repetitions: float | None, block_tokens: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Budgets and cuts of rows (key, n_tokens, row): by source its tokens, weight, budget, whole passes and number of blocks; by block of a
    source's last pass the largest row_key that still goes in."""
    spark = counted.sparkSession
    folder = work_folder(spark, "mixing")
    totals = written(counted.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows")), f"{folder}/totals")
    whole = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = totals.where("tokens > 0").select((F.col("tokens") / F.lit(float(max(whole, 1)))).alias("p"))
    alpha = exponent(shares, entropy, repetitions)
    facts = shares.agg(F.sum(F.pow("p", F.lit(alpha))).alias("z"), F.max(F.col("p") / F.pow("p", F.lit(alpha))).alias("scale")).first()
    p = F.col("tokens") / F.lit(float(max(whole, 1)))
    weight = F.when(F.col("tokens") > 0, F.pow(p, F.lit(alpha)) / F.lit(facts["z"] or 1.0)).otherwise(0.0)
    wanted = F.round(F.when(F.col("tokens") > 0, F.pow(p, F.lit(alpha)) * F.lit((facts["scale"] or 0.0) * whole)).otherwise(0.0)).cast("long")
    sources = totals.select("key", "tokens", F.lit(alpha).alias("exponent"), weight.alias("weight"), F.greatest("tokens", wanted).alias("budget"))
    sources = sources.withColumn("passes", F.greatest(F.lit(1), F.expr("CASE WHEN tokens > 0 THEN budget div tokens ELSE 1 END"))).withColumn("rest", F.greatest(F.lit(0), F.col("budget") - F.col("passes") * F.col("tokens"))).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)))
    sources = written(sources, f"{folder}/sources")
    placed = place(counted.join(sources, "key"), seed)
    blocks = placed.where("rest > 0").groupBy("key", "block", "block_key", "rest").agg(F.sum("n_tokens").alias("n")).where("n > 0")
    before = F.sum("n").over(Window.partitionBy("key").orderBy("block_key", "block")) - F.col("n")
    blocks = written(blocks.withColumn("before", before), f"{folder}/blocks")
    cut = blocks.where("before < rest AND before + n > rest").select("key", "block", "before")
    rows = placed.join(cut, ["key", "block"]).groupBy("key", "block", "row_key", "rest", "before").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("key", "block").orderBy("row_key"))
    last = rows.withColumn("upto", F.col("before") + upto).where("upto <= rest").groupBy("key", "block").agg(F.max("row_key").alias("last"))
    inside = F.when(F.col("before") + F.col("n") <= F.col("rest"), F.lit(MOST)).when(F.col("before") < F.col("rest"), F.coalesce("last", F.lit(-MOST - 1))).otherwise(F.lit(-MOST - 1))
    cuts = blocks.join(last, ["key", "block"], "left").select("key", "block", inside.alias("cut"))
    return sources, written(cuts, f"{folder}/cuts")


def place(rows: DataFrame, seed: int) -> DataFrame:
    """Block of each row in its source, the block's place in the last pass's permutation, and the row's in the block."""
    return rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "row"), F.col("blocks"))).withColumn("block_key", F.xxhash64(F.lit(seed), "key", "passes", "block")).withColumn("row_key", F.xxhash64(F.lit(seed + 1), "row", "passes"))


def mix(docs: DataFrame, entropy: float | None = None, repetitions: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 17, text: str = "text", doc_id: str = "doc_id", source: str = "source", keep: bool = False) -> DataFrame:
    """Rows of docs, each as often as its source's budget has it: doc_id, source, n_tokens, weight, epoch, block, block_key, row_key; or,
    with keep, the columns of docs as they are.

    The stream of a source is its rows by epoch, block_key, row_key. Give either a target entropy (nats) or a limit of repetitions
    (at least 1). Null texts have no tokens; rows of sources without tokens come once. Rows are told apart by doc_id and text; equal rows
    are taken together or left together. Null doc_ids are as good as others.
    """
    if (entropy is None) == (repetitions is None):
        raise ValueError("give an entropy or a limit of repetitions")
    row = F.xxhash64(F.col(doc_id).cast("string"), F.col(text))
    counted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), source_key(source).alias("key"), tokens(text).alias("n_tokens"), row.alias("row"))
    folder = work_folder(docs.sparkSession, "mixing")
    counted = written(counted, f"{folder}/counted")
    sources, cuts = plan(counted, entropy, repetitions, block_tokens, seed)
    copies = F.expr("sequence(0L, passes - 1 + CASE WHEN rest > 0 AND row_key <= coalesce(cut, -9223372036854775808) AND cut > -9223372036854775808 THEN 1L ELSE 0L END)")
    brief = sources.select("key", "passes", "rest", "blocks", "weight")
    if keep:
        names = docs.columns
        inner = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
        own = docs.select(*inner, source_key(source).alias("key"), row.alias("row"))
        placed = place(own.join(brief, "key"), seed).join(cuts, ["key", "block"], "left")
        return placed.select(*[f"c{i}" for i in range(len(names))], F.explode(copies).alias("epoch")).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
    placed = place(counted.join(brief, "key"), seed).join(cuts, ["key", "block"], "left")
    out = placed.select("doc_id", "source", "n_tokens", "weight", F.explode(copies).alias("epoch"), "block", "key", "row")
    return out.select("doc_id", "source", "n_tokens", "weight", "epoch", "block", F.xxhash64(F.lit(seed), "key", "epoch", "block").alias("block_key"), F.xxhash64(F.lit(seed + 1), "row", "epoch").alias("row_key"))


def stream(mixed: DataFrame, folder: str) -> DataFrame:
    """Rows of mix (without keep) written in the order in which they are to be read: sources one after another, each by epoch, block_key and
    row_key; a file holds a range of that order, and files' names follow it. Returns the written table; no task holds more than its range."""
    order = [F.col("source").asc_nulls_first(), "epoch", "block_key", "block", "row_key", "doc_id"]
    return written(mixed.repartitionByRange(*order).sortWithinPartitions(*order), f"{folder}/stream")
