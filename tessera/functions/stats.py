"""Statistics as expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: two-sided 95 % normal quantile as rounded by convention.
Z = 1.96


def wilson(successes: Column, n: Column, z: float = Z) -> Column:
    """Struct (low, high) of the Wilson interval; (0, 0) for n = 0."""
    p = successes / F.greatest(n, F.lit(1))
    d = 1 + z * z / F.greatest(n, F.lit(1))
    middle = p + z * z / (2 * F.greatest(n, F.lit(1)))
    half = z * F.sqrt(p * (1 - p) / F.greatest(n, F.lit(1)) + z * z / (4 * F.greatest(n, F.lit(1)) * F.greatest(n, F.lit(1))))
    low = F.greatest(F.lit(0.0), (middle - half) / d)
    high = F.least(F.lit(1.0), (middle + half) / d)
    return F.struct(F.when(n > 0, low).otherwise(0.0).alias("low"), F.when(n > 0, high).otherwise(0.0).alias("high"))


def log_factorial(n: Column) -> Column:
    """ln n! exactly summed up to 16, by Stirling's series beyond; n may be a large count."""
    small = F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(17)]), F.least(n, F.lit(16)).cast("int") + 1)
    x = (n + 1).cast("double")
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 16, small).otherwise(series)


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs. Terms grow by a recurrence from the largest one, in logarithms, so any count will do."""
    n, m = b + c, F.least(b, c)
    top = log_factorial(n) - log_factorial(m) - log_factorial(n - m) - n * math.log(2.0)
    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    steps = F.when(m > 0, F.sequence(F.lit(0).cast("long"), m.cast("long") - 1)).otherwise(F.expr("CAST(array() AS array<bigint>)"))

    def down(a: Column, i: Column) -> Column:
        term = a["term"] * (m - i) / (n - m + i + 1)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    total = F.aggregate(steps, one, down, lambda a: a["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.exp(top) * total))


def detectable(n: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Smallest difference in percentage points that n pairs can show, two decimals."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return F.round(F.lit(z) / F.sqrt(F.greatest(n, F.lit(1))) * 100, 2)


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """Chance that some of k draws out of n, c of them good, is good; 1 where fewer than k are bad."""
    steps = F.when(k > 0, F.sequence(F.lit(0).cast("long"), k.cast("long") - 1)).otherwise(F.expr("CAST(array() AS array<bigint>)"))
    none = F.aggregate(steps, F.lit(1.0), lambda a, i: a * (n - c - i) / (n - i))
    return F.when(n - c < k, F.lit(1.0)).otherwise(1 - none)


def perplexity(loss: Column, tokens: Column) -> Column:
    """exp of the loss by predicted token; texts of fewer than two tokens don't count. An aggregate."""
    counted = tokens >= 2
    return F.exp(F.coalesce(F.sum(F.when(counted, loss * (tokens - 1))), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(F.when(counted, tokens - 1)), F.lit(0)), F.lit(1)))


def forgetting(before: Column, after: Column) -> Column:
    """Growth of a perplexity in percent."""
    return 100 * (after - before) / F.greatest(before, F.lit(1e-9))


def entropy_proxy(logprobs: Column) -> Column:
    """Mean of minus the log probabilities of all tokens of a rollout (array of arrays); 0 for none."""
    flat = F.flatten(logprobs)
    return F.when(F.size(flat) > 0, -F.aggregate(flat, F.lit(0.0), lambda a, x: a + x) / F.size(flat)).otherwise(0.0)
