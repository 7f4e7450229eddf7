"""Exact tests, intervals and ratios as columns."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959963984540054  # two-sided 95 %
MIN_GAP = 0.05
#: Up to this many observations the tests use whole numbers, where tables count as equally likely within 1e-9; beyond, sums of
#: logarithms, which err by about 1e-16 n log n (1e-11 at a million observations, 1e-8 at a thousand million), within 40 standard
#: deviations of the mode, beyond which lies less than 1e-300; there tables count as equally likely within 1e-7.
EXACT = 20_000


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided: the tables of equal margins no likelier than this one."""
    n, row, column = a + b + c + d, a + b, a + c
    if not n:
        return 1.0
    low, high = max(0, column - (n - row)), min(row, column)
    if n <= EXACT:
        weight = math.comb(row, low) * math.comb(n - row, column - low)
        weights = []
        for k in range(low, high + 1):
            weights.append(weight)
            weight = weight * (row - k) * (column - k) // ((k + 1) * (n - row - column + k + 1)) if k < high else 0
        bound = Fraction(weights[a - low]) * (1 + Fraction(1, 10**9))
        return min(1.0, float(Fraction(sum(w for w in weights if w <= bound), sum(weights))))
    choose = lambda m, k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
    log = lambda k: choose(row, k) + choose(n - row, column - k) - choose(n, column)
    mean, spread = row * column / n, math.sqrt(row * column / n * (n - row) / n * (n - column) / max(1, n - 1))
    here, reach = log(a), 40 * spread + 50
    window = range(max(low, int(mean - reach)), min(high, int(mean + reach)) + 1)
    return min(1.0, math.fsum(math.exp(x) for x in map(log, window) if x <= here + 1e-7))


def mcnemar(b: int, c: int) -> float:
    """Exact binomial test of discordant pairs."""
    n = b + c
    if not n:
        return 1.0
    if n <= EXACT:
        term, total = 1, 0
        for k in range(min(b, c) + 1):
            total += term
            term = term * (n - k) // (k + 1)
        return min(1.0, float(Fraction(2 * total, 1 << n)))
    log = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    least = min(b, c)
    return min(1.0, 2 * math.fsum(math.exp(log(k)) for k in range(max(0, least - int(40 * math.sqrt(n)) - 50), least + 1)))


def _over(test):
    def run(first: pd.Series, *rest: pd.Series) -> pd.Series:
        return pd.Series([test(*map(int, x)) for x in zip(first, *rest)], dtype=float)

    return run


def fisher_exact(*counts) -> Column:
    """Of columns a, b, c, d; a row is a hypothesis, so there are few."""
    return F.pandas_udf(_over(fisher), "double")(*counts)


def mcnemar_exact(*counts) -> Column:
    """Of columns b, c."""
    return F.pandas_udf(_over(mcnemar), "double")(*counts)


def benjamini_hochberg(rows: DataFrame, p: str, order: str, q: float = 0.10) -> DataFrame:
    """rows with p_adjusted and significant; `order` breaks ties. The rows are one per hypothesis, so few."""
    by = Window.orderBy(p, order)
    ranked = rows.withColumn("_rank", F.row_number().over(by)).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy()))
    upward = Window.orderBy(F.desc(p), F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)  # a frame that only grows is read once
    adjusted = ranked.withColumn("p_adjusted", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(upward)))
    return adjusted.withColumn("significant", F.col("p_adjusted") <= q).drop("_rank", "_m")


def wilson_interval(successes: Column, n: Column, z: float = Z) -> Column:
    """struct(low, high), within 0 and 1; other than 0 <= successes <= n and n > 0 is an error."""
    s, m = successes.cast("double"), n.cast("double")
    p = s / m
    centre, scale = p + z * z / (2 * m), 1 + z * z / m
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    bad = n.isNull() | successes.isNull() | (n <= 0) | (successes < 0) | (successes > n)
    found = F.struct(F.greatest(F.lit(0.0), (centre - half) / scale).alias("low"), F.least(F.lit(1.0), (centre + half) / scale).alias("high"))
    return F.when(bad, F.raise_error(F.lit("an interval needs 0 <= successes <= n and n > 0"))).otherwise(found)


def excludes_zero(interval: Column) -> Column:
    return interval["low"] > 0


def contains(interval: Column, value: Column) -> Column:
    return (interval["low"] <= value) & (value <= interval["high"])


def gap_recovery(no_think: Column, think: Column, skill: Column, min_gap: float = MIN_GAP) -> Column:
    """struct(value, status, numerator, denominator); value is null unless the gap is worth dividing by."""
    up, down = skill - no_think, think - no_think
    status = F.when(down <= 0, "gap_nonpositive").when(down < min_gap, "gap_too_small").otherwise("ok")
    return F.struct(F.when(status == "ok", F.try_divide(up, down)).alias("value"), status.alias("status"), up.alias("numerator"), down.alias("denominator"))


def render_gap(gap: Column) -> Column:
    """As a report shows it."""
    return (
        F.when(gap["status"] == "ok", F.format_string("%.1f%%", gap["value"] * 100))
        .when(gap["status"] == "gap_nonpositive", F.format_string("not reportable (think/no-think gap is not positive: %+.3f; the reasoning mode did not help)", gap["denominator"]))
        .otherwise(F.format_string(f"not reportable (think/no-think gap of %.3f is below the {MIN_GAP} reporting threshold)", gap["denominator"]))
    )


def token_reduction(think: Column, mode: Column) -> Column:
    """think / mode; null where either is missing or mode isn't positive."""
    return F.when(mode > 0, think / mode)


reasoning_premium = token_reduction


def success_rate(rewards: Column, threshold: float = 0.0) -> Column:
    """Aggregate: share of rewards above the threshold (NaN is not); an error over no rows."""
    won = F.avg(F.when((rewards > threshold) & ~F.isnan(rewards), 1.0).otherwise(0.0))
    return F.when(won.isNull(), F.raise_error(F.lit("a success rate over no episodes is undefined"))).otherwise(won)


def paired_deltas(baseline: DataFrame, treatment: DataFrame) -> DataFrame:
    """(task_id, delta) of mean rewards; a task in only one condition, or none at all, is an error."""
    mean = lambda df, name: df.groupBy("task_id").agg(F.avg("reward").alias(name))
    both = mean(baseline, "b").join(mean(treatment, "t"), "task_id", "full_outer")
    one_sided = F.col("b").isNull() | F.col("t").isNull()
    return both.select("task_id", F.when(one_sided, F.raise_error(F.concat(F.lit("task in only one condition: "), F.col("task_id").cast("string")))).otherwise(F.col("t") - F.col("b")).alias("delta"))


def exact_percentiles(rows: DataFrame, by: str, value: str, percents: tuple[float, ...]) -> DataFrame:
    """(by, percent, value) with linear interpolation between ranks, exact for groups of any size; null values are left out.

    In groups of over 50,000 rows sketches bracket each rank within 6 in 10,000 of the rows; what lies below a bracket is only
    counted, and ranks are found among the different values within it. So no task holds or sorts a large group.
    """
    own = rows.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).filter("v is not null")
    around = lambda p, to: F.percentile_approx("v", F.lit(min(1.0, max(0.0, p + to))), F.lit(10_000))
    ends = [F.struct(F.lit(p).alias("percent"), around(p, -3e-4).alias("low"), around(p, 3e-4).alias("high")) for p in percents]
    brackets = own.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.array(*ends).alias("ends")).select("g", "n", F.explode("ends").alias("e")).select("g", "n", "e.*")
    place = F.col("percent") * (F.col("n") - 1)
    asked = brackets.withColumns({"first": F.floor(place), "second": F.ceil(place), "share": place - F.floor(place)})
    small = F.col("n") <= 50_000
    met = own.join(asked, "g").filter(small | (F.col("v") <= F.col("high")))
    inside = F.when(small | (F.col("v") >= F.col("low")), F.col("v"))
    counted = met.groupBy("g", "percent", "first", "second", "share", inside.alias("x")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("g", "percent").orderBy(F.asc_nulls_first("x")))
    ranked = counted.withColumn("reach", upto).filter("x is not null")
    at = lambda rank: F.max(F.when((F.col("reach") - F.col("c") <= F.col(rank)) & (F.col(rank) < F.col("reach")), F.col("x")))
    found = ranked.groupBy("g", "percent", "share").agg(at("first").alias("a"), at("second").alias("b"))
    return found.select(F.col("g").alias(by), "percent", (F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("value"))


def bootstrap_delta(deltas: DataFrame, resamples: int = 10_000, seed: int = 0, percentiles: tuple[float, float] = (2.5, 97.5)) -> DataFrame:
    """(point, low, high) by CPython's generator, for equal numbers everywhere; tasks are tens to thousands."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("task_id")["delta"].tolist()
        rng, n = random.Random(seed), len(own)
        means = sorted(sum(own[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples))

        def at(percent: float) -> float:
            place = percent / 100 * (resamples - 1)
            k = min(int(place), max(resamples - 2, 0))
            return means[k] if resamples == 1 else means[k] * (1 - (place - k)) + means[k + 1] * (place - k)

        return pd.DataFrame({"point": [sum(own) / n], "low": [at(percentiles[0])], "high": [at(percentiles[1])]})

    return deltas.select("task_id", "delta", F.lit(0).alias("all")).groupBy("all").applyInPandas(run, "point double, low double, high double")


#: Weights of the mergeable bootstrap: a task's key and a resample's pair of factors give a number below this prime.
PRIME = (1 << 31) - 1
#: A task weighs as much in a resample as it passes of these: the distribution function of the Poisson law of mean 1.
WEIGHT_BOUNDS = tuple(int(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12))


def _resample_factors(resamples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = [hashlib.sha256(f"{seed}:{r}".encode()).hexdigest() for r in range(resamples)]
    return np.array([int(x[:8], 16) % (PRIME - 1) + 1 for x in drawn], np.int64), np.array([int(x[8:16], 16) % PRIME for x in drawn], np.int64)


def bootstrap_delta_distributed(deltas: DataFrame, resamples: int = 10_000, seed: int = 0, percentiles: tuple[float, float] = (2.5, 97.5)) -> DataFrame:
    """(point, low, high) by Poisson weights, for any number of tasks: a mergeable array of sums and weights a resample.

    A partition adds its tasks into two arrays of `resamples` numbers, whatever its rows, and only these are shuffled and added.
    Weights follow from hashes of the task and the resample, so they don't depend on partitions; they are other random numbers than
    bootstrap_delta's. Tasks without a delta are left out; without tasks all three are null. Many tasks of one id share their weights.
    """
    times, plus = _resample_factors(resamples, seed)
    bounds = np.array(WEIGHT_BOUNDS, np.int64)

    def added(batches):
        sums, weights = np.zeros(resamples), np.zeros(resamples, np.int64)
        for batch in batches:
            keys, delta = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for first in range(0, len(keys), 128):
                own = np.searchsorted(bounds, (np.multiply.outer(keys[first : first + 128], times) + plus) % PRIME, side="right")
                sums += delta[first : first + 128] @ own
                weights += own.sum(axis=0)
        if weights.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(sums), pa.array(weights)], names=["r", "sum", "weight"])

    key = F.conv(F.substring(F.sha2(F.col("task_id").cast("string"), 256), 1, 12), 16, 10).cast("long") % PRIME
    held = deltas.select(key.alias("k"), F.col("delta").cast("double").alias("delta")).filter("k is not null and delta is not null")
    per = held.mapInArrow(added, "r long, sum double, weight long").groupBy("r").agg(F.try_divide(F.sum("sum"), F.sum("weight")).alias("mean"))
    low, high = (F.percentile("mean", F.lit(p / 100)) for p in percentiles)
    return per.agg(low.alias("low"), high.alias("high")).crossJoin(F.broadcast(held.agg(F.avg("delta").alias("point")))).select("point", "low", "high")


def bootstrap_sql(deltas: str, resamples: int = 10_000, seed: int = 0) -> str:
    """The same interval in SQL, to nine places; deltas: the name of a table of task_id and delta."""
    weight = " + ".join(f"(v >= {b})::int" for b in WEIGHT_BOUNDS)
    return f"""drawn as (select r, sha256('{seed}:' || r) as h from range({resamples}) t(r)),
factors as (select r, ('0x' || substr(h, 1, 8))::bigint % {PRIME - 1} + 1 as a, ('0x' || substr(h, 9, 8))::bigint % {PRIME} as b from drawn),
keyed as (select ('0x' || substr(sha256(task_id::varchar), 1, 12))::bigint % {PRIME} as k, delta from {deltas}),
weighed as (select r, delta, {weight} as w from (select r, delta, (a * k + b) % {PRIME} as v from keyed cross join factors)),
means as (select r, sum(w * delta) / sum(w) as mean from weighed group by r having sum(w) > 0)
select round((select avg(delta) from {deltas}), 9) as point, round(quantile_cont(mean, 0.025), 9) as low, round(quantile_cont(mean, 0.975), 9) as high from means"""
