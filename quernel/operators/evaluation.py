"""Evaluation: hits, reciprocal ranks, strata, sweeps, ledgers, paired tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 3, 5, 10)
Z95 = 1.96


def hit(item: Column, gold: Column, tokens: Column, key_tokens: Column) -> Column:
    """An item hits if it is a gold section and holds a key token; without key tokens nothing hits."""
    return F.array_contains(gold, item) & F.coalesce(F.arrays_overlap(tokens, key_tokens), F.lit(False))


def cutoff_sweep(ranked: DataFrame, groups: list[str], cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(groups, cutoff, queries, hit_rate, mrr) from ranked(query_id, rank, hit): one pass over one deep pool."""
    first = ranked.groupBy(*groups, "query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    k = F.explode(F.array(*map(F.lit, cutoffs))).alias("cutoff")
    rows = first.select(*groups, "query_id", "first", k)
    inside = F.coalesce(F.col("first") <= F.col("cutoff"), F.lit(False))
    return rows.groupBy(*groups, "cutoff").agg(F.count("*").alias("queries"), F.avg(inside.cast("int")).alias("hit_rate"), F.avg(F.when(inside, 1 / F.col("first")).otherwise(0.0)).alias("mrr"))


def stratified(outcomes: DataFrame, arm: str, strata: list[str], measures: list[str]) -> DataFrame:
    """Means by arm over the full key and over each stratum alone, in one grouping-sets aggregation; absent keys are null."""
    sets = [[arm, *strata], *([arm, s] for s in strata)]
    grouped = outcomes.groupingSets([[F.col(c) for c in g] for g in sets], *map(F.col, [arm, *strata]))
    return grouped.agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in measures))


def macro_mean(outcomes: DataFrame, arm: str, stratum: list[str], measure: str) -> DataFrame:
    """Unweighted mean of stratum means by arm; empty cells do not count."""
    cells = outcomes.groupBy(arm, *stratum).agg(F.avg(measure).alias("m"))
    return cells.groupBy(arm).agg(F.avg("m").alias("macro"), F.count("m").alias("cells"))


def best_arm(scores: DataFrame, arm: str, score: str) -> DataFrame:
    """The arm with the highest score; ties go to the first in alphabetical order."""
    rank = F.row_number().over(Window.orderBy(F.col(score).desc(), arm))
    return scores.withColumn("_r", rank).where("_r = 1").drop("_r")


def discordant(paired: DataFrame, groups: list[str], a: str, b: str) -> DataFrame:
    """(groups, b, c, p): counts of pairs where only one arm hits, and the exact two-sided McNemar test."""
    counts = paired.groupBy(*groups).agg(F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("b"), F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("c"))
    return counts.withColumn("p", mcnemar(F.col("b"), F.col("c")))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided binomial test of b against c at one half, clamped to 1; without discordant pairs 1.

    The tail's terms follow from each other by their quotients in log space, so large counts do no harm.
    """
    n, low = (b + c).cast("double"), F.least(b, c)
    zero = F.struct((-n * math.log(2)).alias("term"), F.exp(-n * math.log(2)).alias("sum"))
    tail = F.aggregate(
        F.filter(F.sequence(F.lit(0).cast("long"), low.cast("long")), lambda k: k > 0),
        zero,
        lambda acc, k: F.struct((acc["term"] + F.log((n - k + 1) / k)).alias("term"), (acc["sum"] + F.exp(acc["term"] + F.log((n - k + 1) / k))).alias("sum")),
        lambda acc: acc["sum"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval of k successes in n, clamped to [0, 1]; without trials (0, 0)."""
    p = k / F.nullif(n, F.lit(0))
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.coalesce(F.greatest(F.lit(0.0), mid - half), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), mid + half), F.lit(0.0))


def holm(tests: DataFrame, p: str, groups: list[str] = ()) -> DataFrame:
    """Adds ``holm``: p-values stepped down, running maximum, clamped to 1."""
    by = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    order = by.orderBy(p)
    scaled = F.col(p) * (F.count("*").over(by) - F.row_number().over(order) + 1)
    return tests.withColumn("_s", scaled).withColumn("holm", F.least(F.lit(1.0), F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def cochran_q(paired: DataFrame, arms: list[str]) -> DataFrame:
    """(q, df, p) of three or more paired binary arms; a zero denominator gives q 0 and p 1."""
    k = len(arms)
    row = sum((F.col(a) for a in arms[1:]), F.col(arms[0]))
    sums = paired.agg(*(F.sum(a).alias(a) for a in arms), F.sum(row).alias("t"), F.sum(row * row).alias("t2"))
    columns = sum((F.col(a) * F.col(a) for a in arms[1:]), F.col(arms[0]) * F.col(arms[0]))
    below = k * F.col("t") - F.col("t2")
    q = F.when(below == 0, 0.0).otherwise((k - 1) * (k * columns - F.col("t") * F.col("t")) / below)
    out = sums.select(q.alias("q"), F.lit(k - 1).alias("df"))
    return out.withColumn("p", F.when(F.col("q") == 0, 1.0).when(F.col("df") == 2, F.exp(-F.col("q") / 2)).otherwise(chi2_sf("q", "df")))


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi2_sf(x: Column | str, df: Column | str) -> Column:
    """Survival function of the chi-square distribution, by Arrow batches."""

    def tail(v: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([upper_gamma(n / 2, q / 2) for q, n in zip(v, k)])

    return F.pandas_udf(tail, "double")(x, df)


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def paired_sample_size(alpha: float, power: float, mdd: float, p: float) -> tuple[int, float]:
    """Pairs needed to tell a difference ``mdd`` from a rate ``p``, arms independent under the null, and the discordant share assumed."""
    q = max(0.0, p - mdd)
    psi = p * (1 - q) + q * (1 - p)
    za, zb = normal_quantile(1 - alpha / 2), normal_quantile(power)
    n = (za * math.sqrt(psi) + zb * math.sqrt(psi - mdd * mdd)) ** 2 / mdd**2
    return math.ceil(n), psi


def achieved_power(n: int, alpha: float, mdd: float, psi: float) -> float:
    from statistics import NormalDist

    za = normal_quantile(1 - alpha / 2)
    return NormalDist().cdf((abs(mdd) * math.sqrt(n) - za * math.sqrt(psi)) / math.sqrt(psi - mdd * mdd))


def bootstrap(paired: DataFrame, groups: list[str], a: str, b: str, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """(groups, mean, low, high, p) of the paired difference a - b: percentile interval, doubled one-sided p.

    Differences of binary pairs take three values, so their counts (one row a group) are all that a resample needs.
    """
    diff = paired.groupBy(*groups, (F.col(a) - F.col(b)).cast("double").alias("diff")).agg(F.count("*").alias("n"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in paired.select(*groups).schema), "mean double, low double, high double, p double"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        value, count = rows["diff"].to_numpy(), rows["n"].to_numpy()
        n = count.sum()
        drawn = np.random.Generator(np.random.PCG64(seed)).multinomial(n, count / n, resamples) @ value / n
        one = min((drawn <= 0).mean(), (drawn >= 0).mean())
        low, high = np.percentile(drawn, [2.5, 97.5])
        return pd.DataFrame([{**{g: rows[g].iloc[0] for g in groups}, "mean": (value * count).sum() / n, "low": low, "high": high, "p": min(1.0, 2 * one)}])

    return diff.groupBy(*groups).applyInPandas(run, schema)


def sweep(positives: DataFrame, negatives: DataFrame, thresholds: list[float], below: bool = True) -> DataFrame:
    """(threshold, refusal, over_refusal, j): shares of negatives and of positives on the refused side of each threshold; a null score is refused."""
    grid = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    side = lambda: F.coalesce(F.col("score") < F.col("threshold") if below else F.col("score") > F.col("threshold"), F.lit(True)).cast("int")
    one = lambda df, name: df.select("score", grid).groupBy("threshold").agg(F.avg(side()).alias(name))
    return one(negatives, "refusal").join(one(positives, "over_refusal"), "threshold").withColumn("j", F.col("refusal") - F.col("over_refusal"))


def youden(swept: DataFrame, default: float) -> DataFrame:
    """The threshold with the greatest J: the default if it is among the best, else the lower median of the plateau."""
    best = swept.withColumn("_top", F.rank().over(Window.orderBy(F.round("j", 12).desc()))).where("_top = 1")
    every = Window.partitionBy(F.lit(1))
    rows = best.withColumn("_r", F.row_number().over(Window.orderBy("threshold"))).withColumn("_n", F.count("*").over(every))
    rows = rows.withColumn("_has", F.max((F.col("threshold") == default).cast("int")).over(every))
    return rows.where((F.col("_has") == 1) & (F.col("threshold") == default) | (F.col("_has") == 0) & (F.col("_r") == F.floor((F.col("_n") + 1) / 2))).select("threshold", "refusal", "over_refusal", "j")


def ledger(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """(stack, phase, calls, tokens, usd) with all slices; an unpriced model adds no dollars, and a slice without any priced call has null."""
    rows = calls.join(F.broadcast(prices), "model", "left")
    usd = (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6
    return rows.withColumn("usd", usd).cube("stack", "phase").agg(F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("usd").alias("usd"), F.grouping_id().alias("slice"))


def control_sample(verdicts: DataFrame, margin: int, n: int, seed: int) -> DataFrame:
    """(id, hit) of ``n`` clear hits (more than ``margin`` tokens in common) and ``n`` clear misses of verdicts(id, hit, overlap), without replacement.

    Drawn by the order of a digest of the seed and the id, so that a draw is the same everywhere; fewer where there are fewer.
    """
    clear = verdicts.where(~F.col("hit") | (F.col("overlap") > margin))
    place = F.row_number().over(Window.partitionBy("hit").orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")), 256), "id"))
    return clear.withColumn("place", place).where(F.col("place") <= n).select("id", "hit")
