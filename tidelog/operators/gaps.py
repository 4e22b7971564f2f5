"""Models of the gap before an entity's next event, gaps that haven't ended yet included.

A gap still open at the cutoff is only known to be longer than its age. Leaving
such gaps out makes the model too short, taking them for whole ones does so
too; here they count by the chance of being longer. Mixtures of log-normals are
fitted by expectation and maximisation over distinct (group, gap) counts, all
groups at once, with one aggregation a step.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.sources.sinks import written

#: Bounds of a component's sigma.
LEAST_SIGMA, MOST_SIGMA = math.exp(-5), math.exp(5)
#: Coefficients of the logarithm of erfc(u) exp(u^2) / t in t = 1 / (1 + u / 2), u >= 0, by
#: Press and others, relative error below 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
LN_2PI = math.log(2 * math.pi)


def _log_scaled_erfc(u: Column) -> Column:
    """ln(erfc(u) exp(u^2)) for u >= 0; never over- or underflows."""
    t = 1.0 / (1.0 + u / 2.0)
    inner = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        inner = inner * t + c
    return F.log(t) + inner


def log_survival(z: Column) -> Column:
    """ln of the chance that a standard normal value is above z."""
    u = F.abs(z) / math.sqrt(2.0)
    tail = _log_scaled_erfc(u) - u * u - math.log(2.0)
    return F.when(z >= 0, tail).otherwise(F.log1p(-F.exp(tail)))


def hazard(z: Column) -> Column:
    """Density over survival of a standard normal value at z: how far beyond z it lies on average, if it does."""
    u = F.abs(z) / math.sqrt(2.0)
    ahead = math.sqrt(2.0 / math.pi) * F.exp(-_log_scaled_erfc(u))
    return F.when(z >= 0, ahead).otherwise(F.exp(-z * z / 2.0 - 0.5 * LN_2PI - log_survival(z)))


def _log_likelihood(x: Column, censored: Column, mu: Column, sigma: Column) -> Column:
    z = (x - mu) / sigma
    return F.when(censored, log_survival(z)).otherwise(-z * z / 2.0 - F.log(sigma) - 0.5 * LN_2PI)


def gap_counts(gaps: DataFrame, group: str) -> DataFrame:
    """`group, x, censored, n`: how often each logarithm of a gap stands in each group; gaps under 1 count as 1, null ones not at all."""
    x = F.log(F.greatest(F.col("gap").cast("double"), F.lit(1.0)))
    return gaps.filter(F.col("gap").isNotNull()).groupBy(F.col(group).alias("group"), x.alias("x"), F.coalesce("censored", F.lit(False)).alias("censored")).agg(F.count("*").alias("n"))


def starting_mixture(counts: DataFrame, components: int) -> DataFrame:
    """`group, mixture`: equal weights, means spread over a deviation to both sides of each group's mean, the group's deviation."""
    mean = F.sum(F.col("n") * F.col("x")) / F.sum("n")
    square = F.sum(F.col("n") * F.col("x") * F.col("x")) / F.sum("n")
    moments = counts.groupBy("group").agg(mean.alias("mean"), square.alias("square"))
    sigma = F.least(F.greatest(F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))), F.lit(LEAST_SIGMA)), F.lit(MOST_SIGMA))
    place = lambda k: (2.0 * k - (components - 1)) / components
    listed = [F.struct(F.lit(1.0 / components).alias("weight"), (F.col("mean") + F.col("sigma") * place(k)).alias("mu"), F.col("sigma").alias("sigma")) for k in range(components)]
    return moments.withColumn("sigma", sigma).select("group", F.array(*listed).alias("mixture"))


def improved_mixture(counts: DataFrame, mixtures: DataFrame, components: int) -> DataFrame:
    """`group, mixture, log_likelihood, n, n_censored`: one step; the likelihood is that of the mixtures given.

    A censored gap stands for the values beyond it: under a component their
    mean lies sigma * hazard above mu, and their mean square distance from mu
    is sigma^2 (1 + z * hazard). Distances are taken from the old mu, so no
    variance is a difference of large numbers.
    """
    rate, sums, parts = _step_columns(components)
    joined = counts.join(mixtures.select("group", "mixture"), "group").withColumn("rated", rate)
    most = F.aggregate("rated", F.lit(float("-inf")), lambda a, r: F.greatest(a, r["term"]))
    known = joined.withColumn("most", most).withColumn("whole", F.expr("most + ln(aggregate(rated, 0D, (a, r) -> a + exp(r.term - most)))"))
    return known.groupBy("group").agg(*sums).select("group", F.array(*parts).alias("mixture"), "log_likelihood", "n", "n_censored")


@functools.lru_cache(maxsize=8)
def _step_columns(components: int) -> tuple[Column, list[Column], list[Column]]:
    """What a step works out for each row, adds up for each group, and makes of the sums; the same in every step."""

    def rated(c: Column) -> Column:
        z, off = (F.col("x") - c["mu"]) / c["sigma"], F.col("x") - c["mu"]
        ahead = hazard(z)
        return F.struct(
            (F.log(F.greatest(c["weight"], F.lit(1e-300))) + _log_likelihood(F.col("x"), F.col("censored"), c["mu"], c["sigma"])).alias("term"),
            F.when(F.col("censored"), c["sigma"] * ahead).otherwise(off).alias("first"),
            F.when(F.col("censored"), c["sigma"] * c["sigma"] * (1.0 + z * ahead)).otherwise(off * off).alias("second"),
        )

    sums = [F.sum(F.col("n") * F.col("whole")).alias("log_likelihood"), F.sum("n").alias("n"), F.sum(F.when(F.col("censored"), F.col("n")).otherwise(0)).alias("n_censored"), F.first("mixture").alias("old")]
    parts = []
    for k in range(components):
        part = f"n * exp(rated[{k}].term - whole)"
        sums += [F.expr(f"sum({part})").alias(f"n{k}"), F.expr(f"sum({part} * rated[{k}].first)").alias(f"first{k}"), F.expr(f"sum({part} * rated[{k}].second)").alias(f"second{k}")]
        # a component that explains nothing stays where it is
        shift = f"first{k} / greatest(n{k}, 1e-12D)"
        sigma = f"least(greatest(sqrt(greatest(second{k} / greatest(n{k}, 1e-12D) - ({shift}) * ({shift}), 0D)), {LEAST_SIGMA!r}D), {MOST_SIGMA!r}D)"
        some = f"n{k} > 1e-9D"
        parts.append(F.expr(f"named_struct('weight', n{k} / n, 'mu', if({some}, old[{k}].mu + {shift}, old[{k}].mu), 'sigma', if({some}, {sigma}, old[{k}].sigma))"))
    return F.transform("mixture", rated), sums, parts


def fit_gap_mixture(gaps: DataFrame, group: str, components: int = 1, steps: int = 200, settled: float = 1e-7) -> DataFrame:
    """`group, component, weight, mu, sigma, log_likelihood, n, n_censored` of the log of each group's gaps.

    `gaps` has the group, `gap` and `censored`. Steps end when the summed
    likelihood gains less than `settled` of itself, and at `steps`. Each step's
    mixtures are written, so a lost executor costs one step; one sum a step
    reaches the driver. `log_likelihood` is that of the mixture before the last
    step. Components are numbered from the smallest mu on.
    """
    counts = written(gap_counts(gaps, group), "gap-counts")
    now, before = starting_mixture(counts, components), None
    for _ in range(max(1, steps)):
        now = written(improved_mixture(counts, now, components), "gap-mixture")
        likelihood = now.agg(F.sum("log_likelihood").alias("l")).first()["l"]
        if likelihood is None or (before is not None and likelihood - before <= settled * abs(before)):
            break
        before = likelihood
    ordered = F.array_sort("mixture", lambda a, b: F.when(a["mu"] < b["mu"], -1).when(a["mu"] > b["mu"], 1).otherwise(0))
    rows = now.select(F.col("group").alias(group), F.posexplode(ordered).alias("component", "c"), "log_likelihood", "n", "n_censored")
    return rows.select(group, (F.col("component") + 1).alias("component"), "c.weight", "c.mu", "c.sigma", "log_likelihood", "n", "n_censored")


def mixture_survival(fitted: DataFrame, group: str, gap: Column) -> DataFrame:
    """`group, gap, survival` of fitted components: the chance that a gap is longer than `gap`, a column or literal."""
    z = (F.log(F.greatest(gap.cast("double"), F.lit(1.0))) - F.col("mu")) / F.col("sigma")
    return fitted.groupBy(group, gap.alias("gap")).agg(F.sum(F.col("weight") * F.exp(log_survival(z))).alias("survival"))
