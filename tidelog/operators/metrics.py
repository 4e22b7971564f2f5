"""Metrics and boards.

Running totals go over distinct scores, not rows; `scored` has `y, pred`, for
`auroc` and `average_precision` optionally `_n`, how many rows a row stands for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.ranges import exact_quantiles, running_sums

def _per_score(scored: DataFrame, *by: str) -> DataFrame:
    many = F.col("_n") if "_n" in scored.columns else F.lit(1)
    return scored.groupBy(*by, "pred").agg(F.sum((F.col("y") == 1).cast("long") * many).alias("pos"), F.sum((F.col("y") != 1).cast("long") * many).alias("neg"))


def _run(counts: DataFrame, *by: str) -> DataFrame:
    """Adds `pos_below, neg_below`: counts of rows with smaller scores; without `by` in two levels, so that no task sees all scores."""
    if not by:
        return running_sums(counts, "pred", {"pos_below": F.col("pos"), "neg_below": F.col("neg")})
    earlier = W.partitionBy(*by).orderBy("pred").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumns({f"{c}_below": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("pos", "neg")})


def auroc(scored: DataFrame, *by: str) -> DataFrame:
    """`auroc`: chance that a positive scores above a negative, ties half; null for one class."""
    won = _run(_per_score(scored, *by), *by).withColumn("won", F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    return won.groupBy(*by).agg(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auroc"))


def average_precision(scored: DataFrame, *by: str) -> DataFrame:
    """`ap`: precision at each distinct score weighted by the recall gained; null without positives."""
    counts = _per_score(scored, *by)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum(F.col("pos") + F.col("neg")).alias("everything"))
    run = _run(counts, *by)
    run = run.join(totals, list(by)) if by else run.crossJoin(F.broadcast(totals))
    tp, n = F.col("all_pos") - F.col("pos_below"), F.col("everything") - F.col("pos_below") - F.col("neg_below")
    return run.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * tp / n), F.sum("pos")).alias("ap"))


def regression(scored: DataFrame, *by: str) -> DataFrame:
    """`n, mae, r2`; r2 is null for a constant target."""
    e = F.col("y") - F.col("pred")
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.var_pop("y") * F.count("y"))).alias("r2"))


def nmae(scored: DataFrame, train: DataFrame) -> DataFrame:
    """`mae, std, nmae`: mean absolute error over the full training split's sample deviation."""
    std = train.agg(F.stddev_samp("y").alias("std"))
    return scored.agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("mae")).crossJoin(std).withColumn("nmae", F.try_divide("mae", "std"))


def map_at_k(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """`n_queries, map`: mean over all queries with truth of the average precision at k.

    `truth` has `query_id, candidate`; a repeated pair counts once, and a
    query without a hit counts 0.
    """
    wanted = truth.select("query_id", "candidate").distinct()
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("size"))
    hits = ranked.filter(F.col("rank") <= k).join(wanted, ["query_id", "candidate"])
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    per = hits.withColumn("precision", nth / F.col("rank")).groupBy("query_id").agg(F.sum("precision").alias("s"))
    joined = sizes.join(per, "query_id", "left")
    return joined.agg(F.count("*").alias("n_queries"), F.avg(F.coalesce("s", F.lit(0.0)) / F.least("size", F.lit(k))).alias("map"))


def pinball(y: Column, pred: Column, tau: float) -> Column:
    """Quantile loss at tau."""
    d = y - pred
    return F.greatest(tau * d, (tau - 1) * d)


def poisson_nll(scored: DataFrame, balanced: bool = False) -> DataFrame:
    """`nll`: mean of rate - y ln(rate); balanced gives zero and non-zero targets half the weight each."""
    rate = F.greatest(F.col("pred"), F.lit(1e-9))
    loss = rate - F.col("y") * F.log(rate)
    if not balanced:
        return scored.agg(F.avg(loss).alias("nll"))
    zero, other = F.avg(F.when(F.col("y") == 0, loss)), F.avg(F.when(F.col("y") != 0, loss))
    return scored.agg(F.when(zero.isNull(), other).when(other.isNull(), zero).otherwise((zero + other) / 2).alias("nll"))


def diagnostics(scored: DataFrame) -> DataFrame:
    """`spread, pearson, p10, p50, p90` of predictions."""
    found = exact_quantiles(scored, F.col("pred"), [0.1, 0.5, 0.9])
    quantiles = [F.lit(x).cast("double").alias(name) for x, name in zip(found, ("p10", "p50", "p90"), strict=True)]
    return scored.agg(F.stddev_samp("pred").alias("spread"), F.corr("pred", "y").alias("pearson")).select("spread", "pearson", *quantiles)


def board(results: DataFrame, tasks: int, lower: bool = False) -> DataFrame:
    """`method, mean_value, n_best, place`: methods that cover every task, by their mean.

    `results` has `method, task, value`.
    """
    order = F.col("value") if lower else F.desc("value")
    best = F.rank().over(W.partitionBy("task").orderBy(order)) == 1
    per = results.withColumn("best", best).groupBy("method").agg(F.avg("value").alias("mean_value"), F.count_if("best").alias("n_best"), F.count_distinct("task").alias("n"))
    kept = per.filter(F.col("n") == tasks).drop("n")
    return kept.withColumn("place", F.rank().over(W.orderBy(F.col("mean_value") if lower else F.desc("mean_value"))))


def subset_means(results: DataFrame, ours: str) -> DataFrame:
    """`method, n_tasks, n_missing, mean_value`, over the tasks that one method has."""
    tasks = results.filter(F.col("method") == ours).select("task").distinct()
    joined = results.join(tasks, "task", "left_semi").groupBy("method").agg(F.count_distinct("task").alias("n_tasks"), F.avg("value").alias("mean_value"))
    total = tasks.agg(F.count("*").alias("n"))
    return joined.crossJoin(F.broadcast(total)).select("method", "n_tasks", (F.col("n") - F.col("n_tasks")).alias("n_missing"), "mean_value")


def pick_on_validation(results: DataFrame, lower: bool = False) -> DataFrame:
    """`task, readout, val, test`: the readout best on validation, with its test value.

    `results` has `task, readout, split, value`; a row without a right split is
    an error.
    """
    stamped = results.withColumn("split", F.when(F.col("split").isin("val", "test"), F.col("split")).otherwise(F.raise_error(F.lit("a result has no split"))))
    wide = stamped.groupBy("task", "readout").agg(F.max(F.when(F.col("split") == "val", F.col("value"))).alias("val"), F.max(F.when(F.col("split") == "test", F.col("value"))).alias("test"))
    order = F.col("val") if lower else F.desc("val")
    place = F.row_number().over(W.partitionBy("task").orderBy(order, "readout"))
    return wide.filter("val is not null").withColumn("place", place).filter("place = 1").drop("place")
