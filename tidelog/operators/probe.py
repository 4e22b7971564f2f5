"""Fitted probes on spark.ml: features in, predictions and cross-validated choices out.

A probe is fitted on one frame and scores another, which has the same features
as of a later time, so that no score is of rows that were fitted on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.ranges import exact_quantile
from tidelog.operators.logits import fit_logistic
from tidelog.operators.metrics import auroc
from tidelog.operators.robust import linear_l1
from tidelog.sources.sinks import packed, written

#: Grids of the published readouts, as inverse regularisation.
COMBINATION_C = (0.01, 0.1, 1.0, 10.0)
PROBE_C = tuple(10 ** (-4 + 5 * i / 11) for i in range(12))


def support_sample(frame: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in an order fixed by the seed and key."""
    return frame.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def stratified_folds(frame: DataFrame, key: str, label: str, folds: int, seed: int) -> DataFrame:
    """Adds `fold`: rows of each label dealt evenly, by hashed order inside hashed cells."""
    cell = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(64))
    nth = F.row_number().over(W.partitionBy(label, "_cell").orderBy(F.xxhash64(F.lit(seed + 1), key), key))
    return frame.withColumn("_cell", cell).withColumn("fold", F.pmod(nth + F.col("_cell"), F.lit(folds)).cast("int")).drop("_cell")


def balanced(frame: DataFrame, label: str) -> DataFrame:
    """Adds `weight` so that both classes weigh the same."""
    counts = frame.agg(F.avg((F.col(label) == 1).cast("double")).alias("_share"))
    weight = F.when(F.col(label) == 1, 0.5 / F.greatest("_share", F.lit(1e-9))).otherwise(0.5 / F.greatest(1 - F.col("_share"), F.lit(1e-9)))
    return frame.crossJoin(F.broadcast(counts)).withColumn("weight", weight).drop("_share")


def _scaled(features: list[str]) -> list:
    return [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)]


def logistic(features: list[str], label: str, c: float, rows: int) -> Pipeline:
    """Standardised logistic regression; C is the inverse penalty summed over rows."""
    model = LogisticRegression(labelCol=label, weightCol="weight", regParam=1.0 / (c * max(1, rows)), maxIter=2000)
    return Pipeline(stages=[*_scaled(features), model])


def raw_coefficients(model, features: list[str]) -> dict[str, float]:
    """The fitted coefficients per unit of the raw features."""
    scale, fitted = model.stages[1], model.stages[2]
    return {f: float(c / s) if s else 0.0 for f, c, s in zip(features, fitted.coefficients.toArray(), scale.std.toArray(), strict=True)}


def scored(model, frame: DataFrame, label: str) -> DataFrame:
    """The frame with `pred`, the chance of label 1, and `y`."""
    return model.transform(frame).withColumn("pred", vector_to_array("probability")[1]).withColumn("y", F.col(label))


def cross_validated(frame: DataFrame, label: str, folds: int, fit: Callable[[DataFrame], object]) -> float:
    """Mean AUROC over the folds of `fold`; folds with one class only are left out."""
    found = []
    for i in range(folds):
        model = fit(frame.filter(F.col("fold") != i))
        value = auroc(scored(model, frame.filter(F.col("fold") == i), label)).first()["auroc"]
        if value is not None:
            found.append(value)
    return sum(found) / len(found) if found else 0.5


def refit_combination(frame: DataFrame, features: list[str], label: str, key: str, grid: tuple[float, ...] = COMBINATION_C, folds: int = 3) -> tuple[float, dict[str, float]]:
    """The best C of the grid by the folds' mean AUROC and the raw coefficients fitted with it on all rows.

    The models are those of `logistic`, where it is fitted to the end: the
    penalty is on standardised coefficients, by the weighted deviations of the
    rows fitted on. All of the grid and the folds, and the fits on all rows, are
    fitted in the same passes and scored in one.
    """
    dealt = balanced(stratified_folds(frame, key, label, folds, 1), label)
    plain = dealt.select(F.array(*[F.col(f).cast("double") for f in features]).alias("f"), F.col(label).cast("double").alias("y"), F.col("weight").cast("double").alias("weight"), "fold")
    held = packed(plain, "fit-rows")
    w, x = F.col("weight"), [F.col("f")[j] for j in range(len(features))]
    bad = F.count_if(F.exists("f", lambda v: v.isNull() | F.isnan(v)) | F.col("y").isNull())
    moments = [F.sum(w * v).alias(f"a{j}") for j, v in enumerate(x)] + [F.sum(w * v * v).alias(f"b{j}") for j, v in enumerate(x)]
    centre = held.agg(F.count("*").alias("rows"), bad.alias("bad"), *[F.avg(v).alias(f"m{j}") for j, v in enumerate(x)], *[F.stddev_pop(v).alias(f"s{j}") for j, v in enumerate(x)]).first()
    rows = centre["rows"]
    if centre["bad"]:
        raise ValueError(f"{centre['bad']} rows have a null feature or label")
    if not rows:
        return min(grid), dict.fromkeys(features, 0.0)
    mean, std = (np.array([centre[f"{c}{j}"] for j in range(len(features))]) for c in "ms")
    scale = np.where(std > 0, std, 1.0)
    scaled = held.select(F.array(*[(v - float(m)) / float(s) for v, m, s in zip(x, mean, scale, strict=True)]).alias("f"), "y", "weight", "fold")
    per = scaled.groupBy("fold").agg(F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * F.col("y")).alias("pos"), *moments).collect()

    tried = [(c, i) for c in grid for i in (*range(folds), -1)]  # -1: all rows
    width = len(features) + 1
    weights, ridge, used = np.ones(len(tried)), np.zeros((len(tried), width)), np.zeros((len(tried), width), dtype=bool)
    for m, (c, out) in enumerate(tried):
        total = {n: sum(r[n] for r in per if r["fold"] != out) for n in per[0].asDict() if n != "fold"}
        if not 0 < total["pos"] < total["w"]:
            continue  # one class only: nothing tells rows apart
        weights[m] = total["w"]
        for j in range(len(features)):
            spread = total[f"b{j}"] - total[f"a{j}"] ** 2 / total["w"]
            variance = spread / max(total["w"] - total["w2"] / total["w"], 1e-300)
            used[m, j] = std[j] > 0 and spread > 1e-12 * max(total[f"b{j}"], 1e-300)
            ridge[m, j] = variance / (c * rows) if used[m, j] else 0.0
        used[m, -1] = True
    beta = fit_logistic(scaled.select(F.concat("f", F.array(F.lit(1.0), "y")).alias("x"), "weight", "fold"), weights, ridge, used, np.array([i for _, i in tried]))
    at = {model: beta[m] for m, model in enumerate(tried)}

    line = lambda b: sum((F.lit(float(v)) * F.col("f")[j] for j, v in enumerate(b[:-1])), F.lit(float(b[-1])))
    own = lambda c: reduce(lambda a, i: a.when(F.col("fold") == i, line(at[c, i])), range(1, folds), F.when(F.col("fold") == 0, line(at[c, 0])))
    arms = F.array(*[F.struct(F.lit(n).alias("nth"), own(c).alias("pred")) for n, c in enumerate(grid)])
    by_fold = auroc(scaled.select("y", "fold", F.inline(arms)), "nth", "fold").filter("auroc is not null")
    means = {r["nth"]: r["v"] for r in by_fold.groupBy("nth").agg(F.avg("auroc").alias("v")).collect()}
    results = {c: means.get(n, 0.5) for n, c in enumerate(grid)}
    best = max(grid, key=lambda c: (results[c], -c))
    return best, {f: float(at[best, -1][j] / scale[j]) for j, f in enumerate(features)}


def auto_pool(known: DataFrame, asked: DataFrame, features: list[str], label: str, key: str, folds: int = 3) -> tuple[str, DataFrame, dict[str, float], dict[str, str]]:
    """The best of a pool by cross-validation over `known`, simplest first, ties to the earlier one.

    Rows of a fold that are alike in features and label are fitted as one, with
    their weights added up. Returns its name, its scores of `asked`, everyone's AUROC, and why those
    that are missing could not be fitted, which doesn't stop the others.
    """
    every = balanced(stratified_folds(known, key, label, folds, 1), label)
    dealt = packed(every.groupBy(*features, label, "fold").agg(F.sum("weight").alias("weight"), F.count("*").alias("_n")), "pool-rows").persist()
    rows = dealt.agg(F.sum("_n").alias("n")).first()["n"] or 0
    tree = [VectorAssembler(inputCols=features, outputCol="features")]
    boosted = lambda depth: Pipeline(stages=[*tree, GBTClassifier(labelCol=label, weightCol="weight", maxDepth=depth, maxIter=10, seed=1)])
    pool = {
        "logistic": logistic(features, label, 1.0, rows),
        "gbt3": boosted(3),
        "gbt6": boosted(6),
        "forest": Pipeline(stages=[*tree, RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=20, maxDepth=6, seed=1)]),
    }
    found, failed = {}, {}
    for name, pipeline in pool.items():
        try:
            found[name] = cross_validated(dealt, label, folds, pipeline.fit)
        except Exception as reason:
            failed[name] = str(reason).split("\n")[0]
    if not found:
        raise ValueError(f"no candidate could be fitted: {failed}")
    best = max(found, key=lambda n: (round(found[n], 6), -list(pool).index(n)))
    result = scored(pool[best].fit(dealt), asked, label)
    dealt.unpersist()
    return best, result, found, failed


def fitted_rate(known: DataFrame, asked: DataFrame, features: list[str], target: str, penalty: float = 0.01) -> DataFrame:
    """Adds `rate` to `asked`: a Poisson regression of window counts on features, fitted on `known`."""
    model = GeneralizedLinearRegression(family="poisson", link="log", labelCol=target, featuresCol="features", predictionCol="rate", regParam=penalty, maxIter=25)
    return Pipeline(stages=[*_scaled(features), model]).fit(known).transform(asked).drop("raw", "features")


def median_regression(known: DataFrame, asked: DataFrame, features: list[str], target: str, key: str, folds: int = 3) -> tuple[DataFrame, str, dict[str, float]]:
    """Adds `pred` to `asked` by the best of the constant median, linear absolute-loss regression and boosted trees under that loss.

    The target is centred on the median of `known` and divided by 1.4826 times
    its median deviation. Each one's mean absolute error over the folds is
    given, too; of equal ones the simpler wins, so that what doesn't beat the
    constant median isn't used. Rows without a target don't count.
    """
    known = known.filter(F.col(target).isNotNull())
    middle = exact_quantile(known, F.col(target), 0.5) or 0.0
    spread = 1.4826 * (exact_quantile(known, F.abs(F.col(target) - middle), 0.5) or 0.0) or 1.0
    every = known.withColumn("_y", (F.col(target) - middle) / spread).withColumn("fold", F.pmod(F.xxhash64(F.lit(5), key), F.lit(folds)).cast("int"))
    dealt = packed(every.groupBy(*features, "_y", "fold").agg(F.count("*").cast("double").alias("_n")), "median-rows").persist()
    line = linear_l1(known, features, target, key, folds=folds)
    assemble = VectorAssembler(inputCols=features, outputCol="features")
    fit = lambda part: Pipeline(stages=[assemble, GBTRegressor(labelCol="_y", weightCol="_n", lossType="absolute", maxDepth=3, maxIter=10, seed=1)]).fit(part)
    held = []
    for i in range(folds):
        error = fit(dealt.filter(F.col("fold") != i)).transform(dealt.filter(F.col("fold") == i)).agg(F.sum(F.col("_n") * F.abs(F.col("_y") - F.col("prediction"))).alias("e"), F.sum("_n").alias("n")).first()
        held.append((error["e"] or 0.0, error["n"] or 0.0))
    errors = {"constant": line.constant_error, "linear": line.error, "trees": sum(e for e, _ in held) / max(1, sum(n for _, n in held))}
    best = min(errors, key=lambda name: (round(errors[name], 9), list(errors).index(name)))
    model = fit(dealt) if best == "trees" else None
    dealt.unpersist()
    if model is not None:
        return model.transform(asked).withColumn("pred", F.col("prediction") * spread + middle).drop("features", "prediction"), best, errors
    return (line.predict(asked) if best == "linear" else asked.withColumn("pred", F.lit(float(middle)))), best, errors
