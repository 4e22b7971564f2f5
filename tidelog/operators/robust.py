"""Linear regression under absolute loss, by reweighted least squares.

A step weighs each row by one over its last residual, so that the weighted
squares touch the absolute values, and solves the normal equations. The sums of
products that a step needs are added up in the tasks, for all penalties and
folds of a cross-validation at once, so a step is one pass over the rows and a
few numbers for each model reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.ranges import exact_quantiles
from tidelog.sources.sinks import packed

#: Inverse penalties of the published readouts, and their folds.
GRID = tuple(10 ** (-4 + 5 * i / 11) for i in range(12))
FOLDS = 5
#: Residuals count as so large at least, in robust deviations: from the first bound, a quarter of it each step, down to the last.
FIRST_RESIDUAL, LEAST_RESIDUAL = 1.0, 1e-4
MOST_STEPS, SETTLED = 60, 1e-5


@dataclass(frozen=True)
class L1Model:
    """`intercept + sum(coefficients * features)`, on the target's own scale."""

    intercept: float
    coefficients: dict[str, float]
    alpha: float
    #: Mean absolute error in units of the robust scale, held out and of the constant median.
    error: float
    constant_error: float

    def predict(self, frame: DataFrame, name: str = "pred") -> DataFrame:
        """Adds the prediction as one expression."""
        return frame.withColumn(name, sum((F.lit(c) * F.col(f) for f, c in self.coefficients.items()), F.lit(self.intercept)))


def _sums(rows: DataFrame, beta: np.ndarray, left_out: np.ndarray, least: float) -> np.ndarray:
    """Per model the weighted sums of products, and of absolute residuals and rows, those fitted on and those left out.

    `rows` has `x` (array of doubles, the last one the target) and `fold`.
    """
    models, d = beta.shape
    above = np.triu_indices(d + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((models, len(above[0]) + 4))
        for batch in batches:
            if not batch.num_rows:
                continue
            both = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d + 1)
            fold = batch.column(1).to_numpy(zero_copy_only=False)
            away = np.abs(both[:, d, None] - both[:, :d] @ beta.T)
            for m in range(models):
                fitted = fold != left_out[m]
                weighed = both[fitted] / np.maximum(away[fitted, m], least)[:, None]
                total[m, :-4] += (weighed.T @ both[fitted])[above]
                total[m, -4:] += (away[fitted, m].sum(), fitted.sum(), away[~fitted, m].sum(), (~fitted).sum())
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["k", "v"])

    summed = rows.select("x", "fold").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(models * (len(above[0]) + 4))
    for r in summed:
        out[r["k"]] = r["v"]
    return out.reshape(models, -1)


def fit_l1(rows: DataFrame, width: int, alphas: np.ndarray, left_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of each model, the last of `width` features being the constant, and mean errors (fitted, left out).

    A model minimises the mean absolute residual plus alpha / 2 times the
    squared coefficients, the constant's apart. Steps end when no model's
    objective changes by more than SETTLED of itself, and at MOST_STEPS.
    """
    models = len(alphas)
    beta, before, least = np.zeros((models, width)), None, FIRST_RESIDUAL
    at = np.triu_indices(width + 1)
    ridge = np.ones(width)
    ridge[-1] = 0.0
    for _ in range(MOST_STEPS):
        sums = _sums(rows, beta, left_out, least)
        n = np.maximum(sums[:, -3], 1.0)
        cost = sums[:, -4] / n + alphas / 2 * (beta**2 * ridge).sum(axis=1)
        if before is not None and least <= LEAST_RESIDUAL and (np.abs(before - cost) <= SETTLED * np.maximum(before, 1e-12)).all():
            break
        before = cost
        for m in range(models):
            products = np.zeros((width + 1, width + 1))
            products[at] = sums[m, :-4]
            products += np.triu(products, 1).T
            left = products[:width, :width] / n[m] + np.diag(alphas[m] * ridge + 1e-12)
            beta[m] = np.linalg.solve(left, products[:width, width] / n[m])
        least = max(LEAST_RESIDUAL, least / 4)
    sums = _sums(rows, beta, left_out, least)
    return beta, np.stack([sums[:, -4] / np.maximum(sums[:, -3], 1.0), sums[:, -2] / np.maximum(sums[:, -1], 1.0)], axis=1)


def linear_l1(known: DataFrame, features: list[str], target: str, key: str, grid: tuple[float, ...] = GRID, folds: int = FOLDS) -> L1Model:
    """Absolute-loss regression on standardised features and a robustly scaled target, the penalty 1 / C chosen by folds.

    The target is centred on its median and divided by 1.4826 times its median
    deviation, as the median is equivariant under both. Rows with a null
    feature or target don't count. Of equal errors the larger penalty wins.
    Without rows the model is the constant 0.
    """
    used = [F.col(f).cast("double") for f in features]
    plain = known.select(F.array(*used).alias("f"), F.col(target).cast("double").alias("y"), F.pmod(F.xxhash64(F.lit(5), key), F.lit(folds)).cast("int").alias("fold"))
    held = packed(plain.filter(~F.exists("f", lambda v: v.isNull() | F.isnan(v)) & F.col("y").isNotNull() & ~F.isnan("y")), "l1-rows")
    middle = exact_quantiles(held, F.col("y"), [0.5])[0]
    if middle is None:
        return L1Model(0.0, dict.fromkeys(features, 0.0), 1.0 / min(grid), 0.0, 0.0)
    spread = 1.4826 * (exact_quantiles(held, F.abs(F.col("y") - middle), [0.5])[0] or 0.0) or 1.0
    moments = held.agg(*[F.avg(F.col("f")[i]).alias(f"m{i}") for i in range(len(features))], *[F.stddev_pop(F.col("f")[i]).alias(f"s{i}") for i in range(len(features))]).first()
    mean = np.array([moments[f"m{i}"] for i in range(len(features))])
    std = np.array([moments[f"s{i}"] or 1.0 for i in range(len(features))])
    scaled = [(F.col("f")[i] - float(m)) / float(s) for i, (m, s) in enumerate(zip(mean, std))]
    rows = held.select(F.array(*scaled, F.lit(1.0), (F.col("y") - middle) / spread).alias("x"), "fold")

    alphas = 1.0 / np.array(sorted(grid))  # the largest penalty first
    width = len(features) + 1
    tried = np.repeat(alphas, folds)
    _, errors = fit_l1(rows, width, tried, np.tile(np.arange(folds), len(alphas)))
    sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    weights = np.array([sizes.get(i, 0) for i in range(folds)], dtype=float)
    mean_errors = (errors[:, 1].reshape(-1, folds) * weights).sum(axis=1) / weights.sum()
    best = int(np.argmin(np.round(mean_errors, 9)))
    beta, _ = fit_l1(rows, width, alphas[best : best + 1], np.array([-1]))
    constant = rows.agg(F.avg(F.abs(F.element_at("x", -1))).alias("e")).first()["e"]
    own = beta[0, :-1] / std * spread
    return L1Model(float(beta[0, -1] * spread + middle - (own * mean).sum()), dict(zip(features, own.tolist())), float(alphas[best]), float(mean_errors[best]), float(constant))
