"""Logistic regression of many penalties and folds together, by Newton's method.

The sums of gradients and curvatures that a step needs are added up in the
tasks, for all models at once, so a step is one pass over the rows and a few
numbers for each model reach the driver. A handful of passes settles what many
small fits of hundreds of steps each would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Passes at most, and by how much of itself an objective may still be above its least.
MOST_STEPS, SETTLED = 100, 1e-12


def _sums(rows: DataFrame, beta: np.ndarray, left_out: np.ndarray) -> np.ndarray:
    """Per model, over the rows that it is fitted on: the upper curvatures, the gradient and the loss, all weighted.

    `rows` has `x` (array of doubles, the last one the label) with a constant
    before the label, `weight` and `fold`.
    """
    models, d = beta.shape
    above = np.triu_indices(d)
    size = len(above[0]) + d + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((models, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            both = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d + 1)
            x, y = both[:, :d], both[:, d]
            weight, fold = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for m in range(models):
                w = np.where(fold != left_out[m], weight, 0.0)
                z = x @ beta[m]
                p = 0.5 * (1.0 + np.tanh(0.5 * z))
                total[m, : len(above[0])] += (x.T @ (x * (w * p * (1.0 - p))[:, None]))[above]
                total[m, len(above[0]) : -1] += x.T @ (w * (p - y))
                total[m, -1] += (w * (np.logaddexp(0.0, z) - y * z)).sum()
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["k", "v"])

    out = np.zeros(models * size)
    for r in rows.select("x", "weight", "fold").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"]
    return out.reshape(models, size)


def fit_logistic(rows: DataFrame, weights: np.ndarray, ridge: np.ndarray, used: np.ndarray, left_out: np.ndarray) -> np.ndarray:
    """Coefficients of each model, the constant last.

    A model minimises its mean weighted loss (`weights` are the sums of weights)
    plus half of `ridge` times the squared coefficients; what isn't `used` stays
    0. A step that makes an objective larger is halved.
    """
    models, d = ridge.shape
    above = np.triu_indices(d)
    kept, step = np.zeros((models, d)), np.zeros((models, d))
    least, going = np.full(models, np.inf), np.ones(models, dtype=bool)
    for _ in range(MOST_STEPS):
        live = np.flatnonzero(going)
        tried = kept[live] + step[live]
        sums = _sums(rows, tried, left_out[live])
        for i, m in enumerate(live):
            cost = sums[i, -1] / weights[m] + (ridge[m] * tried[i] ** 2).sum() / 2
            if cost > least[m] + SETTLED * max(1.0, least[m]):
                step[m] /= 2
                going[m] = np.abs(step[m]).max() > 1e-12
                continue
            kept[m], least[m] = tried[i], cost
            curved = np.zeros((d, d))
            curved[above] = sums[i, : len(above[0])] / weights[m]
            curved += np.triu(curved, 1).T
            curved[np.diag_indices(d)] += ridge[m] + 1e-12
            down = sums[i, len(above[0]) : -1] / weights[m] + ridge[m] * kept[m]
            step[m] = 0.0
            own = np.flatnonzero(used[m])
            if len(own):
                step[m, own] = -np.linalg.solve(curved[np.ix_(own, own)], down[own])
            going[m] = -(down * step[m]).sum() / 2 > SETTLED * max(least[m], 1e-3)
        if not going.any():
            break
    return kept
