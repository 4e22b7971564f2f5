"""Fits that are found in steps: absolute-loss lines and gap mixtures, against brute force and known parameters."""

import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.operators import gaps, probe, robust

# absolute loss


def skewed(n, seed=1):
    """Log-normal errors about a line, a few of them huge: least squares would be far off."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        x = draw.uniform(-2, 2)
        rows.append((i, x, 3.0 + 2.0 * x + draw.lognormvariate(0, 1) * (50 if i % 17 == 0 else 1)))
    return rows


def best_line(points):
    """Some line through two points has the least absolute error of all."""
    return min(sum(abs(y - y1 - (y2 - y1) / (x2 - x1) * (x - x1)) for x, y in points) for (x1, y1), (x2, y2) in itertools.combinations(points, 2) if x1 != x2) / len(points)


def error(model, rows):
    return sum(abs(y - model.intercept - model.coefficients["x"] * x) for _, x, y in rows) / len(rows)


def test_line_is_as_good_as_the_best_through_two_points(spark):
    rows = skewed(120)
    model = robust.linear_l1(spark.createDataFrame(rows, "key long, x double, y double"), ["x"], "y", "key", grid=(1e4, 1e6))
    assert error(model, rows) <= 1.01 * best_line([(x, y) for _, x, y in rows])
    ys = [y for _, _, y in rows]
    spread = 1.4826 * statistics.median(abs(y - statistics.median(ys)) for y in ys)
    assert model.constant_error == pytest.approx(sum(abs(y - statistics.median(ys)) for y in ys) / len(ys) / spread)
    assert model.error < model.constant_error
    squares = np.polyfit([x for _, x, _ in rows], ys, 1)
    assert abs(model.coefficients["x"] - 2) < abs(squares[0] - 2)


def test_penalty_shrinks_and_is_chosen_by_folds(spark):
    draw = random.Random(2)
    noise = spark.createDataFrame([(i, draw.gauss(0, 1), draw.gauss(0, 1)) for i in range(60)], "key long, x double, y double")
    shrunk = robust.linear_l1(noise, ["x"], "y", "key", grid=(1e-6,))
    free = robust.linear_l1(noise, ["x"], "y", "key", grid=(1e6,))
    assert abs(shrunk.coefficients["x"]) < 1e-4 and abs(free.coefficients["x"]) > abs(shrunk.coefficients["x"])
    line = spark.createDataFrame([(i, float(i % 30), 2.0 * (i % 30)) for i in range(60)], "key long, x double, y double")
    assert robust.linear_l1(line, ["x"], "y", "key").alpha == pytest.approx(1.0 / max(robust.GRID))


def test_line_with_nulls_constants_and_nothing(spark):
    rows = [(1, None, 2.0), (2, 1.0, None), (3, float("nan"), 1.0)] + [(i, 5.0, 7.0) for i in range(10, 20)]
    frame = spark.createDataFrame(rows, "key long, x double, y double")
    model = robust.linear_l1(frame, ["x"], "y", "key", grid=(1.0,))
    assert error(model, rows[3:]) < 1e-3 and model.constant_error == 0
    assert robust.linear_l1(frame.limit(0), ["x"], "y", "key", grid=(1.0,)).predict(frame.filter("x = 5")).filter("pred <> 0").count() == 0


def test_fold_rows_do_not_count_in_their_own_fit(spark):
    rows = spark.createDataFrame([([float(i), 1.0, float(3 * i if i < 6 else 100)], int(i >= 6)) for i in range(9)], "x array<double>, fold int")
    beta, errors = robust.fit_l1(rows, 2, np.array([0.0]), np.array([1]))
    assert np.allclose(beta[0], [3, 0], atol=1e-2)
    assert errors[0][0] == pytest.approx(0, abs=1e-2) and errors[0][1] == pytest.approx(sum(100 - 3 * i for i in (6, 7, 8)) / 3, rel=1e-3)


def test_median_regression_takes_the_best_of_three(spark):
    line = spark.createDataFrame([(i, float(i % 40), 3.0 * (i % 40) + (i * 7 % 5)) for i in range(200)], "key long, x double, y double")
    frame, best, errors = probe.median_regression(line, line, ["x"], "y", "key")
    assert best == "linear" and errors["linear"] < errors["trees"] < errors["constant"]
    assert frame.agg(F.max(F.abs(F.col("pred") - F.col("y")))).first()[0] < 6
    step = spark.createDataFrame([(i, float(i % 40), 10.0 * (15 < i % 40 < 25) + (i * 7 % 5) / 10) for i in range(200)], "key long, x double, y double")
    assert probe.median_regression(step, step, ["x"], "y", "key")[1] == "trees"


# gaps


def test_survival_and_hazard(spark):
    zs = [-30.0, -8.0, -3.0, -0.5, 0.0, 0.5, 3.0, 8.0, 40.0, 1000.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", gaps.log_survival(F.col("z")), gaps.hazard(F.col("z"))).collect()
    for z, survival, hazard in got:
        if z <= 30:
            exact = math.log(math.erfc(z / math.sqrt(2)) / 2) if z > -8 else -math.erfc(-z / math.sqrt(2)) / 2
            assert survival == pytest.approx(exact, rel=1e-6, abs=3e-7)
            assert hazard == pytest.approx(math.exp(-z * z / 2 - 0.5 * math.log(2 * math.pi) - exact), rel=1e-6, abs=1e-12)
        else:
            assert hazard == pytest.approx(z + 1 / z, rel=1e-3) and survival < -z * z / 2


def simulated(n, parts, horizon, seed):
    """Log-normal gaps, cut off after a time of their own."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        weight, mu, sigma = parts[0] if draw.random() < parts[0][0] else parts[-1]
        gap, seen = max(1, round(draw.lognormvariate(mu, sigma))), draw.randint(1, horizon)
        rows.append(("g", min(gap, seen), gap > seen))
    return rows


def test_censored_gaps_count_by_their_chance_of_being_longer(spark):
    rows = simulated(4000, [(1.0, 5.0, 0.8)], 300, seed=3)
    assert 0.2 < sum(c for *_, c in rows) / len(rows) < 0.8
    frame = spark.createDataFrame(rows, "g string, gap long, censored boolean")
    (fitted,) = gaps.fit_gap_mixture(frame, "g").collect()
    assert fitted["mu"] == pytest.approx(5.0, abs=0.06) and fitted["sigma"] == pytest.approx(0.8, abs=0.06)
    dropped = statistics.mean(math.log(g) for _, g, c in rows if not c)
    assert dropped < 4.7  # what leaving them out would give


def test_mixture_recovers_its_parts_and_the_likelihood_never_falls(spark):
    rows = simulated(6000, [(0.4, 2.0, 0.4), (0.6, 6.0, 0.7)], 1500, seed=4) + [("h", 5, False)] * 20
    frame = spark.createDataFrame(rows, "g string, gap long, censored boolean")
    counts = gaps.gap_counts(frame, "g").persist()
    now, seen = gaps.starting_mixture(counts, 2), []
    for _ in range(8):
        now = spark.createDataFrame(gaps.improved_mixture(counts, now, 2).collect(), "group string, mixture array<struct<weight:double,mu:double,sigma:double>>, log_likelihood double, n long, n_censored long")
        seen.append(now.filter("group = 'g'").first()["log_likelihood"])
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(seen, seen[1:]))
    first, second = sorted((r for r in gaps.fit_gap_mixture(frame, "g", 2, steps=40).collect() if r["g"] == "g"), key=lambda r: r["component"])
    assert (first["weight"], first["mu"], first["sigma"]) == pytest.approx((0.4, 2.0, 0.4), abs=0.08)
    assert (second["weight"], second["mu"], second["sigma"]) == pytest.approx((0.6, 6.0, 0.7), abs=0.08)
    counts.unpersist()


def test_survival_of_a_mixture(spark):
    rows = [("g", 1, 0.5, math.log(10), 1.0), ("g", 2, 0.5, math.log(1000), 0.5)]
    fitted = spark.createDataFrame(rows, "g string, component int, weight double, mu double, sigma double")
    got = gaps.mixture_survival(fitted, "g", F.lit(10)).first()["survival"]
    assert got == pytest.approx(0.5 * 0.5 + 0.5, abs=1e-6)
    assert gaps.mixture_survival(fitted, "g", F.lit(1)).first()["survival"] == pytest.approx(0.5 * (1 + math.erf(math.log(10) / math.sqrt(2))) / 2 + 0.5, abs=1e-6)


def test_gaps_of_nothing_nulls_and_all_censored(spark):
    shape = "g string, gap long, censored boolean"
    assert gaps.fit_gap_mixture(spark.createDataFrame([], shape), "g").count() == 0
    rows = [("a", None, False), ("a", 0, None), ("b", 9, True), ("b", 9, True)]
    got = {r["g"]: r for r in gaps.fit_gap_mixture(spark.createDataFrame(rows, shape), "g", steps=3).collect()}
    assert (got["a"]["mu"], got["a"]["n"], got["a"]["n_censored"]) == (0.0, 1, 0)
    assert got["b"]["mu"] > math.log(9) and got["b"]["n_censored"] == 2
