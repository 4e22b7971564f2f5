"""Operators whose results are drawn, fitted or approximated inside: properties that must hold, and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions import ranges
from tidelog.functions.exprs import DAY
from tidelog.operators import denorm, features, metrics, probe, ranking, sampling, targets, timeline, typing_rules
from tidelog.sources import sinks
from tidelog.spec import CLICKS, SHOP, DatabaseSpec, TableSpec, union_spec


def test_exact_quantiles_however_few_values_may_be_seen(spark, monkeypatch):
    draw = random.Random(3)
    values = [draw.choice([0.0, 0.0, 0.0, draw.gauss(0, 5), 7.5]) for _ in range(3000)]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    for few in (10_000, 40):
        monkeypatch.setattr(ranges, "FEW_VALUES", few)
        for share in (0.0, 0.1, 0.5, 0.9, 1.0):
            assert ranges.exact_quantile(frame, F.col("v"), share) == pytest.approx(float(np.quantile(values, share)))
        shares = [0.001, 0.2, 0.21, 0.5, 0.75, 0.999]
        assert ranges.exact_quantiles(frame, F.col("v"), shares) == pytest.approx(np.quantile(values, shares).tolist())
    assert ranges.exact_quantile(frame.filter("v > 1e9"), F.col("v"), 0.5) is None


def test_quantiles_beside_infinities_and_in_few_passes(spark, monkeypatch):
    monkeypatch.setattr(ranges, "FEW_VALUES", 8)
    values = [-math.inf] * 30 + [float(i) for i in range(100)] + [math.inf] * 30
    frame = spark.createDataFrame([(v,) for v in values] + [(float("nan"),)], "v double").repartition(3)
    assert ranges.exact_quantiles(frame, F.col("v"), [0.05, 0.5, 0.95]) == [-math.inf, 49.5, math.inf]
    passes = []
    real = ranges._between
    monkeypatch.setattr(ranges, "_between", lambda *a: passes.append(1) or real(*a))
    drawn = spark.range(40_000).select((F.hash("id") / 7.0).alias("v"))
    ranges.exact_quantiles(drawn, F.col("v"), [i / 40 for i in range(1, 40)])
    assert len(passes) <= 2


def test_edges_snap_to_values_that_lie_far_apart(spark):
    """Long runs of one value between quantiles: the separators come from the stretches after."""
    values = [0.0] * 700 + [float(i) for i in range(1, 30)] + [1e6] * 5
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    distinct = sorted(set(values))
    middles = [(a + b) / 2 for a, b in zip(distinct, distinct[1:])]
    expected = targets.snapped(np.quantile(values, [i / 8 for i in range(1, 8)]).tolist(), middles)
    assert targets.bucket_edges(frame, "x") == pytest.approx([e + i * 1e-6 for i, e in enumerate(expected)])


def test_running_sums_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranges, "PART_ROWS", 37)
    keys = random.Random(1).sample(range(10_000), 700)
    got = ranges.running_sums(spark.createDataFrame([(k,) for k in keys], "k long"), "k", {"n": F.lit(1), "s": F.col("k")}).collect()
    ordered = sorted(keys)
    assert {(r["k"], r["n"], r["s"]) for r in got} == {(k, i, sum(ordered[:i])) for i, k in enumerate(ordered)}


def test_areas_without_groups_equal_those_of_one_group(spark):
    draw = random.Random(7)
    rows = [(draw.randint(0, 1), round(draw.random(), 2), 1) for _ in range(2000)]
    frame = spark.createDataFrame(rows, "y int, pred double, one int")
    assert metrics.auroc(frame).first()["auroc"] == pytest.approx(metrics.auroc(frame, "one").first()["auroc"])
    assert metrics.average_precision(frame).first()["ap"] == pytest.approx(metrics.average_precision(frame, "one").first()["ap"])


def test_sweeps_cross_spans(spark):
    draw = random.Random(2)
    events = [(draw.randint(1, 3), draw.randint(0, 400) * DAY) for _ in range(500)]
    queries = [(i, draw.randint(1, 4), draw.randint(0, 400) * DAY, draw.randint(1, 90) * DAY) for i in range(200)]
    got = timeline.window_sums(spark.createDataFrame(events, "entity_id long, t long"), spark.createDataFrame(queries, "query_id long, entity_id long, t_q long, horizon_s long"), {"n": F.lit(1).cast("long")}).collect()
    want = {i: sum(e == entity and at < t <= at + length for e, t in events) for i, entity, at, length in queries}
    assert {r["query_id"]: r["n"] for r in got} == want


@pytest.mark.parametrize("centre", [None, 30.0])
def test_sampled_queries(spark, centre):
    draw = random.Random(5)
    history = [(e, 1000 * DAY + draw.randint(0, 900 * DAY)) for e in range(300) for _ in range(5)]
    frame = spark.createDataFrame(history, "entity_id long, t long")
    cutoff = 2000 * DAY
    rows = targets.sample_queries(frame, cutoff, 8, 1, centre=centre).collect()
    times = {}
    for e, t in history:
        times.setdefault(e, []).append(t)
    for r in rows:
        assert min(times[r["entity_id"]]) <= r["t_q"] and r["t_q"] + r["horizon_s"] <= cutoff
        assert r["k"] == sum(t <= r["t_q"] for t in times[r["entity_id"]]) - 1 >= 0
        assert DAY <= r["horizon_s"] + 1 and r["horizon_s"] <= 365 * DAY
    days = [math.log(r["horizon_s"] / DAY) for r in rows]
    assert np.median(days) == pytest.approx(math.log(30) if centre else math.log(365) / 2, abs=0.25)
    assert np.std(days) == pytest.approx(0.5 if centre else math.log(365) / math.sqrt(12), rel=0.15)
    again = targets.sample_queries(frame.repartition(7), cutoff, 8, 1, centre=centre).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_dense_queries_end_by_the_cutoff(spark):
    history = spark.createDataFrame([(e, e * DAY + i * 10 * DAY, i, 0) for e in range(40) for i in range(12)], "entity_id long, t long, row_key long, table_idx int")
    rows = targets.sample_dense_queries(history, 100 * DAY, 4, 7 * DAY, seed=3).collect()
    assert rows and all(r["t"] <= r["t_q"] <= r["t"] + 30 * DAY and r["t_q"] + r["horizon_s"] <= 100 * DAY for r in rows)
    per = {}
    for r in rows:
        per.setdefault(r["entity_id"], []).append(r["t"])
    assert all(len(x) <= 4 and len(set(x)) == len(x) for x in per.values())


def test_shared_pool_chances(spark):
    counts = spark.createDataFrame([(i, 3 * i) for i in range(20)], "entity_id long, n_links long")
    cdf, ids = sampling.popularity(counts), typing_rules.entity_index(counts, "entity_id")
    pool = sampling.shared_pool(ids, cdf, 7000, 5).collect()
    assert len(pool) == 7000
    chance = {r["candidate"]: r["q"] for r in pool}
    assert sum(chance.values()) == pytest.approx(1.0)
    for candidate in (0, 10, 19):
        assert sum(r["candidate"] == candidate for r in pool) / 7000 == pytest.approx(chance[candidate], abs=0.02)


def test_samples_by_group_keep_their_shares(spark):
    frame = spark.range(9000).select("id", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("g"))
    kept = {r["g"]: r["count"] for r in sampling.sample_by(frame, "g", {"a": 1.0, "b": 0.25}, "id", 2).groupBy("g").count().collect()}
    assert kept["a"] == 3000 and abs(kept["b"] - 750) < 100 and "c" not in kept


def test_entity_rows_hold_the_last_events(spark):
    history = spark.createDataFrame([(e, 100 - i, e * 100 + i) for e in range(3) for i in range(e * 4)], "entity_id long, t long, row_key long")
    got = {r["entity_id"]: [(x["t"], x["row_key"]) for x in r["events"]] for r in sampling.entity_rows(history, 5).collect()}
    assert got == {e: sorted((100 - i, e * 100 + i) for i in range(e * 4))[-5:] for e in (1, 2)}


def test_dot_retrieval_over_many_blocks(spark):
    draw = np.random.default_rng(4)
    q, c = draw.normal(size=(70, 5)), draw.normal(size=(90, 5))
    frames = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vector array<double>") for name, x in (("query_id", q), ("candidate", c))]
    got = {(r["query_id"], r["rank"]): r["candidate"] for r in ranking.retrieve_dot(*frames, 6, q_rows=20, c_rows=25).collect()}
    order = np.argsort(-(q @ c.T), axis=1)[:, :6]
    assert got == {(i, k + 1): int(order[i, k]) for i in range(70) for k in range(6)}


def test_dot_retrieval_spares_what_norms_rule_out(spark):
    draw = np.random.default_rng(5)
    q, c = draw.normal(size=(150, 4)), draw.normal(size=(400, 4)) * np.exp(draw.normal(size=(400, 1)) * 2)
    q[0], c[7], c[8] = 0, c[9], c[9]  # a query that all tie for, and equal candidates
    frames = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vector array<double>") for name, x in (("query_id", q), ("candidate", c))]
    told = {}
    got = {(r["query_id"], r["rank"]): r["candidate"] for r in ranking.retrieve_dot(*frames, 6, q_rows=10, c_rows=20, told=told).collect()}
    order = np.lexsort((np.tile(np.arange(400), (150, 1)), -(q @ c.T)), axis=1)[:, :6]
    assert got == {(i, k + 1): int(order[i, k]) for i in range(150) for k in range(6)}
    assert told["sent"] < 0.6 * told["full"]
    same = [frames[0], frames[1].limit(90).withColumn("vector", F.array(*[F.lit(1.0)] * 4))]
    tied = ranking.retrieve_dot(*same, 3, q_rows=40, c_rows=20).groupBy("query_id").agg(F.sort_array(F.collect_list("candidate")).alias("c")).collect()
    assert len(tied) == 150 and len({tuple(r["c"]) for r in tied}) == 1
    few = ranking.retrieve_dot(frames[0], frames[1].limit(4), 9, q_rows=40, c_rows=2)
    assert few.count() == 600 and ranking.retrieve_dot(frames[0], frames[1].limit(0), 3).count() == 0 and ranking.retrieve_dot(frames[0].limit(0), frames[1], 3).count() == 0


def test_linear_retrieval_with_many_queries_of_one_cutoff(spark, monkeypatch):
    monkeypatch.setattr(ranking, "LIST_QUERIES", 7)
    monkeypatch.setattr(ranges, "PART_ROWS", 20)
    draw = random.Random(2)
    dense = [(1, c, float(draw.randint(0, 30))) for c in range(200)] + [(2, c, float(draw.randint(0, 9))) for c in range(50)]
    queries = [(q, 1 if q % 5 else 2) for q in range(60)]
    sparse = [(q, c, float(draw.randint(-20, 40))) for q, cut in queries for c in draw.sample(range(200 if cut == 1 else 50), draw.randint(0, 12))]
    shapes = ("query_id long, cutoff long", "cutoff long, candidate long, dense double", "query_id long, candidate long, sparse double")
    found = ranking.retrieve_linear(*[spark.createDataFrame(rows, shape) for rows, shape in zip((queries, dense, sparse), shapes)], 5)
    extra = {(q, c): s for q, c, s in sparse}
    expected = set()
    for q, cut in queries:
        scores = sorted((-(d + extra.get((q, c), 0)), c) for own, c, d in dense if own == cut)
        expected |= {(q, c, i) for i, (_, c) in enumerate(scores[:5], 1)}
    assert {(r["query_id"], r["candidate"], r["rank"]) for r in found.collect()} == expected


def test_simple_scores(spark):
    frame = spark.createDataFrame([(i, None if i == 0 else i * DAY, i) for i in range(500)], "entity_id long, idle long, n_past long")
    present, absent = (ranking.simple_scores(frame, 3, absence=a).orderBy("entity_id").collect() for a in (False, True))
    assert all(p["recency"] == -a["recency"] and p["count"] == -a["count"] and p["random"] == a["random"] for p, a in zip(present, absent, strict=True))
    draws = [r["random"] for r in present]
    assert 0.45 < np.mean(draws) < 0.55 and 0 <= min(draws) and max(draws) < 1 and len(set(draws)) == 500
    assert draws != [r["random"] for r in ranking.simple_scores(frame, 4).orderBy("entity_id").collect()]


def test_counter_layouts_only_grow(spark):
    cards = [(0, "a", 0, "x", 5), (0, "a", 1, "y", 17), (0, "a", 2, "z", 16), (1, "b", 0, "u", 1), (1, "b", 1, "v", 9), (1, "b", 2, "w", 4)]
    frame = spark.createDataFrame(cards, "table_no int, table_name string, place int, column_name string, codes long")
    lay = lambda **k: [(r["slot"], r["column_name"], r["codes"]) for r in features.category_layout(frame, **k).orderBy("slot").collect()]
    assert lay(most=20) == [(0, "x", 5), (5, "v", 9), (14, "w", 4)]
    assert lay(most=20, kept=["b.w"]) == [(0, "w", 4), (4, "x", 5), (9, "v", 9)]
    assert lay() == [(0, "x", 5), (5, "v", 9), (14, "z", 16), (30, "w", 4)]
    assert features.category_layout(frame.limit(0)).count() == 0


def test_neighbour_layout_leaves_out_the_entity_itself():
    assert features.neighbour_layout(SHOP, "supplier") == [("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part")]
    assert features.neighbour_layout(SHOP, "customer") == []


def test_child_budgets_share_between_rounds(spark):
    kinds = spark.createDataFrame([(0, "c", 0, "n", "sum"), (0, "c", 1, "k", "category"), (1, "d", 0, "m", "sum"), (1, "d", 1, "j", "drop")], "child_no int, child string, place int, column_name string, kind string")
    values = spark.createDataFrame([("c", "k", v) for v in "zyx"] + [("d", "j", "q")], "child string, column_name string, value string")
    got = [tuple(r) for r in denorm.budgeted_children(kinds, values, 6).orderBy("chosen").collect()]
    assert got == [(0, "c", None, None), (1, "d", None, None), (2, "c", "n", None), (3, "d", "m", None), (4, "c", "k", "x"), (5, "c", "k", "y")]


def test_unions_of_databases_are_checked():
    union = union_spec({s.name: s for s in (SHOP, CLICKS)})
    assert [t.name for t in union.facts] == ["clicks::events", "shop::orders", "shop::lineitem"] and union["clicks::events"].fkeys == {"user_id": "clicks::customer"}
    assert {e.name for e in union.entities} >= {"shop::customer", "clicks::customer"}
    with pytest.raises(ValueError, match="lacks"):
        union_spec({"x": DatabaseSpec("x", (TableSpec("a", "i", "t", {"f": "gone"}),), 1, 1)})


def test_predictions_with_wrong_keys_leave_the_old_ones(spark, tmp_path):
    path = str(tmp_path / "predictions")
    good = spark.createDataFrame([(1, 0.5), (2, 0.25)], "k long, pred double")
    sinks.write_keyed_predictions(good, path, ["k"])
    for wrong in (good.unionByName(good), good.withColumn("k", F.lit(None).cast("long"))):
        with pytest.raises(ValueError, match="distinct"):
            sinks.write_keyed_predictions(wrong, path, ["k"])
        assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 0.5), (2, 0.25)]
    sinks.write_keyed_predictions(good.limit(1), path, ["k"])
    assert spark.read.parquet(path).count() == 1 and [p.name for p in tmp_path.iterdir()] == ["predictions"]


def test_corpora_are_found_again_until_the_data_changes(spark, tmp_path):
    data = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(data)
    first = sinks.data_version(spark, [data])
    assert first == sinks.data_version(spark, [data])
    kept = sinks.materialize_corpus(spark, str(tmp_path), sinks.corpus_name("a", 1, version=first), {"x": spark.range(3)})["x"]
    assert sinks.materialize_corpus(spark, str(tmp_path), sinks.corpus_name("a", 1, version=first), {"x": spark.range(9)})["x"].count() == kept.count() == 3
    spark.range(4).write.mode("overwrite").parquet(data)
    assert sinks.data_version(spark, [data]) != first


def _labelled(spark, n, shift):
    noisy = F.sin(F.col("id") * 12.9898 + shift)
    return spark.range(n).select("id", (F.col("id") % 3 == 0).cast("double").alias("label"), ((F.col("id") % 3 == 0).cast("double") + noisy).alias("x"), F.cos(F.col("id") * 3.7 + shift).alias("z"))


def test_pool_scores_other_rows_and_names_what_failed(spark, monkeypatch):
    real = probe.GBTClassifier
    known, asked = _labelled(spark, 240, 0.0), _labelled(spark, 150, 1.0)
    monkeypatch.setattr(probe, "GBTClassifier", lambda **k: real(**(k | {"maxIter": 2, "maxDepth": min(k["maxDepth"], 3)})))
    best, result, found, failed = probe.auto_pool(known, asked, ["x", "z"], "label", "id", folds=2)
    assert set(found) == {"logistic", "gbt3", "gbt6", "forest"} and not failed and result.count() == 150
    assert metrics.auroc(result).first()["auroc"] > 0.6 and found[best] == max(found.values())
    monkeypatch.setattr(probe, "cross_validated", lambda frame, label, folds, fit: 1 / 0)
    with pytest.raises(ValueError, match="division by zero"):
        probe.auto_pool(known, asked, ["x", "z"], "label", "id", folds=2)


def test_median_regression_falls_back_to_the_median(spark):
    frame = lambda n: spark.range(n).select("id", F.cos("id").alias("x"), F.when(F.col("id") % 10 == 0, 100.0).otherwise(F.col("id") % 3 * 1.0).alias("target"))
    done, best, errors = probe.median_regression(frame(150), frame(20), ["x"], "target", "id", folds=2)
    assert done.count() == 20 and errors[best] == min(errors.values()) and (best != "constant" or {r["pred"] for r in done.collect()} == {1.0})
    line = lambda n: spark.range(n).select("id", (F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 50 * 10.0).alias("target"))
    done, best, _ = probe.median_regression(line(200), line(50), ["x"], "target", "id", folds=2)
    assert best != "constant" and done.agg(F.avg(F.abs(F.col("pred") - F.col("target")))).first()[0] < 60


def test_rates_are_fitted_on_other_rows(spark):
    frame = lambda n: spark.range(n).select("id", (F.col("id") % 4).cast("double").alias("x"), F.exp(F.col("id") % 4 * 0.5).cast("double").alias("target"))
    done = probe.fitted_rate(frame(200), frame(40), ["x"], "target", penalty=0.0).collect()
    assert len(done) == 40 and all(r["rate"] == pytest.approx(r["target"], rel=0.05) for r in done)


def test_hashed_categories_stay_in_range(spark):
    frame = spark.range(2000).select(F.col("id").cast("string").alias("v")).unionByName(spark.createDataFrame([(None,)], "v string"))
    first = frame.withColumn("h", typing_rules.hash_category(F.col("v"))).collect()
    codes = [r["h"] for r in first if r["v"] is not None]
    again = {r["v"]: r["h"] for r in frame.repartition(5).withColumn("h", typing_rules.hash_category(F.col("v"))).collect()}
    assert all(again[r["v"]] == r["h"] for r in first) and min(codes) >= 0 and len(set(codes)) > 500
