"""Hand-worked cases and properties of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from tidelog.functions.exprs import seconds
from tidelog.operators import events, features, metrics, pairs, probe, ranking, readout, sampling, targets, timeline, typing_rules
from tidelog.operators import window_language as wl
from tidelog.sources import sinks
from tidelog.spec import SHOP, TableSpec

DAY = 86400


def test_seconds_round_down_before_1970(spark):
    got = spark.sql("SELECT timestamp_ntz'1969-12-31 23:59:58.5' AS a, timestamp_ntz'1970-01-02 00:00:00' AS b").select(seconds(F.col("a")), seconds(F.col("b"))).first()
    assert tuple(got) == (-2, DAY)


def test_spec_knows_facts_and_entities():
    assert [t.name for t in SHOP.facts] == ["orders", "lineitem"]
    assert {t.name for t in SHOP.entities} == {"region", "nation", "customer", "supplier", "part", "orders"}


def test_window_bounds(spark):
    log = spark.createDataFrame([(1, t) for t in (-5, 0, 1, 10, 11)], "entity_id long, t long")
    points = spark.createDataFrame([(7, 1, 0, 10)], "query_id long, entity_id long, t_q long, horizon_s long")
    assert timeline.window_sums(log, points, {"n": F.lit(1).cast("long")}).first()["n"] == 2
    answer = wl.answer(wl.WindowQuery(("x",), "count"), {"x": log}, points).first()
    assert (answer["answer"], answer["valid"]) == (2.0, True)


def test_mean_of_nothing_is_not_valid(spark):
    log = spark.createDataFrame([(1, 50, 3.0)], "entity_id long, t long, v double")
    points = spark.createDataFrame([(7, 1, 0, 10)], "query_id long, entity_id long, t_q long, horizon_s long")
    got = wl.answer(wl.WindowQuery(("x",), "mean", value="v"), {"x": log}, points).first()
    assert (got["answer"], got["valid"]) == (None, False)


def test_a_missing_column_is_an_error(spark):
    log = spark.createDataFrame([(1, 50)], "entity_id long, t long")
    with pytest.raises(KeyError):
        wl.qualifying(wl.WindowQuery(("x",), filters=(wl.Filter("x", "colour", "in", ("red",)),)), {"x": log})


def test_bridge_files_only_later_events_once(spark):
    bridge = spark.createDataFrame([(0, 0, 0), (0, 1, 50), (1, 1, 200), (0, 1, 50)], "site long, study long, t long")
    analyses = spark.createDataFrame([(0, 10, 1), (1, 100, 2), (1, 300, 3)], "study long, t long, row_key long")
    got = {(r["entity_id"], r["t"]) for r in events.path_expand(bridge, analyses, "study", "study", "site").collect()}
    assert got == {(0, 10), (0, 100), (0, 300), (1, 300)}
    with pytest.raises(ValueError):
        events.split_path("a:b")
    with pytest.raises(KeyError):
        events.path_expand(bridge, analyses, "study", "nothing", "site")


def test_pair_history_literals(spark):
    past = spark.createDataFrame([(1, 2 * DAY, c, d * DAY) for d, c in enumerate([7, 7, 3])], "query_id long, t_q long, candidate long, t long")
    wanted = spark.createDataFrame([(1, c, 2 * DAY) for c in (7, 3, 5)], "query_id long, candidate long, t_q long")
    got = {r["candidate"]: r for r in pairs.pair_history(past, wanted).collect()}
    assert [got[c]["repeat"] for c in (7, 3, 5)] == [1, 1, 0]
    assert got[7]["times"] == pytest.approx(math.log1p(2))
    assert got[7]["recency"] == pytest.approx(math.exp(-1 / 7))
    assert got[3]["recency"] == 1.0 and got[5]["recency"] == 0.0


def _dynamics(spark, times, now=400, horizon=4):
    queries = spark.createDataFrame([(1, 1, now * DAY, horizon * DAY)], "query_id long, entity_id long, t_q long, horizon_s long")
    history = spark.createDataFrame([(1, int(t * DAY), i) for i, t in enumerate(times)] or [(2, 0, 0)], "entity_id long, t long, row_key long")
    return features.dynamics(features.joined(queries, history)).first().asDict()


def test_dynamics_literals(spark):
    none = _dynamics(spark, [])
    assert all(v == 0 for k, v in none.items() if k != "query_id")
    three = _dynamics(spark, [400 - 4 * i - j for i in range(8) for j in (1, 2, 3)])
    assert three["dyn_one"] == 1 and three["dyn_two"] == 1
    daily, monthly = _dynamics(spark, range(310, 370)), _dynamics(spark, range(40, 371, 30))
    assert daily["dyn_overdue"] > monthly["dyn_overdue"]
    falling = _dynamics(spark, [399, *[400 - 4 * i - j / 2 - 0.1 for i in range(1, 8) for j in range(5)]])
    assert falling["dyn_trend"] < 0


def test_typing_thresholds(spark):
    frame = spark.range(2000).select("id", *[(F.col("id") % n).alias(f"n{n}") for n in (20, 21)], *[(F.col("id") % n).cast("string").alias(f"s{n}") for n in (1024, 1025)], F.lit(None).cast("string").alias("empty"), F.array("id").alias("nested"))
    got = {r["column_name"]: r["kind"] for r in typing_rules.column_spec(TableSpec("x", "id"), frame).collect()}
    assert got == {"n20": "vocab", "n21": "numeric", "s1024": "vocab", "s1025": "drop", "empty": "vocab"}
    one = typing_rules.numeric_stats(TableSpec("x", "id"), frame.limit(1), ["n20"]).first()
    assert one["std"] == 1.0


def test_edges_of_a_zero_inflated_column(spark):
    frame = spark.createDataFrame([(0.0,)] * 990 + [(1.0,)] * 9 + [(2.0,)], "x double")
    edges = targets.bucket_edges(frame, "x")
    assert 0 < edges[0] < 1 and min(edges) >= 0.5 and edges == sorted(edges) and len(set(edges)) == 7
    assert targets.snapped([1.0, 1.0, 1.0], [0.5, 1.5, 2.5]) == [0.5, 1.5, 2.5]


def test_other_ends_and_slots(spark):
    fact = spark.createDataFrame([(1, 2, 5), (3, 3, 6)], "a long, b long, t long")
    assert {tuple(r) for r in targets.other_ends(fact, "a", "b").collect()} == {(1, 2, 5), (2, 1, 5)}
    assert targets.destination_slot("u", {"x": "u", "y": "v"}) == ("y",)
    assert targets.destination_slot("u", {"x": "u"}) == ()


def test_auroc_and_precision_with_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (0, 0.5), (1, 0.5)]
    frame = spark.createDataFrame(rows, "y int, pred double")
    won = sum((p > q) + (p == q) / 2 for y, p in rows if y for z, q in rows if not z)
    assert metrics.auroc(frame).first()["auroc"] == pytest.approx(won / 9)
    assert metrics.auroc(frame.filter("y = 1")).first()["auroc"] is None
    assert metrics.average_precision(frame).first()["ap"] == pytest.approx((1 * 1 / 2 + 2 * 3 / 5) / 3)


def test_map_counts_queries_without_hits(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "query_id long, candidate long, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 99), (3, 5)], "query_id long, candidate long")
    got = metrics.map_at_k(ranked, truth, 2).first()
    assert (got["n_queries"], got["map"]) == (2, pytest.approx((0.5 / 2) / 2))


def test_closed_forms(spark):
    frame = spark.createDataFrame([(2.0, 5.0, 0.3), (0.0, 0.0, 0.0), (40.0, 3.0, 1.0)], "mu double, n double, p double")
    got = frame.select(readout.p_more_than(F.col("mu"), 1), readout.binomial_tail(F.col("n"), F.col("p"), 1), readout.poisson_median(F.col("mu"))).collect()
    assert got[0][0] == pytest.approx(1 - math.exp(-2) * 3)
    assert got[0][1] == pytest.approx(1 - 0.7**5 - 5 * 0.3 * 0.7**4)
    assert [r[2] for r in got] == [2.0, 0.0, 40.0]
    assert tuple(got[1])[:2] == (0.0, 0.0)


def test_bucket_weights_of_whole_numbers():
    edges = [0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5]
    assert readout.bucket_weights(edges, list(range(8)), "le", 2) == [1, 1, 1, 0, 0, 0, 0, 0]
    assert readout.bucket_weights([0.25, 1.0], [0, 0.6, 2], "gt", 0.625) == [0.0, 0.5, 1.0]


def test_linear_retrieval_equals_the_full_product(spark):
    dense = spark.range(60).select(F.lit(0).cast("long").alias("cutoff"), F.col("id").alias("candidate"), (F.sin(F.col("id") * 7.0)).alias("dense"))
    queries = spark.range(12).select(F.col("id").alias("query_id"), F.lit(0).cast("long").alias("cutoff"))
    sparse = queries.crossJoin(dense.select("candidate")).filter("(query_id * 31 + candidate * 17) % 5 = 0").select("query_id", "candidate", F.cos(F.col("candidate") * 3.0 + F.col("query_id")).alias("sparse"))
    full = queries.crossJoin(dense.drop("cutoff")).join(sparse, ["query_id", "candidate"], "left").withColumn("score", F.col("dense") + F.coalesce("sparse", F.lit(0.0)))
    want = {(r["query_id"], r["candidate"], r["rank"]) for r in ranking.top(full, "query_id", 7, F.desc("score"), "candidate").collect()}
    got = {(r["query_id"], r["candidate"], r["rank"]) for r in ranking.retrieve_linear(queries, dense, sparse, 7).collect()}
    assert got == want


def test_padded_lists_have_k_items(spark):
    sources = spark.createDataFrame([(1,), (2,)], "src long")
    own = spark.createDataFrame([(1, 5, 1), (1, 9, 2)], "src long, dst long, rank int")
    fill = spark.createDataFrame([(9, 1), (4, 2)], "dst long, rank int")
    got = {r["src"]: r["dsts"] for r in ranking.topk_pad(sources, own, fill, 5).collect()}
    assert got == {1: [5, 9, 4, 9, 9], 2: [9, 4, 9, 9, 9]}


def test_draws_survive_repartitioning_and_follow_popularity(spark):
    counts = spark.createDataFrame([(i, 99 if i == 3 else 0) for i in range(10)], "entity_id long, n_links long")
    cdf = sampling.popularity(counts)
    ids = typing_rules.entity_index(counts, "entity_id")
    queries = spark.range(200).withColumnRenamed("id", "query_id")
    a = sampling.negatives(queries, ids, cdf, 10, 1).collect()
    b = sampling.negatives(queries.repartition(7), ids.repartition(3), cdf, 10, 1).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 2000
    popular = [r["candidate"] for r in a if r["i"] >= 5]
    assert abs(popular.count(3) / len(popular) - 100 / 109) < 0.05


def test_capped_detail_weighs_back_to_the_count(spark):
    inside = spark.range(1000).select((F.col("id") % 2).alias("query_id"), F.lit(0).alias("table_idx"), F.col("id").alias("row_key"), F.col("id").alias("t"))
    kept = targets.capped_detail(inside, most=50)
    assert {tuple(r) for r in kept.groupBy("query_id").agg(F.count("*"), F.round(F.sum("weight"), 6)).collect()} == {(0, 50, 500.0), (1, 50, 500.0)}


def test_packed_rows_hold_no_two_events_in_a_place(spark):
    history = spark.range(500).select((F.col("id") % 23).alias("entity_id"), F.col("id").alias("t"), F.col("id").alias("row_key"))
    packed = sampling.pack_sequences(history, 16, 1, shards=3)
    assert packed.groupBy("shard", "row_id", "place").count().filter("count > 1").count() == 0
    assert packed.agg(F.max("place")).first()[0] < 16


def test_submission_fails_on_a_missing_key(spark):
    keys = spark.createDataFrame([(1,), (2,)], "k long")
    good = spark.createDataFrame([(1, 0.5), (2, 0.7)], "k long, p double")
    assert sinks.assemble_submission(keys, good, ["k"], "p").count() == 2
    with pytest.raises(Exception, match="differ"):
        sinks.assemble_submission(keys, good.limit(1), ["k"], "p").collect()


def test_corpus_names_hold_all_flags():
    name = sinks.corpus_name
    assert name("a", 1, path_expand=("x", "y")) == name("a", 1, path_expand=("y", "x"))
    assert len({name("a", 1), name("a", 2), name("a", 1, child_aggs=True), name("a", 1, path_expand=("x",))}) == 4


def test_val_pick_refuses_unstamped_results(spark):
    rows = spark.createDataFrame([("t", "a", "val", 1.0), ("t", "a", "oops", 2.0)], "task string, readout string, split string, value double")
    with pytest.raises(Exception, match="no split"):
        metrics.pick_on_validation(rows).collect()


def test_logistic_probe_separates(spark):
    frame = spark.range(300).select("id", ((F.col("id") % 3) == 0).cast("double").alias("label"), (((F.col("id") % 3) == 0).cast("double") * 2 + F.sin("id")).alias("x"), F.cos("id").alias("z"))
    _, coefficients = probe.refit_combination(frame, ["x", "z"], "label", "id", grid=(1.0,), folds=2)
    assert coefficients["x"] > abs(coefficients["z"])


def test_probe_tries_the_whole_grid_and_scores_every_row(spark, monkeypatch):
    from tidelog.operators import metrics, probe
    from tidelog.plans import readout_queries as rq

    seen = {}

    def refit(frame, features, label, key, grid=probe.COMBINATION_C, folds=3):
        seen.update(fitted=frame.count(), grid=grid, folds=folds)
        return grid[0], dict.fromkeys(features, 1.0)

    def auroc(frame):
        seen["scored"] = frame.count()
        return real(frame)

    real = metrics.auroc
    monkeypatch.setattr(probe, "refit_combination", refit)
    monkeypatch.setattr(metrics, "auroc", auroc)
    monkeypatch.setattr(rq, "PROBE_SAMPLE", 40)
    rq.p1_p3_logistic_probe(spark, "/root/testdata/sf0.001")
    assert seen == {"fitted": 40, "grid": probe.PROBE_C, "folds": 5, "scored": 150}
    rq.l10_refit_combination(spark, "/root/testdata/sf0.001")
    assert seen["folds"] == 3 and seen["grid"] == probe.COMBINATION_C
    assert probe.logistic(["a"], "y", 1.0, 9).getStages()[-1].getMaxIter() == 2000
