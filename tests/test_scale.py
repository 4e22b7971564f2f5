"""What must not grow with the input: plans, what a task holds, what is computed twice."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions import ranges
from tidelog.operators import ranking


def test_a_range_among_very_many_is_one_small_expression(spark):
    """Each step of the halving used to hold the one before it four times."""
    frame = spark.range(4000).select((F.col("id") * 7 % 4001).cast("double").alias("k")).unionByName(spark.createDataFrame([(None,)], "k double"))
    dealt = ranges.with_part(frame, "k", parts=700)
    assert len(dealt._jdf.queryExecution().analyzed().toString()) < 200_000
    rows = dealt.collect()
    parts = {r["k"]: r["part"] for r in rows if r["k"] is not None}
    ordered = [parts[k] for k in sorted(parts)]
    assert ordered == sorted(ordered) and len(set(ordered)) == 700 and max(np.bincount(ordered)) <= 8
    assert [r["part"] for r in rows if r["k"] is None] == [0]


def test_copies_tie_by_id_whatever_a_matrix_product_rounds(spark):
    draw = np.random.default_rng(8)
    unit = draw.normal(size=(3, 64))
    rows = [(i, unit[i % 3].tolist()) for i in range(1003)]
    candidates = spark.createDataFrame(rows, "candidate long, vector array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw.normal(size=(37, 64)))], "query_id long, vector array<double>")
    found = ranking.retrieve_dot(queries, candidates, 5, q_rows=10, c_rows=300).collect()
    best = {q: int(np.argmax(unit @ np.array(v))) for q, v in ((r["query_id"], r["vector"]) for r in queries.collect())}
    assert {(r["query_id"], r["rank"]): r["candidate"] for r in found} == {(q, k + 1): b + 3 * k for q, b in best.items() for k in range(5)}


def test_few_products_are_held_at_once(monkeypatch):
    import tracemalloc

    import pandas as pd

    draw = np.random.default_rng(9)
    rows = pd.DataFrame({"id": np.arange(9000), "vector": list(draw.normal(size=(9000, 8))), "is_query": np.arange(9000) < 1000})
    tracemalloc.start()
    found = ranking._block_top(rows, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 10_000 and peak < 40e6  # 105 MB with 512 queries' products and their order


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_projected_scores_are_added_up_without_a_shuffle_of_the_product(spark, monkeypatch):
    monkeypatch.setattr(ranking, "LISTED", 3)
    draw = np.random.default_rng(10)
    scores = [(q, i, float(draw.choice([0.0, 2.5, -400.0, -1300.0, 5.0]) + draw.normal())) for q in range(6) for i in range(9)]
    path = [(i, f) for i in range(9) for f in range(20) if (i * f) % 4 == 1]
    found = ranking.project_scores(spark.createDataFrame(scores, "query_id long, candidate long, score double"), spark.createDataFrame(path, "inter long, final long"))
    got = {(r["query_id"], r["candidate"]): r["score"] for r in found.collect()}
    met = {}
    for q, i, s in scores:
        for _, f in (p for p in path if p[0] == i):
            met.setdefault((q, f), []).append(s)
    assert got.keys() == met.keys()
    assert all(abs(got[k] - np.logaddexp.reduce(v)) < 1e-9 for k, v in met.items())
    above = _plan(found).split("Generate explode")
    assert len(above) > 1 and "Exchange" not in above[0]


def test_scores_and_lists_are_worked_out_once(spark):
    from tidelog.plans import QUERIES

    for name in ("l5_retrieve_linear", "l8_rank_depth", "l9_oracle_rerank"):
        assert "l_orderkey" not in _plan(QUERIES[name](spark, "/root/testdata/sf0.001")), name


def test_cooccurrence_of_some_items_is_that_of_all(spark):
    from tidelog.operators import pairs

    links = spark.range(400).select((F.col("id") % 37).alias("src"), (F.col("id") * 7 % 23).alias("dst"))
    some = spark.createDataFrame([(i,) for i in (2, 5, 5, 99)], "item long")
    rows = lambda f: sorted(tuple(r) for r in f.collect())
    assert rows(pairs.cooccurrence(links, 4, items=some)) == rows(pairs.cooccurrence(links, 4).filter("item in (2, 5, 99)"))


def test_combinations_are_fitted_together_and_to_the_end(spark):
    from tidelog.operators import probe

    x = lambda a, b: F.sin(F.col("id") * a) * b
    frame = spark.range(400).select("id", x(1.7, 3.0).alias("p"), (x(0.3, 0.2) + 5).alias("q"), F.lit(2.0).alias("same"), (F.col("id") % 2 * 1.0).alias("r"), ((x(1.7, 1.0) + x(0.3, 0.5) + x(9.1, 1.2) > 0.4)).cast("double").alias("label")).persist()
    names = ["p", "q", "same", "r"]
    spark.sparkContext.setJobGroup("refit", "refit")
    best, found = probe.refit_combination(frame, names, "label", "id", grid=(0.01, 0.1), folds=3)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("refit")) < 80
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    dealt = probe.balanced(probe.stratified_folds(frame, "id", "label", 3, 1), "label")
    errors = {c: probe.cross_validated(dealt, "label", 3, lambda part, c=c: probe.logistic(names, "label", c, 400).fit(part)) for c in (0.01, 0.1)}
    assert best == max(errors, key=lambda c: (errors[c], -c))
    pipeline = probe.logistic(names, "label", best, 400)
    pipeline.getStages()[-1].setTol(1e-13)
    expected = probe.raw_coefficients(pipeline.fit(dealt), names)
    assert found["same"] == expected["same"] == 0
    assert all(abs(found[n] - expected[n]) < 1e-6 for n in names), (found, expected)
    one = probe.refit_combination(frame.withColumn("label", F.lit(1.0)), names, "label", "id", grid=(0.01, 0.1), folds=3)
    assert one == (0.01, dict.fromkeys(names, 0.0))


def test_pools_are_fitted_on_distinct_rows(spark, monkeypatch):
    from tidelog.operators import metrics, probe

    known = spark.range(900).select("id", (F.col("id") % 5 * 1.0).alias("x"), (F.col("id") % 3 * 1.0).alias("z"), ((F.col("id") % 5 + F.col("id") % 7) > 5).cast("double").alias("label"))
    seen = []

    def held(frame, label, folds, fit):
        seen.append((frame.count(), frame.agg(F.sum("_n")).first()[0]))
        return 0.7

    monkeypatch.setattr(probe, "cross_validated", held)
    best, result, _, failed = probe.auto_pool(known, known, ["x", "z"], "label", "id", folds=2)
    assert seen == [(seen[0][0], 900)] * 4 and seen[0][0] <= 5 * 3 * 2 * 2 and best == "logistic" and not failed
    counts = spark.createDataFrame([(1, 0.5, 3), (0, 0.5, 2), (0, 0.1, 4), (1, 0.9, 1)], "y int, pred double, _n long")
    plain = counts.select("y", "pred", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("y", "pred")
    for metric in (metrics.auroc, metrics.average_precision):
        assert abs(metric(counts).first()[0] - metric(plain).first()[0]) < 1e-12


def test_what_short_passes_read_is_packed_into_few_tasks(spark, monkeypatch):
    from tidelog.operators import probe, robust
    from tidelog.sources import sinks

    assert sinks.packed(spark.range(1000).repartition(40), "x").rdd.getNumPartitions() == 1
    monkeypatch.setattr(sinks, "PACKED_ROWS", 300)
    assert 2 <= sinks.packed(spark.range(1000).repartition(40), "x").rdd.getNumPartitions() <= 4
    seen, real = [], robust._sums
    monkeypatch.setattr(robust, "_sums", lambda rows, *more: seen.append(rows.rdd.getNumPartitions()) or real(rows, *more))
    frame = spark.range(200).repartition(30).select("id", F.cos("id").alias("x"), (F.cos("id") * 3 + F.sin("id")).alias("target"))
    model = robust.linear_l1(frame, ["x"], "target", "id", grid=(1.0,), folds=2)
    assert model.coefficients["x"] > 1 and set(seen) == {1}


def test_tasks_of_history_states_go_with_the_rows(spark, monkeypatch):
    from tidelog.operators import history_state
    from tidelog.plans import QUERIES, feature_queries

    folder = "/root/testdata/sf0.001"
    rows = lambda f: sorted(tuple(r) for r in f.collect())
    names = ("f1_f2_table_counts", "f5_dynamics", "f6_gap_globals")
    expected = {n: rows(QUERIES[n](spark, folder)) for n in names}
    assert "REPARTITION_BY_NUM" not in _plan(feature_queries.shop_states(spark, folder))
    monkeypatch.setattr(history_state, "TASK_ROWS", 150)
    plan = _plan(feature_queries.shop_states(spark, folder))
    assert plan.count("REPARTITION_BY_NUM") >= 4
    assert {n: rows(QUERIES[n](spark, folder)) for n in names} == expected


def test_linear_retrieval_shuffles_only_what_is_touched(spark, monkeypatch):
    dense = spark.range(300).select((F.col("id") % 2).alias("cutoff"), F.col("id").alias("candidate"), F.floor(F.sin(F.col("id") * 7.0) * 9).cast("double").alias("dense"))
    queries = spark.range(40).select(F.col("id").alias("query_id"), (F.col("id") % 3 % 2).alias("cutoff"))
    sparse = queries.drop("cutoff").crossJoin(dense.select("candidate")).filter("query_id > 2 and (query_id * 31 + candidate * 17) % 19 < query_id % 9").select("query_id", "candidate", F.floor(F.cos(F.col("candidate") * 3.0 + F.col("query_id")) * 9).cast("double").alias("sparse"))
    full = queries.join(dense, "cutoff").join(sparse, ["query_id", "candidate"], "left").withColumn("score", F.col("dense") + F.coalesce("sparse", F.lit(0.0)))
    rows = lambda f: sorted((r["query_id"], r["candidate"], r["score"], r["rank"]) for r in f.collect())
    expected = rows(ranking.top(full, "query_id", 11, F.desc("score"), "candidate"))
    found = ranking.retrieve_linear(queries, dense, sparse, 11)
    above = _plan(found).split("Generate inline")
    assert rows(found) == expected and len(above) > 1 and "hashpartitioning" not in above[0]
    # lists that don't go to every task
    monkeypatch.setattr(ranking, "FEW_LISTED", 0)
    monkeypatch.setattr(ranking, "LIST_QUERIES", 6)
    assert rows(ranking.retrieve_linear(queries, dense, sparse, 11)) == expected


def test_written_tables_leave_no_files_of_the_way_there(spark):
    from tidelog.sources import sinks

    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: set(part for part in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in part)
    tables = lambda: [path for _, path in sinks._temporary]
    before, known, setting = files(), len(tables()), spark.conf.get(sinks.FILE_CLEANUP, None)

    def build():
        step = sinks.written(spark.range(5000).repartition("id"), "step")
        inner = sinks.settled(lambda: sinks.written(step.repartition("id"), "deeper").filter("id % 2 = 0"), "inner")
        assert [p.rpartition("/")[2].split("-")[0] for p in tables()[known:]] == ["step", "inner"]
        return inner.join(step.filter("id < 100"), "id").repartition("id")

    made = sinks.settled(build, "made")
    assert len(made.collect()) == 50 and len(tables()) == known + 1 and spark.conf.get(sinks.FILE_CLEANUP, None) == setting
    with pytest.raises(Exception, match="broken"):
        sinks.settled(lambda: sinks.written(spark.range(5), "step").select(F.raise_error(F.lit("broken")).alias("x")), "made")
    assert len(tables()) == known + 1 and os.path.exists(tables()[-1].removeprefix("file:"))
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before


def test_held_out_rows_are_those_of_the_pair_features(spark, monkeypatch):
    from tidelog.operators import pairs
    from tidelog.plans import QUERIES, feature_queries as fq, ranking_queries as rq, readout_queries as ro
    from tidelog.sources import sinks

    folder, start, seen = "/root/testdata/sf0.001", len(sinks._temporary), []
    monkeypatch.setattr(ro, "held_out_ranking", lambda known, asked, *more: seen.extend([known, asked]) or spark.range(1))
    QUERIES["l10_held_out"](spark, folder)
    assert [path.rpartition("/")[2][:-33] for _, path in sinks._temporary[start:]] == ["fit-rows", "candidates", "truth"]
    names = ["query_id", "candidate", *fq.WEIGHTS]
    for held, cutoff, k in zip(seen, (ro.CUT - ro.D, ro.CUT), (20, ro.SHORTLIST)):
        truth = fq._supplier_pairs(spark, folder, cutoff).select("query_id", "candidate").withColumn("label", F.lit(1.0))
        candidates = rq._linear(spark, folder, cutoff, k).select("query_id", "candidate")
        timed = (candidates.unionByName(truth.drop("label")) if k == 20 else candidates).distinct().withColumn("t_q", F.lit(cutoff).cast("long"))
        past = fq.supplier_past(spark, folder, cutoff).withColumnRenamed("part", "candidate").filter("t is not null")
        wide = pairs.pair_features(timed, fq._activity(spark, folder, cutoff), pairs.pair_history(past, timed), rq._scores(spark, folder, cutoff), fq.WEIGHTS)
        wide = wide.join(truth, ["query_id", "candidate"], "left").fillna(0, ["label"]).select(*names, "label")
        own = [*names, "label"] if "label" in held.columns else names
        rows = lambda f: sorted(tuple(r) for r in f.select(own).collect())  # noqa: B023, E731
        expected = rows(wide)
        assert rows(held) == expected and any(r[names.index("repeat")] for r in expected) and any(r[names.index("cooc")] for r in expected)


def test_labelled_features_of_odd_rows(spark):
    from tidelog.operators import pairs

    frame = lambda rows, shape: spark.createDataFrame(rows, shape)
    both, day = "query_id long, candidate long", 86400
    candidates = frame([(1, 5), (1, 5), (1, 6), (2, 99), (2, None)], both)
    past = frame([(1, 5, 93 * day), (1, 5, 90 * day), (3, 5, 1), (2, None, 1), (None, 99, 1)], f"{both}, t long")
    activity = frame([(5, 1.0, 2.0, 3.0, 4.0), (6, 0.5, 0.0, -1.0, 0.25)], "entity_id long, total double, recent double, trend double, staleness double")
    found = pairs.labelled_features(candidates, past, frame([(1, 6, 3), (7, 7, 1)], f"{both}, score long"), frame([(1, 6), (2, None), (8, 8)], both), activity, 100 * day)
    got = {(r["query_id"], r["candidate"]): r for r in found.collect()}
    assert got.keys() == {(1, 5), (1, 6), (2, 99), (2, None)} and found.count() == 4
    assert [got[1, 5][c] for c in ("label", "repeat", "total", "trend", "cooc")] == [0.0, 1, 1.0, 3.0, 0.0]
    assert abs(got[1, 5]["times"] - np.log1p(2)) < 1e-12 and abs(got[1, 5]["recency"] - np.exp(-1)) < 1e-12
    assert [got[1, 6][c] for c in ("label", "repeat", "times", "recency", "trend")] == [1.0, 0, 0.0, 0.0, -1.0] and abs(got[1, 6]["cooc"] - np.log(4)) < 1e-12
    assert all(got[2, c][n] == 0 for c in (99, None) for n in ("label", "repeat", "times", "recency", "total", "trend", "cooc"))


def test_tasks_of_pairs_go_with_the_rows(spark, monkeypatch):
    from tidelog.operators import pairs

    links = spark.range(400).select((F.col("id") % 37).alias("src"), (F.col("id") * 7 % 23).alias("dst"))
    rows = lambda f: sorted(tuple(r) for r in f.collect())
    asked = spark.range(60).select((F.col("id") % 9).alias("query_id"), (F.col("id") * 5 % 11).alias("candidate"), F.col("id").alias("t"), F.col("id").alias("score"))
    activity = spark.range(11).select(F.col("id").alias("entity_id"), *[(F.col("id") * i).cast("double").alias(n) for i, n in enumerate(("total", "recent", "trend", "staleness"))])
    features = lambda: pairs.labelled_features(asked, asked.filter("t % 4 = 1"), asked.filter("t % 5 = 2"), asked.filter("t % 3 = 0"), activity, 99)
    weights, expected = rows(pairs.cooccurrence(links, 4)), rows(features())
    tasks, real = [], pairs._dealt
    monkeypatch.setattr(pairs, "_dealt", lambda frame, n, key: tasks.append((n, (out := real(frame, n, key)).rdd.getNumPartitions())) or out)
    monkeypatch.setattr(pairs, "TASK_ROWS", 10)
    assert rows(pairs.cooccurrence(links, 4)) == weights and rows(features()) == expected
    assert tasks == [(400, 40), (60 + 15 + 12 + 20, 11)]
