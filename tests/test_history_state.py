"""Features read off running states against the same features by joining queries with their past."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions.exprs import DAY
from tidelog.operators import features, history_state
from tidelog.operators.timeline import SPAN


def close(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    names = ["query_id", *[c for c in sorted(a.columns) if c != "query_id"]]
    left, right = ({r[0]: r for r in f.select(names).collect()} for f in (a, b))
    assert left.keys() == right.keys() and left
    for key, row in left.items():
        assert tuple(row)[1:] == pytest.approx(tuple(right[key])[1:], abs=1e-9), key


def drawn(spark, seed, entities=6, hot=1500):
    """Histories with ties, long silences, times before 1970, and an entity with far more events than LAST_TIMES."""
    draw = random.Random(seed)
    rows = []
    for e in range(entities):
        t = draw.randint(-5 * SPAN, 2 * SPAN)
        for i in range(hot if e == 0 else draw.randint(0, 40)):
            t += draw.choice([0, 1, 3600, DAY, 9 * DAY, 40 * DAY]) if e else draw.choice([0, 60, 3600, 7200])
            rows.append((e, t, draw.randint(0, 1), i, draw.choice("abc")))
    history = spark.createDataFrame(rows, "entity_id long, t long, table_idx int, row_key long, kind string")
    times = [r[1] for r in rows]
    asked = []
    for q in range(60):
        own = [r[1] for r in rows if r[0] == q % (entities + 1)]
        t_q = draw.choice(own) + draw.choice([-1, 0, 1, 5000]) if own and q % 3 else draw.randint(min(times), max(times) + SPAN)
        asked.append((q, q % (entities + 1), t_q, draw.choice([3600, DAY, 30 * DAY])))
    return history, spark.createDataFrame(asked, "query_id long, entity_id long, t_q long, horizon_s long")


@pytest.mark.parametrize("inclusive", [False, True])
def test_states_equal_the_join_with_the_past(spark, inclusive):
    history, queries = drawn(spark, 1 + inclusive)
    tables, values = {"x": 0, "y": 1}, ["a", "b", "c"]
    states = history_state.past_states(queries, history, tables, {"kind": values}, inclusive).persist()
    past = features.joined(queries, history, inclusive).persist()
    close(history_state.table_counts(states, tables), features.table_counts(past, tables, inclusive))
    close(history_state.category_counts(states, "kind", values), features.category_counts(past, "kind", values, inclusive=inclusive))
    if not inclusive:  # with it, the join form has no event at t_q - horizon, the first window has
        close(history_state.category_counts(states, "kind", values, recent=True), features.category_counts(past, "kind", values, recent=True))
        close(history_state.dynamics(states), features.dynamics(past))
    close(history_state.gap_globals(states), features.gap_globals(past))
    states.unpersist(), past.unpersist()


def test_median_of_the_last_gaps_only(spark):
    # 600 gaps of a day, then 100 of an hour: 511 are looked at
    times = [0]
    for gap in [DAY] * 600 + [3600] * 300:
        times.append(times[-1] + gap)
    history = spark.createDataFrame([(1, t, 0, i) for i, t in enumerate(times)], "entity_id long, t long, table_idx int, row_key long")
    queries = spark.createDataFrame([(1, 1, times[-1] + 1, DAY), (2, 1, times[600] + 1, DAY), (3, 1, times[1], DAY), (4, 1, 0, DAY), (5, 9, 5, DAY)], "query_id long, entity_id long, t_q long, horizon_s long")
    got = {r["query_id"]: r["gap"] for r in history_state.past_states(queries, history, {"x": 0}).collect()}
    assert got == {1: 3600, 2: DAY, 3: None, 4: None, 5: None}


def test_no_history_and_no_queries(spark):
    history, queries = drawn(spark, 5)
    nothing = history_state.past_states(queries, history.limit(0), {"x": 0})
    assert {tuple(r)[1:] for r in history_state.dynamics(nothing).collect()} == {(0.0,) * 8}
    assert {tuple(r)[1:] for r in history_state.gap_globals(nothing).collect()} == {(0.0, 0.0)}
    assert history_state.past_states(queries.limit(0), history, {"x": 0}).count() == 0


def test_neighbours_equal_the_join_with_their_histories(spark):
    draw = random.Random(8)
    rows, t = [], -2 * SPAN
    for i in range(900):
        t += draw.choice([0, 0, 600, DAY])
        rows.append((draw.choice([0, 0, 0, 1, 2, 3]), t, draw.randint(0, 1), i, draw.choice([None, 1, 1, 1, 2, 3, 4, 5, 6, 7])))
    links = spark.createDataFrame(rows, "entity_id long, t long, table_idx int, row_key long, neighbour_id long")
    theirs = [(n, draw.randint(-2 * SPAN, t), draw.randint(0, 1)) for n in (1, 1, 2, 3, 3, 3, 4, 5, 6) for _ in range(30)]
    history = spark.createDataFrame(theirs, "neighbour_id long, t long, table_idx int")
    queries = spark.createDataFrame([(q, q % 5, draw.choice(rows)[1] + draw.choice([-1, 0, 1, DAY]), DAY) for q in range(40)], "query_id long, entity_id long, t_q long, horizon_s long")
    mine = history_state.neighbour_features(queries, links, history, 1)
    past = features.joined(queries, links)
    close(mine, features.neighbour_features(past, "neighbour_id", history, 1))
    both = mine.agg(F.max(F.abs(F.col("nb_events") - F.col("nb_alike")))).first()[0]
    assert both > 0  # events of two tables, so the features differ


def test_no_query_meets_its_past(spark):
    """Queries are joined by their id, or with bounded blocks, never with events."""
    history, queries = drawn(spark, 3)
    states = history_state.past_states(queries, history, {"x": 0})
    plan = states._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("query_id" in j or "span" in j or "block" in j for j in joins)


def test_links_are_numbered_once_and_only_asked_neighbours_are_followed(spark):
    """A pair has a row per query time, not per link, and other neighbours' histories aren't sorted."""
    links = spark.createDataFrame([(1, 10 * i, i, n) for i in range(300) for n in (1, 2)], "entity_id long, t long, row_key long, neighbour_id long")
    marks = spark.createDataFrame([(1, 1500), (1, SPAN + 5), (1, 5), (2, 7)], "entity_id long, mark_t long")
    got = {tuple(r) for r in history_state.pair_counts(links, marks).collect()}
    # 1500 is excluded at 1500; what lies in a span without marks belongs to a later span's
    want = {(1, n, 5, 1, 0, 1) for n in (1, 2)} | {(1, n, 1500, 149, 1490, 150) for n in (1, 2)} | {(1, n, SPAN + 5, 150, 2990, 300) for n in (1, 2)}
    assert got == want
    early = links.withColumn("t", F.col("t") - 5 * SPAN)
    assert {tuple(r) for r in history_state.pair_counts(early, marks).collect()} == {(1, n, 5, 300, 2990 - 5 * SPAN, 300) for n in (1, 2)}
    queries = spark.createDataFrame([(1, 1, 1500)], "query_id long, entity_id long, t_q long")
    history = spark.range(1000).selectExpr("id AS neighbour_id", "id AS t", "0 AS table_idx")
    plan = history_state.neighbour_features(queries, links, history, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
