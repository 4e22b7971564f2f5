"""Many window queries compiled together against each one alone, and their plans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidelog.operators import window_language as wl
from tidelog.plans import QUERIES
from tidelog.plans.feature_queries import CUT

FOLDER = "/root/testdata/sf0.001"


def drawn(spark):
    draw = random.Random(4)
    logs = {
        name: spark.createDataFrame([(draw.randint(0, 5), draw.randint(0, 60), draw.choice([None, "a", "b"]), draw.choice([None, 1.5, -2.0, 30.0]), draw.choice([1.0, 2.5])) for _ in range(300)], "entity_id long, t long, kind string, x double, weight double")
        for name in ("one", "two")
    }
    points = spark.createDataFrame([(q, q % 8, draw.randint(-5, 60), draw.randint(1, 30)) for q in range(40)], "query_id long, entity_id long, t_q long, horizon_s long")
    return logs | {"one": logs["one"].drop("weight")}, points


def tasks():
    a, not_b = wl.Filter("one", "kind", "in", ("a",)), wl.Filter("two", "kind", "not_in", ("b",))
    big = wl.Filter("one", "x", "gt", 1.0)
    return {
        "occurs": wl.WindowQuery(("one",)), "twice": wl.WindowQuery(("one",), k=1, filters=(a,)), "gone": wl.WindowQuery(("two",), absence=True),
        "count": wl.WindowQuery(("one", "two"), "count", (a, not_b)), "sum": wl.WindowQuery(("one", "two"), "sum", (big,), value="x"),
        "mean": wl.WindowQuery(("two",), "mean", (not_b,), value="x"), "ratio": wl.WindowQuery(("one", "two"), "ratio", (a, big), denominator=(a,)),
    }


def test_each_task_is_as_it_is_alone(spark):
    logs, points = drawn(spark)
    held = {n: (lambda after, until, f=f: f.filter((F.col("t") > after) & (F.col("t") <= until))) for n, f in logs.items()}
    together = {(r["task"], r["query_id"]): (r["answer"], r["valid"]) for r in wl.answers(tasks(), held, points).collect()}
    wide = {r["query_id"]: r.asDict() for r in wl.workload(tasks(), held, points).collect()}
    assert len(together) == 7 * 40
    for name, query in tasks().items():
        for r in wl.answer(query, logs, points).collect():
            answer, valid = together[name, r["query_id"]]
            assert valid == r["valid"] and answer == pytest.approx(r["answer"]), (name, r)
            assert wide[r["query_id"]][name] == answer
    assert wl.answers(tasks(), {n: (lambda *_, f=f: f) for n, f in logs.items()}, points.limit(0)).count() == 0


def test_missing_tables_and_columns_are_errors(spark):
    logs, points = drawn(spark)
    held = {"one": lambda *_: logs["one"]}
    for query in (wl.WindowQuery(("two",)), wl.WindowQuery(("one",), filters=(wl.Filter("one", "nothing", "gt", 1.0),)), wl.WindowQuery(("one",), "sum", value="nothing")):
        with pytest.raises(KeyError):
            wl.answers({"q": query}, held, points)


@pytest.fixture(autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def scans(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"FileScan parquet \[[^\]]*\].*", plan)


@pytest.mark.parametrize("name", ["w3_window_counts", "w4_category_counts", "w6_window_bucket_counts", "w7_window_sums", "w8_capped_detail", "w10_window_destinations", "w12_path_retarget", "q1_labels", "q2_weighted_answer", "q8_query_workload", "s2_task_table"])
def test_both_bounds_reach_the_scan(spark, name):
    found = scans(QUERIES[name](spark, FOLDER))
    timed = [s for s in found if re.search(r"GreaterThanOrEqual\((o_orderdate|l_shipdate|ts),", s)]
    assert timed and all(re.search(r"LessThan\((o_orderdate|l_shipdate|ts),", s) for s in timed)


def test_all_tasks_read_each_log_once(spark):
    found = scans(QUERIES["q7_task_registry"](spark, FOLDER))
    for column in ("o_orderdate", "l_shipdate", "ts"):
        timed = [s for s in found if f"GreaterThanOrEqual({column}," in s and f"LessThan({column}," in s]
        assert len(timed) == 1, column


def test_a_path_of_scores_ends_at_the_cutoff(spark):
    """A line that ships after the cutoff must not add a destination."""
    found = QUERIES["l3_project_scores"](spark, FOLDER)
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    known = {(r[0], r[1]) for r in lines.filter(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) <= CUT).select("l_partkey", "l_suppkey").collect()}
    suppliers = {s for _, s in known}
    assert {r["candidate"] for r in found.collect()} <= suppliers
