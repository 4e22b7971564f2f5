"""Publishing under races and crashes, bounded samples, refits held out, and the entry without a library."""

import functools
import os
import random
import subprocess
import sys
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import ROOT
from tidelog.operators import probe, targets
from tidelog.plans import QUERIES, readout_queries
from tidelog.sources import sinks

FOLDER = "/root/testdata/sf0.001"


def staged(path):
    return [n for n in os.listdir(path) if n.startswith(".staged")]


def test_second_of_two_builders_reads_what_the_first_published(spark, tmp_path, monkeypatch):
    root, real = str(tmp_path), sinks._there
    first = sinks.materialize_corpus(spark, root, "c", {"a": spark.range(3), "b": spark.range(1)})
    # the second looked before the first had published, so it builds, too
    looked = []
    monkeypatch.setattr(sinks, "_there", lambda s, p: bool(looked) and real(s, p) if looked.append(p) or len(looked) > 1 else False)
    second = sinks.materialize_corpus(spark, root, "c", {"a": spark.range(50), "b": spark.range(9)})
    assert [f.count() for f in (*first.values(), *second.values())] == [3, 1, 3, 1] and not staged(root)


def test_a_build_that_is_killed_half_way_leaves_the_name_free(spark, tmp_path):
    root = str(tmp_path)
    broken = spark.range(5).select(F.raise_error(F.lit("killed")).alias("x"))
    with pytest.raises(Exception, match="killed"):
        sinks.materialize_corpus(spark, root, "c", {"a": spark.range(3), "b": broken})
    assert not os.path.exists(f"{root}/c")
    os.makedirs(f"{root}/.staged-c-of-a-dead-process/a")  # what a lost driver leaves is never read
    assert sinks.materialize_corpus(spark, root, "c", {"a": spark.range(4)})["a"].count() == 4
    with pytest.raises(ValueError):
        sinks.materialize_corpus(spark, root, "c", {"a": spark.range(4), "new": spark.range(1)})


def test_predictions_survive_a_crash_between_the_renames(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/p"
    rows = lambda n: spark.range(n).select(F.col("id").alias("k"), F.rand(1).alias("pred"))
    sinks.write_keyed_predictions(rows(3), path, ["k"])
    real, calls = sinks._moved, []

    def dies(s, source, target):
        calls.append(target)
        if len(calls) == 2:
            raise RuntimeError("crash")
        return real(s, source, target)

    monkeypatch.setattr(sinks, "_moved", dies)
    with pytest.raises(RuntimeError):
        sinks.write_keyed_predictions(rows(7), path, ["k"])
    monkeypatch.setattr(sinks, "_moved", real)
    assert spark.read.parquet(f"{path}-aside").count() == 3
    doubled = rows(2).union(rows(2))
    with pytest.raises(ValueError):  # even a write that fails brings the old table back
        sinks.write_keyed_predictions(doubled, path, ["k"])
    assert spark.read.parquet(path).count() == 3
    sinks.write_keyed_predictions(rows(5), path, ["k"])
    assert spark.read.parquet(path).count() == 5 and os.listdir(tmp_path) == ["p"]


def test_sample_of_a_window_is_that_of_one_sort(spark):
    draw = random.Random(6)
    rows = [(q, draw.randint(0, 2), i, i) for q in range(4) for i in range((3, 40, 900, 0)[q])]
    inside = spark.createDataFrame([*rows, (3, None, None, None)], "query_id long, table_idx int, row_key long, t long")
    got = targets.capped_detail(inside, most=25, seed=3).collect()
    hashed = {tuple(r)[:3]: r["h"] for r in inside.withColumn("h", F.xxhash64(F.lit(3), "query_id", "table_idx", "row_key")).collect()}
    expected = defaultdict(list)
    for row in sorted(rows, key=lambda r: (hashed[r[:3]], r[2])):
        if len(expected[row[0]]) < 25:
            expected[row[0]].append(row[:3])
    assert sorted(tuple(r)[:3] for r in got) == sorted(k for kept in expected.values() for k in kept)
    events, kept = Counter(r[:2] for r in rows), Counter(k[:2] for ks in expected.values() for k in ks)
    assert all(r["weight"] == pytest.approx(events[r["query_id"], r["table_idx"]] / kept[r["query_id"], r["table_idx"]]) for r in got)


def test_refit_is_scored_on_rows_of_a_later_time(spark):
    draw = random.Random(9)

    def rows(start):
        out = []
        for q in range(start, start + 40):
            for c in range(10):
                x, z = draw.gauss(0, 1), draw.gauss(0, 1)
                out.append((q, c, float(x + 0.2 * draw.gauss(0, 1) > 0.8), q * 100 + c, x, z))
        return spark.createDataFrame(out, "query_id long, candidate long, label double, key long, x double, z double")

    given = {"x": 0.0, "z": 1.0}  # looks at the wrong column
    asked = rows(100)
    got = {r["coefficients"]: r for r in readout_queries.held_out_ranking(rows(0), asked, asked.filter("label = 1"), given, k=10, grid=(1.0,), folds=2).collect()}
    assert got["refitted"]["map"] > 0.9 > got["given"]["map"] + 0.2
    assert got["given"]["n_queries"] == got["refitted"]["n_queries"]


@pytest.mark.parametrize("name", ["l10_refit_combination", "l10_held_out", "p1_p3_logistic_probe", "p4_p5_median_probe", "p6_p7_pool_against_composed"])
def test_fitted_queries_run_in_full(spark, monkeypatch, name):
    """On a short grid, with the real fits."""
    monkeypatch.setattr(probe, "PROBE_C", (0.1,))
    monkeypatch.setattr(probe, "refit_combination", functools.partial(probe.refit_combination, grid=(0.1,), folds=2))
    found = QUERIES[name](spark, FOLDER).collect()
    assert found
    if name == "l10_held_out":
        assert {r["coefficients"] for r in found} == {"given", "refitted"} and all(0 <= r["map"] <= 1 for r in found)


@pytest.mark.parametrize("library", ["ahocorasick", "zstandard", "sentencepiece"])
def test_entry_without_a_library_of_the_corpus_operators(library):
    code = f"import sys; sys.modules[{library!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'w3_window_counts' in q and not any(n.startswith('op1_') for n in q) and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0
