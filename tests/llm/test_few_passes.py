"""Work that doesn't grow with the rows: passes over all partitions, and what they leave on disk."""

import random
import time

from pyspark.sql import functions as F

from tidelog.llm import common, components, jaccard


def counted(monkeypatch, *modules):
    """Names of the tables that are written from now on."""
    names = []
    for module in modules:
        monkeypatch.setattr(module, "cut", lambda df, name, put=module.cut: names.append(name) or put(df, name))
    return names


def test_a_star_is_settled_by_one_round(spark, monkeypatch):
    names = counted(monkeypatch, components)
    edges = spark.createDataFrame([(7, i) for i in range(40) if i != 7] + [(3, 7)], "a long, b long")
    assert {r["node"]: r["root"] for r in components.components(edges).collect()} == dict.fromkeys(range(40), 0)
    assert len(names) == 1


def test_forests_need_a_round_for_each_doubling(spark, monkeypatch):
    names = counted(monkeypatch, components)
    draw = random.Random(3)
    parents = {i: i - 1 for i in range(101, 117)} | {i: draw.randrange(200, i) for i in range(201, 260)}
    roots = {r["node"]: r["root"] for r in components.forest_roots(spark.createDataFrame(list(parents.items()), "node long, root long")).collect()}
    assert roots == {n: 100 if n < 200 else 200 for n in parents}
    assert len(names) == 5  # four that double the steps of a chain of 16, one that moves nothing
    assert components.forest_roots(spark.createDataFrame([], "node long, root long")).count() == 0


def test_hung_leaves_out_roots_and_loops(spark):
    edges = [(1, 1), (2, 3), (3, 2), (5, 4), (4, 6), (6, 9), (9, 8), (8, 7), (2, 3)]
    found = components.hung(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(tuple(r) for r in found.collect()) == [(3, 2), (5, 4), (6, 4), (7, 4), (8, 4), (9, 4)]
    assert components.hung(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_sets_give_a_pair_once_without_another_shuffle(spark):
    sets = jaccard.shingle(["a b c d e f g h i j k l", "a b c d e f g h i j k l m", "quite another text of some words"])
    rows = [(n, bytearray(s.tobytes())) for n, s in enumerate(sets)] * 3
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    found = jaccard.verified(pairs, spark.createDataFrame(rows, "node long, shingles binary"))
    assert [tuple(r) for r in found.collect()] == [(0, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("MapInArrow"), plan[:200]


def test_the_join_writes_few_tables(spark, monkeypatch):
    names = counted(monkeypatch, components, jaccard)
    draw = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = draw.choices(words, k=60)
        texts += [" ".join(base)] + [" ".join(base[:at] + ["x"] + base[at + 1 :]) for at in draw.sample(range(60), 4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = jaccard.with_component_ids(jaccard.similar_groups(docs)).collect()
    assert {r["id"]: r["component_id"] for r in rows} == {i: i // 5 * 5 for i in range(60)}
    assert "jaccard-sized" not in names  # sizes come with the blocks
    assert names.count("edges") <= 2 and names.count("roots") <= 3


def test_cuts_leave_no_shuffle_files(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: set(part for part in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in part)
    before, setting = files(), spark.conf.get(common.FILE_CLEANUP, None)
    made = common.cut(spark.range(5000).groupBy((F.col("id") % 50).alias("k")).count(), "few-passes")
    assert made.count() == 50 and spark.conf.get(common.FILE_CLEANUP, None) == setting
    spark.range(10).groupBy("id").count().write.format("noop").mode("overwrite").save()
    assert files() - before  # other queries keep theirs
    before |= files()
    common.cut(spark.range(5000).groupBy((F.col("id") % 60).alias("k")).count(), "few-passes")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
