"""How often the mix repeats each document, against a count from the operator's rows."""

import hashlib
import random
from collections import Counter

import pytest

from tests.llm.cases import documents
from tidelog.llm import mixing


def copies_of(taken, size, doc_id):
    draw = int(hashlib.md5(f"draw{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16) / 2**32
    return taken // size + (taken / size - taken // size > draw)


def compared(spark, docs):
    """Copies of each (id, size) as they come, and as the rows of `mix` ask for."""
    got = Counter((r["doc_id"], len((r["text"] or "").split())) for r in mixing.repeat_documents(docs).select("doc_id", "text").collect())
    want = Counter()
    for r in mixing.mix(docs).collect():
        if r["size"]:
            want[r["doc_id"], r["size"]] += copies_of(r["taken"], r["size"], r["doc_id"])
    return got, +want


@pytest.mark.parametrize("seed", range(3))
def test_rows_come_as_often_as_the_mix_takes_them(spark, seed):
    draw = random.Random(seed)
    sources = [None, "", "a", "b", "c", "d"][: 2 + 2 * seed]
    rows = []
    for i in range(150):
        source = draw.choices(sources, [40, 1, 9, 3, 1, 1][: len(sources)])[0]
        rows.append((draw.choice([i, i, i, None]), " ".join(draw.choices("pqrs", k=draw.choice([0, 1, 3, 40, 700]))) or None, source))
    rows += rows[:40]  # repeated rows
    got, want = compared(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got == want and sum(got.values()) > 20


def test_one_row_many_times_and_one_source(spark):
    frame = spark.createDataFrame([(7, "one two three", "a")] * 50 + [(8, "four five six seven", "a"), (9, "b", "z")], "doc_id long, text string, source string")
    got, want = compared(spark, frame)
    assert got == want
    one = frame.filter("source = 'a'")
    assert compared(spark, one)[0] == {(7, 3): 50, (8, 4): 1}
    assert compared(spark, documents(spark))[0] == compared(spark, documents(spark))[1]


def test_documents_are_not_dealt_out_to_learn_how_often_they_come(spark):
    """Whole rows are exchanged only where the mix of a source stops."""
    docs = spark.createDataFrame([(i, f"w{i} x", "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    plan = mixing.repeat_documents(docs)._jdf.queryExecution().executedPlan().toString()
    clear = plan[: plan.index("Window")] if "Window" in plan else plan
    assert "Union" in plan and "Exchange hashpartitioning" not in clear
