"""The divergence audit against SQL, brute force and hard cases."""

import re
from collections import Counter, defaultdict

import pandas as pd

from tests.llm.cases import TEXTS, documents, nothing
from tidelog.llm import divergence as d

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, most):
    """`rows` of (lang, source, text)."""
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups.add((lang, source))
    share = lambda n, total, v: 1 + 10**9 * (n + 5) // (total + 5 * v)
    out = []
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= least]
        mine = [s for one, s in groups if one == lang]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in mine}
        p = {s: {t: share(counts[lang, s][t], total[s], len(kept)) for t in kept} for s in mine}
        q = {t: share(sum(counts[lang, s][t] for s in mine), sum(total.values()), len(kept)) for t in kept}
        pairs = [(s, sum(abs(p[source][t] - p[s][t]) for t in kept)) for s in mine if s != source]
        terms = [(t, p[source][t] - q[t]) for t in kept if counts[lang, source][t] and p[source][t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda f: (-f[1], f[0].encode()))
            out += [(lang, source, part, item, value, i) for i, (item, value) in enumerate(found, 1) if part == "pair" or i <= most]
    return sorted(out)


def rows_of(frame, **kwargs):
    return sorted(map(tuple, d.source_divergence(frame, **kwargs).select("lang", "source", "part", "item", "value", "rank").collect()))


def plain(frame):
    return [(r["lang"], r["source"], r["text"]) for r in frame.select("lang", "source", "text").collect()]


def test_terms_of_a_document():
    assert d.document_terms("Don't STOP, café ÀB\x00é１x_y9z\n".encode()) == Counter({b"don": 1, b"t": 1, b"stop": 1, "café".encode(): 1, "Àb".encode(): 1, "é１x".encode(): 1, b"y": 1, b"z": 1})
    assert d.document_terms(b"") == Counter()
    for text in TEXTS:
        assert d.document_terms((text or "").encode()) == Counter(t.translate(LOWER).encode() for t in TERM.findall(text or ""))


def test_hard_documents(spark):
    frame = documents(spark)
    for least in (1, 2, 99):
        assert rows_of(frame, least=least, most_terms=3) == brute(plain(frame), least, 3)
    assert rows_of(nothing(spark)) == []
    alone = frame.limit(1)
    assert rows_of(alone) == []


def test_many_sources_and_small_blocks(spark, monkeypatch):
    rows = [("en" if i % 3 else None, f"s{i % 41}" if i % 7 else "", " ".join(f"{chr(97 + (i * j) % 23)}{chr(97 + j % 5)}" for j in range(i % 30))) for i in range(400)]
    monkeypatch.setattr(d, "BLOCK_TERMS", 7)
    monkeypatch.setattr(d, "TILE_SOURCES", 6)
    monkeypatch.setattr(d, "HELD", 20)
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    assert rows_of(frame, least=4, most_terms=5) == brute(rows, 4, 5)


def test_one_source_with_a_third_of_all_rows(spark):
    rows = [("en", "big" if i % 3 == 0 else f"s{i % 9}", f"common words here {chr(97 + i % 26) * 3} {chr(97 + i % 11) * 2}") for i in range(900)]
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    assert rows_of(frame) == brute(rows, 30, 50)


def test_distances_of_one_block():
    rows = pd.DataFrame({"lang": "x", "source": ["a", "a", "b", "a", "b"], "term": ["t", "u", "u", None, None], "p": [7, 9, 4, 1, 2], "tile": 0, "low": 0, "high": 0, "block": 0, "terms": 5})
    assert d._distances(rows).values.tolist() == [["x", "a", "b", abs(7 - 2) + abs(9 - 4) + 3 * abs(1 - 2)]]
    assert d._distances(rows.assign(block=1)).values.tolist() == [["x", "a", "b", abs(7 - 2) + abs(9 - 4) - 2 * abs(1 - 2)]]
