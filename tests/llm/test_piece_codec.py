"""Piece encoding by backtracking against the library and against plain merging."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tests.llm.cases import TEXTS, documents, nothing
from tidelog.llm import piece_codec, queries
from tidelog.llm.merging import merge

FILE = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "a", "e", "th", "in", "▁", "\n", "\n\n", "é", "東", "京", "🙂", "<s>", "</s>", "<0x41>", "\x00", "A", "0", "1", "…", "ing", "tion", "\t", "\r", "aaa", "=", "==", "//", "--", "​", "ſ", "�"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


@pytest.fixture(scope="module")
def coder():
    return piece_codec.PieceCoder(piece_codec.checked(FILE))


def test_drawn_texts_equal_the_library(library, coder):
    draw = random.Random(3)
    for _ in range(4000):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 40)))
        ids = coder.encode(text)
        assert ids == library.encode(text, add_eos=True) and coder.decode(ids) == library.decode(ids), text


def test_any_ids_decode_as_the_library_does(library, coder):
    draw = random.Random(4)
    for _ in range(3000):
        ids = [draw.randrange(32000) if draw.random() < 0.5 else draw.randrange(260) for _ in range(draw.randint(0, 20))]
        assert coder.decode(ids) == library.decode(ids)


def test_backtracking_equals_merging_under_drawn_vocabularies(coder):
    """Small vocabularies, where the longest match often fails and failed positions matter."""
    draw, failures = random.Random(5), 0
    for _ in range(300):
        pieces = ["a", "b", "c"]
        for _ in range(draw.randint(3, 25)):
            pieces.append(draw.choice(pieces) + draw.choice(pieces))
        pieces = [p for p in dict.fromkeys(pieces) if len(p) < 9]
        own = piece_codec.PieceCoder.__new__(piece_codec.PieceCoder)
        own.ranks = {p: float(i) for i, p in enumerate(pieces)}
        kept = [p for p in pieces if merge(list(p), own.ranks) == [p]]
        own.ranks = {p: own.ranks[p] for p in kept}
        if any(merge(list(p), own.ranks) != [p] for p in kept):
            continue
        own.ids = {p: i for i, p in enumerate(kept)}
        own.starts = piece_codec.ahocorasick.Automaton()
        for p in kept:
            own.starts.add_word(p, len(p))
        own.starts.make_automaton()
        own.shorter = {p: next(p[:n] for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in own.ids) for p in kept if len(p) > 1}
        own.pairs = {}
        for _ in range(20):
            text = "".join(draw.choice("abcx") for _ in range(draw.randint(1, 30)))
            found = own.cut(text)
            assert found == merge(list(text), own.ranks)
            greedy, at = [], 0
            while at < len(text):
                size = max((len(p) for p in kept if text.startswith(p, at)), default=1)
                greedy.append(text[at : at + size])
                at += size
            failures += greedy != found
    assert failures > 100  # the longest match alone would be wrong


def test_long_runs_take_linear_time(library, coder):
    for text in ("a" * 200_000, " " * 50_000 + "x", "ab" * 100_000, "é" * 50_000, "\n" * 50_000):
        assert coder.encode(text) == library.encode(text, add_eos=True)


def test_hard_documents(spark, library):
    got = {r["id"]: r for r in piece_codec.encode_and_decode(documents(spark), FILE).collect()}
    for i, text in enumerate(TEXTS):
        if i != 3:
            expected = library.encode(text or "", add_eos=True)
            assert (list(got[i]["ids"]), got[i]["decoded"]) == (expected, library.decode(expected))
    assert piece_codec.encode_and_decode(documents(spark), FILE).count() == len(TEXTS) + 2
    assert piece_codec.encode_and_decode(nothing(spark), FILE).count() == 0


def test_registered_query(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.queries()["op12_piece_backtracking"](spark, folder).collect()}
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = library.encode(row["text"] or "", add_eos=True)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got[row["doc_id"]]) == (row["doc_id"], len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)))


def test_a_vocabulary_that_neighbours_do_not_settle_is_refused(monkeypatch, tmp_path):
    piece_codec.checked.cache_clear()
    monkeypatch.setattr(piece_codec, "merge", lambda symbols, ranks: symbols)
    with pytest.raises(ValueError):
        piece_codec.checked(FILE)


def test_stretches_are_remembered_over_tasks_in_two_generations(library, monkeypatch):
    monkeypatch.setattr(piece_codec, "REMEMBERED", 5)
    own, walked = piece_codec.PieceCoder(FILE), []
    walk = own.stretch
    monkeypatch.setattr(own, "stretch", lambda part: walked.append(part) or walk(part))
    for i in range(40):
        text = f"qzxv {i}wq {i}vk"
        assert own.encode(text) == library.encode(text, add_eos=True)
        assert len(own.known) <= 5 and len(own.older) <= 5
    assert len(walked) == 81  # the stretch that each text has is walked once, the others come once
