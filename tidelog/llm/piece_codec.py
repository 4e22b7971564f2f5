"""Exact merge-type encoding of pieces by backtracking, and decoding.

The merges of a text lead to the one sequence of pieces in which every two
neighbours, merged anew side by side, stay as they are. So a text is walked
from the left: one Aho-Corasick pass tells the pieces that start at each
character, the longest goes first, it is taken if it is compatible with the
piece before it, else the next shorter one is tried. Where none fits, the
position is marked as failed and the piece that led to it gives way to a
shorter one. A prefix has only one valid sequence, so a failed position is
never entered again and the work grows with the text's length.
"""

from __future__ import annotations

import codecs
import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import token_counts
from tidelog.llm.common import in_slices, keyed_text, lean, table
from tidelog.llm.merging import merge
from tidelog.llm.token_counts import MARK

#: So many different stretches, and pairs of pieces, are remembered in a worker, over all its tasks; stretches
#: twice, as those of the time before are kept until as many others have come.
REMEMBERED = 600_000

codecs.register_error("one_mark_a_byte", lambda wrong: ("�", wrong.start + 1))


class PieceCoder:
    """Encodes and decodes under one vocabulary file."""

    def __init__(self, model_file: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.silent = {i for i in range(len(self.pieces)) if model.is_control(i)}
        self.raw = {i: int(p[3:-1], 16) for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.raw.items()}
        self.unknown, self.end = model.unk_id(), model.eos_id()
        self.said = ["" if i in self.silent else " ⁇ " if i == self.unknown else p for i, p in enumerate(self.pieces)]
        ordinary = [i for i in range(len(self.pieces)) if not (i in self.silent or i in self.raw or i == self.unknown or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in ordinary}
        self.ranks = {self.pieces[i]: -model.get_score(i) for i in ordinary}
        self.starts = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1:  # a single character needs no search
                self.starts.add_word(piece, len(piece))
        self.starts.make_automaton()
        #: The longest shorter piece, or single character, that a piece begins with.
        self.shorter = {p: next(p[:n] for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in self.ids) for p in self.ids if len(p) > 1}
        stop = "" if any("\n" in p for p in self.ids if len(p) > 1) else "\n"
        # no merge crosses a mark that follows another character, nor such a line break: those cut a text
        self.stretches = re.compile(f"{MARK}*[^{MARK}{stop}]+|{MARK}+" + ("|\n+" if stop else ""))
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def compatible(self, left: str, right: str) -> bool:
        """Whether two neighbours, merged anew, stay themselves."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            self.pairs[key] = found = merge([*left, *right], self.ranks) == [left, right]
        return found

    def cut(self, text: str) -> list[str]:
        """The pieces of one stretch; a character that the vocabulary lacks is one of its own."""
        n = len(text)
        longest = [1] * n
        for last, length in self.starts.iter(text):  # by their ends, so the longest of a start comes last
            longest[last - length + 1] = length
        failed = bytearray(n + 1)
        known, compatible = self.pairs.get, self.compatible
        taken: list[str] = []
        at, piece, before = 0, text[: longest[0]], ""
        while at < n:
            while piece:
                after = at + len(piece)
                if not failed[after]:
                    fits = known((before, piece)) if before else True
                    if fits or (fits is None and compatible(before, piece)):
                        break
                piece = self.shorter.get(piece, "")
            if piece:
                taken.append(piece)
                at, before = after, piece
                piece = text[at : at + longest[at]] if at < n else ""
            else:
                failed[at] = 1
                piece = taken.pop()
                at -= len(piece)
                before = taken[-1] if taken else ""
        return taken

    def stretch(self, text: str) -> list[int]:
        """The ids of one stretch, bytes for unknown characters."""
        if (whole := self.ids.get(text)) is not None:  # the longest match at the start, and nothing beside it
            return [whole]
        out: list[int] = []
        for piece in self.cut(text):
            known = self.ids.get(piece)
            out += [known] if known is not None else [self.byte_ids[b] for b in piece.encode()]
        return out

    def recalled(self, part: str) -> tuple[int, ...]:
        """The ids of a stretch that `known` lacks; short ones are remembered, and those asked for again outlive the others."""
        ids = self.older.get(part)
        if ids is None:
            ids = tuple(self.stretch(part))
        if len(part) <= 64:
            if len(self.known) >= REMEMBERED:
                self.known, self.older = {}, self.known
            self.known[part] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text and the end id."""
        out: list[int] = []
        for part in self.stretches.findall(MARK + text.replace(" ", MARK)) if text else []:
            out += self.known.get(part) or self.recalled(part)
        return [*out, self.end]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks are spaces but for one at the start, runs of bytes are UTF-8, controls say nothing."""
        if self.raw.keys().isdisjoint(ids):
            return "".join(map(self.said.__getitem__, ids)).removeprefix(MARK).replace(MARK, " ")
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.raw:
                run.append(self.raw[i])
            elif i not in self.silent:
                out += [run.decode("utf-8", "one_mark_a_byte"), self.said[i]]
                run.clear()
        out.append(run.decode("utf-8", "one_mark_a_byte"))
        first = next((i for i in ids if i not in self.silent), self.end)
        text = "".join(out)
        return (text if first in self.raw else text.removeprefix(MARK)).replace(MARK, " ")


@functools.lru_cache(maxsize=2)
def checked(model_file: str) -> str:
    """The file, if compatible neighbours tell the merges' result; looked at once, on the driver.

    Every piece must be what its own characters merge to. Pieces of equal rank
    must be runs of marks, and runs of each length up to four times the
    longest piece, alone and before a letter, must come out as merging has them.
    """
    coder = PieceCoder(token_counts.checked(model_file))
    if any(MARK in p.lstrip(MARK) for p in coder.ids):
        raise ValueError("a piece spans words; texts can't be cut before marks")
    if any(merge(list(p), coder.ranks) != [p] for p in coder.ids):
        raise ValueError(f"{model_file} has a piece that merging doesn't lead to")
    by_rank: dict[float, list[str]] = {}
    for piece, rank in coder.ranks.items():
        by_rank.setdefault(rank, []).append(piece)
    tied = [p for same in by_rank.values() if len(same) > 1 for p in same]
    runs = [MARK * n + tail for n in range(1, 4 * max(map(len, coder.ids)) + 1) for tail in ("", "a")] if tied else []
    if any(p.strip(MARK) for p in tied) or any(coder.cut(r) != merge(list(r), coder.ranks) for r in runs):
        raise ValueError(f"{model_file} ranks pieces alike, so that neighbours don't tell which merge goes first")
    return model_file


@functools.lru_cache(maxsize=2)
def coder(model_file: str) -> PieceCoder:
    """One coder per worker process and file."""
    return PieceCoder(model_file)


def encode_and_decode(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, ids, decoded` of every row: the ids of its text with the end id, and the text that they stand for.

    A null text counts as empty and has the end id only. Texts are encoded
    whole, repeated rows each; strings that look like special tokens are
    ordinary text; other columns are ignored. The decoded text is the text
    itself, but for marks (U+2581) in it, which come back as spaces. The
    vocabulary file must be on every executor.
    """
    checked(model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = coder(model_file)
        for batch in (part for whole in batches for part in in_slices(whole, 1)):
            ids = [codec.encode(t) for t in batch.column(1).to_pylist()]
            decoded = [codec.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    return keyed_text(df, id_col, text_col).mapInArrow(lean(run), "id long, ids array<int>, decoded string")


def op12_piece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents` encoded and decoded under the 32k piece vocabulary."""
    import public_tokenizers

    done = encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.selectExpr("id AS doc_id", "cast(size(ids) AS long) AS n_tokens", "sha2(array_join(transform(ids, i -> cast(i AS string)), ' '), 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256")
