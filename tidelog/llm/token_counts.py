"""Token counts by heap-and-linked-list byte-pair merging.

A text's count is its number of initial symbols less the number of merges; no
identifiers are made. Symbols are characters, with spaces as the mark U+2581
and one mark before the text; a character that the vocabulary lacks counts as
one token per UTF-8 byte.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import in_slices, keyed_text, table
from tidelog.llm.merging import merge

MARK = "▁"
MOST_TOKENS = 4096
#: Counts of so many different stretches are remembered in each task.
REMEMBERED = 300_000


class PieceCounter:
    """Counts the tokens of texts under one vocabulary file."""

    def __init__(self, model_file: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ordinary = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ranks = {model.id_to_piece(i): -model.get_score(i) for i in ordinary}
        joined = [p for p in self.ranks if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in joined):
            raise ValueError("a piece spans words; texts can't be cut before marks")
        # No merge crosses a place where a mark follows another character, nor
        # a line break if no longer piece holds one: those cut a text.
        stop = "" if any("\n" in p for p in joined) else "\n"
        self.stretches = re.compile(f"{MARK}*[^{MARK}{stop}]+|{MARK}+" + ("|\n+" if stop else ""))
        self.known: dict[str, int] = {}

    def stretch(self, text: str) -> int:
        """Tokens of one stretch: symbols less merges, bytes for unknown ones."""
        left = merge(list(text), self.ranks)
        return len(left) + sum(len(s.encode()) - 1 for s in left if s not in self.ranks)

    def count(self, text: str) -> int:
        """Tokens of a whole text; 0 for an empty one."""
        if not text:
            return 0
        known, total = self.known, 0
        for part in self.stretches.findall(MARK + text.replace(" ", MARK)):
            n = known.get(part)
            if n is None:
                n = self.stretch(part)
                if len(part) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[part] = n
            total += n
        return total


@functools.lru_cache(maxsize=2)
def checked(model_file: str) -> str:
    """The file, if it holds what is counted here; looked at once, on the driver."""
    stated = sentencepiece_model_pb2.ModelProto.FromString(sentencepiece.SentencePieceProcessor(model_file=model_file).serialized_model_proto())
    normal, trained = stated.normalizer_spec, stated.trainer_spec
    if trained.model_type != trained.BPE or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not (normal.add_dummy_prefix and normal.escape_whitespaces and trained.byte_fallback):
        raise ValueError("only byte-pair models with byte fallback that leave texts as they are, but for one mark before them, are counted")
    return model_file


@functools.lru_cache(maxsize=2)
def counter(model_file: str) -> PieceCounter:
    """One counter per worker process and file."""
    return PieceCounter(model_file)


def count_tokens(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_TOKENS) -> DataFrame:
    """`id, n_bytes, n_tokens, over_limit` for every row.

    A null text counts as empty: no tokens. Strings that look like special
    tokens are ordinary text. Texts are counted whole, repeated rows each;
    other columns are ignored. The vocabulary file must be on every executor.
    """
    checked(model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(model_file)
        for batch in (part for whole in batches for part in in_slices(whole, 1)):
            texts = batch.column(1).to_pylist()
            counts = [pieces.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > most for n in counts], pa.bool_()),
                ],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )
        pieces.known.clear()  # a worker lives on after its task

    return keyed_text(df, id_col, text_col).mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every row of `documents` under the 32k piece vocabulary."""
    import public_tokenizers

    model_file = public_tokenizers.path("piece_bpe_32k.model")
    return count_tokens(table(spark, sf_dir, "documents"), model_file).withColumnRenamed("id", "doc_id")
