"""Byte-level BPE as a monoid: halves are encoded apart and joined.

Two encodings join by re-encoding a window around their boundary. The window
grows until its outer tokens agree with the tokens outside, that is, until each
of the two outer pairs encodes to itself. A sequence whose neighbouring pairs
all encode to themselves is the encoding of its bytes, so nothing further out
can change and the join is exact. Joining is associative, with the empty
sequence as its unit, so a text may be encoded along any tree. Decoding
concatenates up the same tree.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import in_slices, in_small_batches, keyed_text, lean, table
from tidelog.llm.merging import merge

#: So many different matches of the pattern, and pairs of tokens, are remembered in each task.
REMEMBERED = 300_000
#: Up to so many bytes, a scan finds the lowest pair sooner than a heap.
SHORT, NEVER = 24, 1 << 32


class TreeCoder:
    """Encodes and decodes under one rank file and one splitting pattern."""

    def __init__(self, rank_file: str, pattern: str) -> None:
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.bytes = [bytes((b,)) for b in range(256)]
        self.find = regex.compile(pattern).findall
        self.pairs: dict[int, list[int] | None] = {}
        self.known: dict[str, bytes] = {}

    def window(self, data: bytes) -> list[int]:
        """The encoding of a run of bytes by merging; short ones need no heap."""
        own, ranks = [self.bytes[b] for b in data], self.ranks
        if len(own) > SHORT:
            return [ranks[s] for s in merge(own, ranks)]
        waiting = [ranks.get(data[i : i + 2], NEVER) for i in range(len(own) - 1)]
        while waiting and (lowest := min(waiting)) != NEVER:
            i = waiting.index(lowest)
            own[i : i + 2] = [own[i] + own[i + 1]]
            del waiting[i]
            if i < len(waiting):
                waiting[i] = ranks.get(own[i] + own[i + 1], NEVER)
            if i:
                waiting[i - 1] = ranks.get(own[i - 1] + own[i], NEVER)
        return [ranks[s] for s in own]

    def pair(self, left: int, right: int) -> list[int] | None:
        """The encoding of two tokens side by side; None if it is themselves."""
        key = left << 32 | right
        if key in self.pairs:
            return self.pairs[key]
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        found = self.window(self.tokens[left] + self.tokens[right])
        self.pairs[key] = found = None if found == [left, right] else found
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both."""
        if not left or not right or (inner := self.pair(left[-1], right[0])) is None:
            return left + right
        reach = 1
        while True:
            outer_left, outer_right = left[:-reach], right[reach:]
            if (not outer_left or self.pair(outer_left[-1], inner[0]) is None) and (not outer_right or self.pair(inner[-1], outer_right[0]) is None):
                return outer_left + inner + outer_right
            reach *= 2
            inner = self.window(self.decode(left[-reach:] + right[:reach]))

    def encode(self, data: bytes) -> list[int]:
        """Token ids of one match of the pattern; leaves are tokens."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        if not data:
            return []
        middle = len(data) // 2
        return self.join(self.encode(data[:middle]), self.encode(data[middle:]))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of a sequence of ids."""
        return b"".join(map(self.tokens.__getitem__, ids))

    def forget(self) -> None:
        """Give back what is remembered; a worker lives on after its task."""
        self.known.clear()
        self.pairs.clear()

    def text(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        known = self.known
        out = []
        for match in self.find(text):
            packed = known.get(match)
            if packed is None:
                ids = self.encode(match.encode())
                packed = struct.pack(f"<{len(ids)}I", *ids)
                if len(match) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[match] = packed
            out.append(packed)
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def checked(rank_file: str) -> str:
    """The rank file, if every token encodes to itself; the tree takes a part that is a token for its encoding.

    Looked at once, on the driver.
    """
    tree = TreeCoder(rank_file, "")
    if any(tree.window(token) != [rank] for token, rank in tree.ranks.items()):
        raise ValueError(f"{rank_file} has a token that merging doesn't lead to")
    return rank_file


@functools.lru_cache(maxsize=2)
def coder(rank_file: str, pattern: str) -> TreeCoder:
    """One coder per worker process, file and pattern."""
    return TreeCoder(rank_file, pattern)


def encode_texts(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, ids`: the token ids of each text, packed as little-endian u32.

    A null or empty text has no ids. Special strings are ordinary text. Texts
    are encoded whole, repeated rows each; other columns are ignored. The rank
    file must be on every executor.
    """
    checked(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = coder(rank_file, pattern)
        for batch in (part for whole in batches for part in in_slices(whole, 1)):
            packed = [tree.text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "ids"])
        tree.forget()

    return in_small_batches(keyed_text(df, id_col, text_col)).mapInArrow(lean(run), "id long, ids binary")


def decode_ids(df: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """`id, ids, decoded` of packed ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = coder(rank_file, pattern)
        for batch in (part for whole in batches for part in in_slices(whole, 1)):
            decoded = [tree.decode(np.frombuffer(p or b"", dtype="<u4").tolist()) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], ["id", "ids", "decoded"])

    return in_small_batches(df.select("id", "ids")).mapInArrow(lean(run), "id long, ids binary, decoded binary")


def encode_and_decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, ids, decoded`: as `encode_texts` and then `decode_ids`, in one pass with one coder a worker."""
    checked(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = coder(rank_file, pattern)
        for batch in (part for whole in batches for part in in_slices(whole, 1)):
            packed = [tree.text(t) for t in batch.column(1).to_pylist()]
            decoded = [tree.decode(np.frombuffer(p, dtype="<u4").tolist()) for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())], ["id", "ids", "decoded"])
        tree.forget()

    return in_small_batches(keyed_text(df, id_col, text_col)).mapInArrow(lean(run), "id long, ids binary, decoded binary")


def digest_round_trip(df: DataFrame) -> DataFrame:
    """`id, n_tokens, ids_sha256, decoded_sha256` of `id, ids, decoded`."""
    return df.selectExpr("id", "cast(octet_length(ids) div 4 as long) AS n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256")


def round_trip(df: DataFrame) -> DataFrame:
    """Encode and decode every text of `doc_id, text` and digest both ways."""
    import public_tokenizers

    rank_file, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return digest_round_trip(encode_and_decode(df, rank_file, pattern)).withColumnRenamed("id", "doc_id")


def op9_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents` encoded and decoded."""
    return round_trip(table(spark, sf_dir, "documents"))
