"""Quality rules: repetition coverage.

Words become 64-bit hashes; a rolling sum of products over them hashes every
n-word window of a text in one numpy pass per length. The characters inside windows
that occur more than once, and inside repeated lines, are measured against all
characters of the text's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import WORD, in_slices, in_small_batches, keyed_text, lean, table

#: The most that n-word windows found more than once may cover,
#: as parts of the characters in words.
MOST_COVERED = {5: 0.35, 6: 0.34, 7: 0.33, 8: 0.32, 9: 0.31, 10: 0.30}
#: The most that repeated lines may cover, by characters.
MOST_LINE_CHARS = 0.30
FEWEST_WORDS = 20
BASE_WINDOW, BASE_PERCENT = 8, 30

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Odd multipliers of the rolling product: 5 ** (2 k + 1) modulo 2 ** 64.
_POWERS = np.array([pow(5, 2 * k + 1, 1 << 64) for k in range(max(MOST_COVERED))], dtype=np.uint64)


def rolled_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every window of n words."""
    windows = max(0, len(hashes) - n + 1)
    rolled = np.zeros(windows, dtype=np.uint64)
    for k in range(n):
        rolled += hashes[k : k + windows] * _POWERS[k]
    return rolled


def covered_words(hashes: np.ndarray, n: int) -> np.ndarray | None:
    """True for words inside n-word windows found at least twice; None: no such window."""
    rolled = rolled_hashes(hashes, n)
    ordered = np.sort(rolled)
    if not (ordered[1:] == ordered[:-1]).any():
        return None
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    step = np.zeros(len(hashes) + 1, dtype=np.int64)
    twice = np.zeros(len(rolled), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    step[starts] += 1
    step[starts + n] -= 1
    return np.cumsum(step[:-1]) > 0


def measure(text: str) -> dict:
    """All measures of one text, and both verdicts."""
    raw = text.encode()
    words = raw.split()  # bytes split on exactly the six white space bytes
    chars = len(text) - (len(raw) - sum(map(len, words)))
    seen: set[str] = set()
    dup_lines = dup_line_chars = 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            if line in seen:
                dup_lines += 1
                dup_line_chars += len(line)
            seen.add(line)
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    hashes = (hashes ^ (hashes >> np.uint64(31))) * _POWERS[-1]
    parts = dict.fromkeys(MOST_COVERED, 0.0)
    repeat_words = 0
    lengths = None
    for n in sorted(MOST_COVERED):
        inside = covered_words(hashes, n)
        if inside is None:  # then no longer window occurs twice either
            break
        if lengths is None:
            lengths = np.fromiter((len(w.decode()) for w in words), dtype=np.int64, count=len(words))
        parts[n] = float(lengths[inside].sum()) / chars
        if n == BASE_WINDOW:
            repeat_words = int(inside.sum())
    base_failed = len(words) < FEWEST_WORDS or 100 * repeat_words > BASE_PERCENT * len(words)
    line_part = dup_line_chars / len(text) if text else 0.0
    repetitive = line_part > MOST_LINE_CHARS or any(parts[n] > most for n, most in MOST_COVERED.items())
    return {
        "n_words": len(words),
        "word_chars": chars,
        "n_symbols": sum(map(text.count, _SYMBOLS)),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words,
        "base_failed": base_failed,
        "kept": not base_failed and not repetitive,
        "dup_line_part": line_part,
        "covered_parts": [parts[n] for n in sorted(parts)],
    }


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = (
    "id long, " + ", ".join(f"{c} long" for c in _LONGS) + ", base_failed boolean, kept boolean, "
    "dup_line_part double, covered_parts array<double>, text string"
)


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row of measures per input row, `text` null unless asked for.

    A null or empty text has no words, so it fails the base rule. Repeated rows
    are measured each. Other columns are ignored. A text is measured whole;
    memory goes with the longest text, not with their number.
    """
    schema = pa.schema(
        [("id", pa.int64()), *((c, pa.int64()) for c in _LONGS), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("dup_line_part", pa.float64()), ("covered_parts", pa.list_(pa.float64())), ("text", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, 1):
                both = zip(*(c.to_pylist() for c in part.columns), strict=True)
                rows = [{"id": i, **measure(t), "text": t if with_text else None} for i, t in both]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return in_small_batches(keyed_text(df, id_col, text_col)).mapInArrow(lean(run), MEASURED)


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of `documents` that the rules keep, with all their columns."""
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.get_field_index("text")
            for part in in_slices(batch, column):
                yield part.filter(pa.array([measure(t or "")["kept"] for t in part.column(column).to_pylist()], pa.bool_()))

    return in_small_batches(docs).mapInArrow(lean(run), fields)


def op5_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdicts for every row of `documents`."""
    return quality_rules(table(spark, sf_dir, "documents")).drop("text").withColumnRenamed("id", "doc_id")


_COVERED = ", ".join(f"CAST(coalesce(max(part) FILTER (n = {n}), 0.0) AS DOUBLE)" for n in MOST_COVERED)
_TOO_MUCH = " OR ".join(f"coalesce(max(part) FILTER (n = {n}), 0.0) > {most}" for n, most in MOST_COVERED.items())

#: From the definitions: windows as strings, and the words that lie in repeated ones.
OP5_SQL = rf"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), t AS (
    SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d
), chars AS (
    SELECT doc_id, CAST(sum(length(word)) AS BIGINT) AS word_chars FROM t GROUP BY doc_id
), leads AS (
    SELECT doc_id, pos, {", ".join(f"lead(word, {k}) OVER (PARTITION BY doc_id ORDER BY pos) AS w{k}" for k in range(max(MOST_COVERED)))} FROM t
), windows AS (
    {" UNION ALL ".join(f"SELECT doc_id, {n} AS n, pos, concat_ws(' ', {', '.join(f'w{k}' for k in range(n))}) AS g FROM leads WHERE w{n - 1} IS NOT NULL" for n in MOST_COVERED)}
), twice AS (
    SELECT doc_id, n, pos FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, n, g) > 1
), inside AS (
    SELECT DISTINCT doc_id, n, unnest(range(pos, pos + n)) AS pos FROM twice
), covered AS (
    SELECT doc_id, n, count(*) AS words, CAST(sum(length(word)) AS DOUBLE) / any_value(word_chars) AS part FROM inside JOIN t USING (doc_id, pos) JOIN chars USING (doc_id) GROUP BY doc_id, n
), lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d
), again AS (
    SELECT doc_id, line FROM lines WHERE regexp_matches(line, '{WORD}') QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1
), dup AS (
    SELECT doc_id, count(*) AS n_dup_lines, sum(length(line)) AS dup_chars FROM again GROUP BY doc_id
), parts AS (
    SELECT doc_id, CAST(coalesce(max(words) FILTER (n = {BASE_WINDOW}), 0) AS BIGINT) AS n_repeat_words, [{_COVERED}] AS covered_parts, {_TOO_MUCH} AS too_much FROM covered GROUP BY doc_id
), m AS (
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(too_much, false) AS too_much,
           CASE WHEN length(text) > 0 THEN coalesce(dup_chars, 0) / CAST(length(text) AS DOUBLE) ELSE 0.0::DOUBLE END AS dup_line_part,
           coalesce(covered_parts, [{", ".join(["0.0::DOUBLE"] * len(MOST_COVERED))}]) AS covered_parts
    FROM d LEFT JOIN chars USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN parts USING (doc_id)
), b AS (
    SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR too_much OR dup_line_part > {MOST_LINE_CHARS}) AS kept,
       dup_line_part, covered_parts
FROM b
"""
