"""Helpers shared by the corpus operators: reading, typing and lineage cuts."""

from __future__ import annotations

import atexit
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.sinks import shared_folder

#: White space between words: space and the ASCII controls 9 to 13.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (long) and the text (null: empty), as `id` and `text`.

    Selecting first means that any other input column, whatever its name,
    neither clashes with a result column nor reaches a shuffle.
    """
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


#: Texts of so many bytes are looked at together inside a task.
SLICE_BYTES = 2 << 20


def in_slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts take about `most` bytes, or single rows where one takes more."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end
    pa.default_memory_pool().release_unused()  # a worker lives on after its task


#: What limits the bytes that Spark hands to a Python task at once; by itself Spark goes by rows, 10,000 of any length.
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same frame, in a session that hands its rows to Python tasks in batches of about SLICE_BYTES.

    A batch is held by the executor and by the Python worker. The limit only
    deals the same rows out differently; one that the session already has stays.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_LIMIT, None) is None:
        conf.set(BATCH_LIMIT, str(SLICE_BYTES))
    return df


@functools.cache
def _trim() -> Callable[[int], int] | None:
    """The C library's own way to give back free memory, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of a task's batches, which gives free memory back when its last batch is gone.

    A worker lives on after its task, and with it what its allocators keep.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := _trim():
            trim(0)

    return task


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Bits of the filter that tells rows that a list of keys can't concern.
FILTER_BITS = 1 << 24
#: Bits of one bitmap, as Spark's own function makes them.
BUCKET_BITS = 1 << 15


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS with a bit for each 64-bit hash in the only column, in words of 32, put together by Spark."""
    bit = F.pmod(F.col(hashes.columns[0]), F.lit(FILTER_BITS))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 32).cast("int"))
    words = hashes.select(F.floor(bit / 32).alias("word"), one.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def split_by_keys(frame: DataFrame, key_hash: Column, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key hash may be among `hashes`, and rows where it is not.

    Only the former have to be dealt out to be joined. The filter is at most
    512 bitmaps of 4 kB, whatever the number of keys, so that it can be
    broadcast; where it is full, all rows are among the former.
    """
    name = hashes.columns[0]
    low = F.lit(BUCKET_BITS - 1)
    place = lambda h: F.pmod(h, F.lit(FILTER_BITS))
    keyed = hashes.select(F.shiftright(place(F.col(name)), BUCKET_BITS.bit_length() - 1).alias("bucket"), place(F.col(name)).bitwiseAND(low).alias("bit"))
    held = keyed.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bit = place(key_hash).bitwiseAND(low)
    byte = F.conv(F.hex(F.substring(held["bits"], F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    both = frame.join(F.broadcast(held), F.shiftright(place(key_hash), BUCKET_BITS.bit_length() - 1) == held["bucket"], "left")
    own = [frame[f"`{c}`"] for c in frame.columns]
    return both.filter(hit).select(*own), both.filter(~hit).select(*own)


#: Lets Spark delete a query's shuffle files when it ends; by itself it waits until the driver happens to collect its garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Later stages start from the written table, so a lost executor costs only
    its own tasks. The table goes when the driver's session ends, the files
    that were shuffled for it at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended before
            return
