"""Sinks: published corpora, keyed predictions, submissions and metric rows."""

from __future__ import annotations

import atexit
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest"
#: Rows of a task of a packed frame.
PACKED_ROWS = 100_000
#: Lets Spark delete a query's shuffle files when it ends; by itself it waits until the driver happens to collect its garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor share.

    A cluster names it in spark.checkpoint.dir. Only a local session, where
    that may be unset, gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


@contextmanager
def files_go(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete what they have shuffled when they end."""
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, before)


_temporary: list[tuple[SparkSession, str]] = []
#: The tables written so far by what `settled` is building.
_steps: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("steps", default=None)


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read back, so that what follows starts from there.

    The table goes with the session, the files that were shuffled for it at once.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _temporary.append((spark, path))
    if (steps := _steps.get()) is not None:
        steps.append((spark, path))
    with files_go(spark):
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `build` makes, written; the tables that were written on the way go at once."""
    outer, steps = _steps.get(), []
    token = _steps.set(steps)
    try:
        held = written(build(), name)
        if outer is not None:
            outer.append(steps[-1])
        steps.pop()
    finally:
        _steps.reset(token)
        for spark, path in steps:
            store, at = _store(spark, path)
            store.delete(at, True)
            _temporary.remove((spark, path))
    return held


def packed(frame: DataFrame, name: str) -> DataFrame:
    """As `written`, in tasks of PACKED_ROWS rows, for what many short passes read: each task of each pass reports to the driver."""
    held = written(frame, name)
    return held.coalesce(max(1, -(-held.count() // PACKED_ROWS)))


@atexit.register
def _drop_temporary() -> None:
    for spark, path in _temporary:
        try:
            store, at = _store(spark, path)
            store.delete(at, True)
        except Exception:  # the session may have ended before
            return


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def data_version(spark: SparkSession, paths: list[str]) -> str:
    """A digest of sizes, numbers of files and times of change, so that changed data isn't taken for old."""
    known = []
    for path in sorted(paths):
        store, at = _store(spark, path)
        held = store.getContentSummary(at)
        known.append([path, held.getLength(), held.getFileCount(), store.getFileStatus(at).getModificationTime()])
    return hashlib.sha256(json.dumps(known).encode()).hexdigest()[:12]


def corpus_name(dataset: str, cutoff: int, self_rows: bool = False, denorm_fk: bool = False, child_aggs: bool = False, path_expand: tuple[str, ...] = (), version: str = "") -> str:
    """A folder name that holds all that a corpus depends on; the order of paths doesn't matter.

    Equal arguments give equal names in every process, so one process finds
    what another has published.
    """
    flags = json.dumps({"self_rows": self_rows, "denorm_fk": denorm_fk, "child_aggs": child_aggs, "path_expand": sorted(path_expand), "version": version}, sort_keys=True)
    return f"{dataset}-{cutoff}-{hashlib.sha256(flags.encode()).hexdigest()[:12]}"


def _there(spark: SparkSession, path: str) -> bool:
    store, at = _store(spark, path)
    return store.exists(at)


def _moved(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder; False, and nothing done, if the target is there already."""
    jvm = spark.sparkContext._jvm
    store, at = _store(spark, source)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    try:
        files.rename(at, _store(spark, target)[1], how)
    except Py4JJavaError as refused:
        if "FileAlreadyExists" in str(refused.java_exception) or _there(spark, target):
            return False
        raise
    return True


def materialize_corpus(spark: SparkSession, root: str, name: str, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The named corpus: read if it has been published, else built.

    A build goes to a folder of its own beside it, with a manifest of its
    parts, and is published by one rename. So nobody sees half a corpus, a
    build that is killed leaves the name free, and of two builders that race
    the one that comes second reads what the first has published. A published
    folder must hold the parts that are asked for.
    """
    folder = f"{root}/{name}"
    if not _there(spark, folder):
        staged = f"{root}/.staged-{name}-{uuid.uuid4().hex}"
        try:
            for part, frame in frames.items():
                frame.write.parquet(f"{staged}/{part}")
            listed = spark.range(1).select(F.explode(F.array(*map(F.lit, sorted(frames)))).alias("part"))
            listed.coalesce(1).write.parquet(f"{staged}/{MANIFEST}")
            _moved(spark, staged, folder)
        finally:
            store, at = _store(spark, staged)
            store.delete(at, True)
    held = {r["part"] for r in spark.read.parquet(f"{folder}/{MANIFEST}").collect()}
    if missing := sorted(frames.keys() - held):
        raise ValueError(f"{name} was published without {missing}")
    return {part: spark.read.parquet(f"{folder}/{part}") for part in frames}


def write_keyed_predictions(predictions: DataFrame, path: str, keys: list[str]) -> None:
    """Predictions with their keys; a null or repeated key is an error, and nothing is published then.

    They are computed once, into a folder beside `path`, and checked there. An
    older table is put aside and dropped only when the new one is in its
    place, so a crash leaves one of the two; the next write brings a table that
    was left aside back first.
    """
    spark = predictions.sparkSession
    aside = f"{path}-aside"
    if _there(spark, aside):
        _moved(spark, aside, path)  # unless the new one had arrived
    beside = f"{path}-{uuid.uuid4().hex}"
    store, at = _store(spark, beside)
    try:
        predictions.write.parquet(beside)
        null_key = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
        wrong = spark.read.parquet(beside).groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | null_key)
        if wrong.limit(1).count():
            raise ValueError("predictions need distinct keys that aren't null")
        store.delete(_store(spark, aside)[1], True)
        if _there(spark, path):
            _moved(spark, path, aside)
        _moved(spark, beside, path)
        store.delete(_store(spark, aside)[1], True)
    finally:
        store.delete(at, True)


def assemble_submission(official: DataFrame, predictions: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Official keys with their predictions.

    Keys without a prediction, and predictions without a key, fail the job.
    """
    joined = official.select(keys).join(predictions.select(*keys, F.col(column).alias("pred")).withColumn("_found", F.lit(True)), keys, "full")
    known = official.select(keys).withColumn("_asked", F.lit(True))
    both = joined.join(known, keys, "left")
    right = F.col("_found").isNotNull() & F.col("_asked").isNotNull()
    return both.select(*keys, F.when(right, F.col("pred")).otherwise(F.raise_error(F.lit("submission keys and predictions differ")).cast("double")).alias("pred"))


def metric_rows(results: DataFrame, dataset: str, task: str, split: str, model: str) -> DataFrame:
    """`dataset, task, split, model, metric, value`: one row per column of a one-row result."""
    if split not in ("train", "val", "test"):
        raise ValueError(f"unknown split {split}")
    each = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in results.columns])
    return results.select(F.inline(each)).select(F.lit(dataset).alias("dataset"), F.lit(task).alias("task"), F.lit(split).alias("split"), F.lit(model).alias("model"), "metric", "value")
