"""Schema inference: kinds of columns, statistics and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.ranges import running_before
from tidelog.spec import TableSpec

#: More distinct values make a number numeric, or a category hashed; a category
#: with over LOOSE_PART of its rows distinct is dropped instead.
NUMERIC_FROM, VOCAB_MOST, LOOSE_PART, BUCKETS = 20, 1024, 0.2, 1024
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def typed_columns(table: TableSpec, frame: DataFrame) -> dict[str, str]:
    """Columns that get a kind: not keys, links, times or nested values."""
    skip = {table.pkey, table.time_col, "t", *table.fkeys}
    return {c: kind for c, kind in frame.dtypes if c not in skip and (kind in (*NUMBERS, "string", "boolean"))}


def melted(table: TableSpec, frame: DataFrame, columns: list[str]) -> DataFrame:
    """`column_name, value` (as string) for each row and column, in one pass."""
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return frame.select(F.inline(each)).withColumn("table_name", F.lit(table.name))


def column_spec(table: TableSpec, frame: DataFrame) -> DataFrame:
    """`table_name, column_name, n_distinct, n_known, kind` by the typing rules.

    The frame must hold only rows up to the cutoff. Values are counted per
    (column, value) first, so no task holds all distinct values of a column.
    """
    columns = typed_columns(table, frame)
    numeric = F.col("column_name").isin([c for c, kind in columns.items() if kind in NUMBERS])
    values = melted(table, frame, list(columns)).groupBy("table_name", "column_name", "value").agg(F.count("*").alias("n"))
    counts = values.groupBy("table_name", "column_name").agg(F.count("value").alias("n_distinct"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("n_known"))
    many = F.col("n_distinct") > VOCAB_MOST
    kind = (
        F.when(numeric & (F.col("n_distinct") > NUMERIC_FROM), "numeric")
        .when(many & (F.col("n_distinct") > LOOSE_PART * F.col("n_known")), "drop")
        .when(many, "hashed")
        .otherwise("vocab")
    )
    return counts.withColumn("kind", kind)


def numeric_stats(table: TableSpec, frame: DataFrame, columns: list[str]) -> DataFrame:
    """`table_name, column_name, mean, std`: sample deviation, 1 where it is 0 or unknown."""
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns])
    stats = frame.select(F.inline(each)).groupBy("column_name").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    std = F.when(F.coalesce("std", F.lit(0.0)) == 0, 1.0).otherwise(F.col("std"))
    return stats.select(F.lit(table.name).alias("table_name"), "column_name", "mean", std.alias("std"))


def vocabulary(table: TableSpec, frame: DataFrame, columns: list[str]) -> DataFrame:
    """`table_name, column_name, value, code`: sorted values coded from 1; 0 stays for unknown."""
    values = melted(table, frame, columns).filter("value is not null").distinct()
    code = F.row_number().over(W.partitionBy("table_name", "column_name").orderBy("value"))
    return values.select("table_name", "column_name", "value", code.alias("code"))


def hash_category(value: Column) -> Column:
    """Bucket 1 to 1024 of a category, 0 for null; the same in every build."""
    return F.when(value.isNull(), 0).otherwise(F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int") + 1)


def entity_index(frame: DataFrame, pkey: str) -> DataFrame:
    """`pkey, row_index`: 0, 1, ... in the order of a numeric key."""
    keys = frame.select(pkey).distinct()
    return running_before(keys, pkey, F.lit(1).cast("long"), "row_index")


def vocab_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Values whose code differs between two vocabularies, or is in one only."""
    keys = ["table_name", "column_name", "value"]
    both = old.withColumnRenamed("code", "old_code").join(new.withColumnRenamed("code", "new_code"), keys, "full")
    return both.filter(~F.col("old_code").eqNullSafe(F.col("new_code")))
