"""Sources: databases of parquet tables and profiles of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.exprs import seconds
from tidelog.spec import DatabaseSpec


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_database(spark: SparkSession, folder: str, spec: DatabaseSpec) -> dict[str, DataFrame]:
    """All tables of a database; facts get their time in seconds as `t`."""
    tables = {}
    for table in spec.tables:
        frame = read_table(spark, folder, table.name)
        tables[table.name] = frame.withColumn("t", seconds(F.col(table.time_col))) if table.is_fact else frame
    return tables


def profile(spec: DatabaseSpec, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: kind, index, rows, time range, duplicate keys, null and dangling links."""
    rows = []
    entities = {e.name for e in spec.entities}
    for table in spec.tables:
        frame = tables[table.name]
        time = [F.min("t"), F.max("t")] if table.is_fact else [F.lit(None).cast("long")] * 2
        nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in table.fkeys], F.lit(0))
        doubles = F.count(table.pkey) - F.count_distinct(table.pkey) if table.pkey else F.lit(0)
        counts = frame.agg(F.count("*").alias("n_rows"), time[0].alias("min_t"), time[1].alias("max_t"), nulls.cast("long").alias("null_links"), doubles.cast("long").alias("duplicate_keys"))
        dangling = [
            frame.select(F.col(col).alias("k")).filter("k is not null").join(tables[to].select(F.col(spec[to].pkey).alias("k")), "k", "left_anti").agg(F.count("*").alias("d"))
            for col, to in table.fkeys.items()
        ]
        lost = reduce(DataFrame.unionAll, dangling).agg(F.sum("d").alias("dangling_links")) if dangling else counts.sparkSession.range(1).select(F.lit(0).cast("long").alias("dangling_links"))
        index = spec.table_idx(table.name) if table.is_fact else None
        rows.append(
            counts.crossJoin(lost).select(
                F.lit(table.name).alias("table_name"),
                F.lit("fact" if table.is_fact else "dimension").alias("kind"),
                F.lit(table.name in entities).alias("is_entity"),
                F.lit(index).cast("int").alias("table_idx"),
                "n_rows", "min_t", "max_t", "null_links", "dangling_links", "duplicate_keys",
            )
        )
    return reduce(DataFrame.unionByName, rows)
