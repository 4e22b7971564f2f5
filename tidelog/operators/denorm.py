"""Derived columns as of each event: what a link's target knew, and what its children were."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Columns per fact table, distinct values of a copied category, and of a counted one.
MOST_COLUMNS, MOST_COPIED, MOST_COUNTED, LONGEST_LABEL = 16, 64, 16, 64
#: Columns that a parent gets from its children.
MOST_CHILD_COLUMNS = 32


def fk_target_columns(events: DataFrame, fkey: str, target: DataFrame, pkey: str, columns: list[str], slot: str, timed: bool, cutoff: int | None = None) -> DataFrame:
    """Events with the target's columns as `slot__column`.

    A dimension target is always visible; a fact target only if it is no later
    than the event and than the cutoff.
    """
    right = target.select(F.col(pkey).alias("_key"), *([F.col("t").alias("_t")] if timed else []), *[F.col(c).alias(f"{slot}__{c}") for c in columns])
    condition = events[fkey] == F.col("_key")
    if timed:
        condition = condition & (F.col("_t") <= events["t"])
        if cutoff is not None:
            right = right.filter(F.col("_t") <= cutoff)
    return events.join(right, condition, "left").drop("_key", "_t")


def budgeted_selection(stats: DataFrame, most: int = MOST_COLUMNS) -> DataFrame:
    """The chosen columns of `slot, slot_no, column_name, place, kind, n_distinct`, round-robin over slots.

    Numeric columns are viable, and categories of at most 64 values; the first
    of each slot come first, then the second ones.
    """
    viable = stats.filter((F.col("kind") == "numeric") | ((F.col("kind") == "vocab") & (F.col("n_distinct") <= MOST_COPIED)))
    depth = F.row_number().over(W.partitionBy("slot").orderBy("place"))
    chosen = F.row_number().over(W.orderBy("depth", "slot_no"))
    return viable.withColumn("depth", depth).withColumn("chosen", chosen).filter(F.col("chosen") <= most)


def visible_children(parents: DataFrame, pkey: str, children: DataFrame, fkey: str, timed: bool) -> DataFrame:
    """`parent_id` and the children that are no later than their parent; timeless ones always count."""
    right = parents.select(F.col(pkey).alias("parent_id"), F.col("t").alias("parent_t"))
    joined = children.join(right, F.col(fkey) == F.col("parent_id"))
    return joined.filter("t <= parent_t") if timed else joined


def child_aggregates(parents: DataFrame, pkey: str, visible: DataFrame, sums: list[str], categories: dict[str, list[str]]) -> DataFrame:
    """Every parent with `n_children`, `<col>_sum` and `<col>_<value>_n`, 0 where it has none."""
    aggregates = [F.count("*").alias("n_children")]
    aggregates += [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"{c}_sum") for c in sums]
    aggregates += [F.count_if(F.col(c) == v).alias(f"{c}_{v}_n") for c, values in categories.items() for v in values]
    counted = visible.groupBy("parent_id").agg(*aggregates)
    names = [c for c in counted.columns if c != "parent_id"]
    keys = parents.select(F.col(pkey).alias("parent_id"))
    return keys.join(counted, "parent_id", "left").select("parent_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def budgeted_children(kinds: DataFrame, values: DataFrame, most: int = MOST_CHILD_COLUMNS) -> DataFrame:
    """`chosen, child, column_name, value` of the columns that a parent gets from its children, at most `most`.

    First the count of every child (`column_name` null), then sums, then one
    column per value of a category, so that many children share the budget.
    `kinds` has `child_no, child, place, column_name, kind`, `values` has
    `child, column_name, value`. There is a row per column, not per row.
    """
    children = kinds.select("child_no", "child").distinct().select(F.lit(0).alias("round"), "child_no", "child", F.lit(0).alias("place"), F.lit(None).cast("string").alias("column_name"), F.lit(None).cast("string").alias("value"))
    sums = kinds.filter("kind = 'sum'").select(F.lit(1).alias("round"), "child_no", "child", "place", "column_name", F.lit(None).cast("string").alias("value"))
    counted = kinds.filter("kind = 'category'").join(values.select("child", "column_name", "value").distinct(), ["child", "column_name"]).select(F.lit(2).alias("round"), "child_no", "child", "place", "column_name", "value")
    chosen = F.row_number().over(W.orderBy("round", "child_no", "place", "value")) - 1
    return children.unionByName(sums).unionByName(counted).withColumn("chosen", chosen).filter(F.col("chosen") < most).select("chosen", "child", "column_name", "value")


def child_column_kinds(values: DataFrame, numbers: list[str]) -> DataFrame:
    """`column_name, n_distinct, longest, kind` of melted child columns.

    A number with over 20 distinct values is summed; 1 to 16 distinct labels of
    at most 64 characters are counted each; the rest is left out.
    """
    per_value = values.filter("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    stats = per_value.groupBy("column_name").agg(F.count("*").alias("n_distinct"), F.max(F.length("value")).alias("longest"))
    kind = (
        F.when(F.col("column_name").isin(numbers) & (F.col("n_distinct") > 20), "sum")
        .when(F.col("n_distinct").between(1, MOST_COUNTED) & (F.col("longest") <= LONGEST_LABEL), "category")
        .otherwise("drop")
    )
    return stats.withColumn("kind", kind)
