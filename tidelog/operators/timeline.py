"""Counts around query times: the timeline sweep and the join form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.exprs import DAY

#: Seconds of an entity's time that are sorted together.
SPAN = 30 * DAY


def sweep(events: DataFrame, marks: DataFrame, measures: dict[str, Column], inclusive: bool = False) -> DataFrame:
    """Running sums at each mark: `marks` plus one column per measure.

    `events` has `entity_id, t`, `marks` has `entity_id, mark_t` and columns of
    its own. Both are sorted once per entity and SPAN, and a mark reads the sums
    of the events before it: those of earlier spans, which are summed up first,
    and those inside its own. So an entity with very many events is spread over
    many tasks. An event at the very second of a mark counts if inclusive. No
    event meets a mark in a join, so the cost is one sort however many marks
    there are. Measures must be whole numbers or exact decimals.
    """
    extra = [c for c in marks.columns if c not in ("entity_id", "mark_t")]
    rank = F.lit(1 if inclusive else -1)
    rows = events.select("entity_id", F.col("t").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(marks.select(F.struct(*extra)).schema[0].dataType).alias("own"), *[m.alias(n) for n, m in measures.items()])
    points = marks.select("entity_id", F.col("mark_t").alias("at"), rank.alias("kind"), F.struct(*extra).alias("own"), *[F.lit(0).alias(n) for n in measures])
    run = rows.unionByName(points).withColumn("span", F.floor(F.col("at") / SPAN))
    sums = run.groupBy("entity_id", "span").agg(*[F.sum(n).alias(f"before_{n}") for n in measures])
    earlier = W.partitionBy("entity_id").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("entity_id", "span", *[F.coalesce(F.sum(f"before_{n}").over(earlier), F.lit(0)).alias(f"before_{n}") for n in measures])
    so_far = W.partitionBy("entity_id", "span").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = run.withColumns({n: F.coalesce(F.sum(n).over(so_far), F.lit(0)) for n in measures}).filter("kind <> 0")
    total = [(F.col(n) + F.col(f"before_{n}")).alias(n) for n in measures]
    return inside.join(starts, ["entity_id", "span"]).select("entity_id", F.col("at").alias("mark_t"), "own.*", *total)


def window_sums(events: DataFrame, queries: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """For each query the measures over (t_q, t_q + horizon_s], zeros kept, by sweep.

    `queries` has `query_id, entity_id, t_q, horizon_s`.
    """
    ends = F.array(F.struct(F.lit(-1).alias("sign"), F.col("t_q").alias("mark_t")), F.struct(F.lit(1).alias("sign"), (F.col("t_q") + F.col("horizon_s")).alias("mark_t")))
    marks = queries.select("query_id", "entity_id", F.inline(ends))
    swept = sweep(events, marks, measures, inclusive=True)
    return swept.groupBy("query_id", "entity_id").agg(*[F.sum(F.col("sign") * F.col(n)).cast("long").alias(n) for n in measures])


def around(queries: DataFrame, events: DataFrame, condition: Column) -> DataFrame:
    """Each query with the events of its entity that satisfy the condition; queries without stay."""
    return queries.join(events, (queries["entity_id"] == events["entity_id"]) & condition, "left").drop(events["entity_id"])
