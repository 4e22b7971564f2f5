"""Point-in-time features, one row per (entity, t_q, horizon).

Only events before t_q count; with `inclusive` those at t_q do too.
"""

from __future__ import annotations

from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.exprs import DAY, count_if, trailing, weekday
from tidelog.operators.timeline import sweep
from tidelog.spec import DatabaseSpec

#: Tiled past windows, and the last times that gaps are taken from.
MOST_WINDOWS, LAST_TIMES, MOST_SLOTS, NEIGHBOURS = 8, 512, 64, 4
#: Codes of a column that gets counters, and links whose neighbours are looked at.
CODES, MOST_NEIGHBOUR_SLOTS = (2, 16), 12


def _seen(inclusive: bool) -> Column:
    return (F.col("t") <= F.col("t_q")) if inclusive else (F.col("t") < F.col("t_q"))


def joined(queries: DataFrame, history: DataFrame, inclusive: bool = False) -> DataFrame:
    """Queries with their past events; a query without any keeps one row of nulls."""
    past = queries.select("query_id", "entity_id", "t_q", "horizon_s").join(history, "entity_id").filter(_seen(inclusive))
    return queries.join(past.drop("entity_id", "t_q", "horizon_s"), "query_id", "left")


def days_since(last: Column, now: Column) -> Column:
    """log1p of the days since a time, 0 if it never was."""
    return F.coalesce(F.log1p((now - last) / DAY), F.lit(0.0))


def table_counts(past: DataFrame, tables: dict[str, int], inclusive: bool = False) -> DataFrame:
    """Per fact table: log1p of all events, of days since the last, and of events in the trailing horizon; and the same globally."""
    exprs = []
    for name, idx in tables.items():
        own = F.col("table_idx") == idx
        exprs += [
            F.log1p(count_if(own)).alias(f"{name}_n"),
            days_since(F.max(F.when(own, F.col("t"))), F.col("t_q")).alias(f"{name}_since"),
            F.log1p(count_if(own & trailing(F.col("t"), F.col("t_q"), F.col("horizon_s"), inclusive))).alias(f"{name}_recent"),
        ]
    exprs += [F.log1p(F.count("t")).alias("all_n"), days_since(F.min("t"), F.col("t_q")).alias("all_first")]
    return past.groupBy("query_id", "t_q").agg(*exprs)


def swept_counts(queries: DataFrame, history: DataFrame, tables: dict[str, int]) -> DataFrame:
    """Plain counts before t_q, in [t_q - horizon + 1, t_q) and in (t_q, t_q + horizon], by one sweep for all queries.

    A hot entity with many query times costs a sort, not a join.
    """
    def at(kind: str, t: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind_of"), t.alias("mark_t"))

    t_q, horizon = F.col("t_q"), F.col("horizon_s")
    # a mark reads what is before it; +1 second turns "up to" into "before"
    marks = queries.select("query_id", "entity_id", F.inline(F.array(at("start", t_q - horizon + 1), at("now", t_q), at("after", t_q + 1), at("end", t_q + horizon + 1))))
    measures = {f"{n}_c": (F.col("table_idx") == i).cast("long") for n, i in tables.items()}
    swept = sweep(history, marks, measures)
    out = []
    for n in tables:
        read = {k: F.sum(F.when(F.col("kind_of") == k, F.col(f"{n}_c"))) for k in ("start", "now", "after", "end")}
        out += [read["now"].alias(f"{n}_n"), (read["now"] - read["start"]).alias(f"{n}_recent"), (read["end"] - read["after"]).alias(f"{n}_next")]
    return swept.groupBy("query_id").agg(*out)


def category_counts(past: DataFrame, column: str, values: list[str], recent: bool = False, inclusive: bool = False) -> DataFrame:
    """log1p counts per value of a category over a fixed layout, all time or over the trailing horizon."""
    if len(values) > MOST_SLOTS:
        raise ValueError(f"a layout has at most {MOST_SLOTS} slots")
    within = trailing(F.col("t"), F.col("t_q"), F.col("horizon_s"), inclusive) if recent else F.lit(True)
    return past.groupBy("query_id").agg(*[F.log1p(count_if((F.col(column) == v) & within)).alias(f"{column}_{v}") for v in values])


def dynamics(past: DataFrame) -> DataFrame:
    """Regularity over up to 8 tiled past windows (t_q - (i + 1) D, t_q - i D].

    log1p of the largest count, shares of windows with at least one and two
    events, log1p of the mean count, its population deviation over it, log1p of
    the median gap in days, how overdue the next event is, and the trend from
    the earlier windows to the last. All 0 without events.
    """
    back = F.floor((F.col("t_q") - F.col("t")) / F.col("horizon_s"))
    known = past.filter("t is not null")
    recency = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("t"), F.desc("row_key")))
    gap = F.lag("t").over(W.partitionBy("query_id").orderBy("t", "row_key"))
    timed = known.withColumn("recency", recency).withColumn("gap", F.when(F.col("recency") < LAST_TIMES, F.col("t") - gap))
    whole = timed.groupBy("query_id").agg(
        F.greatest(F.lit(1), F.least(F.lit(MOST_WINDOWS), F.ceil((F.max("t_q") - F.min("t")) / F.max("horizon_s")))).cast("int").alias("n_windows"),
        F.percentile("gap", F.lit(0.5)).alias("gap"),
        F.max("t").alias("last"),
        F.max("t_q").alias("now"),
    )
    counts = known.withColumn("i", back).filter(F.col("i") < MOST_WINDOWS).groupBy("query_id", "i").agg(F.count("*").alias("n"))
    tiles = whole.select("query_id", "n_windows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_windows").cast("long") - 1)).alias("i"))
    filled = tiles.join(counts, ["query_id", "i"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mean, earlier = F.avg("n"), F.avg(F.when(F.col("i") > 0, F.col("n")))
    stats = filled.groupBy("query_id").agg(
        F.log1p(F.max("n")).alias("dyn_max"),
        F.avg((F.col("n") >= 1).cast("double")).alias("dyn_one"),
        F.avg((F.col("n") >= 2).cast("double")).alias("dyn_two"),
        F.log1p(mean).alias("dyn_mean"),
        F.coalesce(F.try_divide(F.stddev_pop("n"), mean), F.lit(0.0)).alias("dyn_spread"),
        F.coalesce(F.log1p(F.max(F.when(F.col("i") == 0, F.col("n")))) - F.log1p(earlier), F.lit(0.0)).alias("dyn_trend"),
    )
    elapsed = F.col("now") - F.col("last")
    gaps = whole.select(
        "query_id",
        F.coalesce(F.log1p(F.col("gap") / DAY), F.lit(0.0)).alias("dyn_gap"),
        F.when(F.col("gap").isNull(), F.log1p(elapsed / DAY)).otherwise(F.log1p(elapsed / (F.col("gap") + DAY))).alias("dyn_overdue"),
    )
    names = ["dyn_max", "dyn_one", "dyn_two", "dyn_mean", "dyn_spread", "dyn_trend", "dyn_gap", "dyn_overdue"]
    done = stats.join(gaps, "query_id")
    return past.select("query_id").distinct().join(done, "query_id", "left").select("query_id", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def gap_globals(past: DataFrame) -> DataFrame:
    """Deviation of log1p gaps in days, and the share of events on t_q's weekday."""
    gap = F.log1p((F.col("t") - F.lag("t").over(W.partitionBy("query_id").orderBy("t", "row_key"))) / DAY)
    same = (weekday(F.col("t")) == weekday(F.col("t_q"))).cast("double")
    return past.withColumn("gap", gap).groupBy("query_id").agg(F.coalesce(F.stddev_pop("gap"), F.lit(0.0)).alias("gap_std"), F.coalesce(F.avg(same), F.lit(0.0)).alias("weekday_share"))


def neighbour_layout(spec: DatabaseSpec, entity: str, most: int = MOST_NEIGHBOUR_SLOTS) -> list[tuple[str, str, str]]:
    """(table, column, target) of the links that an entity's facts hold beside the one to itself, the first of each table first."""
    facts = [t for t, _ in spec.slots(entity)]
    by_table = [[(t.name, c, to) for c, to in t.fkeys.items() if to != entity] for t in {f.name: f for f in facts}.values()]
    return [slot for turn in zip_longest(*by_table) for slot in turn if slot][:most]


def category_layout(cards: DataFrame, most: int = MOST_SLOTS, kept: list[str] | None = None) -> DataFrame:
    """`slot, table_name, column_name, codes` of the columns that get counters, `slot` being a column's first.

    `cards` has `table_no, table_name, place, column_name, codes`. Columns of 2
    to 16 codes count, the first of each table first; one that doesn't fit
    into what is left of `most` slots is passed over. Columns of an earlier
    layout, named table.column in `kept`, keep their places in front, so widths
    only grow. There is a row per column of the schema, not of the data.
    """
    name = F.concat_ws(".", "table_name", "column_name")
    earlier = F.array_position(F.array(*[F.lit(k) for k in kept or []]).cast("array<string>"), name)
    viable = cards.filter(F.col("codes").between(*CODES)).withColumn("depth", F.row_number().over(W.partitionBy("table_no").orderBy("place")))
    order = F.struct((earlier == 0).alias("fresh"), earlier.alias("earlier"), "depth", "table_no", "table_name", "column_name", F.col("codes").cast("int").alias("codes"))
    listed = viable.agg(F.array_sort(F.collect_list(order)).alias("c"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<slot:int,table_name:string,column_name:string,codes:int>>").alias("out"))

    def step(done: Column, c: Column) -> Column:
        fits = done["used"] + c["codes"] <= most
        one = F.array(F.struct(done["used"].alias("slot"), c["table_name"].alias("table_name"), c["column_name"].alias("column_name"), c["codes"].alias("codes")))
        return F.struct(F.when(fits, done["used"] + c["codes"]).otherwise(done["used"]).alias("used"), F.when(fits, F.concat(done["out"], one)).otherwise(done["out"]).alias("out"))

    return listed.select(F.inline(F.aggregate("c", start, step)["out"]))


def neighbour_features(past: DataFrame, neighbour: str, neighbour_history: DataFrame, same: int) -> DataFrame:
    """What an entity's links say: distinct neighbours, share of the top one, and means over the 4 most recent ones.

    `past` is query rows of one table with a neighbour column;
    `neighbour_history` has `neighbour_id, t, table_idx`. The means are of log1p
    of the neighbour's events before t_q, of those in table `same`, and of days
    since its last; a neighbour without events counts 0. `with_last` counts
    events with the latest neighbour.
    """
    linked = past.filter(F.col(neighbour).isNotNull())
    per = linked.groupBy("query_id", "t_q", F.col(neighbour).alias("neighbour_id")).agg(F.count("*").alias("n"), F.max("t").alias("last"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("last"), "neighbour_id"))
    ranked = per.withColumn("place", place)
    own = ranked.groupBy("query_id").agg(
        F.log1p(F.count("*")).alias("nb_distinct"),
        (F.max("n") / F.sum("n")).alias("nb_top_share"),
        F.log1p(F.max(F.when(F.col("place") == 1, F.col("n")))).alias("nb_with_last"),
    )
    recent = ranked.filter(F.col("place") <= NEIGHBOURS)
    seen = recent.join(neighbour_history, "neighbour_id").filter("t < t_q").groupBy("query_id", "neighbour_id", "t_q").agg(F.count("*").alias("events"), F.count_if(F.col("table_idx") == same).alias("alike"), F.max("t").alias("latest"))
    pooled = recent.select("query_id", "neighbour_id").join(seen.withColumn("since", (F.col("t_q") - F.col("latest")) / DAY).drop("t_q"), ["query_id", "neighbour_id"], "left")
    mean = lambda c: F.avg(F.log1p(F.coalesce(c, F.lit(0))))
    theirs = pooled.groupBy("query_id").agg(mean("events").alias("nb_events"), mean("alike").alias("nb_alike"), mean("since").alias("nb_since"))
    names = ["nb_distinct", "nb_top_share", "nb_with_last", "nb_events", "nb_alike", "nb_since"]
    done = own.join(theirs, "query_id", "left")
    return past.select("query_id").distinct().join(done, "query_id", "left").select("query_id", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
