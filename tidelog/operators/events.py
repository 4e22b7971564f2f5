"""The event log: one time-ordered stream, and histories per entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.exprs import DAY, month_bucket, weekday
from tidelog.functions.ranges import with_part
from tidelog.spec import DatabaseSpec, union_spec

Tables = dict[str, DataFrame]


def cutoff_filter(frame: DataFrame, cutoff: int, time_col: str | None = None) -> DataFrame:
    """Rows up to and including the cutoff; on the raw time column the filter reaches the scan."""
    if time_col is None:
        return frame.filter(F.col("t") <= cutoff)
    return frame.filter(F.col(time_col) < F.timestamp_add("SECOND", F.lit(cutoff + 1), F.lit("1970-01-01").cast("timestamp_ntz")))


def later_than(frame: DataFrame, start: int, time_col: str) -> DataFrame:
    """Rows after `start`; the filter reaches the scan."""
    return frame.filter(F.col(time_col) >= F.timestamp_add("SECOND", F.lit(start + 1), F.lit("1970-01-01").cast("timestamp_ntz")))


def before(spec: DatabaseSpec, tables: Tables, cutoff: int) -> Tables:
    """The tables with facts cut at the cutoff."""
    return {n: cutoff_filter(f, cutoff, spec[n].time_col) if spec[n].is_fact else f for n, f in tables.items()}


def event_stream(spec: DatabaseSpec, tables: Tables, cutoff: int) -> DataFrame:
    """`t, table_idx, row_key` of all facts up to the cutoff."""
    known = before(spec, tables, cutoff)
    arms = [known[f.name].select("t", F.lit(spec.table_idx(f.name)).alias("table_idx"), F.expr(f.key).cast("long").alias("row_key")) for f in spec.facts]
    return reduce(DataFrame.unionByName, arms)


def positions(events: DataFrame) -> DataFrame:
    """Events with their `position` in the order (t, table_idx, row_key).

    Ranges of time with about equal numbers of events, as many as the events
    ask for, are summed up first, so a task ranks one range.
    """
    dealt = with_part(events, "t")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.row_number().over(W.partitionBy("part").orderBy("t", "table_idx", "row_key")) - 1
    return dealt.withColumn("inside", inside).join(starts, "part").select("t", "table_idx", "row_key", (F.col("start") + F.col("inside")).alias("position"))


def standardized(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std, 0 for null."""
    return F.coalesce((x - mean) / std, F.lit(0.0))


def encode(frame: DataFrame, column: str, vocab: DataFrame, name: str) -> DataFrame:
    """Adds the code of a column's value, 0 where the vocabulary lacks it."""
    codes = vocab.filter(F.col("column_name") == column).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    joined = frame.join(codes, frame[column].cast("string") == F.col("_value"), "left")
    return joined.withColumn(name, F.coalesce("_code", F.lit(0))).drop("_value", "_code")


def resolve_links(frame: DataFrame, fkey: str, entity: DataFrame, pkey: str) -> DataFrame:
    """Adds `linked`: the key of the entity that a link points at, null if there is none."""
    keys = entity.select(F.col(pkey).alias("linked"))
    return frame.join(keys, frame[fkey] == F.col("linked"), "left")


def histories(spec: DatabaseSpec, tables: Tables, entity: str, cutoff: int, self_rows: bool = False) -> DataFrame:
    """`entity_id, t, table_idx, slot, row_key`: one row for each link of an event to an entity.

    An event with two links to one entity comes twice. With `self_rows`, a fact
    that is an entity itself is filed in its own history too, under slot "self".
    """
    known = before(spec, tables, cutoff)

    def arm(fact: str, column: str, slot: str) -> DataFrame:
        return known[fact].filter(F.col(column).isNotNull()).select(
            F.col(column).cast("long").alias("entity_id"), "t", F.lit(spec.table_idx(fact)).alias("table_idx"), F.lit(slot).alias("slot"), F.expr(spec[fact].key).cast("long").alias("row_key")
        )

    arms = [arm(f.name, col, f"{f.name}.{col}") for f, col in spec.slots(entity)]
    if self_rows and spec[entity].is_fact:
        arms.append(arm(entity, spec[entity].pkey, "self"))
    return reduce(DataFrame.unionByName, arms)


def path_expand(bridge: DataFrame, events: DataFrame, via: str, events_via: str, entity: str) -> DataFrame:
    """`entity_id` and the events that it reaches through a bridge no later than they are.

    `bridge` has `t`, the shared key `via` and the entity's link; `events` has
    `t`, `row_key` and the shared key. An event reached twice is filed once.
    """
    for frame, column in ((bridge, via), (bridge, entity), (events, events_via)):
        if column not in frame.columns:
            raise KeyError(f"the path needs a column {column}")
    first = bridge.select(F.col(entity).cast("long").alias("entity_id"), F.col(via).alias("shared"), F.col("t").alias("bridge_t"))
    joined = first.join(events.withColumn("shared", F.col(events_via)), "shared").filter("bridge_t <= t and entity_id is not null")
    return joined.drop("bridge_t", "shared").dropDuplicates(["entity_id", "row_key"])


def split_path(path: str) -> tuple[str, str, str]:
    """The parts of entity:bridge:events."""
    parts = path.split(":")
    if len(parts) != 3 or not all(parts):
        raise ValueError(f"a path has three tables: {path}")
    return parts[0], parts[1], parts[2]


def history_tail(queries: DataFrame, history: DataFrame, most: int, inclusive: bool = False) -> DataFrame:
    """The last `most` events before each query's `t_q`, with `back` = 1 for the latest.

    `queries` has `query_id, entity_id, t_q`; ties go to the later table and key.
    """
    joined = queries.join(history, "entity_id").filter((F.col("t") <= F.col("t_q")) if inclusive else (F.col("t") < F.col("t_q")))
    back = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("t"), F.desc("table_idx"), F.desc("row_key")))
    return joined.withColumn("back", back).filter(F.col("back") <= most)


def link_counts(history: DataFrame, entities: DataFrame, pkey: str, since: int | None = None) -> DataFrame:
    """`entity_id, n_links` of every entity, 0 for those without, optionally from a time on."""
    kept = history if since is None else history.filter(F.col("t") >= since)
    counts = kept.groupBy("entity_id").agg(F.count("*").alias("n"))
    keys = entities.select(F.col(pkey).cast("long").alias("entity_id"))
    return keys.join(counts, "entity_id", "left").select("entity_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


def link_targets(tables: dict[str, Tables], specs: dict[str, DatabaseSpec]) -> DataFrame:
    """`table_idx, table_name, column_name, target, n_links` of all foreign keys of the facts of several databases, named as in their union."""
    union, arms = union_spec(specs), []
    for fact in union.facts:
        db, table = fact.name.split("::")
        known = cutoff_filter(tables[db][table], specs[db].cutoff, fact.time_col)
        if fact.fkeys:
            listed = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(to).alias("target"), F.count(c).alias("n_links")) for c, to in fact.fkeys.items()])
            arms.append(known.agg(listed.alias("links")).select(F.lit(union.table_idx(fact.name)).alias("table_idx"), F.lit(fact.name).alias("table_name"), F.inline("links")))
    return reduce(DataFrame.unionByName, arms)


def union_databases(logs: dict[str, DataFrame], specs: dict[str, DatabaseSpec]) -> DataFrame:
    """The event logs of several databases, tables named db::table and numbered on, databases by name."""
    arms, start = [], 0
    for name in sorted(logs):
        facts = specs[name].facts
        names = F.array(*[F.lit(f"{name}::{f.name}") for f in facts])
        arms.append(logs[name].select("t", (F.col("table_idx") + start).alias("table_idx"), F.get(names, F.col("table_idx")).alias("table_name"), "row_key"))
        start += len(facts)
    return reduce(DataFrame.unionByName, arms)


def reachability(history: DataFrame, entities: DataFrame, pkey: str, tables: list[int]) -> DataFrame:
    """One row: entities, those with an event of the tables, and their share."""
    has = history.filter(F.col("table_idx").isin(tables)).select("entity_id").distinct().withColumn("has", F.lit(1))
    joined = entities.select(F.col(pkey).cast("long").alias("entity_id")).join(has, "entity_id", "left")
    return joined.agg(F.count("*").alias("n_entities"), F.count("has").alias("n_reached"), (F.count("has") / F.count("*")).alias("share"))


def calendar_gaps(history: DataFrame) -> DataFrame:
    """Histories with weekday, 30-day bucket and log1p of the gap in days before each event, 0 for the first."""
    last = F.lag("t").over(W.partitionBy("entity_id").orderBy("t", "table_idx", "row_key"))
    gap = F.log1p(F.coalesce(F.col("t") - last, F.lit(0)) / DAY)
    return history.withColumn("weekday", weekday(F.col("t"))).withColumn("month_bucket", month_bucket(F.col("t"))).withColumn("log_gap", gap)
