"""Window targets, next events and destinations."""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.exprs import DAY, in_window, uniform
from tidelog.functions.ranges import exact_quantiles
from tidelog.operators.timeline import sweep
from tidelog.sources.sinks import written

#: Events of a window that are kept in detail, and destinations of a query.
MOST_DETAIL, MOST_DESTINATIONS = 256, 8
#: Parts of a window that are cut to a sample of their own first.
SALTS = 16


def sample_queries(history: DataFrame, cutoff: int, per_entity: int, seed: int, days: tuple[float, float] = (1.0, 365.0), tail: float = 0.25, centre: float | None = None, spread: float = 0.5) -> DataFrame:
    """`query_id, entity_id, t_q, horizon_s, k`: horizons first, then times uniform from an entity's first event to where the window ends by the cutoff.

    Horizons are log-uniform in days, or log-normal about `centre` days with
    that spread of the logarithm, clipped to the same range. With probability
    `tail` the time's age, back from the latest admissible one, is log-uniform
    instead. k is the place, from 0, of the entity's last event at or before
    t_q. Draws depend on the seed, entity and number only.
    """
    first = history.groupBy("entity_id").agg(F.min("t").alias("t0"))
    rows = first.select("entity_id", "t0", F.explode(F.sequence(F.lit(0), F.lit(per_entity - 1))).alias("i"))
    draw = lambda k: uniform(seed + k, "entity_id", "i")
    low, high = F.log(F.lit(days[0])), F.log(F.lit(days[1]))
    if centre is None:
        log_days = low + draw(0) * (high - low)
    else:
        # a normal draw from two uniform ones
        normal = F.sqrt(-2.0 * F.log(1.0 - draw(0))) * F.cos(2.0 * math.pi * draw(3))
        log_days = F.least(F.greatest(math.log(centre) + spread * normal, low), high)
    horizon = F.greatest(F.lit(1), F.floor(F.exp(log_days) * DAY)).cast("long")
    room = F.col("latest") - F.col("t0")
    aged = F.least(room, F.floor(F.exp(draw(2) * F.log(1 + room)) - 1))
    t_q = F.when(draw(1) < tail, F.col("latest") - aged).otherwise(F.col("t0") + F.floor(draw(2) * (room + 1))).cast("long")
    sized = rows.withColumn("horizon_s", horizon).withColumn("latest", cutoff - F.col("horizon_s")).filter("latest >= t0")
    asked = sized.select(F.xxhash64(F.lit(seed), "entity_id", "i").alias("query_id"), "entity_id", t_q.alias("t_q"), "horizon_s")
    marks = asked.select("entity_id", F.col("t_q").alias("mark_t"), "query_id", "horizon_s")
    placed = sweep(history.select("entity_id", "t"), marks, {"n": F.lit(1).cast("long")}, inclusive=True)
    return placed.select("query_id", "entity_id", F.col("mark_t").alias("t_q"), "horizon_s", (F.col("n") - 1).alias("k"))


def sample_dense_queries(history: DataFrame, cutoff: int, per_entity: int, horizon: int, seed: int) -> DataFrame:
    """Up to n query times per entity, each a log-uniform offset after an event of its own, without replacement."""
    offset = F.floor(F.exp(uniform(seed, "entity_id", "row_key", "table_idx") * F.log(F.lit(30.0 * DAY)))).cast("long")
    timed = history.withColumn("t_q", F.col("t") + offset).filter(F.col("t_q") + horizon <= cutoff)
    place = F.row_number().over(W.partitionBy("entity_id").orderBy(F.xxhash64(F.lit(seed + 1), "entity_id", "row_key", "table_idx"), "row_key", "table_idx"))
    return timed.withColumn("place", place).filter(F.col("place") <= per_entity).select(F.xxhash64(F.lit(seed), "entity_id", "row_key", "table_idx").alias("query_id"), "entity_id", "t_q", F.lit(horizon).cast("long").alias("horizon_s"), "t")


def windowed(queries: DataFrame, history: DataFrame) -> DataFrame:
    """Queries joined to their entity's events in (t_q, t_q + horizon_s]; none leaves a row of nulls."""
    inside = queries.join(history, "entity_id").filter(in_window(F.col("t"), F.col("t_q"), F.col("horizon_s")))
    return queries.join(inside.drop("entity_id", "t_q", "horizon_s"), "query_id", "left")


def category_counts(inside: DataFrame, column: str, weight: Column | None = None) -> DataFrame:
    """`query_id, value, n` for the categories that occur in each window."""
    n = F.sum(weight).alias("n") if weight is not None else F.count("*").alias("n")
    return inside.filter(F.col(column).isNotNull()).groupBy("query_id", F.col(column).alias("value")).agg(n)


def snapped(quantiles: list[float], separators: list[float]) -> list[float]:
    """Each quantile moved to the nearest separator not before the one after the last taken, ties to the lower; they saturate at the top."""
    if not separators:
        return list(quantiles)
    out, taken = [], -1
    for x in quantiles:
        nearest = min(range(len(separators)), key=lambda k: (abs(separators[k] - x), k))
        taken = min(max(nearest, taken + 1), len(separators) - 1)
        out.append(separators[taken])
    return out


def bucket_edges(frame: DataFrame, column: str, buckets: int = 8) -> list[float]:
    """Interior edges of a column: quantiles snapped to midpoints between distinct values, then 1e-6 apart.

    The distinct values are written once, and one job finds those beside all
    quantiles: a few of each stretch between two quantiles, so what is ranked
    is cut to a few rows in each task first, and only they reach the driver.
    """
    values = frame.select(F.col(column).cast("double").alias("x")).filter("x is not null and not isnan(x)")
    quantiles = exact_quantiles(values, F.col("x"), [i / buckets for i in range(1, buckets)])
    if quantiles[0] is None:
        return [0.0] * (buckets - 1)
    starts = sorted(set(quantiles))
    below, above = 2, buckets + 2
    stretch = F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= F.col("x")))
    dealt = written(values.distinct(), "distinct-values").withColumn("stretch", stretch)
    arms = []
    for order, most in ((F.col("x"), above), (F.desc("x"), below)):
        arms.append(dealt.withColumn("nth", F.row_number().over(W.partitionBy("stretch").orderBy(order))).filter(F.col("nth") <= most).select("x"))
    near = sorted({r["x"] for r in arms[0].union(arms[1]).collect()})
    runs = {}
    for i, x in enumerate(starts):
        place = bisect.bisect_left(near, x)
        runs[i] = near[max(0, place - below) : place + above]
    middles = {(a + b) / 2 for run in runs.values() for a, b in zip(sorted(run), sorted(run)[1:], strict=False)}
    return [e + i * 1e-6 for i, e in enumerate(snapped(quantiles, sorted(middles)))]


def bucket_of(x: Column, edges: list[float]) -> Column:
    """Bucket b holds (edge[b - 1], edge[b]]."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < x))


def bucket_centres(frame: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """`bucket, n, centre`: the mean of each bucket, the adjoining edge where it is empty."""
    x = F.col(column).cast("double")
    held = frame.filter(x.isNotNull()).groupBy(bucket_of(x, edges).alias("bucket")).agg(F.count("*").alias("n"), F.avg(x).alias("mean"))
    every = frame.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bucket"))
    edge = F.element_at(F.array(*map(F.lit, edges)), F.least(F.col("bucket") + 1, F.lit(len(edges))))
    return every.join(held, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", edge).alias("centre"))


def capped_detail(inside: DataFrame, most: int = MOST_DETAIL, seed: int = 0) -> DataFrame:
    """A uniform sample of at most `most` events of each window, weighted by events over kept ones per table.

    The sample is the events with the lowest hashes. Each of SALTS parts of a
    window is cut to its own lowest ones first, in each task before anything
    is shuffled, and only what is left of them meets, so no task sorts a whole
    window. Events are counted per table beside that, added up in the tasks.
    """
    known = inside.filter("t is not null").withColumn("_h", F.xxhash64(F.lit(seed), "query_id", "table_idx", "row_key"))
    order = ["_h", "row_key"]
    parts = known.withColumn("_part", F.pmod(F.hash("_h"), F.lit(SALTS)))
    few = parts.withColumn("_place", F.row_number().over(W.partitionBy("query_id", "_part").orderBy(*order))).filter(F.col("_place") <= most)
    kept = few.withColumn("_place", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("_place") <= most)
    counts = known.groupBy("query_id", "table_idx").agg(F.count("*").alias("_events"))
    held = F.count("*").over(W.partitionBy("query_id", "table_idx"))
    weighted = kept.withColumn("_kept", held).join(counts, ["query_id", "table_idx"]).withColumn("weight", F.col("_events") / F.col("_kept"))
    return weighted.select(*inside.columns, "weight")


def next_events(history: DataFrame, cutoff: int, values: list[str]) -> DataFrame:
    """For each event the gap to its entity's next one (1 s at least), its table and values; the last is censored at the cutoff."""
    order = W.partitionBy("entity_id").orderBy("t", "table_idx", "row_key")
    upcoming = F.lead("t").over(order)
    gap = F.greatest(F.lit(1).cast("long"), F.coalesce(upcoming, F.lit(cutoff)) - F.col("t"))
    return history.select(
        "entity_id", "row_key", "t", gap.alias("gap"), upcoming.isNull().alias("censored"), F.lead("table_idx").over(order).alias("next_table"), *[F.lead(v).over(order).alias(f"next_{v}") for v in values]
    )


def window_destinations(queries: DataFrame, links: DataFrame, cutoff: int, by: str = "time", most: int = MOST_DESTINATIONS) -> DataFrame:
    """`query_id, destinations`: distinct destinations in (t_q, t_q + horizon_s], the first few by time or id.

    `links` has `entity_id, dst, t`. Queries whose window passes the cutoff go.
    """
    known = queries.filter(F.col("t_q") + F.col("horizon_s") <= cutoff)
    inside = known.join(links, "entity_id").filter(in_window(F.col("t"), F.col("t_q"), F.col("horizon_s")))
    firsts = inside.groupBy("query_id", "dst").agg(F.min("t").alias("t"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(*(["t", "dst"] if by == "time" else ["dst"])))
    kept = firsts.withColumn("place", place).filter(F.col("place") <= most)
    lists = kept.groupBy("query_id").agg(F.array_sort(F.collect_list("dst")).alias("destinations"))
    return known.select("query_id").join(lists, "query_id", "left").select("query_id", F.coalesce("destinations", F.array().cast("array<bigint>")).alias("destinations"))


def destination_slot(entity: str, slots: dict[str, str]) -> tuple[str, ...]:
    """The link that leads away from the entity; both ends if two lead to it, none if a single one does."""
    away = [c for c, to in slots.items() if to != entity]
    if away:
        return (away[0],)
    own = [c for c, to in slots.items() if to == entity]
    return tuple(own[:2]) if len(own) > 1 else ()


def other_ends(fact: DataFrame, a: str, b: str) -> DataFrame:
    """`entity_id, dst, t` of a fact with two links to one entity: each end sees the other, and not itself."""
    ends = F.array(F.struct(F.col(a).alias("entity_id"), F.col(b).alias("dst")), F.struct(F.col(b).alias("entity_id"), F.col(a).alias("dst")))
    return fact.select("t", F.inline(ends)).filter("entity_id <> dst").select("entity_id", "dst", "t")


def path_retarget(links: DataFrame, path: DataFrame) -> DataFrame:
    """Destinations replaced by every final entity that they lead to: `path` has `inter, final`."""
    return links.join(path, links["dst"] == path["inter"]).select("entity_id", F.col("final").alias("dst"), "t")


def drop_accounting(queries: DataFrame, cutoff: int) -> DataFrame:
    """One row: queries seen, and dropped because their window passes the cutoff."""
    late = F.col("t_q") + F.col("horizon_s") > cutoff
    return queries.agg(F.count("*").alias("seen"), F.count_if(late).alias("dropped"))
