"""Features of a history read off running states, so that no query meets its past in a join.

Events and query marks are sorted together once per entity and span of time; a
mark reads counts, extremes and sums of gaps of all events before it: those of
earlier spans are summed up first, so an entity with very many events, or very
many query times, is spread over many tasks. What isn't a running sum is kept
in bounded blocks: a query reads two blocks of gaps for the median of its last
ones, and the few last neighbours are carried from span to span.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.exprs import DAY, weekday
from tidelog.operators.features import LAST_TIMES, MOST_SLOTS, MOST_WINDOWS, NEIGHBOURS, days_since
from tidelog.operators.timeline import SPAN
from tidelog.sources.sinks import written

_KEYS = ["entity_id", "span"]
#: Events and marks that a task sorts and holds states of.
TASK_ROWS = 250_000


def _spread(frame: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Dealt by the keys to as many tasks as the rows ask for, where the session's number of partitions is too small."""
    tasks = -(-rows // TASK_ROWS)
    return frame.repartition(tasks, *keys) if tasks > int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")) else frame


def _log_days(gap: Column) -> Column:
    return F.log1p(gap / DAY)


#: What is summed over the gaps between an entity's events.
GAP_SUMS: dict[str, Callable[[Column], Column]] = {"gap_log": _log_days, "gap_square": lambda gap: _log_days(gap) * _log_days(gap)}


def running(events: DataFrame, marks: DataFrame, sums: dict[str, Column], most: dict[str, Column] | None = None, gap_sums: dict[str, Callable[[Column], Column]] | None = None, n_rows: int = 0) -> DataFrame:
    """Each row of `marks`, and each event, with the state of its entity's events before it.

    `events` has `entity_id, t`, `marks` has `entity_id, mark_t` and columns of
    its own. The result has `entity_id, at, own` (null for events), `n, first,
    last, gap` (events only), and a column per sum, maximum and sum over gaps.
    A mark's state excludes events at its own second, an event's includes
    itself. `n_rows`, if known, is how many events and marks there are; the
    tasks that sort them go with it.
    """
    most, gap_sums = most or {}, gap_sums or {}
    extra = [c for c in marks.columns if c not in ("entity_id", "mark_t")]
    kind = marks.select(F.struct(*extra)).schema[0].dataType
    measures = [*[c.alias(n) for n, c in sums.items()], *[c.alias(n) for n, c in most.items()]]
    rows = events.select("entity_id", F.col("t").alias("at"), F.col("t").alias("own_t"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("own"), *measures)
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name in sums or f.name in most]
    points = marks.select("entity_id", F.col("mark_t").alias("at"), F.lit(None).cast("long").alias("own_t"), F.lit(-1).alias("kind"), F.struct(*extra).alias("own"), *empty)
    inside = W.partitionBy(*_KEYS).orderBy("at", "kind")
    so_far = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    run = _spread(rows.unionByName(points).withColumn("span", F.floor(F.col("at") / SPAN)), n_rows, *_KEYS)
    gap = F.when(F.col("own_t").isNotNull(), F.col("own_t") - F.max("own_t").over(inside.rowsBetween(W.unboundedPreceding, -1)))
    run = run.withColumn("gap", gap)
    run = run.withColumns({n: g(F.col("gap")) for n, g in gap_sums.items()})
    added = [*sums, *gap_sums]

    # per span: what it adds, and the gap from the event before it to its first
    per = run.groupBy(*_KEYS).agg(F.count("own_t").alias("s_n"), F.min("own_t").alias("s_first"), F.max("own_t").alias("s_last"), *[F.sum(n).alias(f"s_{n}") for n in added], *[F.max(n).alias(f"s_{n}") for n in most])
    spans = W.partitionBy("entity_id").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    linked = _spread(per, n_rows, "entity_id").withColumns({"b_last": F.max("s_last").over(spans), "b_first": F.min("s_first").over(spans)}).withColumn("between", F.col("s_first") - F.col("b_last"))
    whole = linked.withColumns({f"s_{n}": F.coalesce(F.col(f"s_{n}"), F.lit(0.0)) + F.coalesce(g(F.col("between")), F.lit(0.0)) for n, g in gap_sums.items()})
    before = {"b_n": F.coalesce(F.sum("s_n").over(spans), F.lit(0))} | {f"b_{n}": F.sum(f"s_{n}").over(spans) for n in added} | {f"b_{n}": F.max(f"s_{n}").over(spans) for n in most}
    starts = whole.withColumns(before).select(*_KEYS, "b_last", "b_first", "between", *before)

    state = {"i_n": F.count("own_t").over(so_far), "i_first": F.min("own_t").over(so_far), "i_last": F.max("own_t").over(so_far)}
    state |= {f"i_{n}": F.sum(n).over(so_far) for n in added} | {f"i_{n}": F.max(n).over(so_far) for n in most}
    joined = run.withColumns(state).join(starts, _KEYS)
    both = lambda n: F.coalesce(F.col(f"b_{n}"), F.lit(0)) + F.coalesce(F.col(f"i_{n}"), F.lit(0))
    entered = lambda g: F.when(F.col("i_n") > 0, F.coalesce(g(F.col("between")), F.lit(0.0))).otherwise(0.0)
    return joined.select(
        "entity_id", "at", "own",
        (F.col("b_n") + F.col("i_n")).alias("n"), F.least("b_first", "i_first").alias("first"), F.greatest("b_last", "i_last").alias("last"),
        F.coalesce("gap", F.when(F.col("own_t").isNotNull(), F.col("between"))).alias("gap"),
        *[both(n).alias(n) for n in sums], *[F.greatest(f"b_{n}", f"i_{n}").alias(n) for n in most], *[(both(n) + entered(g)).alias(n) for n, g in gap_sums.items()],
    )


def _edge(i: int, inclusive: bool) -> Column:
    """Events before this time are those up to the end of past window i, strictly before t_q for the first unless inclusive."""
    return F.col("t_q") - i * F.col("horizon_s") + (1 if i or inclusive else 0)


def past_states(queries: DataFrame, history: DataFrame, tables: dict[str, int], categories: dict[str, list[str]] | None = None, inclusive: bool = False) -> DataFrame:
    """One row per query with the states that all history features are read from.

    `queries` has `query_id, entity_id, t_q, horizon_s`, `history` has
    `entity_id, t, table_idx` and the categories' columns. A query has marks at
    t_q and at the ends of its MOST_WINDOWS past windows; they cost one sort
    with the events, however many queries an entity has. Only the median gap
    reads events again: those of two blocks of LAST_TIMES.
    """
    categories = categories or {}
    if any(len(values) > MOST_SLOTS for values in categories.values()):
        raise ValueError(f"a layout has at most {MOST_SLOTS} slots")
    ends = F.array(*[F.struct(F.lit(i).alias("i"), _edge(i, inclusive).alias("mark_t")) for i in range(MOST_WINDOWS + 1)])
    marks = queries.select("query_id", "entity_id", "t_q", "horizon_s", F.inline(ends))
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    sums = {f"c_{n}": one(F.col("table_idx") == i) for n, i in tables.items()}
    sums |= {f"v_{c}_{k}": one(F.col(c) == v) for c, values in categories.items() for k, v in enumerate(values)}
    sums |= {f"wd_{d}": one(weekday(F.col("t")) == d) for d in range(7)}
    most = {f"l_{n}": F.when(F.col("table_idx") == i, F.col("t")) for n, i in tables.items()}
    n_events, n_marks = history.count(), (MOST_WINDOWS + 1) * queries.count()
    states = running(history, marks, sums, most, GAP_SUMS, n_events + n_marks)

    at = lambda i, c: F.max(F.when(F.col("own.i") == i, F.col(c)))
    read = [at(i, "n").alias(f"n_{i}") for i in range(MOST_WINDOWS + 1)]
    read += [at(i, c).alias(f"{c}_{i}") for c in sums if not c.startswith("wd_") for i in (0, 1)]
    read += [at(0, c).alias(c) for c in ("first", "last", *most, *GAP_SUMS, *(f"wd_{d}" for d in range(7)))]
    points = states.filter("own is not null").withColumns({c: F.col(f"own.{c}") for c in ("query_id", "t_q", "horizon_s")})
    wide = _spread(points, n_marks, "query_id").groupBy("query_id", "entity_id", "t_q", "horizon_s").agg(*read)
    return wide.join(_median_gaps(states, wide.select("query_id", "entity_id", F.col("n_0").alias("n")), n_events), "query_id", "left")


def _median_gaps(states: DataFrame, asked: DataFrame, n_events: int) -> DataFrame:
    """`query_id, gap`: the median of the gaps between the last LAST_TIMES events of the first n of an entity.

    Events are numbered by their state and dealt into blocks of LAST_TIMES, one
    row with its gaps each; a query looks at the block of its last event and the
    one before.
    """
    numbered = states.filter("own is null and gap is not null").select("entity_id", F.floor(F.col("n") / LAST_TIMES).alias("block"), F.struct("n", "gap").alias("g"))
    blocks = _spread(numbered, n_events, "entity_id", "block").groupBy("entity_id", "block").agg(F.collect_list("g").alias("gs"))
    last = F.floor(F.col("n") / LAST_TIMES)
    wanted = asked.filter("n > 1").withColumn("block", F.explode(F.array_distinct(F.array(F.greatest(last - 1, F.lit(0).cast("long")), last))))
    met = wanted.join(blocks, ["entity_id", "block"]).withColumn("g", F.expr(f"transform(filter(gs, g -> g.n <= n and g.n > n - {LAST_TIMES - 1}), g -> g.gap)"))
    gaps = met.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("g"))).alias("g"))
    size = F.size("g")
    middle = lambda k: F.element_at("g", (F.floor(k / 2) + 1).cast("int"))
    return gaps.select("query_id", F.when(size > 0, (middle(size - 1) + middle(size)) / 2.0).alias("gap"))


def table_counts(states: DataFrame, tables: Iterable[str]) -> DataFrame:
    """As `features.table_counts`."""
    out = []
    for name in tables:
        out += [F.log1p(f"c_{name}_0").alias(f"{name}_n"), days_since(F.col(f"l_{name}"), F.col("t_q")).alias(f"{name}_since"), F.log1p(F.col(f"c_{name}_0") - F.col(f"c_{name}_1")).alias(f"{name}_recent")]
    return states.select("query_id", "t_q", *out, F.log1p("n_0").alias("all_n"), days_since(F.col("first"), F.col("t_q")).alias("all_first"))


def category_counts(states: DataFrame, column: str, values: list[str], recent: bool = False) -> DataFrame:
    """As `features.category_counts`."""
    seen = lambda k, i: F.col(f"v_{column}_{k}_{i}")
    return states.select("query_id", *[F.log1p(seen(k, 0) - seen(k, 1) if recent else seen(k, 0)).alias(f"{column}_{v}") for k, v in enumerate(values)])


def dynamics(states: DataFrame) -> DataFrame:
    """As `features.dynamics`: the tiled windows' counts are differences of marks."""
    windows = F.greatest(F.lit(1), F.least(F.lit(MOST_WINDOWS), F.ceil((F.col("t_q") - F.col("first")) / F.col("horizon_s")))).cast("int")
    counts = F.slice(F.array(*[F.col(f"n_{i}") - F.col(f"n_{i + 1}") for i in range(MOST_WINDOWS)]), 1, F.coalesce(windows, F.lit(1)))
    known = states.withColumn("tiles", counts).withColumn("w", F.size("tiles"))
    add = lambda f, of: F.aggregate(of, F.lit(0.0), lambda a, x: a + f(x.cast("double")))
    mean = known.withColumn("mean", add(lambda x: x, "tiles") / F.col("w"))
    earlier = F.expr("slice(tiles, 2, greatest(w - 1, 0))")
    elapsed = F.col("t_q") - F.col("last")
    spread = F.sqrt(F.aggregate("tiles", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.col("w"))
    some = F.col("n_0") > 0
    out = {
        "dyn_max": F.log1p(F.array_max("tiles")),
        "dyn_one": add(lambda x: F.when(x >= 1, 1.0).otherwise(0.0), "tiles") / F.col("w"),
        "dyn_two": add(lambda x: F.when(x >= 2, 1.0).otherwise(0.0), "tiles") / F.col("w"),
        "dyn_mean": F.log1p("mean"),
        "dyn_spread": F.try_divide(spread, F.col("mean")),
        "dyn_trend": F.when(F.col("w") > 1, F.log1p(F.col("tiles")[0]) - F.log1p(add(lambda x: x, earlier) / (F.col("w") - 1))),
        "dyn_gap": _log_days(F.col("gap")),
        "dyn_overdue": F.when(F.col("gap").isNull(), _log_days(elapsed)).otherwise(F.log1p(elapsed / (F.col("gap") + DAY))),
    }
    return mean.select("query_id", *[F.coalesce(F.when(some, c), F.lit(0.0)).alias(n) for n, c in out.items()])


def gap_globals(states: DataFrame) -> DataFrame:
    """As `features.gap_globals`: the deviation from sums of gaps and their squares."""
    n = F.col("n_0") - 1
    variance = F.greatest(F.try_divide(F.col("gap_square"), n) - F.pow(F.try_divide(F.col("gap_log"), n), F.lit(2.0)), F.lit(0.0))
    same = reduce(lambda a, d: a.when(weekday(F.col("t_q")) == d, F.col(f"wd_{d}")), range(1, 7), F.when(weekday(F.col("t_q")) == 0, F.col("wd_0")))
    return states.select("query_id", F.when(n > 0, F.coalesce(F.sqrt(variance), F.lit(0.0))).otherwise(0.0).alias("gap_std"), F.coalesce(F.try_divide(same.cast("double"), F.col("n_0")), F.lit(0.0)).alias("weekday_share"))


# neighbours -------------------------------------------------------------------------------------------------------


def _until(links: DataFrame, marks: DataFrame) -> DataFrame:
    """Links with `until`, the first of their entity's `mark_t` after them; those after the last one are left out.

    Where no mark falls into a link's span, it is the first one of a later span,
    of which an entity has a list; only spans with marks are sorted with them.
    """
    span = F.floor(F.col("t") / SPAN)
    placed = marks.select("entity_id", "mark_t").distinct().withColumn("span", F.floor(F.col("mark_t") / SPAN))
    firsts = placed.groupBy(*_KEYS).agg(F.min("mark_t").alias("first")).groupBy("entity_id").agg(F.collect_list(F.struct("span", "first")).alias("firsts"))
    later = F.array_min(F.expr("transform(filter(firsts, f -> f.span > span), f -> f.first)"))
    met = links.withColumn("span", span).join(firsts, "entity_id").withColumns({"later": later, "here": F.expr("exists(firsts, f -> f.span = span)")}).drop("firsts")
    # times fall, and links come before the marks of their own second, which exclude them
    both = met.filter("here").withColumn("mark_t", F.lit(None).cast("long")).unionByName(placed.withColumn("t", F.col("mark_t")), True)
    falling = W.partitionBy(*_KEYS).orderBy(F.desc("t"), F.col("mark_t").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    near = both.withColumn("until", F.coalesce(F.min("mark_t").over(falling), "later")).filter("here")
    far = met.filter("not here").withColumn("until", F.col("later"))
    return far.unionByName(near.drop("mark_t")).filter("until is not null").select(*links.columns, "until")


def pair_counts(links: DataFrame, marks: DataFrame) -> DataFrame:
    """`entity_id, neighbour_id, until, c, t, nth`: a pair's links between two marks of its entity, `until` the second.

    c counts them, t is the last one's time, and nth counts the pair's links up
    to there. Nothing else of the links is needed at the marks.
    """
    counts = _until(links.select("entity_id", "neighbour_id", "t"), marks).groupBy("entity_id", "neighbour_id", "until").agg(F.count("*").alias("c"), F.max("t").alias("t"))
    so_far = W.partitionBy("entity_id", "neighbour_id").orderBy("until").rowsBetween(W.unboundedPreceding, W.currentRow)
    return counts.withColumn("nth", F.sum("c").over(so_far))


def _latest(held: list[tuple[int, int]], more: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """(-t, neighbour) of the last NEIGHBOURS different neighbours, the latest first, ties to the smaller id."""
    seen = dict((nb, t) for t, nb in held)
    for t, nb in more:
        seen[nb] = min(seen.get(nb, t), t)
    return sorted((t, nb) for nb, t in seen.items())[:NEIGHBOURS]


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`query_id, t_q, neighbour_id` for each mark of rows in order; the row of kind -2 has what earlier spans left."""
    now, held = None, []
    for batch in batches:
        out: list[tuple] = []
        for entity, span, at, kind, neighbour, query, carried in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (entity, span) != now:
                now, held = (entity, span), []
            if kind == 0:
                held = _latest(held, [(-at, neighbour)])
            elif kind == -2:
                held = _latest([], [(-c["t"], c["nb"]) for c in carried])
            else:
                out += [(query, at, nb) for _, nb in held]
        queries, times, neighbours = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(queries, batch.schema.field("query_id").type), pa.array(times, pa.int64()), pa.array(neighbours, pa.int64())], ["query_id", "t_q", "neighbour_id"])


def recent_neighbours(queries: DataFrame, links: DataFrame) -> DataFrame:
    """`query_id, t_q, neighbour_id`: the last NEIGHBOURS different neighbours before each query's time.

    Each span's last ones are carried to the spans after it, a few rows a span;
    a task walks through one entity's events and marks of one span.
    """
    timed = links.select("entity_id", F.col("t").alias("at"), "neighbour_id").withColumn("span", F.floor(F.col("at") / SPAN))
    marks = queries.select("entity_id", F.col("t_q").alias("at"), "query_id").withColumn("span", F.floor(F.col("at") / SPAN))
    last = timed.groupBy(*_KEYS, "neighbour_id").agg(F.max("at").alias("t"))
    few = last.withColumn("i", F.row_number().over(W.partitionBy(*_KEYS).orderBy(F.desc("t"), "neighbour_id"))).filter(F.col("i") <= NEIGHBOURS)
    tails = few.groupBy(*_KEYS).agg(F.collect_list(F.struct("t", F.col("neighbour_id").alias("nb"))).alias("tail"))
    asked = marks.select(*_KEYS).distinct()
    spans = W.partitionBy("entity_id").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    told = asked.join(tails, _KEYS, "full").withColumn("carried", F.flatten(F.collect_list("tail").over(spans)))
    carried = told.filter(F.size("carried") > 0).select(*_KEYS, (F.col("span") * SPAN).alias("at"), F.lit(-2).alias("kind"), "carried")
    shaped = carried.unionByName(timed.withColumn("kind", F.lit(0)), True).unionByName(marks.withColumn("kind", F.lit(-1)), True)
    kinds = {f.name: f.dataType.simpleString() for f in shaped.schema}
    # only spans that a query falls into are walked through
    walked = shaped.join(asked, _KEYS, "left_semi").repartition(*_KEYS).sortWithinPartitions(*_KEYS, "at", "kind")
    return walked.select(*_KEYS, "at", "kind", "neighbour_id", "query_id", "carried").mapInArrow(_picked, f"query_id {kinds['query_id']}, t_q long, neighbour_id long")


def neighbour_features(queries: DataFrame, links: DataFrame, neighbour_history: DataFrame, same: int) -> DataFrame:
    """As `features.neighbour_features`, for `links` of `entity_id, t, row_key, neighbour_id`; null neighbours don't count.

    Links are counted per pair and query time first, so what is summed up along
    an entity's query times has a row for each of them: different neighbours are
    pairs that begin there, the top one's count is the highest of a pair. The
    last neighbours' ids, with their query's time, are marks among the
    neighbours' own events, so no neighbour's history meets a query.
    """
    known = links.filter("neighbour_id is not null").withColumn("neighbour_id", F.col("neighbour_id").cast("long"))
    marks = queries.select("entity_id", F.col("t_q").cast("long").alias("mark_t"), "query_id")
    pairs = written(pair_counts(known, marks), "neighbour-pairs")
    latest = F.struct("t", (-F.col("neighbour_id")).alias("nb"), "nth")
    began = F.when(F.col("nth") == F.col("c"), 1).otherwise(0).cast("long")
    each = pairs.groupBy("entity_id", "until").agg(F.sum("c").alias("links"), F.sum(began).alias("different"), F.max("nth").alias("top"), F.max(latest).alias("latest"))
    # what lies before a mark counts as a second before it
    added = each.withColumn("t", F.col("until") - 1)
    own = running(added, marks, {c: F.col(c) for c in ("links", "different")}, {c: F.col(c) for c in ("top", "latest")}).filter("own is not null")
    mine = own.select(F.col("own.query_id").alias("query_id"), F.log1p("different").alias("nb_distinct"), F.try_divide(F.col("top").cast("double"), F.col("links")).alias("nb_top_share"), F.log1p(F.col("latest.nth")).alias("nb_with_last"))

    # no other pair can be among the last ones at this mark or a later one
    place = F.row_number().over(W.partitionBy("entity_id", "until").orderBy(F.desc("t"), "neighbour_id"))
    last = pairs.select("entity_id", "neighbour_id", "until", "t").withColumn("place", place).filter(F.col("place") <= NEIGHBOURS)
    picked = written(recent_neighbours(queries, last), "neighbour-picked")
    theirs_at = picked.select(F.col("neighbour_id").alias("entity_id"), F.col("t_q").alias("mark_t"), "query_id")
    history = neighbour_history.select(F.col("neighbour_id").cast("long").alias("entity_id"), "t", "table_idx").join(theirs_at.select("entity_id").distinct(), "entity_id", "left_semi")
    seen = running(history, theirs_at, {"alike": F.when(F.col("table_idx") == same, 1).otherwise(0).cast("long")}).filter("own is not null")
    since = F.coalesce((F.col("at") - F.col("last")) / DAY, F.lit(0.0))
    theirs = seen.groupBy(F.col("own.query_id").alias("query_id")).agg(F.avg(F.log1p("n")).alias("nb_events"), F.avg(F.log1p("alike")).alias("nb_alike"), F.avg(F.log1p(since)).alias("nb_since"))
    names = ["nb_distinct", "nb_top_share", "nb_with_last", "nb_events", "nb_alike", "nb_since"]
    return mine.join(theirs, "query_id", "left").select("query_id", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
