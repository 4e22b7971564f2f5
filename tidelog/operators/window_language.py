"""Questions about a window: which rows qualify, and what is read off them."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.exprs import in_window


@dataclass(frozen=True)
class Filter:
    """A condition on a column of one table: in, not_in, le or gt."""

    table: str
    column: str
    op: str
    value: tuple | float

    def condition(self) -> Column:
        """True for rows that satisfy it; a null value satisfies none."""
        column = F.col(self.column)
        if self.op in ("in", "not_in"):
            within = column.cast("string").isin([str(v) for v in self.value])
            return F.coalesce(within if self.op == "in" else ~within, F.lit(False))
        if self.op in ("le", "gt"):
            return F.coalesce(column <= self.value if self.op == "le" else column > self.value, F.lit(False))
        raise ValueError(f"unknown operation {self.op}")


@dataclass(frozen=True)
class WindowQuery:
    """occur (more than k, or absence of that), count, sum, mean or ratio over qualifying rows."""

    tables: tuple[str, ...]
    agg: str = "occur"
    filters: tuple[Filter, ...] = ()
    k: int = 0
    absence: bool = False
    value: str | None = None
    denominator: tuple[Filter, ...] | None = None

    def hit(self, table: str, filters: tuple[Filter, ...] | None = None) -> Column:
        """True for the qualifying rows of one table."""
        own = [f.condition() for f in (self.filters if filters is None else filters) if f.table == table]
        return reduce(lambda a, b: a & b, own, F.lit(True))


def check(query: WindowQuery, columns: dict[str, list[str]]) -> None:
    """Raise KeyError for a table or column that isn't there, rather than answer another question."""
    for f in (*query.filters, *(query.denominator or ())):
        if f.column not in columns.get(f.table, ()):
            raise KeyError(f"{f.table}.{f.column} isn't in the corpus")
    if missing := [t for t in query.tables if t not in columns]:
        raise KeyError(f"no such fact tables: {missing}")


def qualifying(query: WindowQuery, logs: dict[str, DataFrame]) -> DataFrame:
    """`entity_id, t, hit, base, x, w` of the query's tables; w is 1 where a log has no weight."""
    check(query, {n: f.columns for n, f in logs.items()})
    arms = []
    for table in query.tables:
        log = logs[table]
        x = F.col(query.value).cast("double") if query.value else F.lit(None).cast("double")
        base = query.hit(table, query.denominator) if query.denominator is not None else F.lit(True)
        weight = F.col("weight").cast("double") if "weight" in log.columns else F.lit(1.0)
        arms.append(log.select("entity_id", "t", query.hit(table).alias("hit"), base.alias("base"), x.alias("x"), weight.alias("w")))
    return reduce(DataFrame.unionByName, arms)


def _read(query: WindowQuery) -> tuple[Column, Column]:
    """The answer's expression over joined rows, and whether it is defined."""
    hits = F.coalesce(F.sum(F.when(F.col("hit"), F.col("w"))), F.lit(0.0))
    if query.agg == "occur":
        yes = (hits > query.k) != F.lit(query.absence)
        return yes.cast("double"), F.lit(True)
    if query.agg == "count":
        return hits, F.lit(True)
    total = F.coalesce(F.sum(F.when(F.col("hit"), F.col("w") * F.col("x"))), F.lit(0.0))
    if query.agg == "sum":
        return total, F.lit(True)
    under = F.coalesce(F.sum(F.when((F.col("hit") & F.col("x").isNotNull()) if query.agg == "mean" else F.col("base"), F.col("w"))), F.lit(0.0))
    over = total if query.agg == "mean" else hits
    if query.agg not in ("mean", "ratio"):
        raise ValueError(f"unknown aggregate {query.agg}")
    return F.try_divide(over, under), under > 0


def answer(query: WindowQuery, logs: dict[str, DataFrame], points: DataFrame) -> DataFrame:
    """`query_id, answer, valid` for every point; mean and ratio of nothing aren't valid.

    `points` has `query_id, entity_id, t_q, horizon_s`; rows in
    (t_q, t_q + horizon_s] count. Points without rows are kept.
    """
    rows = qualifying(query, logs)
    inside = points.join(rows, "entity_id").filter(in_window(F.col("t"), F.col("t_q"), F.col("horizon_s")))
    joined = points.select("query_id").join(inside.select("query_id", "hit", "base", "x", "w"), "query_id", "left")
    value, valid = _read(query)
    return joined.groupBy("query_id").agg(value.alias("answer"), valid.alias("valid"))


#: The rows of a log in (after, until], the bounds on its raw time column so that they reach the scan.
Log = Callable[[int | None, int | None], DataFrame]


def _totals(queries: dict[str, WindowQuery], logs: dict[str, Log], points: DataFrame) -> DataFrame:
    """`query_id` of every point and `hits, total, under` of each query, numbered in their order, null where no row is in the window.

    Every log is read once, within the bounds of all windows together. Filters
    that queries share are looked at once, as a column each; all queries of a
    log are added up in one aggregation, and those of several logs by
    `query_id` after.
    """
    bounds = points.agg(F.min("t_q").alias("after"), F.max(F.col("t_q") + F.col("horizon_s")).alias("until")).first()
    names = list(queries)
    arms = []
    for table in sorted({t for q in queries.values() for t in q.tables}):
        if table not in logs:
            raise KeyError(f"no such fact tables: [{table!r}]")
        log = logs[table](bounds["after"], bounds["until"])
        own = {i: queries[n] for i, n in enumerate(names) if table in queries[n].tables}
        for q in own.values():
            check_columns(q, table, log.columns)
        filters = list(dict.fromkeys(f for q in own.values() for f in (*q.filters, *(q.denominator or ())) if f.table == table))
        values = sorted({q.value for q in own.values() if q.value})
        weight = F.col("weight").cast("double") if "weight" in log.columns else F.lit(1.0)
        rows = log.select("entity_id", "t", weight.alias("_w"), *[f.condition().alias(f"_f{i}") for i, f in enumerate(filters)], *[F.col(v).cast("double").alias(f"_x{i}") for i, v in enumerate(values)])
        inside = points.join(rows, "entity_id").filter(in_window(F.col("t"), F.col("t_q"), F.col("horizon_s")))

        def all_of(wanted: tuple[Filter, ...], filters: list[Filter] = filters, table: str = table) -> Column:
            return reduce(lambda a, b: a & b, [F.col(f"_f{filters.index(f)}") for f in wanted if f.table == table], F.lit(True))

        sums = []
        for i, q in own.items():
            hit = all_of(q.filters)
            sums.append(F.sum(F.when(hit, F.col("_w"))).alias(f"hits{i}"))
            if q.value:
                x = F.col(f"_x{values.index(q.value)}")
                sums.append(F.sum(F.when(hit, F.col("_w") * x)).alias(f"total{i}"))
            if q.agg in ("mean", "ratio"):
                counted = hit & x.isNotNull() if q.agg == "mean" else all_of(q.denominator or ())
                sums.append(F.sum(F.when(counted, F.col("_w"))).alias(f"under{i}"))
        arms.append(inside.groupBy("query_id").agg(*sums))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), arms)
    added = both if len(arms) == 1 else both.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in both.columns if c != "query_id"])
    return points.select("query_id").join(added, "query_id", "left")


def check_columns(query: WindowQuery, table: str, columns: list[str]) -> None:
    """Raise KeyError for a column of the table that isn't there, rather than answer another question."""
    wanted = [f.column for f in (*query.filters, *(query.denominator or ())) if f.table == table] + ([query.value] if query.value else [])
    if missing := [c for c in wanted if c not in columns]:
        raise KeyError(f"{table}.{missing[0]} isn't in the corpus")


def _answer_column(i: int, query: WindowQuery) -> tuple[Column, Column]:
    """A query's answer off its totals, and whether it is defined."""
    read = lambda c: F.coalesce(F.col(f"{c}{i}"), F.lit(0.0))
    if query.agg == "occur":
        return ((read("hits") > query.k) != F.lit(query.absence)).cast("double"), F.lit(True)
    if query.agg in ("count", "sum"):
        return read("hits" if query.agg == "count" else "total"), F.lit(True)
    if query.agg not in ("mean", "ratio"):
        raise ValueError(f"unknown aggregate {query.agg}")
    return F.try_divide(read("total" if query.agg == "mean" else "hits"), read("under")), read("under") > 0


def answers(queries: dict[str, WindowQuery], logs: dict[str, Log], points: DataFrame) -> DataFrame:
    """`query_id, task, answer, valid` of every query and point, compiled together: one read of each log for all of them.

    Each row is what `answer` gives for that query alone.
    """
    listed = []
    for i, (name, q) in enumerate(queries.items()):
        value, valid = _answer_column(i, q)
        listed.append(F.struct(F.lit(name).alias("task"), value.alias("answer"), valid.alias("valid")))
    return _totals(queries, logs, points).select("query_id", F.inline(F.array(*listed)))


def workload(queries: dict[str, WindowQuery], logs: dict[str, Log], points: DataFrame) -> DataFrame:
    """As `answers`, with a column per name."""
    return _totals(queries, logs, points).select("query_id", *[_answer_column(i, q)[0].alias(name) for i, (name, q) in enumerate(queries.items())])


def generate(table: str, categories: dict[str, list[str]], numbers: list[str], n: int, seed: int, held_out: frozenset[str] = frozenset()) -> dict[str, WindowQuery]:
    """n random queries by signature; a ratio always has a filter, value sets at most four values."""
    draw, found = random.Random(seed), {}
    while len(found) < n:
        agg = draw.choice(["occur", "count", "sum", "mean", "ratio"])
        filters = []
        if agg == "ratio" or draw.random() < 0.5:
            column = draw.choice(sorted(categories))
            values = tuple(sorted(draw.sample(categories[column], draw.randint(1, min(4, len(categories[column]))))))
            filters.append(Filter(table, column, draw.choice(["in", "not_in"]), values))
        value = draw.choice(numbers) if agg in ("sum", "mean") else None
        query = WindowQuery((table,), agg, tuple(filters), k=draw.randint(0, 2) if agg == "occur" else 0, value=value, denominator=() if agg == "ratio" else None)
        signature = f"{agg}_{value or 'rows'}_" + "_".join(f"{f.column}_{f.op}_{len(f.value)}" for f in filters)
        if signature not in held_out:
            found.setdefault(signature, query)
    return found


def filter_audit(spark: SparkSession, queries: dict[str, WindowQuery], vocab: DataFrame) -> DataFrame:
    """`name, table_name, column_name, value` of every categorical filter value that the vocabulary lacks.

    A value is also looked for as it is spelled as a number with and without
    decimals. The list of filters is part of the program, so it is small.
    """
    wanted = []
    for name, q in queries.items():
        for f in (*q.filters, *(q.denominator or ())):
            if f.op in ("in", "not_in"):
                wanted += [(name, f.table, f.column, str(v), [str(v), *_spellings(v)]) for v in f.value]
    listed = spark.createDataFrame(wanted, "name string, table_name string, column_name string, wanted string, spellings array<string>")
    tried = listed.withColumn("value", F.explode("spellings"))
    found = tried.join(vocab.select("table_name", "column_name", "value").distinct(), ["table_name", "column_name", "value"], "left_semi")
    keys = ["name", "table_name", "column_name", "wanted"]
    return listed.select(keys).join(found.select(keys).distinct(), keys, "left_anti").withColumnRenamed("wanted", "value")


def _spellings(value: object) -> list[str]:
    try:
        number = float(str(value))
    except ValueError:
        return []
    return [str(number), *([str(int(number))] if number == int(number) else [])]
