"""Queries of window targets and the window language."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.exprs import signed_exp, signed_log
from tidelog.operators import events, targets, timeline, typing_rules
from tidelog.operators import window_language as wl
from tidelog.plans.feature_queries import CCUT, CD, CUT, D, rounded
from tidelog.plans.registry import EV, L, O, query
from tidelog.sources.tables import read_database, read_table
from tidelog.spec import CLICKS, DAY, SHOP

#: Query points whose windows end by the cutoff: customers of the shop, and of the clicks.
T0, CT0 = CUT - D, CCUT - CD
Q = f"q AS (SELECT c_custkey AS query_id, c_custkey AS entity_id, {T0} AS t_q, {D} AS horizon_s FROM customer)"
QC = f"q AS (SELECT c_custkey AS query_id, c_custkey AS entity_id, {CT0} AS t_q, {CD} AS horizon_s FROM customer)"


def customers(spark: SparkSession, sf: str, t_q: int = T0, horizon: int = D) -> DataFrame:
    return read_table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_custkey").alias("entity_id"), F.lit(t_q).cast("long").alias("t_q"), F.lit(horizon).cast("long").alias("horizon_s"))


def _span(frame: DataFrame, time_col: str, after: int | None, until: int | None) -> DataFrame:
    frame = frame if after is None else events.later_than(frame, after, time_col)
    return frame if until is None else events.cutoff_filter(frame, until, time_col)


def orders_log(spark: SparkSession, sf: str, after: int | None = None, until: int | None = None) -> DataFrame:
    """Orders in (after, until]; both bounds reach the scan."""
    orders = _span(read_database(spark, sf, SHOP)["orders"], SHOP["orders"].time_col, after, until)
    return orders.withColumnsRenamed({"o_custkey": "entity_id", "o_orderkey": "row_key"}).withColumn("table_idx", F.lit(0))


def clicks_log(spark: SparkSession, sf: str, after: int | None = None, until: int | None = None) -> DataFrame:
    """Clicks in (after, until]; both bounds reach the scan."""
    clicks = _span(read_database(spark, sf, CLICKS)["events"], CLICKS["events"].time_col, after, until)
    return clicks.withColumnsRenamed({"user_id": "entity_id", "event_id": "row_key"}).withColumn("table_idx", F.lit(0))


def shipped(spark: SparkSession, sf: str, after: int | None = None, until: int | None = None) -> DataFrame:
    """Line items in (after, until]; both bounds reach the scan."""
    return _span(read_database(spark, sf, SHOP)["lineitem"], SHOP["lineitem"].time_col, after, until)


def lines_log(spark: SparkSession, sf: str, after: int | None = None, until: int | None = None) -> DataFrame:
    """Line items in (after, until], under the customer of their order; both bounds reach the scan."""
    tables = read_database(spark, sf, SHOP)
    owner = tables["orders"].select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("entity_id"))
    return shipped(spark, sf, after, until).join(owner, "l_orderkey").withColumn("row_key", F.expr(SHOP["lineitem"].key)).withColumn("table_idx", F.lit(1))


@query()
def w1_sample_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Query times and horizons, log-uniform ones and log-normal ones about 90 days."""
    log = orders_log(spark, sf)
    drawn = [targets.sample_queries(log, CUT, 4, seed, centre=centre).withColumn("aimed", F.lit(centre is not None)) for seed, centre in ((7, None), (17, 90.0))]
    return drawn[0].unionByName(drawn[1])


@query()
def w2_dense_queries(spark: SparkSession, sf: str) -> DataFrame:
    log = orders_log(spark, sf, until=CUT)
    return targets.sample_dense_queries(log.select("entity_id", "t", "row_key", "table_idx"), CUT, 4, D, seed=11)


@query(f"WITH {O} SELECT c_custkey AS query_id, c_custkey AS entity_id, count(t) AS n_orders FROM customer LEFT JOIN o ON o_custkey = c_custkey AND t > {CUT} AND t <= {CUT + D} GROUP BY ALL")
def w3_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of each customer in the horizon after the cutoff, zeros kept."""
    log = orders_log(spark, sf, CUT, CUT + D)
    return timeline.window_sums(log, customers(spark, sf, CUT), {"n_orders": F.lit(1).cast("long")})


@query(f"WITH {EV}, {QC} SELECT query_id, event_type AS value, count(*) AS n FROM q JOIN ev ON user_id = entity_id AND t > t_q AND t <= t_q + horizon_s WHERE event_type IS NOT NULL GROUP BY ALL")
def w4_category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return targets.category_counts(targets.windowed(customers(spark, sf, CT0, CD), clicks_log(spark, sf, CT0, CT0 + CD)), "event_type")


#: The last column is mostly zeros, so that its quantiles fall together and are snapped forward.
_EDGE_COLUMNS = (("lineitem", "l_quantity", "l_quantity"), ("orders", "o_totalprice", "o_totalprice"), ("lineitem", "large_quantity", "greatest(l_quantity - 40, 0)"))
_EDGE_VALUES = {"lineitem": f"(SELECT * FROM l WHERE t <= {CUT})", "orders": f"(SELECT * FROM o WHERE t <= {CUT})"}


def _quantile_arm(column: str) -> str:
    """Edges of one column: with j the nearest separator of quantile i, the one taken is the largest of j + (i - i') over all i' up to i."""
    arms = " UNION ALL ".join(f"SELECT {i} AS i, quantile_cont(v, {i / 8}) AS x FROM v_{column}" for i in range(1, 8))
    return f"""SELECT '{column}' AS column_name, CAST(p.i - 1 AS INT) AS edge_no, round(s.m + (p.i - 1) * 1e-6, 7) AS edge FROM (
        SELECT i, least(i + max(j - i) OVER (ORDER BY i), (SELECT max(j) FROM s_{column})) AS j FROM (
            SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY abs(m - x), j) AS nth FROM ({arms}) q, s_{column}) WHERE nth = 1) p
        JOIN s_{column} s USING (j)"""


def _edge_values(table: str, column: str, sql: str) -> str:
    between = f"SELECT (v + lead(v) OVER (ORDER BY v)) / 2 AS m FROM (SELECT DISTINCT v FROM v_{column})"
    return f"v_{column} AS (SELECT CAST({sql} AS DOUBLE) AS v FROM {_EDGE_VALUES[table]}), s_{column} AS (SELECT m, row_number() OVER (ORDER BY m) AS j FROM ({between}) WHERE m IS NOT NULL)"


@query(f"""WITH {O}, {L}, {", ".join(_edge_values(*c) for c in _EDGE_COLUMNS)} {" UNION ALL ".join(_quantile_arm(c) for _, c, _ in _EDGE_COLUMNS)}""")
def w5_bucket_edges(spark: SparkSession, sf: str) -> DataFrame:
    tables = events.before(SHOP, read_database(spark, sf, SHOP), CUT)
    arms = []
    for table, column, sql in _EDGE_COLUMNS:
        edges = targets.bucket_edges(tables[table].select(F.expr(sql).alias(column)), column)
        listed = F.posexplode(F.array(*map(F.lit, edges))).alias("edge_no", "edge")
        arms.append(spark.range(1).select(F.lit(column).alias("column_name"), listed).withColumn("edge", F.round("edge", 7)))
    return reduce(DataFrame.unionByName, arms)


_EDGES = [6.5, 12.5, 18.5, 25.5, 31.5, 38.5, 44.5]
_BUCKET_SQL = " + ".join(f"CASE WHEN l_quantity > {e} THEN 1 ELSE 0 END" for e in _EDGES)


@query(f"""WITH {O}, {L}, {Q} SELECT query_id, CAST({_BUCKET_SQL} AS INT) AS bucket, count(*) AS n, round(avg(l_quantity), 6) AS centre
    FROM q JOIN o ON o_custkey = entity_id JOIN l ON l_orderkey = o_orderkey AND l.t > t_q AND l.t <= t_q + horizon_s GROUP BY ALL""")
def w6_window_bucket_counts(spark: SparkSession, sf: str) -> DataFrame:
    inside = targets.windowed(customers(spark, sf), lines_log(spark, sf, T0, T0 + D)).filter("t is not null")
    return inside.groupBy("query_id", targets.bucket_of(F.col("l_quantity"), _EDGES).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("centre"))


@query(f"""WITH {O}, {Q}, s AS (SELECT query_id, coalesce(sum(o_totalprice), 0) AS x FROM q LEFT JOIN o ON o_custkey = entity_id AND t > t_q AND t <= t_q + horizon_s GROUP BY 1)
    SELECT query_id, round(x, 4) AS raw_sum, round(sign(x) * ln(1 + abs(x)), 6) AS signed_log, round(x, 4) AS back FROM s""")
def w7_window_sums(spark: SparkSession, sf: str) -> DataFrame:
    sums = targets.windowed(customers(spark, sf), orders_log(spark, sf, T0, T0 + D)).groupBy("query_id").agg(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("x"))
    log = signed_log(F.col("x"))
    return sums.select("query_id", F.round("x", 4).alias("raw_sum"), F.round(log, 6).alias("signed_log"), F.round(signed_exp(log), 4).alias("back"))


@query()
def w8_capped_detail(spark: SparkSession, sf: str) -> DataFrame:
    inside = targets.windowed(customers(spark, sf, CCUT - 21 * DAY, 21 * DAY), clicks_log(spark, sf, CCUT - 21 * DAY, CCUT))
    return targets.capped_detail(inside, most=16).select("query_id", "row_key", "t", "weight")


@query(f"""WITH {EV}, k AS (SELECT * FROM ev WHERE t <= {CCUT}), n AS (SELECT user_id AS entity_id, event_id AS row_key, t, lead(t) OVER w AS up, lead(event_type) OVER w AS ty FROM k WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
    SELECT entity_id, row_key, t, greatest(1, coalesce(up, {CCUT}) - t) AS gap, up IS NULL AS censored, ty AS next_event_type FROM n""")
def w9_next_events(spark: SparkSession, sf: str) -> DataFrame:
    log = clicks_log(spark, sf, until=CCUT)
    return targets.next_events(log, CCUT, ["event_type"]).drop("next_table")


def _supplier_points(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("query_id"), F.col("s_suppkey").alias("entity_id"), F.lit(T0).cast("long").alias("t_q"), F.lit(D).cast("long").alias("horizon_s"))


def _supplier_links(spark: SparkSession, sf: str) -> DataFrame:
    return shipped(spark, sf, T0, T0 + D).select(F.col("l_suppkey").alias("entity_id"), F.col("l_partkey").alias("dst"), "t")


@query(f"""WITH {L}, f AS (SELECT l_suppkey AS query_id, l_partkey AS dst, min(t) AS t FROM l WHERE t > {T0} AND t <= {T0 + D} GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY t, dst) AS n FROM f)
    SELECT s_suppkey AS query_id, coalesce(string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst), '') AS destinations FROM supplier LEFT JOIN r ON query_id = s_suppkey AND n <= 8 GROUP BY 1""")
def w10_window_destinations(spark: SparkSession, sf: str) -> DataFrame:
    found = targets.window_destinations(_supplier_points(spark, sf), _supplier_links(spark, sf), CUT)
    return found.select("query_id", F.array_join("destinations", ",").alias("destinations"))


@query(f"""WITH {L}, p AS (SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b, a.t AS t FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey WHERE a.t <= {CUT} AND b.t <= {CUT} AND a.l_linenumber = 1 AND b.l_linenumber = 2)
    SELECT a AS entity_id, b AS dst, t FROM p WHERE a <> b UNION ALL SELECT b, a, t FROM p WHERE a <> b""")
def w11_other_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of the first two lines of an order: a fact with two links to one entity."""
    lines = events.before(SHOP, read_database(spark, sf, SHOP), CUT)["lineitem"]
    first = lines.filter("l_linenumber = 1").select("l_orderkey", F.col("l_suppkey").alias("a"), "t")
    # the second end is a row of its own, so it has to be there by the cutoff, too
    second = lines.filter("l_linenumber = 2").select("l_orderkey", F.col("l_suppkey").alias("b"))
    a, b = targets.destination_slot("supplier", {"a": "supplier", "b": "supplier"})
    return targets.other_ends(first.join(second, "l_orderkey").select("a", "b", "t").distinct(), a, b)


@query(f"""WITH {O}, {L} SELECT l_suppkey AS entity_id, o_custkey AS dst, l.t AS t, count(*) AS n FROM l JOIN o ON o_orderkey = l_orderkey WHERE l.t > {T0} AND l.t <= {T0 + D} AND o_custkey IS NOT NULL GROUP BY ALL""")
def w12_path_retarget(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' orders replaced by the customers behind them."""
    tables = read_database(spark, sf, SHOP)
    links = shipped(spark, sf, T0, T0 + D).select(F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("dst"), "t")
    path = tables["orders"].filter("o_custkey is not null").select(F.col("o_orderkey").alias("inter"), F.col("o_custkey").alias("final"))
    return targets.path_retarget(links, path).groupBy("entity_id", "dst", "t").agg(F.count("*").alias("n"))


@query(f"WITH {O} SELECT count(*) AS seen, count(*) FILTER (t + {D} > {CUT}) AS dropped FROM o")
def w13_drop_accounting(spark: SparkSession, sf: str) -> DataFrame:
    points = orders_log(spark, sf).select(F.col("t").alias("t_q"), F.lit(D).cast("long").alias("horizon_s"))
    return targets.drop_accounting(points, CUT)


# the window language ----------------------------------------------------------------------------------------------

_URGENT = wl.Filter("orders", "o_orderpriority", "in", ("1-URGENT", "2-HIGH"))
_NOT_F = wl.Filter("orders", "o_orderstatus", "not_in", ("F",))
_CHEAP = wl.Filter("orders", "o_totalprice", "le", 100000.0)
_DEAR = wl.Filter("orders", "o_totalprice", "gt", 150000.0)
_BUY = wl.Filter("events", "event_type", "in", ("purchase",))
_SEEN = wl.Filter("events", "event_type", "in", ("view", "click"))
_BIG = wl.Filter("events", "value", "gt", 50.0)
_RETURNED = wl.Filter("lineitem", "l_returnflag", "in", ("R",))
_MANY = wl.Filter("lineitem", "l_quantity", "gt", 25.0)
W = wl.WindowQuery
#: Named tasks over both databases.
TASKS: dict[str, wl.WindowQuery] = {
    "customer_churn": W(("orders",), absence=True),
    "customer_active": W(("orders",)),
    "customer_repeat": W(("orders",), k=1),
    "urgent_order": W(("orders",), filters=(_URGENT,)),
    "order_count": W(("orders",), "count"),
    "open_order_count": W(("orders",), "count", (_NOT_F,)),
    "cheap_order_count": W(("orders",), "count", (_CHEAP,)),
    "customer_ltv": W(("orders",), "sum", value="o_totalprice"),
    "dear_order_value": W(("orders",), "sum", (_DEAR,), value="o_totalprice"),
    "mean_order_price": W(("orders",), "mean", value="o_totalprice"),
    "urgent_share": W(("orders",), "ratio", (_URGENT,), denominator=()),
    "dear_urgent": W(("orders",), filters=(_URGENT, _DEAR)),
    "shipments": W(("lineitem",), "count"),
    "returns": W(("lineitem",), filters=(_RETURNED,)),
    "return_share": W(("lineitem",), "ratio", (_RETURNED,), denominator=(_MANY,)),
    "quantity_shipped": W(("lineitem",), "sum", value="l_quantity"),
    "orders_or_shipments": W(("orders", "lineitem"), "count"),
    "user_purchase": W(("events",), filters=(_BUY,)),
    "user_churn": W(("events",), absence=True),
    "purchase_value": W(("events",), "sum", (_BUY,), value="value"),
    "purchase_per_view": W(("events",), "ratio", (_BUY,), denominator=(_SEEN,)),
}


def _is_clicks(q: wl.WindowQuery) -> bool:
    return q.tables == ("events",)


def _logs(spark: SparkSession, sf: str) -> dict[str, wl.Log]:
    return {"orders": partial(orders_log, spark, sf), "lineitem": partial(lines_log, spark, sf), "events": partial(clicks_log, spark, sf)}


def _condition(filters: tuple[wl.Filter, ...], table: str) -> str:
    parts = []
    for f in filters:
        if f.table == table:
            values = ", ".join(f"'{v}'" for v in f.value) if isinstance(f.value, tuple) else ""
            parts.append({"in": f"{f.column} IN ({values})", "not_in": f"{f.column} NOT IN ({values})", "le": f"{f.column} <= {f.value}", "gt": f"{f.column} > {f.value}"}[f.op])
    return " AND ".join(parts) or "true"


_SQL_LOGS = {"orders": "SELECT o_custkey AS e, t, * EXCLUDE (t) FROM o", "lineitem": "SELECT o_custkey AS e, l.t AS t, l.* EXCLUDE (t) FROM l JOIN o ON l_orderkey = o_orderkey", "events": "SELECT user_id AS e, t, * EXCLUDE (t) FROM ev"}


def answer_sql(q: wl.WindowQuery, weight: str = "1.0") -> str:
    """`query_id, answer, valid` of one query in SQL."""
    arms = " UNION ALL ".join(
        f"SELECT e, t, coalesce({_condition(q.filters, t)}, false) AS hit, coalesce({_condition(q.denominator or (), t)}, false) AS base, {q.value or 'NULL'} AS x, {weight} AS w FROM ({_SQL_LOGS[t]})" for t in q.tables
    )
    hits, total = "coalesce(sum(w) FILTER (hit), 0.0)", "coalesce(sum(w * x) FILTER (hit), 0.0)"
    under = "coalesce(sum(w) FILTER (hit AND x IS NOT NULL), 0.0)" if q.agg == "mean" else "coalesce(sum(w) FILTER (base), 0.0)"
    value = {"occur": f"CASE WHEN ({hits} > {q.k}) <> {str(q.absence).lower()} THEN 1.0 ELSE 0.0 END", "count": hits, "sum": total, "mean": f"CASE WHEN {under} > 0 THEN {total} / {under} END", "ratio": f"CASE WHEN {under} > 0 THEN {hits} / {under} END"}[q.agg]
    valid = f"{under} > 0" if q.agg in ("mean", "ratio") else "true"
    t_q, horizon = (CT0, CD) if _is_clicks(q) else (T0, D)
    return f"SELECT c_custkey AS query_id, CAST(round({value}, 6) AS DOUBLE) AS answer, {valid} AS valid FROM customer LEFT JOIN ({arms}) ON e = c_custkey AND t > {t_q} AND t <= {t_q + horizon} GROUP BY c_custkey"


def _answers(spark: SparkSession, sf: str, names: list[str]) -> DataFrame:
    """The named tasks, those of each database compiled together."""
    logs = _logs(spark, sf)
    halves = [({n: TASKS[n] for n in names if _is_clicks(TASKS[n]) == clicks}, customers(spark, sf, CT0, CD) if clicks else customers(spark, sf)) for clicks in (False, True)]
    return reduce(DataFrame.unionByName, [rounded(wl.answers(own, logs, points)) for own, points in halves if own])


def _answers_sql(names: list[str]) -> str:
    return f"WITH {O}, {L}, {EV} " + " UNION ALL ".join(f"SELECT *, '{n}' AS task FROM ({answer_sql(TASKS[n])})" for n in names)


_LABELS = ["customer_churn", "urgent_order", "customer_ltv", "mean_order_price", "urgent_share"]


@query(_answers_sql(_LABELS))
def q1_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf, _LABELS)


_WEIGHTED = W(("events",), "mean", (_BIG,), value="value")


@query(f"WITH {O}, {L}, {EV} " + answer_sql(_WEIGHTED, "1.0 + (event_id % 2) * 0.5"))
def q2_weighted_answer(spark: SparkSession, sf: str) -> DataFrame:
    """A mean over rows that stand for more than one event each."""
    weighted = lambda after, until: clicks_log(spark, sf, after, until).withColumn("weight", 1.0 + (F.col("row_key") % 2) * 0.5)
    return rounded(wl.answers({"weighted": _WEIGHTED}, {"events": weighted}, customers(spark, sf, CT0, CD))).drop("task")


_SUSPECT = {"good": W(("orders",), filters=(_URGENT,)), "bad": W(("orders",), filters=(wl.Filter("orders", "o_orderpriority", "in", ("1-URGENT", "9-NEVER")),)), "number": W(("lineitem",), filters=(wl.Filter("lineitem", "l_linenumber", "in", ("1.0", "99")),))}


@query(f"""WITH {O}, {L}, w AS (SELECT * FROM (VALUES ('good', 'orders', 'o_orderpriority', '1-URGENT'), ('good', 'orders', 'o_orderpriority', '2-HIGH'), ('bad', 'orders', 'o_orderpriority', '1-URGENT'), ('bad', 'orders', 'o_orderpriority', '9-NEVER'),
    ('number', 'lineitem', 'l_linenumber', '1.0'), ('number', 'lineitem', 'l_linenumber', '99')) v(name, table_name, column_name, value)),
    vocab AS (SELECT DISTINCT o_orderpriority AS v FROM o WHERE t <= {CUT} UNION SELECT DISTINCT CAST(l_linenumber AS VARCHAR) FROM l WHERE t <= {CUT})
    SELECT * FROM w WHERE value NOT IN (SELECT v FROM vocab) AND coalesce(CAST(CAST(try_cast(value AS DOUBLE) AS BIGINT) AS VARCHAR), value) NOT IN (SELECT v FROM vocab)""")
def q6_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    tables = events.before(SHOP, read_database(spark, sf, SHOP), CUT)
    vocab = typing_rules.vocabulary(SHOP["orders"], tables["orders"], ["o_orderpriority"]).unionByName(typing_rules.vocabulary(SHOP["lineitem"], tables["lineitem"], ["l_linenumber"]))
    return wl.filter_audit(spark, _SUSPECT, vocab)


@query(f"WITH {O}, {L}, {EV} " + " UNION ALL ".join(f"SELECT '{n}' AS task, count(*) AS n_queries, count(*) FILTER (valid) AS n_valid, round(coalesce(sum(answer), 0), 2) AS total FROM ({answer_sql(q)})" for n, q in TASKS.items()))
def q7_task_registry(spark: SparkSession, sf: str) -> DataFrame:
    """All tasks in one read of each of the three logs."""
    total = F.round(F.coalesce(F.sum("answer"), F.lit(0.0)), 2)
    return _answers(spark, sf, list(TASKS)).groupBy("task").agg(F.count("*").alias("n_queries"), F.count_if("valid").alias("n_valid"), total.alias("total"))


_WORK = {n: q for n, q in TASKS.items() if q.tables == ("orders",)} | wl.generate("orders", {"o_orderstatus": ["F", "O", "P"], "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}, ["o_totalprice"], 8, seed=3, held_out=frozenset({"count_rows_"}))


@query(f"WITH {O}, {L}, {EV} SELECT query_id, {', '.join(f't{i}.answer AS "{n}"' for i, n in enumerate(_WORK))} FROM " + " JOIN ".join(f"({answer_sql(q)}) t{i}" + (" USING (query_id)" if i else "") for i, q in enumerate(_WORK.values())))
def q8_query_workload(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(wl.workload(_WORK, _logs(spark, sf), customers(spark, sf)))
