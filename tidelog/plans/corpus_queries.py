"""Queries of sources, typing, the event log and derived columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import denorm, events, typing_rules
from tidelog.plans.registry import EV, L, O, query
from tidelog.sources.tables import profile, read_database, read_table
from tidelog.spec import CLICKS, SHOP, DatabaseSpec

CUT = SHOP.cutoff
#: Before this time some categories of the shop haven't been seen yet: 1997-07-01.
EARLY = 867715200
#: Kinds of the columns of the two databases, by the types of their values.
SHOP_NUMBERS = {"nation": [], "region": [], "customer": ["c_acctbal"], "supplier": ["s_acctbal"], "part": ["p_size", "p_retailprice"], "orders": ["o_totalprice"], "lineitem": ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]}
SHOP_STRINGS = {"region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"]}
NUMERIC = {"customer": ["c_acctbal"], "supplier": ["s_acctbal"], "part": ["p_size", "p_retailprice"], "orders": ["o_totalprice"], "lineitem": ["l_quantity", "l_extendedprice"]}
VOCAB = {"nation": ["n_name"], "customer": ["c_mktsegment"], "part": ["p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]}
_RAW = {"orders": "(SELECT * FROM o WHERE t <= {cut})", "lineitem": "(SELECT * FROM l WHERE t <= {cut})"}


def _known(table: str, cut: int = CUT) -> str:
    return _RAW.get(table, table).format(cut=cut)


def _shop(spark: SparkSession, sf: str, cut: int = CUT) -> dict[str, DataFrame]:
    return events.before(SHOP, read_database(spark, sf, SHOP), cut)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _profile_sql(spec: DatabaseSpec) -> str:
    rows, entities = [], {e.name for e in spec.entities}
    for t in spec.tables:
        time = {"orders": "epoch(o_orderdate)", "lineitem": "epoch(l_shipdate)", "events": "floor(epoch_us(ts) / 1000000.0)"}.get(t.name)
        nulls = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in t.fkeys) or "0"
        lost = " + ".join(f"(SELECT count(*) FROM {t.name} x WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {to} y WHERE y.{spec[to].pkey} = x.{c}))" for c, to in t.fkeys.items()) or "0"
        rows.append(
            f"SELECT '{t.name}' AS table_name, '{'fact' if t.is_fact else 'dimension'}' AS kind, {t.name in entities} AS is_entity, "
            f"CAST({spec.table_idx(t.name) if t.is_fact else 'NULL'} AS INT) AS table_idx, count(*) AS n_rows, "
            f"CAST({f'min({time})' if time else 'NULL'} AS BIGINT) AS min_t, CAST({f'max({time})' if time else 'NULL'} AS BIGINT) AS max_t, "
            f"CAST({nulls} AS BIGINT) AS null_links, CAST({lost} AS BIGINT) AS dangling_links, "
            f"CAST({f'count({t.pkey}) - count(DISTINCT {t.pkey})' if t.pkey else '0'} AS BIGINT) AS duplicate_keys FROM {t.name}"
        )
    return " UNION ALL ".join(rows)


@query(_profile_sql(SHOP))
def s1_database_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile(SHOP, read_database(spark, sf, SHOP))


@query(_profile_sql(CLICKS))
def s1_clicks_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile(CLICKS, read_database(spark, sf, CLICKS))


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS row_index FROM customer")
def t2_entity_index(spark: SparkSession, sf: str) -> DataFrame:
    return typing_rules.entity_index(read_table(spark, sf, "customer"), "c_custkey")


def _spec_sql() -> str:
    arms = []
    for table in SHOP_STRINGS:
        for c in SHOP_NUMBERS[table] + SHOP_STRINGS[table]:
            number = "true" if c in SHOP_NUMBERS[table] else "false"
            arms.append(f"SELECT '{table}' AS table_name, '{c}' AS column_name, {number} AS number, count(DISTINCT {c}) AS n_distinct, count({c}) AS n_known FROM {_known(table)}")
    return f"""WITH {O}, {L}, s AS ({" UNION ALL ".join(arms)})
        SELECT table_name, column_name, n_distinct, n_known,
               CASE WHEN number AND n_distinct > 20 THEN 'numeric' WHEN n_distinct > 1024 AND n_distinct > 0.2 * n_known THEN 'drop'
                    WHEN n_distinct > 1024 THEN 'hashed' ELSE 'vocab' END AS kind FROM s"""


@query(_spec_sql())
def t3_column_spec(spark: SparkSession, sf: str) -> DataFrame:
    shop = _shop(spark, sf)
    return _union([typing_rules.column_spec(SHOP[t], shop[t]) for t in SHOP_STRINGS])


_STATS_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, round(avg({c}), 4) AS mean, round(CASE WHEN coalesce(stddev_samp({c}), 0) = 0 THEN 1.0 ELSE stddev_samp({c}) END, 4) AS std FROM {_known(t)}"
    for t, columns in NUMERIC.items()
    for c in columns
)


@query(f"WITH {O}, {L} {_STATS_SQL}")
def t4_numeric_stats(spark: SparkSession, sf: str) -> DataFrame:
    shop = _shop(spark, sf)
    return _union([typing_rules.numeric_stats(SHOP[t], shop[t], c) for t, c in NUMERIC.items()]).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


def _vocab_sql(cut: int = CUT, columns: dict[str, list[str]] | None = None) -> str:
    arms = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {_known(t, cut)}" for t, cs in (columns or VOCAB).items() for c in cs)
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY table_name, column_name ORDER BY value) AS INT) AS code FROM ({arms}) WHERE value IS NOT NULL"


@query(f"WITH {O}, {L} {_vocab_sql()}")
def t5_categorical_vocab(spark: SparkSession, sf: str) -> DataFrame:
    shop = _shop(spark, sf)
    return _union([typing_rules.vocabulary(SHOP[t], shop[t], c) for t, c in VOCAB.items()])


@query()
def t6_hash_category(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "customer").select("c_custkey", typing_rules.hash_category(F.col("c_name")).alias("bucket"))


@query(f"""WITH {O}, {L}, y AS (SELECT *, CAST(year(o_orderdate) AS VARCHAR) || '-' || o_orderstatus AS season FROM o),
    old AS (SELECT DISTINCT season AS value FROM y WHERE t <= {EARLY}), new AS (SELECT DISTINCT season AS value FROM y WHERE t <= {CUT}),
    a AS (SELECT value, CAST(row_number() OVER (ORDER BY value) AS INT) AS old_code FROM old), b AS (SELECT value, CAST(row_number() OVER (ORDER BY value) AS INT) AS new_code FROM new)
    SELECT 'orders' AS table_name, 'season' AS column_name, value, old_code, new_code FROM a FULL JOIN b USING (value) WHERE old_code IS DISTINCT FROM new_code""")  # fmt: skip
def t7_vocab_drift(spark: SparkSession, sf: str) -> DataFrame:
    seasons = read_database(spark, sf, SHOP)["orders"].withColumn("season", F.concat_ws("-", F.year("o_orderdate"), "o_orderstatus"))
    old, new = (typing_rules.vocabulary(SHOP["orders"], events.cutoff_filter(seasons, at), ["season"]) for at in (EARLY, CUT))
    return typing_rules.vocab_drift(old, new)


@query(f"WITH {O} SELECT o_orderkey, o_custkey, t FROM o WHERE t <= {CUT}")
def e1_cutoff_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _shop(spark, sf)["orders"].select("o_orderkey", "o_custkey", "t")


@query(f"""WITH {O}, {L}, e AS (SELECT t, 0 AS table_idx, o_orderkey AS row_key FROM o WHERE t <= {CUT} UNION ALL SELECT t, 1, l_orderkey * 10 + l_linenumber FROM l WHERE t <= {CUT})
    SELECT *, CAST(row_number() OVER (ORDER BY t, table_idx, row_key) - 1 AS BIGINT) AS position FROM e""")
def e2_event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return events.positions(events.event_stream(SHOP, read_database(spark, sf, SHOP), CUT))


@query(f"""WITH {L}, k AS (SELECT * FROM l WHERE t <= {CUT}), s AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS d, avg(l_extendedprice) AS m2, stddev_samp(l_extendedprice) AS d2 FROM k)
    SELECT l_orderkey, l_linenumber, round(coalesce((l_quantity - m) / d, 0), 6) AS z_quantity, round(coalesce((l_extendedprice - m2) / d2, 0), 6) AS z_price FROM k, s""")
def e3_standardize(spark: SparkSession, sf: str) -> DataFrame:
    lines = _shop(spark, sf)["lineitem"]
    stats = typing_rules.numeric_stats(SHOP["lineitem"], lines, ["l_quantity", "l_extendedprice"]).groupBy().pivot("column_name", ["l_quantity", "l_extendedprice"]).agg(F.first("mean").alias("m"), F.first("std").alias("s"))
    joined = lines.crossJoin(F.broadcast(stats))
    z = {"z_quantity": "l_quantity", "z_price": "l_extendedprice"}
    return joined.select("l_orderkey", "l_linenumber", *[F.round(events.standardized(F.col(c), F.col(f"{c}_m"), F.col(f"{c}_s")), 6).alias(n) for n, c in z.items()])


@query(f"""WITH {O}, {L}, v AS ({_vocab_sql(EARLY, {"part": ["p_brand"], "orders": ["o_orderpriority"]})})
    SELECT o_orderkey, coalesce(code, 0) AS priority_code FROM o LEFT JOIN v ON v.column_name = 'o_orderpriority' AND value = o_orderpriority WHERE t <= {CUT}""")
def e4_encode_categorical(spark: SparkSession, sf: str) -> DataFrame:
    vocab = typing_rules.vocabulary(SHOP["orders"], _shop(spark, sf, EARLY)["orders"], ["o_orderpriority"])
    return events.encode(_shop(spark, sf)["orders"], "o_orderpriority", vocab, "priority_code").select("o_orderkey", "priority_code")


@query("SELECT event_id, user_id, c_custkey AS linked FROM events LEFT JOIN customer ON user_id = c_custkey")
def e5_resolve_links(spark: SparkSession, sf: str) -> DataFrame:
    return events.resolve_links(read_table(spark, sf, "events"), "user_id", read_table(spark, sf, "customer"), "c_custkey").select("event_id", "user_id", "linked")


@query(f"""WITH {O}, {L} SELECT l_partkey AS entity_id, t, 1 AS table_idx, 'lineitem.l_partkey' AS slot, l_orderkey * 10 + l_linenumber AS row_key FROM l WHERE t <= {CUT} AND l_partkey IS NOT NULL""")
def e6_entity_histories(spark: SparkSession, sf: str) -> DataFrame:
    return events.histories(SHOP, read_database(spark, sf, SHOP), "part", CUT)


@query(f"""WITH {O}, {L} SELECT l_orderkey AS entity_id, t, 1 AS table_idx, 'lineitem.l_orderkey' AS slot, l_orderkey * 10 + l_linenumber AS row_key FROM l WHERE t <= {CUT} AND l_orderkey IS NOT NULL
    UNION ALL SELECT o_orderkey, t, 0, 'self', o_orderkey FROM o WHERE t <= {CUT}""")
def e7_self_rows(spark: SparkSession, sf: str) -> DataFrame:
    return events.histories(SHOP, read_database(spark, sf, SHOP), "orders", CUT, self_rows=True)


@query(f"""WITH {O}, {L} SELECT DISTINCT o_custkey AS entity_id, l_orderkey * 10 + l_linenumber AS row_key, min(l.t) OVER (PARTITION BY o_custkey, l_orderkey * 10 + l_linenumber) AS t
    FROM o JOIN l ON o_orderkey = l_orderkey AND o.t <= l.t WHERE l.t <= {CUT} AND o.t <= {CUT} AND o_custkey IS NOT NULL""")
def e8_path_expand(spark: SparkSession, sf: str) -> DataFrame:
    events.split_path("customer:orders:lineitem")
    shop = _shop(spark, sf)
    lines = shop["lineitem"].select("l_orderkey", F.expr(SHOP["lineitem"].key).cast("long").alias("row_key"), "t")
    lines = lines.groupBy("l_orderkey", "row_key", "t").agg(F.count("*").alias("n"))
    found = events.path_expand(shop["orders"], lines, "o_orderkey", "l_orderkey", "o_custkey")
    # keys of lines aren't unique here: the first time stands for a key
    reached = shop["orders"].select(F.col("o_orderkey").alias("l_orderkey"), F.col("t").alias("order_t"))
    first = lines.join(reached, "l_orderkey").filter("order_t <= t").groupBy("row_key").agg(F.min("t").alias("t"))
    return found.select("entity_id", "row_key").join(first, "row_key")


_QUERY_POINTS = f"SELECT c_custkey * 2 + j AS query_id, c_custkey AS entity_id, {CUT} - j * {180 * 86400} AS t_q FROM customer, range(2) r(j)"


def query_points(spark: SparkSession, sf: str) -> DataFrame:
    """Two query times for each customer: the cutoff and 180 days before."""
    back = F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))
    return read_table(spark, sf, "customer").select("c_custkey", back.alias("j")).select((F.col("c_custkey") * 2 + F.col("j")).alias("query_id"), F.col("c_custkey").alias("entity_id"), (CUT - F.col("j") * 180 * 86400).cast("long").alias("t_q"))


@query(f"""WITH {O}, q AS ({_QUERY_POINTS}), r AS (SELECT query_id, entity_id, t_q, t, o_orderkey AS row_key,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY t DESC, o_orderkey DESC) AS INT) AS back FROM q JOIN o ON o_custkey = entity_id AND t < t_q) SELECT * FROM r WHERE back <= 5""")
def e9_history_tail(spark: SparkSession, sf: str) -> DataFrame:
    history = events.histories(SHOP, read_database(spark, sf, SHOP), "customer", CUT)
    return events.history_tail(query_points(spark, sf), history, 5).select("query_id", "entity_id", "t_q", "t", "row_key", "back")


@query(f"""WITH {L} SELECT p_partkey AS entity_id, count(l_partkey) AS n_links FROM part LEFT JOIN (SELECT * FROM l WHERE t <= {CUT} AND t >= {CUT - 365 * 86400}) k ON l_partkey = p_partkey GROUP BY 1""")
def e10_link_counts(spark: SparkSession, sf: str) -> DataFrame:
    tables = read_database(spark, sf, SHOP)
    return events.link_counts(events.histories(SHOP, tables, "part", CUT), tables["part"], "p_partkey", CUT - 365 * 86400)


@query(f"""WITH {O}, {L}, {EV} SELECT t, 0 AS table_idx, 'clicks::events' AS table_name, event_id AS row_key FROM ev WHERE t <= {CLICKS.cutoff}
    UNION ALL SELECT t, 1, 'shop::orders', o_orderkey FROM o WHERE t <= {CUT} UNION ALL SELECT t, 2, 'shop::lineitem', l_orderkey * 10 + l_linenumber FROM l WHERE t <= {CUT}""")
def e11_union_databases(spark: SparkSession, sf: str) -> DataFrame:
    specs = {s.name: s for s in (SHOP, CLICKS)}
    return events.union_databases({n: events.event_stream(s, read_database(spark, sf, s), s.cutoff) for n, s in specs.items()}, specs)


@query(f"""WITH {EV} SELECT count(*) AS n_entities, count(u) AS n_reached, count(u) / count(*) AS share
    FROM customer LEFT JOIN (SELECT DISTINCT user_id AS u FROM ev WHERE t <= {CLICKS.cutoff}) ON u = c_custkey""")
def e12_reachability(spark: SparkSession, sf: str) -> DataFrame:
    tables = read_database(spark, sf, CLICKS)
    return events.reachability(events.histories(CLICKS, tables, "customer", CLICKS.cutoff), tables["customer"], "c_custkey", [0])


@query(f"""WITH {EV} SELECT event_id AS row_key, CAST((t // 86400 + 4) % 7 AS INT) AS weekday, CAST((t // 2592000) % 12 AS INT) AS month_bucket,
    round(ln(1 + coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id), 0) / 86400.0), 6) AS log_gap FROM ev WHERE t <= {CLICKS.cutoff}""")
def e13_calendar_gaps(spark: SparkSession, sf: str) -> DataFrame:
    history = events.histories(CLICKS, read_database(spark, sf, CLICKS), "customer", CLICKS.cutoff)
    return events.calendar_gaps(history).select("row_key", "weekday", "month_bucket", F.round("log_gap", 6).alias("log_gap"))


_D1_OUT = "l_orderkey, l_linenumber, l.t AS t, o_totalprice AS order__o_totalprice, o_orderpriority AS order__o_orderpriority, p_brand AS part__p_brand, p_size AS part__p_size"


@query(f"""WITH {O}, {L} SELECT {_D1_OUT} FROM (SELECT * FROM l WHERE t <= {CUT}) l LEFT JOIN o ON o_orderkey = l_orderkey AND o.t <= l.t AND o.t <= {CUT} LEFT JOIN part ON p_partkey = l_partkey""")
def d1_fk_target_columns(spark: SparkSession, sf: str) -> DataFrame:
    shop = _shop(spark, sf)
    timed = denorm.fk_target_columns(shop["lineitem"], "l_orderkey", shop["orders"], "o_orderkey", ["o_totalprice", "o_orderpriority"], "order", True, CUT)
    both = denorm.fk_target_columns(timed, "l_partkey", shop["part"], "p_partkey", ["p_brand", "p_size"], "part", False)
    return both.select("l_orderkey", "l_linenumber", "t", "order__o_totalprice", "order__o_orderpriority", "part__p_brand", "part__p_size")


_SLOTS = [("l_orderkey", 0, "orders", ["o_totalprice", "o_orderstatus", "o_orderpriority"]), ("l_partkey", 1, "part", ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]), ("l_suppkey", 2, "supplier", ["s_name", "s_acctbal"])]
_SLOT_SQL = " UNION ALL ".join(
    f"SELECT '{slot}' AS slot, {no} AS slot_no, '{c}' AS column_name, {place} AS place, {c in SHOP_NUMBERS[table]} AS number, count(DISTINCT {c}) AS n_distinct, count({c}) AS n_known FROM {_known(table)}"
    for slot, no, table, columns in _SLOTS
    for place, c in enumerate(columns)
)


@query(f"""WITH {O}, {L}, s AS ({_SLOT_SQL}), k AS (SELECT *, CASE WHEN number AND n_distinct > 20 THEN 'numeric' WHEN n_distinct > 1024 AND n_distinct > 0.2 * n_known THEN 'drop' WHEN n_distinct > 1024 THEN 'hashed' ELSE 'vocab' END AS kind FROM s),
    d AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY place) AS depth FROM k WHERE kind = 'numeric' OR (kind = 'vocab' AND n_distinct <= 64)),
    c AS (SELECT *, row_number() OVER (ORDER BY depth, slot_no) AS chosen FROM d) SELECT slot, column_name, kind, n_distinct, CAST(chosen AS INT) AS chosen FROM c WHERE chosen <= 16""")
def d2_budgeted_selection(spark: SparkSession, sf: str) -> DataFrame:
    shop = _shop(spark, sf)
    arms = []
    for slot, number, table, columns in _SLOTS:
        places = F.create_map(*[F.lit(x) for place, c in enumerate(columns) for x in (c, place)])
        stats = typing_rules.column_spec(SHOP[table], shop[table])
        arms.append(stats.select(F.lit(slot).alias("slot"), F.lit(number).alias("slot_no"), "column_name", places[F.col("column_name")].alias("place"), "kind", "n_distinct"))
    return denorm.budgeted_selection(_union(arms)).select("slot", "column_name", "kind", "n_distinct", "chosen")


@query(f"""WITH {O}, {L}, v AS (SELECT * FROM o JOIN l ON o_orderkey = l_orderkey AND l.t <= o.t WHERE o.t <= {CUT} AND l.t <= {CUT})
    SELECT k.o_orderkey AS parent_id, count(l_orderkey) AS n_children, round(coalesce(sum(l_quantity), 0), 4) AS l_quantity_sum, round(coalesce(sum(l_extendedprice), 0), 4) AS l_extendedprice_sum,
    count(*) FILTER (l_returnflag = 'A') AS "l_returnflag_A_n", count(*) FILTER (l_returnflag = 'N') AS "l_returnflag_N_n", count(*) FILTER (l_returnflag = 'R') AS "l_returnflag_R_n"
    FROM (SELECT * FROM o WHERE t <= {CUT}) k LEFT JOIN v ON v.o_orderkey = k.o_orderkey GROUP BY 1""")
def d3_d5_child_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    shop = _shop(spark, sf)
    visible = denorm.visible_children(shop["orders"], "o_orderkey", shop["lineitem"], "l_orderkey", True)
    done = denorm.child_aggregates(shop["orders"], "o_orderkey", visible, ["l_quantity", "l_extendedprice"], {"l_returnflag": ["A", "N", "R"]})
    return done.withColumns({c: F.round(c, 4) for c in ("l_quantity_sum", "l_extendedprice_sum")})


_KIND_SQL = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c in SHOP_NUMBERS['lineitem']} AS number, count(DISTINCT {c}) AS n_distinct, max(length(CAST({c} AS VARCHAR))) AS longest FROM {_known('lineitem')}" for c in SHOP_NUMBERS["lineitem"] + SHOP_STRINGS["lineitem"])


@query(f"""WITH {O}, {L}, s AS ({_KIND_SQL}) SELECT column_name, n_distinct, CASE WHEN number AND n_distinct > 20 THEN 'sum' WHEN n_distinct BETWEEN 1 AND 16 AND longest <= 64 THEN 'category' ELSE 'drop' END AS kind FROM s""")
def d6_child_column_kind(spark: SparkSession, sf: str) -> DataFrame:
    lines, columns = _shop(spark, sf)["lineitem"], SHOP_NUMBERS["lineitem"] + SHOP_STRINGS["lineitem"]
    return denorm.child_column_kinds(typing_rules.melted(SHOP["lineitem"], lines, columns), SHOP_NUMBERS["lineitem"]).select("column_name", "n_distinct", "kind")


_CHILD_COLUMNS = [*SHOP_NUMBERS["lineitem"], *SHOP_STRINGS["lineitem"]]
_PLACES = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(_CHILD_COLUMNS))
_CHILD_VALUES = " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {_known('lineitem')} WHERE {c} IS NOT NULL" for c in _CHILD_COLUMNS)


@query(f"""WITH {O}, {L}, s AS ({_KIND_SQL}), k AS (SELECT column_name, CASE column_name {_PLACES} END AS place, CASE WHEN number AND n_distinct > 20 THEN 'sum' WHEN n_distinct BETWEEN 1 AND 16 AND longest <= 64 THEN 'category' ELSE 'drop' END AS kind FROM s),
    a AS (SELECT 0 AS r, 0 AS place, NULL AS column_name, NULL AS value UNION ALL SELECT 1, place, column_name, NULL FROM k WHERE kind = 'sum' UNION ALL SELECT 2, place, column_name, value FROM k JOIN ({_CHILD_VALUES}) v USING (column_name) WHERE kind = 'category'),
    n AS (SELECT *, row_number() OVER (ORDER BY r, place, value) - 1 AS chosen FROM a)
    SELECT CAST(chosen AS INT) AS chosen, 'lineitem' AS child, column_name, value FROM n WHERE chosen < 32""")
def d6_budgeted_children(spark: SparkSession, sf: str) -> DataFrame:
    """The columns that an order gets from its line items within the budget."""
    lines = _shop(spark, sf)["lineitem"]
    melted = typing_rules.melted(SHOP["lineitem"], lines, _CHILD_COLUMNS)
    place = F.array_position(F.array(*map(F.lit, _CHILD_COLUMNS)), F.col("column_name")) - 1
    child = F.lit("lineitem").alias("child")
    kinds = denorm.child_column_kinds(melted, SHOP_NUMBERS["lineitem"]).select(F.lit(0).alias("child_no"), child, place.alias("place"), "column_name", "kind")
    values = melted.filter("value is not null").select(child, "column_name", F.col("value").cast("string").alias("value"))
    return denorm.budgeted_children(kinds, values)


@query(f"""WITH {O}, {L}, {EV} SELECT 0 AS table_idx, 'clicks::events' AS table_name, 'user_id' AS column_name, 'clicks::customer' AS target, count(user_id) AS n_links FROM ev WHERE t <= {CLICKS.cutoff}
    UNION ALL SELECT 1, 'shop::orders', 'o_custkey', 'shop::customer', count(o_custkey) FROM o WHERE t <= {CUT}
    {" ".join(f"UNION ALL SELECT 2, 'shop::lineitem', '{c}', 'shop::{to}', count({c}) FROM l WHERE t <= {CUT}" for c, to in SHOP["lineitem"].fkeys.items())}""")
def e11_union_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of two databases that share a table name, each to its own database's table."""
    specs = {s.name: s for s in (SHOP, CLICKS)}
    return events.link_targets({n: read_database(spark, sf, s) for n, s in specs.items()}, specs)
