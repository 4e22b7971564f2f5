"""Queries of point-in-time and pair features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import events, features, history_state, pairs
from tidelog.plans.corpus_queries import query_points
from tidelog.plans.registry import EV, L, O, ORACLES, query
from tidelog.sources.sinks import written
from tidelog.sources.tables import read_database, read_table
from tidelog.spec import CLICKS, DAY, SHOP

CUT, D, CCUT, CD = SHOP.cutoff, SHOP.horizon, CLICKS.cutoff, CLICKS.horizon
#: Query points of the shop and of the clicks, for use after WITH.
Q = f"q AS (SELECT c_custkey * 2 + j AS query_id, c_custkey AS entity_id, {CUT} - j * {180 * DAY} AS t_q, {D} AS horizon_s FROM customer, range(2) r(j))"
QC = f"q AS (SELECT c_custkey AS query_id, c_custkey AS entity_id, {CCUT} AS t_q, {CD} AS horizon_s FROM customer)"
#: Past orders of each query, and past clicks.
P = f"p AS (SELECT q.*, x.t, x.row_key FROM q LEFT JOIN (SELECT o_custkey AS e, t, o_orderkey AS row_key FROM o WHERE t <= {CUT}) x ON e = entity_id AND x.t < t_q)"
PC = f"p AS (SELECT q.*, x.t, x.row_key, x.event_type FROM q LEFT JOIN (SELECT user_id AS e, t, event_id AS row_key, event_type FROM ev WHERE t <= {CCUT}) x ON e = entity_id AND x.t < t_q)"
TYPES = ["click", "error", "purchase", "signup", "view"]


def shop_points(spark: SparkSession, sf: str) -> DataFrame:
    return query_points(spark, sf).withColumn("horizon_s", F.lit(D).cast("long"))


def shop_states(spark: SparkSession, sf: str) -> DataFrame:
    history = events.histories(SHOP, read_database(spark, sf, SHOP), "customer", CUT)
    return history_state.past_states(shop_points(spark, sf), history, {"orders": 0})


def click_points(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_custkey").alias("entity_id"), F.lit(CCUT).cast("long").alias("t_q"), F.lit(CD).cast("long").alias("horizon_s"))


def click_states(spark: SparkSession, sf: str) -> DataFrame:
    log = events.before(CLICKS, read_database(spark, sf, CLICKS), CCUT)["events"]
    history = log.select(F.col("user_id").alias("entity_id"), "t", F.lit(0).alias("table_idx"), "event_type")
    return history_state.past_states(click_points(spark, sf), history, {"events": 0}, {"event_type": TYPES})


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c, kind in frame.dtypes if kind == "double"})


@query(f"""WITH {O}, {Q}, {P} SELECT query_id, t_q, round(ln(1 + count(t)), 6) AS orders_n, round(coalesce(ln(1 + (t_q - max(t)) / 86400.0), 0), 6) AS orders_since,
    round(ln(1 + count(*) FILTER (t > t_q - horizon_s)), 6) AS orders_recent, round(ln(1 + count(t)), 6) AS all_n, round(coalesce(ln(1 + (t_q - min(t)) / 86400.0), 0), 6) AS all_first FROM p GROUP BY query_id, t_q""")
def f1_f2_table_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(history_state.table_counts(shop_states(spark, sf), ["orders"]))


@query(f"""WITH {EV}, {QC}, {PC} SELECT query_id, {", ".join(f"round(ln(1 + count(*) FILTER (event_type = '{v}')), 6) AS event_type_{v}" for v in TYPES)} FROM p GROUP BY 1""")
def f3_category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(history_state.category_counts(click_states(spark, sf), "event_type", TYPES))


@query(f"""WITH {EV}, {QC}, {PC} SELECT query_id, {", ".join(f"round(ln(1 + count(*) FILTER (event_type = '{v}' AND t > t_q - horizon_s)), 6) AS event_type_{v}" for v in TYPES)} FROM p GROUP BY 1""")
def f4_trailing_category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(history_state.category_counts(click_states(spark, sf), "event_type", TYPES, recent=True))


@query(f"""WITH {O}, {Q}, {P}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY t DESC, row_key DESC) AS recency, t - lag(t) OVER (PARTITION BY query_id ORDER BY t, row_key) AS gap FROM p WHERE t IS NOT NULL),
    w AS (SELECT query_id, greatest(1, least(8, ceil((max(t_q) - min(t)) / CAST(max(horizon_s) AS DOUBLE)))) AS n_windows, quantile_cont(gap, 0.5) FILTER (recency < 512) AS gap, max(t_q) - max(t) AS elapsed FROM k GROUP BY 1),
    c AS (SELECT query_id, (t_q - t) // horizon_s AS i, count(*) AS n FROM k GROUP BY ALL),
    f AS (SELECT w.query_id, r.i, coalesce(n, 0) AS n FROM w JOIN range(8) r(i) ON r.i < n_windows LEFT JOIN c ON c.query_id = w.query_id AND c.i = r.i),
    s AS (SELECT query_id, ln(1 + max(n)) AS a, avg(CASE WHEN n >= 1 THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END) AS c, ln(1 + avg(n)) AS d, CASE WHEN avg(n) > 0 THEN stddev_pop(n) / avg(n) ELSE 0 END AS e,
          coalesce(ln(1 + max(n) FILTER (i = 0)) - ln(1 + avg(n) FILTER (i > 0)), 0) AS f FROM f GROUP BY 1)
    SELECT q.query_id, round(coalesce(a, 0), 6) AS dyn_max, round(coalesce(b, 0), 6) AS dyn_one, round(coalesce(c, 0), 6) AS dyn_two, round(coalesce(d, 0), 6) AS dyn_mean, round(coalesce(e, 0), 6) AS dyn_spread, round(coalesce(f, 0), 6) AS dyn_trend,
           round(coalesce(ln(1 + gap / 86400.0), 0), 6) AS dyn_gap, round(coalesce(CASE WHEN gap IS NULL THEN ln(1 + elapsed / 86400.0) ELSE ln(1 + elapsed / (gap + 86400.0)) END, 0), 6) AS dyn_overdue
    FROM q LEFT JOIN s USING (query_id) LEFT JOIN w USING (query_id)""")  # fmt: skip
def f5_dynamics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(history_state.dynamics(shop_states(spark, sf)))


@query(f"""WITH {O}, {Q}, {P}, g AS (SELECT *, ln(1 + (t - lag(t) OVER (PARTITION BY query_id ORDER BY t, row_key)) / 86400.0) AS gap FROM p)
    SELECT query_id, round(coalesce(stddev_pop(gap), 0), 6) AS gap_std, round(coalesce(avg(CASE WHEN t IS NULL THEN NULL WHEN (t // 86400 + 4) % 7 = (t_q // 86400 + 4) % 7 THEN 1.0 ELSE 0.0 END), 0), 6) AS weekday_share FROM g GROUP BY 1""")
def f6_gap_globals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(history_state.gap_globals(shop_states(spark, sf)))


_SUPPLIER_Q = f"q AS (SELECT s_suppkey AS query_id, s_suppkey AS entity_id, {CUT} AS t_q, {D} AS horizon_s FROM supplier)"


def supplier_past(spark: SparkSession, sf: str, cutoff: int = CUT) -> DataFrame:
    """Past lines of each supplier at the cutoff, with the part as neighbour."""
    tables = events.before(SHOP, read_database(spark, sf, SHOP), cutoff)
    history = tables["lineitem"].select(F.col("l_suppkey").alias("entity_id"), "t", F.col("l_partkey").alias("part"), "l_partkey", "l_orderkey", F.expr(SHOP["lineitem"].key).alias("row_key"))
    points = tables["supplier"].select(F.col("s_suppkey").alias("query_id"), F.col("s_suppkey").alias("entity_id"), F.lit(cutoff).cast("long").alias("t_q"), F.lit(D).cast("long").alias("horizon_s"))
    return features.joined(points, history)


_NB_SLOTS = features.neighbour_layout(SHOP, "supplier")
_NB_NAMES = ("distinct", "top_share", "with_last", "events", "alike", "since")


def _neighbour_sql(i: int, column: str, target: str) -> str:
    own = f"UNION ALL SELECT {SHOP[target].pkey}, t, {SHOP.table_idx(target)} FROM {target[0]} WHERE t < {CUT}" if SHOP[target].is_fact else ""
    return f"""per{i} AS (SELECT query_id, t_q, {column} AS nb, count(*) AS n, max(t) AS last FROM q JOIN k ON l_suppkey = entity_id GROUP BY ALL),
    r{i} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY last DESC, nb) AS place FROM per{i}),
    own{i} AS (SELECT query_id, ln(1 + count(*)) AS nb_distinct, max(n) / sum(n) AS nb_top_share, ln(1 + max(n) FILTER (place = 1)) AS nb_with_last FROM r{i} GROUP BY 1),
    theirs{i} AS (SELECT {column} AS e, t, {SHOP.table_idx("lineitem")} AS tab FROM k {own}),
    seen{i} AS (SELECT query_id, nb, t_q, count(*) AS events, count(*) FILTER (tab = {SHOP.table_idx("lineitem")}) AS alike, max(t) AS latest FROM r{i} JOIN theirs{i} ON e = nb WHERE place <= 4 GROUP BY ALL),
    th{i} AS (SELECT query_id, avg(ln(1 + events)) AS nb_events, avg(ln(1 + alike)) AS nb_alike, avg(ln(1 + (t_q - latest) / 86400.0)) AS nb_since FROM seen{i} GROUP BY 1)"""


# an order is a fact itself, so it has events of two tables: its line items and its own row
@query(f"""WITH {O}, {L}, {_SUPPLIER_Q}, k AS (SELECT * FROM l WHERE t < {CUT}), {", ".join(_neighbour_sql(i, c, to) for i, (_, c, to) in enumerate(_NB_SLOTS))}
    SELECT q.query_id, {", ".join(f"round(coalesce({'own' if n in ('distinct', 'top_share', 'with_last') else 'th'}{i}.nb_{n}, 0), 6) AS {c}_{n}" for i, (_, c, _) in enumerate(_NB_SLOTS) for n in _NB_NAMES)}
    FROM q {" ".join(f"LEFT JOIN own{i} ON own{i}.query_id = q.query_id LEFT JOIN th{i} ON th{i}.query_id = q.query_id" for i in range(len(_NB_SLOTS)))}""")  # fmt: skip
def f7_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbour features of suppliers over every link that their line items hold beside the one to them."""
    tables = read_database(spark, sf, SHOP)
    known = events.before(SHOP, tables, CUT)
    points = tables["supplier"].select(F.col("s_suppkey").alias("query_id"), F.col("s_suppkey").alias("entity_id"), F.lit(CUT).cast("long").alias("t_q"))
    done = points.select("query_id")
    for table, column, target in _NB_SLOTS:
        links = known[table].select(F.col("l_suppkey").alias("entity_id"), "t", F.expr(SHOP[table].key).alias("row_key"), F.col(column).alias("neighbour_id"))
        theirs = events.histories(SHOP, tables, target, CUT, self_rows=True).select(F.col("entity_id").alias("neighbour_id"), "t", "table_idx")
        own = history_state.neighbour_features(points, links, theirs, SHOP.table_idx(table))
        done = done.join(own.withColumnsRenamed({f"nb_{n}": f"{column}_{n}" for n in _NB_NAMES}), "query_id")
    return rounded(done)


_LAYOUT_COLUMNS = {"orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]}
_LAYOUT_KEPT, _LAYOUT_MOST = ["lineitem.l_linestatus"], 24


@query(f"""WITH RECURSIVE {O}, {L}, c AS ({" UNION ALL ".join(f"SELECT {i} AS table_no, '{t}' AS table_name, {j} AS place, '{c}' AS column_name, CAST(count(DISTINCT {c}) AS INT) AS codes FROM {t[0]} WHERE t <= {CUT}" for i, (t, columns) in enumerate(_LAYOUT_COLUMNS.items()) for j, c in enumerate(columns))}),
    d AS (SELECT *, row_number() OVER (PARTITION BY table_no ORDER BY place) AS depth FROM c WHERE codes BETWEEN 2 AND 16),
    k AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN table_name || '.' || column_name = '{_LAYOUT_KEPT[0]}' THEN 0 ELSE 1 END, depth, table_no) AS i FROM d),
    p AS (SELECT 0 AS i, 0 AS slot, 0 AS used, '' AS table_name, '' AS column_name, 0 AS codes, false AS fits
          UNION ALL SELECT k.i, p.used, CASE WHEN p.used + k.codes <= {_LAYOUT_MOST} THEN p.used + k.codes ELSE p.used END, k.table_name, k.column_name, k.codes, p.used + k.codes <= {_LAYOUT_MOST} FROM p JOIN k ON k.i = p.i + 1)
    SELECT CAST(slot AS INT) AS slot, table_name, column_name, codes FROM p WHERE fits""")  # fmt: skip
def f3_category_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Which columns of the shop's facts get counters, in a small budget, behind one that had some before."""
    tables, arms = events.before(SHOP, read_database(spark, sf, SHOP), CUT), []
    for i, (name, columns) in enumerate(_LAYOUT_COLUMNS.items()):
        listed = F.array(*[F.struct(F.lit(j).alias("place"), F.lit(c).alias("column_name"), F.count_distinct(c).alias("codes")) for j, c in enumerate(columns)])
        arms.append(tables[name].agg(listed.alias("l")).select(F.lit(i).alias("table_no"), F.lit(name).alias("table_name"), F.inline("l")))
    return features.category_layout(arms[0].unionByName(arms[1]), _LAYOUT_MOST, _LAYOUT_KEPT)


@query(f"""WITH {O}, q AS (SELECT o_orderkey AS query_id, o_custkey AS entity_id, t AS t_q, {D} AS horizon_s FROM o)
    SELECT query_id, count(*) FILTER (x.t < t_q) AS orders_n, count(*) FILTER (x.t < t_q AND x.t > t_q - horizon_s) AS orders_recent, count(*) FILTER (x.t > t_q AND x.t <= t_q + horizon_s) AS orders_next
    FROM q JOIN o x ON x.o_custkey = entity_id GROUP BY 1""")
def f8_bulk_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Every order's own time as a query, so that ties fall on each bound."""
    orders = read_database(spark, sf, SHOP)["orders"]
    points = orders.select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("entity_id"), F.col("t").alias("t_q"), F.lit(D).cast("long").alias("horizon_s"))
    history = orders.select(F.col("o_custkey").alias("entity_id"), "t", F.lit(0).alias("table_idx"))
    return features.swept_counts(points, history, {"orders": 0})


def _named_features(spark: SparkSession, sf: str) -> DataFrame:
    states = written(shop_states(spark, sf), "states")
    return rounded(history_state.table_counts(states, ["orders"]).join(history_state.dynamics(states), "query_id").join(history_state.gap_globals(states), "query_id"))


@query(f"SELECT * FROM ({ORACLES['f1_f2_table_counts']}) JOIN ({ORACLES['f5_dynamics']}) USING (query_id) JOIN ({ORACLES['f6_gap_globals']}) USING (query_id)")
def f10_named_features(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that is known of each query, by name."""
    return _named_features(spark, sf)


@query()
def f10_feature_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Named features in one row per query, and as a vector."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    wide = _named_features(spark, sf)
    names = [c for c in wide.columns if c not in ("query_id", "t_q")]
    return VectorAssembler(inputCols=names, outputCol="vector").transform(wide).withColumn("vector", vector_to_array("vector"))


def _activity(spark: SparkSession, sf: str, cutoff: int = CUT) -> DataFrame:
    tables = read_database(spark, sf, SHOP)
    cutoffs = spark.range(2).select((cutoff - F.col("id") * D).alias("cutoff"))
    history = events.histories(SHOP, tables, "part", cutoff).select("entity_id", "t")
    return pairs.candidate_activity(cutoffs, history, tables["part"].select(F.col("p_partkey").alias("entity_id")))


ACTIVITY = f"""act AS (SELECT cutoff, p_partkey AS entity_id, ln(1 + count(t)) AS total, ln(1 + count(*) FILTER (cutoff - t <= 604800)) AS recent,
    ln(1 + count(*) FILTER (cutoff - t <= 604800)) - ln(1 + count(*) FILTER (cutoff - t > 604800 AND cutoff - t <= 2419200) / 3.0) AS trend, coalesce(exp(-(cutoff - max(t)) / 1209600.0), 0) AS staleness
    FROM part CROSS JOIN (SELECT {CUT} - j * {D} AS cutoff FROM range(2) r(j)) LEFT JOIN (SELECT * FROM l WHERE t <= {CUT}) k ON l_partkey = p_partkey AND t < cutoff GROUP BY cutoff, p_partkey)"""  # fmt: skip


@query(f"WITH {L}, {ACTIVITY} SELECT cutoff, entity_id, round(total, 6) AS total, round(recent, 6) AS recent, round(trend, 6) AS trend, round(staleness, 6) AS staleness FROM act")
def c1_candidate_activity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_activity(spark, sf))


def _supplier_pairs(spark: SparkSession, sf: str, cutoff: int = CUT) -> DataFrame:
    """Candidates: for each supplier the parts that it ships after the cutoff."""
    shipped = SHOP["lineitem"].time_col
    lines = events.later_than(events.cutoff_filter(read_database(spark, sf, SHOP)["lineitem"], cutoff + D, shipped), cutoff, shipped)
    return lines.select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("candidate")).distinct().withColumn("t_q", F.lit(cutoff).cast("long"))


_SP = f"sp AS (SELECT DISTINCT l_suppkey AS query_id, l_partkey AS candidate, CAST({CUT} AS BIGINT) AS t_q FROM l WHERE t > {CUT} AND t <= {CUT + D})"
_HIST = f"""h AS (SELECT query_id, candidate, CASE WHEN count(k.t) > 0 THEN 1 ELSE 0 END AS "repeat", ln(1 + count(k.t)) AS times, coalesce(exp(-(t_q - max(k.t)) / 604800.0), 0) AS recency
    FROM sp LEFT JOIN l k ON l_suppkey = query_id AND l_partkey = candidate AND k.t < t_q GROUP BY query_id, candidate, t_q)"""


def _pair_history(spark: SparkSession, sf: str) -> DataFrame:
    past = supplier_past(spark, sf).withColumnRenamed("part", "candidate").filter("t is not null")
    return pairs.pair_history(past, _supplier_pairs(spark, sf))


@query(f'WITH {L}, {_SP}, {_HIST} SELECT query_id, candidate, "repeat", round(times, 6) AS times, round(recency, 6) AS recency FROM h')
def c2_pair_history(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_pair_history(spark, sf))


@query(f"WITH {L} SELECT l_orderkey AS src, l_partkey AS dst, t FROM l WHERE t <= {CUT} UNION ALL SELECT l_orderkey, l_suppkey, t FROM l WHERE t <= {CUT}")
def c3_link_pairs(spark: SparkSession, sf: str) -> DataFrame:
    lines = events.before(SHOP, read_database(spark, sf, SHOP), CUT)["lineitem"]
    return pairs.link_pairs(lines, ["l_orderkey"], ["l_partkey", "l_suppkey"])


def _cooc(spark: SparkSession, sf: str, cutoff: int = CUT, items: DataFrame | None = None) -> DataFrame:
    lines = events.before(SHOP, read_database(spark, sf, SHOP), cutoff)["lineitem"]
    return pairs.cooccurrence(pairs.link_pairs(lines, ["l_orderkey"], ["l_partkey"]), items=items)


COOC = f"""lk AS (SELECT l_orderkey AS src, l_partkey AS dst, count(*) AS n FROM l WHERE t <= {CUT} GROUP BY ALL), kept AS (SELECT src, dst FROM lk WHERE src IN (SELECT src FROM lk GROUP BY 1 HAVING sum(n) <= 500)),
    wt AS (SELECT a.dst AS item, b.dst AS other, count(*) AS weight FROM kept a JOIN kept b ON a.src = b.src AND a.dst <> b.dst GROUP BY ALL),
    cooc AS (SELECT item, other, weight FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY weight DESC, other) AS place FROM wt) WHERE place <= 32)"""


@query(f"WITH {L}, {COOC} SELECT * FROM cooc")
def c4_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return _cooc(spark, sf)


PRIOR = f"prior AS (SELECT query_id, item, back FROM (SELECT l_suppkey AS query_id, l_partkey AS item, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY t DESC, l_orderkey * 10 + l_linenumber DESC, l_partkey) AS INT) AS back FROM l WHERE t < {CUT}) WHERE back <= 8)"
SCORE = "sc AS (SELECT query_id, other AS candidate, CAST(sum(weight) AS BIGINT) AS score FROM prior JOIN cooc USING (item) GROUP BY ALL)"


def _prior(spark: SparkSession, sf: str, cutoff: int = CUT) -> DataFrame:
    tables = events.before(SHOP, read_database(spark, sf, SHOP), cutoff)
    shipped = tables["lineitem"].filter(F.col("t") < cutoff).select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("item"), "t", F.expr(SHOP["lineitem"].key).alias("row_key"))
    # a supplier's last lines first: nothing else of the lines is worth a join
    return pairs.prior_items(shipped.filter("query_id is not null")).join(tables["supplier"].select(F.col("s_suppkey").alias("query_id")), "query_id", "left_semi")


@query(f"WITH {L}, {PRIOR} SELECT * FROM prior")
def c6_prior_items(spark: SparkSession, sf: str) -> DataFrame:
    return _prior(spark, sf)


@query(f"WITH {L}, {COOC}, {PRIOR}, {SCORE} SELECT * FROM sc")
def c5_cooc_score(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.cooc_score(_prior(spark, sf), _cooc(spark, sf))


WEIGHTS = {"total": 0.1, "recent": 0.3, "trend": 0.2, "staleness": 0.5, "repeat": 0.7, "times": 0.4, "recency": 0.6, "cooc": 0.8}


@query(f"""WITH {L}, {ACTIVITY}, {_SP}, {_HIST}, {COOC}, {PRIOR}, {SCORE},
    wide AS (SELECT sp.query_id, sp.t_q, sp.candidate, total, recent, trend, staleness, "repeat", times, recency, ln(1 + coalesce(score, 0)) AS cooc
             FROM sp JOIN h USING (query_id, candidate) LEFT JOIN sc USING (query_id, candidate) LEFT JOIN act ON cutoff = sp.t_q AND act.entity_id = sp.candidate)
    SELECT query_id, t_q, candidate, "repeat", {", ".join(f"round({c}, 6) AS {c}" for c in WEIGHTS if c != "repeat")}, round({" + ".join(f'{w} * "{c}"' for c, w in WEIGHTS.items())}, 6) AS linear FROM wide""")  # fmt: skip
def c7_pair_features(spark: SparkSession, sf: str) -> DataFrame:
    scores = pairs.cooc_score(_prior(spark, sf), _cooc(spark, sf))
    return rounded(pairs.pair_features(_supplier_pairs(spark, sf), _activity(spark, sf), _pair_history(spark, sf), scores, WEIGHTS))
