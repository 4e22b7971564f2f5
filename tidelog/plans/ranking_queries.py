"""Queries of sampling, ranking, baselines and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.exprs import DAY
from tidelog.functions.ranges import exact_quantile
from tidelog.operators import events, metrics, pairs, ranking, sampling, typing_rules
from tidelog.plans import feature_queries as fq
from tidelog.plans import target_queries as tq
from tidelog.plans.feature_queries import COOC, CUT, PRIOR, SCORE, D, rounded
from tidelog.plans.registry import EV, L, O, query
from tidelog.sources.sinks import written
from tidelog.sources.tables import read_database, read_table
from tidelog.spec import SHOP


def _part_counts(spark: SparkSession, sf: str) -> DataFrame:
    tables = read_database(spark, sf, SHOP)
    return events.link_counts(events.histories(SHOP, tables, "part", CUT), tables["part"], "p_partkey")


COUNTS = f"counts AS (SELECT p_partkey AS entity_id, count(l_partkey) AS n_links FROM part LEFT JOIN (SELECT * FROM l WHERE t <= {CUT}) k ON l_partkey = p_partkey GROUP BY 1)"
POP = "pop AS (SELECT entity_id, (n_links + 1) / sum(n_links + 1) OVER () AS p, sum(n_links + 1) OVER (ORDER BY entity_id) / sum(n_links + 1) OVER () AS high FROM counts)"


@query(f"WITH {L}, {COUNTS}, {POP} SELECT entity_id, round(p, 9) AS p, round(high, 9) AS high FROM pop")
def n1_popularity_cdf(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.popularity(_part_counts(spark, sf)).select("entity_id", F.round("p", 9).alias("p"), F.round("high", 9).alias("high"))


def _parts_index(spark: SparkSession, sf: str) -> DataFrame:
    return typing_rules.entity_index(read_table(spark, sf, "part"), "p_partkey").withColumnRenamed("p_partkey", "entity_id")


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("query_id"))


def _negatives(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.negatives(_suppliers(spark, sf), _parts_index(spark, sf), sampling.popularity(_part_counts(spark, sf)), 16, seed=5)


@query()
def n1_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return _negatives(spark, sf)


def _scores(spark: SparkSession, sf: str, cutoff: int = CUT) -> DataFrame:
    """Scores by co-occurrence, which is counted for the prior items only."""
    prior = written(fq._prior(spark, sf, cutoff), "prior")
    return pairs.cooc_score(prior, fq._cooc(spark, sf, cutoff, prior))


SHARES = "sh AS (SELECT query_id, candidate, score / sum(score) OVER (PARTITION BY query_id) AS share FROM sc)"


@query(f"WITH {L}, {COUNTS}, {POP}, {COOC}, {PRIOR}, {SCORE}, {SHARES}, {fq._SP}, m AS (SELECT sp.query_id, sp.candidate, 0.4 / (SELECT count(*) FROM part) + 0.3 * p + 0.3 * coalesce(share, 0) AS q FROM sp JOIN pop ON entity_id = sp.candidate LEFT JOIN sh USING (query_id, candidate)) SELECT query_id, candidate, round(q, 9) AS q, round(ln(q), 6) AS log_q FROM m")
def n2_mixture_proposal(spark: SparkSession, sf: str) -> DataFrame:
    pairs = fq._supplier_pairs(spark, sf).select("query_id", "candidate")
    catalogue = read_table(spark, sf, "part").count()
    mixed = sampling.mixture(pairs, sampling.popularity(_part_counts(spark, sf)), sampling.two_hop_shares(_scores(spark, sf)), catalogue)
    return mixed.select("query_id", "candidate", F.round("q", 9).alias("q"), F.round("log_q", 6).alias("log_q"))


@query(f"WITH {L}, {COOC}, {PRIOR}, {SCORE}, {SHARES} SELECT query_id, candidate, round(share, 9) AS share FROM sh")
def n3_two_hop_shares(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sampling.two_hop_shares(_scores(spark, sf)), 9)


@query(f"WITH {L}, {COOC}, {PRIOR}, {SCORE}, {fq._SP} SELECT query_id, candidate, score FROM sc ANTI JOIN sp USING (query_id, candidate)")
def n4_accidental_hits(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.without_hits(_scores(spark, sf), fq._supplier_pairs(spark, sf))


@query("SELECT s_suppkey AS query_id, r_regionkey AS candidate FROM supplier, region")
def n5_enumerate_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    regions = read_table(spark, sf, "region").select(F.col("r_regionkey").alias("candidate"))
    return sampling.enumerate_catalogue(_suppliers(spark, sf), regions, 8, regions.count())


@query()
def n6_shared_pool(spark: SparkSession, sf: str) -> DataFrame:
    pool = sampling.shared_pool(_parts_index(spark, sf), sampling.popularity(_part_counts(spark, sf)), 4096, seed=9)
    return pool.withColumn("log_weight", sampling.mixed_correction(16, F.col("q"), 4096, F.col("q")))


@query(f"""WITH {L}, {COUNTS}, {COOC}, {PRIOR}, {SCORE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate) AS n FROM sc),
    top AS (SELECT entity_id FROM counts ORDER BY n_links DESC, entity_id LIMIT 20)
    SELECT query_id, item AS candidate FROM prior UNION SELECT s_suppkey, entity_id FROM supplier, top UNION SELECT query_id, candidate FROM r WHERE n <= 20""")
def n7_shortlist(spark: SparkSession, sf: str) -> DataFrame:
    own = fq._prior(spark, sf).select("query_id", F.col("item").alias("candidate"))
    return sampling.shortlist(own, _part_counts(spark, sf), _scores(spark, sf), _suppliers(spark, sf), 20, 20)


@query()
def n8_pack_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.pack_sequences(events.histories(SHOP, read_database(spark, sf, SHOP), "customer", CUT), 32, seed=3)


@query(f"""WITH {O}, h AS (SELECT o_custkey AS entity_id, o_orderkey AS row_key, t, row_number() OVER (PARTITION BY o_custkey ORDER BY t DESC, o_orderkey DESC) AS back FROM o WHERE t <= {CUT} AND o_custkey IS NOT NULL)
    SELECT entity_id, count(*) AS length, string_agg(CAST(row_key AS VARCHAR), ',' ORDER BY back DESC) AS row_keys FROM h WHERE back <= 8 GROUP BY 1""")
def n8_entity_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's last events as one row each."""
    rows = sampling.entity_rows(events.histories(SHOP, read_database(spark, sf, SHOP), "customer", CUT), 8)
    return rows.select("entity_id", "length", F.array_join(F.transform("events", lambda e: e["row_key"].cast("string")), ",").alias("row_keys"))


@query()
def n9_sample_databases(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_by(read_table(spark, sf, "events"), "event_type", {"purchase": 1.0, "view": 0.25, "click": 0.5}, "event_id", seed=2).select("event_id", "event_type")


@query(f"WITH {O} SELECT o_custkey AS entity_id, count(*) AS n FROM o WHERE t <= {CUT} AND o_custkey IS NOT NULL GROUP BY 1 HAVING count(*) >= 8")
def n10_eligible_entities(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.eligible_entities(events.histories(SHOP, read_database(spark, sf, SHOP), "customer", CUT), 8)


# ranking ----------------------------------------------------------------------------------------------------------


def _part_history(spark: SparkSession, sf: str) -> DataFrame:
    return events.histories(SHOP, read_database(spark, sf, SHOP), "part", CUT)


POPULAR = f"""popular AS (SELECT entity_id, n, CAST(row_number() OVER (ORDER BY n DESC, entity_id) AS INT) AS "rank" FROM
    (SELECT l_partkey AS entity_id, count(*) AS n FROM l WHERE t <= {CUT} AND t >= (SELECT max(t) FROM l WHERE t <= {CUT}) - {7 * DAY} GROUP BY 1 ORDER BY n DESC, entity_id LIMIT 50))"""


@query(f"WITH {L}, {POPULAR} SELECT * FROM popular")
def l1_popularity_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.popularity(_part_history(spark, sf), 50)


@query(f'WITH {L} SELECT DISTINCT l_partkey AS inter, l_suppkey AS "final" FROM l WHERE t <= {CUT}')
def l2_path_map(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.path_map(events.before(SHOP, read_database(spark, sf, SHOP), CUT)["lineitem"], "l_partkey", "l_suppkey")


PROJECTED = f"""pm AS (SELECT DISTINCT l_partkey AS i, l_suppkey AS f FROM l WHERE t <= {CUT}),
    proj AS (SELECT query_id, f AS candidate, max(ln(score)) + ln(sum(exp(ln(score) - m))) AS score FROM (SELECT query_id, f, score, max(ln(score)) OVER (PARTITION BY query_id, f) AS m FROM sc JOIN pm ON candidate = i) GROUP BY ALL)"""


@query(f"WITH {L}, {COOC}, {PRIOR}, {SCORE}, {PROJECTED} SELECT query_id, candidate, round(score, 6) AS score FROM proj")
def l3_project_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of parts taken on to the suppliers that are known by the cutoff to have shipped them."""
    lines = events.before(SHOP, read_database(spark, sf, SHOP), CUT)["lineitem"]
    scores = _scores(spark, sf).withColumn("score", F.log("score"))
    return rounded(ranking.project_scores(scores, ranking.path_map(lines, "l_partkey", "l_suppkey")))


@query("""WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS candidate, list_dot_product(a.e, b.e) AS s FROM v a, v b WHERE a.vec_id % 100 = 0)
    SELECT query_id, candidate, round(s, 4) AS score, CAST(n AS INT) AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, candidate) AS n FROM s) WHERE n <= 10""")
def l4_retrieve_dot(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read_table(spark, sf, "embeddings")
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = ranking.retrieve_dot(queries, vectors.select(F.col("vec_id").alias("candidate"), F.col("embedding").alias("vector")), 10)
    return rounded(found, 4)


@query("""WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) * (1 + 600.0 / (1 + vec_id)) FOR x IN embedding] AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS candidate, list_dot_product(a.e, b.e) AS s FROM v a, v b WHERE a.vec_id % 100 = 0)
    SELECT query_id, candidate, round(s, 4) AS score, CAST(n AS INT) AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, candidate) AS n FROM s) WHERE n <= 10""")
def l4_retrieve_skewed(spark: SparkSession, sf: str) -> DataFrame:
    """Few vectors are far longer than the others, as with popular items, so most queries are done after the first parts."""
    vectors = read_table(spark, sf, "embeddings").withColumn("vector", F.transform("embedding", lambda x: x.cast("double") * (1 + 600.0 / (1 + F.col("vec_id")))))
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return rounded(ranking.retrieve_dot(queries, vectors.select(F.col("vec_id").alias("candidate"), "vector"), 10, c_rows=256), 4)


def _linear(spark: SparkSession, sf: str, cutoff: int = CUT, k: int = 20, scores: DataFrame | None = None, activity: DataFrame | None = None) -> DataFrame:
    """Rankings at the cutoff; scores and activity are worked out here unless they are given, as tables that have been written."""
    scores = written(_scores(spark, sf, cutoff), "scores") if scores is None else scores
    activity = (fq._activity(spark, sf, cutoff) if activity is None else activity).filter(F.col("cutoff") == cutoff)
    dense = activity.select("cutoff", F.col("entity_id").alias("candidate"), (0.1 * F.col("total") + 0.3 * F.col("recent") + 0.2 * F.col("trend") + 0.5 * F.col("staleness")).alias("dense"))
    sparse = scores.select("query_id", "candidate", (0.8 * F.log1p("score") - 0.7).alias("sparse"))
    queries = _suppliers(spark, sf).withColumn("cutoff", F.lit(cutoff).cast("long"))
    return ranking.retrieve_linear(queries, dense, sparse, k)


LINEAR = f"""lin AS (SELECT s_suppkey AS query_id, a.entity_id AS candidate, 0.1 * total + 0.3 * recent + 0.2 * trend + 0.5 * staleness + coalesce(0.8 * ln(1 + score) - 0.7, 0) AS score
    FROM supplier CROSS JOIN (SELECT * FROM act WHERE cutoff = {CUT}) a LEFT JOIN sc ON sc.query_id = s_suppkey AND sc.candidate = a.entity_id),
    ranked AS (SELECT * FROM (SELECT query_id, candidate, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, candidate) AS INT) AS "rank" FROM lin) WHERE "rank" <= 20)"""
_LIN = f"{L}, {fq.ACTIVITY}, {COOC}, {PRIOR}, {SCORE}, {LINEAR}"


@query(f'WITH {_LIN} SELECT query_id, candidate, round(score, 6) AS score, "rank" FROM ranked')
def l5_retrieve_linear(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_linear(spark, sf))


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    return fq._supplier_pairs(spark, sf).select("query_id", "candidate")


@query(f"""WITH {_LIN}, d AS (SELECT l_suppkey AS query_id, l_partkey AS candidate, ln(1 + count(*)) AS delta FROM l WHERE t < {CUT} GROUP BY ALL),
    s AS (SELECT r.query_id, r.candidate, score + coalesce(delta, 0) AS score FROM ranked r LEFT JOIN d USING (query_id, candidate) WHERE "rank" <= 10)
    SELECT query_id, candidate, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, candidate) AS INT) AS "rank" FROM s""")
def l6_rerank(spark: SparkSession, sf: str) -> DataFrame:
    past = events.before(SHOP, read_database(spark, sf, SHOP), CUT - 1)["lineitem"]
    delta = past.groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("candidate")).agg(F.log1p(F.count("*")).alias("delta"))
    return rounded(ranking.rerank(_linear(spark, sf), delta, first=10))


@query(f"""WITH {L}, {POPULAR}, r AS (SELECT s_suppkey AS query_id FROM supplier WHERE s_suppkey % 3 <> 0), own AS (SELECT query_id, item AS candidate, back AS "rank" FROM (SELECT l_suppkey AS query_id, l_partkey AS item, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY t DESC, l_orderkey * 10 + l_linenumber DESC, l_partkey) AS INT) AS back FROM l WHERE t < {CUT}) JOIN r USING (query_id) WHERE back <= 8)
    SELECT * FROM own UNION ALL SELECT s_suppkey, entity_id, "rank" FROM supplier, popular WHERE s_suppkey NOT IN (SELECT query_id FROM own)""")
def l7_cold_start(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the suppliers count as unknown here, so that the fallback is used."""
    ranked = fq._prior(spark, sf).filter("query_id % 3 <> 0").select("query_id", F.col("item").alias("candidate"), F.col("back").alias("rank"))
    return ranking.cold_start(_suppliers(spark, sf), ranked, ranking.popularity(_part_history(spark, sf), 50))


_TRUTH_SQL = fq._SP


@query(f"""WITH {_LIN}, {_TRUTH_SQL}, b AS (SELECT query_id, min("rank") AS best FROM sp LEFT JOIN ranked USING (query_id, candidate) GROUP BY 1)
    SELECT count(*) AS n_queries, {", ".join(f"round(avg(CASE WHEN best <= {d} THEN 1.0 ELSE 0.0 END), 6) AS hit_{d}" for d in (1, 5, 10, 20))}, quantile_cont(best, 0.5) AS median_rank, quantile_cont(best, 0.9) AS p90_rank FROM b""")
def l8_rank_depth(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.rank_depth(_linear(spark, sf), _truth(spark, sf), [1, 5, 10, 20]))


@query(f"""WITH {_LIN}, {_TRUTH_SQL}, h AS (SELECT r.query_id, r.candidate, r."rank" AS old_rank, sp.candidate IS NOT NULL AS hit FROM ranked r LEFT JOIN sp USING (query_id, candidate))
    SELECT query_id, candidate, hit, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hit DESC, old_rank) AS INT) AS "rank" FROM h""")
def l9_oracle_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.oracle_rerank(_linear(spark, sf), _truth(spark, sf), 20).select("query_id", "candidate", "hit", "rank")


_VEC = [f"round(avg(e[{i + 1}]), 6) AS v{i}" for i in range(4)]


@query(f"WITH v AS (SELECT label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings) SELECT CAST(label AS BIGINT) AS entity_id, count(*) AS n, {', '.join(_VEC)} FROM v GROUP BY 1")
def l11_entity_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _label_vectors(spark, sf)
    means = ranking.entity_vectors(vectors, 64)
    return means.select("entity_id", "n", *[F.round(F.get("vector", F.lit(i)), 6).alias(f"v{i}") for i in range(4)])


def _label_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("entity_id"), F.col("vec_id").alias("t"), F.col("vec_id").alias("row_key"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


@query("""WITH v AS (SELECT CAST(label AS BIGINT) AS entity_id, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT entity_id, d, avg(x) AS x FROM v GROUP BY ALL),
    c AS (SELECT d, avg(x) AS c FROM m GROUP BY 1), k AS (SELECT entity_id, d, x - c AS x FROM m JOIN c USING (d)), n AS (SELECT entity_id, sqrt(sum(x * x)) AS len FROM k GROUP BY 1)
    SELECT entity_id, round(max(x / len) FILTER (d = 1), 6) AS v0, round(max(x / len) FILTER (d = 2), 6) AS v1, round(max(x / len) FILTER (d = 64), 6) AS v63 FROM k JOIN n USING (entity_id) GROUP BY 1""")
def l11_normalized_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vectors, centred over all entities and of length 1."""
    done = ranking.normalized(ranking.entity_vectors(_label_vectors(spark, sf), 64), 64)
    return done.select("entity_id", *[F.round(F.get("vector", F.lit(i)), 6).alias(f"v{i}") for i in (0, 1, 63)])


@query("""WITH v AS (SELECT label, vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e, power(0.5, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) - 1) AS w FROM embeddings)
    SELECT CAST(label AS BIGINT) AS entity_id, round(sum(w * e[1]) / sum(w), 6) AS ema0, round(sum(w * e[2]) / sum(w), 6) AS ema1, round(arg_max(e[1], vec_id), 6) AS last0 FROM v GROUP BY 1""")
def l11_ema_and_last(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _label_vectors(spark, sf)
    ema, last = ranking.entity_vectors(vectors, 64, "ema"), ranking.entity_vectors(vectors, 64, "last")
    return ema.select("entity_id", F.round(F.get("vector", F.lit(0)), 6).alias("ema0"), F.round(F.get("vector", F.lit(1)), 6).alias("ema1")).join(last.select("entity_id", F.round(F.get("vector", F.lit(0)), 6).alias("last0")), "entity_id")


@query(f"""WITH {EV} SELECT count(*) AS n_queries, 0.0::DOUBLE AS "unknown", round(avg(CASE WHEN u IS NULL THEN 1.0 ELSE 0.0 END), 6) AS cold, round(avg(CASE WHEN u IS NULL THEN 0.0 ELSE 1.0 END), 6) AS covered
    FROM customer LEFT JOIN (SELECT DISTINCT user_id AS u FROM ev WHERE t <= {fq.CCUT}) ON u = c_custkey""")
def l12_coverage(spark: SparkSession, sf: str) -> DataFrame:
    log = tq.clicks_log(spark, sf, until=fq.CCUT)
    points = tq.customers(spark, sf)
    return rounded(ranking.coverage(points, read_table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id")), log))


# baselines --------------------------------------------------------------------------------------------------------


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    """Per supplier and day the list of parts shipped."""
    lines = read_database(spark, sf, SHOP)["lineitem"]
    return lines.groupBy(F.col("l_suppkey").alias("src"), "t").agg(F.collect_list("l_partkey").alias("dsts"))


def _exploded(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.explode_history(_labels(spark, sf), CUT)


H = f"h AS (SELECT l_suppkey AS src, l_partkey AS dst, t FROM l WHERE t < {CUT})"


@query(f"WITH {L}, {H} SELECT * FROM h")
def b1_explode_history(spark: SparkSession, sf: str) -> DataFrame:
    return _exploded(spark, sf)


_ALL = "pa AS (SELECT dst, count(*) AS n FROM h GROUP BY 1 ORDER BY n DESC, dst LIMIT 10)"
_RECENT = "pr AS (SELECT dst, count(*) AS n FROM h WHERE t >= (SELECT max(t) - (max(t) - min(t)) * 0.15 FROM h) GROUP BY 1 ORDER BY n DESC, dst LIMIT 10)"


@query(f"""WITH {L}, {H}, {_ALL}, {_RECENT} SELECT 'all' AS list, dst, n, CAST(row_number() OVER (ORDER BY n DESC, dst) AS INT) AS "rank" FROM pa
    UNION ALL SELECT 'recent', dst, n, CAST(row_number() OVER (ORDER BY n DESC, dst) AS INT) FROM pr""")
def b2_b3_popular_lists(spark: SparkSession, sf: str) -> DataFrame:
    history = _exploded(spark, sf)
    return ranking.popular_list(history, 10).withColumn("list", F.lit("all")).unionByName(ranking.popular_list(history, 10, 0.15).withColumn("list", F.lit("recent")))


def _own_sql(order: str) -> str:
    return f"""own AS (SELECT src, dst, n FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY {order}, dst) AS n FROM (SELECT src, dst, max(t) AS last, count(*) AS c FROM h GROUP BY ALL)) WHERE n <= 5),
    fl AS (SELECT dst, row_number() OVER (ORDER BY n DESC, dst) AS n FROM pa), every AS (SELECT s_suppkey AS src FROM supplier),
    al AS (SELECT src, dst, n FROM own UNION ALL SELECT src, dst, 100 + n FROM every, fl), ded AS (SELECT src, dst, min(n) AS n FROM al GROUP BY ALL),
    k AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n) AS n FROM ded)
    SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY n) AS dsts FROM k WHERE n <= 10 GROUP BY 1"""


def _padded(spark: SparkSession, sf: str, by: str) -> DataFrame:
    history = _exploded(spark, sf)
    sources = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("src"))
    return ranking.topk_pad(sources, ranking.own_list(history, 5, by), ranking.popular_list(history, 10), 10).select("src", F.array_join("dsts", ",").alias("dsts"))


@query(f"WITH {L}, {H}, {_ALL}, {_own_sql('last DESC')}")
def b4_b6_user_history(spark: SparkSession, sf: str) -> DataFrame:
    return _padded(spark, sf, "recent")


@query(f"WITH {L}, {H}, {_ALL}, {_own_sql('c DESC')}")
def b5_b6_user_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return _padded(spark, sf, "frequent")


@query(f"""WITH {L}, {H}, {fq._SP}, hd AS (SELECT DISTINCT src, dst FROM h) SELECT count(*) AS n_pairs, round(count(hd.dst) / count(*), 6) AS repeat_rate,
    round((SELECT 1 - count(w) / count(*) FROM (SELECT DISTINCT query_id FROM sp) LEFT JOIN (SELECT DISTINCT src AS w FROM h) ON w = query_id), 6) AS cold_frac FROM sp LEFT JOIN hd ON src = query_id AND dst = candidate""")
def b7_repeat_rate(spark: SparkSession, sf: str) -> DataFrame:
    truth = _truth(spark, sf).withColumnsRenamed({"query_id": "src", "candidate": "dst"})
    return rounded(ranking.repeat_rates(truth, _exploded(spark, sf)))


# metrics ----------------------------------------------------------------------------------------------------------

#: Customers with their past orders as score and activity after the cutoff as truth; many scores tie.
SCORED = f"""sc1 AS (SELECT c_custkey AS entity_id, CAST(count(*) FILTER (t <= {CUT} AND t > {CUT - 4 * D}) AS DOUBLE) AS pred, CAST(count(*) FILTER (t > {CUT} AND t <= {CUT + D}) AS DOUBLE) AS n_next,
    coalesce(sum(o_totalprice) FILTER (t <= {CUT} AND t > {CUT - D}), 0) AS past_sum, coalesce(sum(o_totalprice) FILTER (t > {CUT} AND t <= {CUT + D}), 0) AS next_sum, {CUT} - max(t) FILTER (t <= {CUT}) AS idle, count(t) FILTER (t <= {CUT}) AS n_past
    FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1), scored AS (SELECT *, CASE WHEN n_next > 0 THEN 1 ELSE 0 END AS y FROM sc1)"""


def scored(spark: SparkSession, sf: str, cutoff: int = CUT) -> DataFrame:
    """Customers as of a cutoff; `y`, `n_next` and `next_sum` are of the horizon after it."""
    log = tq.orders_log(spark, sf, until=cutoff + D)
    t, price = F.col("t"), F.col("o_totalprice")
    add = lambda c: F.coalesce(F.sum(F.when(c, price)), F.lit(0.0))
    before, last, after = t <= cutoff, (t <= cutoff) & (t > cutoff - D), (t > cutoff) & (t <= cutoff + D)
    per = log.groupBy("entity_id").agg(
        F.count_if((t <= cutoff) & (t > cutoff - 4 * D)).cast("double").alias("pred"), F.count_if(after).cast("double").alias("n_next"), add(last).alias("past_sum"), add(after).alias("next_sum"), (cutoff - F.max(F.when(before, t))).alias("idle"), F.count_if(before).alias("n_past")
    )
    joined = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id")).join(per, "entity_id", "left")
    return joined.fillna(0, ["pred", "n_next", "past_sum", "next_sum", "n_past"]).withColumn("y", (F.col("n_next") > 0).cast("int"))


@query(f"""WITH {O}, {SCORED}, d AS (SELECT pred, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY 1), r AS (SELECT *, sum(neg) OVER (ORDER BY pred) - neg AS below, sum(pos) OVER (ORDER BY pred DESC) AS tp, sum(pos + neg) OVER (ORDER BY pred DESC) AS n FROM d)
    SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auroc, round(sum(pos * tp / n) / sum(pos), 6) AS ap FROM r""")
def m1_m2_auroc_ap(spark: SparkSession, sf: str) -> DataFrame:
    frame = scored(spark, sf)
    return rounded(metrics.auroc(frame).crossJoin(metrics.average_precision(frame)))


@query(f"""WITH {O}, {SCORED}, m AS (SELECT avg(next_sum) AS a FROM scored) SELECT count(*) AS n, round(avg(abs(next_sum - past_sum)), 4) AS mae, round(1 - sum(power(next_sum - past_sum, 2)) / sum(power(next_sum - a, 2)), 6) AS r2 FROM scored, m""")
def m3_mae_r2(spark: SparkSession, sf: str) -> DataFrame:
    done = metrics.regression(scored(spark, sf).select(F.col("next_sum").alias("y"), F.col("past_sum").alias("pred")))
    return done.withColumns({"mae": F.round("mae", 4), "r2": F.round("r2", 6)})


@query(f"WITH {O}, {SCORED} SELECT round(avg(abs(next_sum - past_sum)), 4) AS mae, round(stddev_samp(past_sum), 4) AS std, round(avg(abs(next_sum - past_sum)) / stddev_samp(past_sum), 6) AS nmae FROM scored")
def m4_nmae(spark: SparkSession, sf: str) -> DataFrame:
    frame = scored(spark, sf)
    done = metrics.nmae(frame.select(F.col("next_sum").alias("y"), F.col("past_sum").alias("pred")), frame.select(F.col("past_sum").alias("y")))
    return done.withColumns({"mae": F.round("mae", 4), "std": F.round("std", 4), "nmae": F.round("nmae", 6)})


@query(f"""WITH {_LIN}, {_TRUTH_SQL}, h AS (SELECT r.query_id, r."rank", row_number() OVER (PARTITION BY r.query_id ORDER BY r."rank") AS nth FROM ranked r JOIN sp USING (query_id, candidate) WHERE r."rank" <= 10),
    s AS (SELECT query_id, sum(nth / "rank") AS s FROM h GROUP BY 1), z AS (SELECT query_id, count(*) AS size FROM sp GROUP BY 1) SELECT count(*) AS n_queries, round(avg(coalesce(s, 0) / least(size, 10)), 6) AS map FROM z LEFT JOIN s USING (query_id)""")
def m5_map_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.map_at_k(_linear(spark, sf), _truth(spark, sf), 10))


_TAUS = (0.1, 0.25, 0.5, 0.75, 0.9)


@query(f"WITH {O}, {SCORED} SELECT {', '.join(f'round(avg(greatest({t} * (next_sum - past_sum), ({t} - 1) * (next_sum - past_sum))), 4) AS tau_{int(t * 100)}' for t in _TAUS)} FROM scored")
def m6_pinball(spark: SparkSession, sf: str) -> DataFrame:
    losses = [F.round(F.avg(metrics.pinball(F.col("next_sum"), F.col("past_sum"), t)), 4).alias(f"tau_{int(t * 100)}") for t in _TAUS]
    return scored(spark, sf).agg(*losses)


_NLL = "greatest(pred / 4, 1e-9) - n_next * ln(greatest(pred / 4, 1e-9))"


@query(f"WITH {O}, {SCORED} SELECT round(avg({_NLL}), 6) AS nll, round((avg({_NLL}) FILTER (n_next = 0) + avg({_NLL}) FILTER (n_next <> 0)) / 2, 6) AS balanced_nll FROM scored")
def m7_poisson_nll(spark: SparkSession, sf: str) -> DataFrame:
    frame = scored(spark, sf).select(F.col("n_next").alias("y"), (F.col("pred") / 4).alias("pred"))
    return rounded(metrics.poisson_nll(frame).crossJoin(metrics.poisson_nll(frame, balanced=True).withColumnRenamed("nll", "balanced_nll")))


@query(f"WITH {O}, {SCORED} SELECT round(stddev_samp(past_sum), 4) AS spread, round(corr(past_sum, next_sum), 4) AS pearson, round(quantile_cont(past_sum, 0.1), 4) AS p10, round(quantile_cont(past_sum, 0.5), 4) AS p50, round(quantile_cont(past_sum, 0.9), 4) AS p90 FROM scored")
def m8_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.diagnostics(scored(spark, sf).select(F.col("next_sum").alias("y"), F.col("past_sum").alias("pred"))), 4)


# the boards compare segments' mean order values per priority: methods are market segments, tasks are order priorities
_RESULTS = f"""res AS (SELECT c_mktsegment AS method, o_orderpriority AS task, round(avg(o_totalprice), 4) AS value FROM o JOIN customer ON o_custkey = c_custkey
    WHERE t <= {CUT} AND NOT (c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT') GROUP BY ALL)"""


def _results(spark: SparkSession, sf: str) -> DataFrame:
    tables = events.before(SHOP, read_database(spark, sf, SHOP), CUT)
    joined = tables["orders"].join(tables["customer"], F.col("o_custkey") == F.col("c_custkey")).filter(~((F.col("c_mktsegment") == "BUILDING") & (F.col("o_orderpriority") == "1-URGENT")))
    return joined.groupBy(F.col("c_mktsegment").alias("method"), F.col("o_orderpriority").alias("task")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))


@query(f"""WITH {O}, {_RESULTS}, b AS (SELECT *, rank() OVER (PARTITION BY task ORDER BY value DESC) AS r FROM res), m AS (SELECT method, avg(value) AS v, count(*) FILTER (r = 1) AS n_best FROM b GROUP BY 1 HAVING count(DISTINCT task) = (SELECT count(DISTINCT task) FROM res))
    SELECT method, round(v, 4) AS mean_value, n_best, CAST(rank() OVER (ORDER BY v DESC) AS INT) AS place FROM m""")
def m9_board(spark: SparkSession, sf: str) -> DataFrame:
    results = _results(spark, sf)
    return rounded(metrics.board(results, results.select("task").distinct().count()), 4)


@query(f"""WITH {O}, {_RESULTS}, k AS (SELECT DISTINCT task FROM res WHERE method = 'BUILDING'), n AS (SELECT count(*) AS n FROM k)
    SELECT method, count(DISTINCT task) AS n_tasks, n - count(DISTINCT task) AS n_missing, round(avg(value), 4) AS mean_value FROM res SEMI JOIN k USING (task), n GROUP BY method, n""")
def m10_subset_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.subset_means(_results(spark, sf), "BUILDING"), 4)


@query(f"""WITH {O}, r AS (SELECT o_orderpriority AS task, c_mktsegment AS readout, CASE WHEN t <= {CUT} THEN 'val' ELSE 'test' END AS split, round(avg(o_totalprice), 4) AS value FROM o JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    w AS (SELECT task, readout, max(value) FILTER (split = 'val') AS val, max(value) FILTER (split = 'test') AS test FROM r GROUP BY ALL)
    SELECT task, readout, val, test FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY val DESC, readout) AS n FROM w WHERE val IS NOT NULL) WHERE n = 1""")
def m11_pick_on_validation(spark: SparkSession, sf: str) -> DataFrame:
    tables = read_database(spark, sf, SHOP)
    joined = tables["orders"].join(tables["customer"], F.col("o_custkey") == F.col("c_custkey"))
    split = F.when(F.col("t") <= CUT, "val").otherwise("test").alias("split")
    results = joined.groupBy(F.col("o_orderpriority").alias("task"), F.col("c_mktsegment").alias("readout"), split).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    return metrics.pick_on_validation(results)


@query(f"""WITH {O}, {SCORED} SELECT entity_id, round(coalesce(-idle / 86400.0, -1e9), 6) AS recency, CAST(n_past AS DOUBLE) AS "count", round(coalesce(idle / 86400.0, 1e9), 6) AS recency_absence, CAST(-n_past AS DOUBLE) AS count_absence,
    0.0::DOUBLE AS zero, (SELECT median(past_sum) FROM scored) AS median_sum FROM scored""")
def b8_b9_simple_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Recency and count scores, for presence and for absence, and the zero and training-median predictors."""
    frame = scored(spark, sf)
    both = ranking.simple_scores(frame).select("entity_id", "recency", "count", "past_sum", "idle", "n_past")
    flipped = ranking.simple_scores(both.select("entity_id", "idle", "n_past"), absence=True).select("entity_id", F.col("recency").alias("recency_absence"), F.col("count").alias("count_absence"))
    middle = F.lit(exact_quantile(frame, F.col("past_sum"), 0.5)).cast("double").alias("median_sum")
    return both.join(flipped, "entity_id").select("entity_id", F.round("recency", 6).alias("recency"), "count", F.round("recency_absence", 6).alias("recency_absence"), "count_absence", F.lit(0.0).alias("zero"), middle)


@query()
def b8_random_score(spark: SparkSession, sf: str) -> DataFrame:
    """A random score per customer, the same in every run."""
    return ranking.simple_scores(scored(spark, sf), seed=12).select("entity_id", "random")


@query(f"""WITH {O}, w AS (SELECT c_custkey AS entity_id, j, coalesce(sum(o_totalprice), 0) AS y FROM customer CROSS JOIN range(1, 5) r(j) LEFT JOIN o ON o_custkey = c_custkey AND t > {CUT} - j * {D} AND t <= {CUT} - (j - 1) * {D} GROUP BY ALL)
    SELECT entity_id, round(avg(y), 4) AS entity_mean, round(median(y), 4) AS entity_median, (SELECT round(avg(y), 4) FROM w) AS global_mean, (SELECT round(median(y), 4) FROM w) AS global_median, (SELECT CASE WHEN avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE FROM w) AS majority FROM w GROUP BY 1""")
def b10_past_values(spark: SparkSession, sf: str) -> DataFrame:
    """Means and medians of a customer's and of all past windows, and whether most windows hold anything."""
    points = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("j"))
    log = tq.orders_log(spark, sf, after=CUT - 4 * D, until=CUT).select("entity_id", F.ceil((CUT - F.col("t") + 1) / D).alias("j"), "t", "o_totalprice").filter((F.col("t") <= CUT) & (F.col("j") <= 4))
    sums = points.join(log.groupBy("entity_id", "j").agg(F.sum("o_totalprice").alias("s")), ["entity_id", "j"], "left").select("entity_id", F.coalesce("s", F.lit(0.0)).alias("y"))
    median = F.round(F.lit(exact_quantile(sums, F.col("y"), 0.5)).cast("double"), 4).alias("global_median")
    majority = (F.avg((F.col("y") > 0).cast("double")) >= 0.5).cast("double").alias("majority")
    everyone = sums.agg(F.round(F.avg("y"), 4).alias("global_mean"), majority).select("global_mean", median, "majority")
    own = sums.groupBy("entity_id").agg(F.round(F.avg("y"), 4).alias("entity_mean"), F.round(F.percentile("y", F.lit(0.5)), 4).alias("entity_median"))
    return own.crossJoin(F.broadcast(everyone))


@query(f"""WITH {O}, {SCORED}, m AS (SELECT avg(abs(next_sum)) AS zero, avg(abs(next_sum - past_sum)) AS past, avg(abs(next_sum - (SELECT median(past_sum) FROM scored))) AS med, stddev_samp(past_sum) AS sd FROM scored)
    SELECT round(least(zero, past, med) / sd, 6) AS best_trivial, round(100 * (zero / sd) / (least(zero, past, med) / sd), 4) AS zero_percent FROM m""")
def b11_best_trivial(spark: SparkSession, sf: str) -> DataFrame:
    frame = scored(spark, sf)
    middle = frame.agg(F.stddev_samp("past_sum").alias("sd")).withColumn("median_sum", F.lit(exact_quantile(frame, F.col("past_sum"), 0.5)).cast("double"))
    y = F.col("next_sum")
    errors = frame.crossJoin(F.broadcast(middle)).agg(F.avg(F.abs(y)).alias("zero"), F.avg(F.abs(y - F.col("past_sum"))).alias("past"), F.avg(F.abs(y - F.col("median_sum"))).alias("med"), F.max("sd").alias("sd"))
    best = F.least("zero", "past", "med") / F.col("sd")
    return errors.select(F.round(best, 6).alias("best_trivial"), F.round(100 * (F.col("zero") / F.col("sd")) / best, 4).alias("zero_percent"))
