"""Queries of readouts, probes, task tables and sinks."""

from __future__ import annotations

import hashlib
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import ranges
from tidelog.functions.exprs import count_if
from tidelog.operators import events, gaps, metrics, pairs, probe, ranking, readout, robust, targets
from tidelog.operators import window_language as wl
from tidelog.plans import feature_queries as fq
from tidelog.plans import ranking_queries as rq
from tidelog.plans import target_queries as tq
from tidelog.plans.feature_queries import CCUT, CUT, D, rounded
from tidelog.plans.registry import EV, O, query
from tidelog.sources import sinks
from tidelog.sources.sinks import written
from tidelog.sources.tables import read_database, read_table
from tidelog.spec import DAY, SHOP

#: Per customer: past orders in all, urgent ones, dear ones, and how long since the first, as rates per horizon.
RATES = f"""r0 AS (SELECT c_custkey AS entity_id, count(t) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS u, count(*) FILTER (o_totalprice > 150000) AS d, {CUT} - min(t) AS age, coalesce(sum(o_totalprice), 0) AS s
    FROM customer LEFT JOIN (SELECT * FROM o WHERE t < {CUT}) k ON o_custkey = c_custkey GROUP BY 1),
    r AS (SELECT *, coalesce(n * {D} / CAST(greatest(age, {D}) AS DOUBLE), 0) AS total, coalesce(u * {D} / CAST(greatest(age, {D}) AS DOUBLE), 0) AS urgent, coalesce(d * {D} / CAST(greatest(age, {D}) AS DOUBLE), 0) AS dear FROM r0)"""


def rates(spark: SparkSession, sf: str) -> DataFrame:
    log = tq.orders_log(spark, sf, until=CUT - 1)
    per = log.groupBy("entity_id").agg(
        F.count("*").alias("n"), count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"), count_if(F.col("o_totalprice") > 150000).alias("d"), (CUT - F.min("t")).alias("age"), F.sum("o_totalprice").alias("s")
    )
    joined = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id")).join(per, "entity_id", "left").fillna(0, ["n", "u", "d", "s"])
    rate = lambda c: readout.entity_rate(F.col(c), D, F.col("age"))
    return joined.withColumns({"total": rate("n"), "urgent": rate("u"), "dear": rate("d")})


@query(f"WITH {O}, {RATES} SELECT entity_id, round(total, 6) AS total, round(urgent, 6) AS urgent FROM r")
def r12_entity_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rates(spark, sf).select("entity_id", "total", "urgent"))


_C = "least(greatest({}, 0), 1)"


@query(f"""WITH {O}, {RATES} SELECT entity_id, round(greatest(total, 1e-9), 6) AS whole, round(greatest(urgent, 1e-9), 6) AS one, round(greatest(total * {_C.format("urgent / greatest(total, 1e-12)")} * {_C.format("dear / greatest(total, 1e-12)")}, 1e-9), 6) AS both FROM r""")
def r1_compose_rate(spark: SparkSession, sf: str) -> DataFrame:
    total, urgent, dear = F.col("total"), F.col("urgent"), F.col("dear")
    frame = rates(spark, sf).select("entity_id", readout.compose_rate([total], [[]]).alias("whole"), readout.compose_rate([total], [[urgent]]).alias("one"), readout.compose_rate([total], [[urgent, dear]]).alias("both"))
    return rounded(frame)


_EDGES, _CENTRES = tq._EDGES, [3.5, 9.5, 15.5, 22.0, 28.5, 35.0, 41.5, 47.5]


@query(f"""WITH {O}, l AS (SELECT *, CAST(epoch(l_shipdate) AS BIGINT) AS t FROM lineitem), b AS (SELECT o_custkey AS entity_id, {tq._BUCKET_SQL} AS b FROM l JOIN o ON o_orderkey = l_orderkey WHERE l.t < {CUT})
    SELECT entity_id, round(sum(CASE WHEN b < 3 THEN 1 WHEN b = 3 THEN 2.0 / 7 ELSE 0 END), 6) AS le_20, round(sum(CASE WHEN b < 3 THEN 0 WHEN b = 3 THEN 5.0 / 7 ELSE 1 END), 6) AS gt_20,
    round(sum([{", ".join(map(str, _CENTRES))}][b + 1]) / count(*), 6) AS mean_quantity FROM b GROUP BY 1""")
def r2_r9_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Rows at most, and over, 20 by bucket weights, and the bucketed mean."""
    lines = tq.lines_log(spark, sf, until=CUT - 1)
    b = targets.bucket_of(F.col("l_quantity"), _EDGES)
    held = lines.groupBy("entity_id").agg(F.array(*[count_if(b == i).cast("double") for i in range(8)]).alias("rates"))
    weigh = lambda op: F.aggregate(F.zip_with("rates", F.array(*map(F.lit, readout.bucket_weights(_EDGES, _CENTRES, op, 20.0))), lambda r, w: r * w), F.lit(0.0), lambda a, x: a + x)
    mean = readout.bucket_mean(F.col("rates"), F.array(*map(F.lit, _CENTRES)))
    return rounded(held.select("entity_id", weigh("le").alias("le_20"), weigh("gt").alias("gt_20"), mean.alias("mean_quantity")))


@query(f"""WITH {O}, {RATES} SELECT entity_id, round(exp(-total), 6) AS none, round({_C.format("1 - exp(-total)")}, 6) AS over_0, round({_C.format("1 - exp(-total) * (1 + total + total * total / 2)")}, 6) AS over_2 FROM r""")
def r4_poisson_tail(spark: SparkSession, sf: str) -> DataFrame:
    mu = F.col("total")
    return rounded(rates(spark, sf).select("entity_id", readout.p_none(mu).alias("none"), readout.p_more_than(mu, 0).alias("over_0"), readout.p_more_than(mu, 2).alias("over_2")))


@query(f"""WITH {O}, {RATES}, p AS (SELECT *, {_C.format("urgent / greatest(total, 1e-9)")} AS p FROM r), q AS (SELECT *, greatest(1 - p, 1e-12) AS q FROM p)
    SELECT entity_id, round({_C.format("1 - power(q, total)")}, 6) AS over_0, round({_C.format("1 - power(q, total) - greatest(total, 0) * p * power(q, total - 1)")}, 6) AS over_1 FROM q""")
def r5_binomial_tail(spark: SparkSession, sf: str) -> DataFrame:
    p = readout.ratio(F.col("urgent"), F.col("total"))
    frame = rates(spark, sf).withColumn("p", p)
    return rounded(frame.select("entity_id", readout.binomial_tail(F.col("total"), F.col("p"), 0).alias("over_0"), readout.binomial_tail(F.col("total"), F.col("p"), 1).alias("over_1")))


@query(f"""WITH {O}, {RATES} SELECT entity_id, round(1 - {_C.format("1 - exp(-total)")}, 6) AS churn, round({_C.format("urgent / greatest(total, 1e-9)")}, 6) AS urgent_share, round({_C.format("1 - exp(-urgent) * (1 + urgent)")}, 6) AS urgent_twice FROM r""")
def r6_classify(spark: SparkSession, sf: str) -> DataFrame:
    total, urgent = F.col("total"), F.col("urgent")
    return rounded(rates(spark, sf).select("entity_id", readout.classify(total, total, 0, False, absence=True).alias("churn"), readout.classify(urgent, total, 0, True).alias("urgent_share"), readout.classify(urgent, total, 1, True).alias("urgent_twice")))


@query(f"""WITH {O}, {RATES} SELECT entity_id, greatest(floor(total + 1.0 / 3.0 - 0.02 / greatest(total, 1e-9)), 0.0::DOUBLE) AS median_count, round(greatest(s * {_C.format("urgent / greatest(total, 1e-9)")}, 0), 4) AS median_sum, round({_C.format("dear / greatest(total, 1e-9)")}, 6) AS dear_share FROM r""")
def r7_r8_r10_medians(spark: SparkSession, sf: str) -> DataFrame:
    total, urgent = F.col("total"), F.col("urgent")
    frame = rates(spark, sf).select("entity_id", readout.poisson_median(total).alias("median_count"), F.round(readout.sum_median(F.col("s"), urgent, total), 4).alias("median_sum"), F.round(readout.ratio(F.col("dear"), total), 6).alias("dear_share"))
    return frame


@query(f"""WITH {EV}, k AS (SELECT * FROM ev WHERE t < {CCUT}), base AS (SELECT avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS b FROM k),
    h AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS n FROM k), c AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS hits FROM h WHERE n <= 512 GROUP BY 1)
    SELECT c_custkey AS entity_id, round(least(greatest((coalesce(hits, 0) + 5 * b) / (coalesce(n, 0) + 5), 1e-9), 1), 6) AS share FROM customer CROSS JOIN base LEFT JOIN c ON user_id = c_custkey""")
def r11_empirical_share(spark: SparkSession, sf: str) -> DataFrame:
    log = tq.clicks_log(spark, sf, until=CCUT - 1)
    base = log.agg(F.avg((F.col("event_type") == "purchase").cast("double")).alias("base"))
    points = tq.customers(spark, sf, CCUT)
    tail = events.history_tail(points, log.select("entity_id", "t", "table_idx", "row_key", "event_type"), 512)
    per = tail.groupBy("query_id").agg(F.count("*").alias("n"), count_if(F.col("event_type") == "purchase").alias("hits"))
    joined = points.join(per, "query_id", "left").fillna(0, ["n", "hits"]).crossJoin(F.broadcast(base))
    return rounded(joined.select("entity_id", readout.empirical_share(F.col("hits"), F.col("n"), F.col("base")).alias("share")))


@query()
def r13_fitted_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in the next horizon, regressed on past counts one horizon before."""
    at = lambda cutoff: rq.scored(spark, sf, cutoff).select("entity_id", F.log1p("pred").alias("recent"), F.log1p("n_past").alias("past"), F.col("n_next").alias("target"))
    return probe.fitted_rate(at(CUT - D), at(CUT), ["recent", "past"], "target").select("entity_id", "target", "rate")


def _gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps in days between a customer's orders up to the cutoff, per market segment."""
    log = tq.orders_log(spark, sf, until=CUT)
    gaps = targets.next_events(log, CUT, []).select("entity_id", F.ceil(F.col("gap") / DAY).cast("long").alias("gap"), "censored")
    segments = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("segment"))
    return gaps.join(segments, "entity_id").select("segment", "gap", "censored")


GAPS = f"""gp AS (SELECT c_mktsegment AS segment, CAST(ceil(greatest(1, coalesce(up, {CUT}) - t) / 86400.0) AS BIGINT) AS gap, up IS NULL AS censored FROM (SELECT *, lead(t) OVER (PARTITION BY o_custkey ORDER BY t, o_orderkey) AS up FROM o WHERE t <= {CUT}) JOIN customer ON o_custkey = c_custkey)"""
KM = """c AS (SELECT segment, gap, count(*) FILTER (NOT censored) AS events, count(*) AS n FROM gp GROUP BY ALL), k AS (SELECT *, CAST(sum(n) OVER (PARTITION BY segment ORDER BY gap DESC) AS BIGINT) AS at_risk FROM c),
    km AS (SELECT segment, gap, at_risk, events, CASE WHEN max(CASE WHEN events = at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER w) END AS survival FROM k WINDOW w AS (PARTITION BY segment ORDER BY gap))"""


@query(f"WITH {O}, {GAPS}, {KM} SELECT segment, gap, at_risk, events, round(survival, 6) AS survival FROM km")
def r15_kaplan_meier(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(readout.kaplan_meier(_gaps(spark, sf), "segment"))


def _inner_sql(u: str) -> str:
    """ln(erfc(u) exp(u^2)) of a u of 0 or more."""
    t = f"(1.0 / (1.0 + ({u}) / 2.0))"
    inner = str(gaps.ERFC[-1])
    for c in reversed(gaps.ERFC[:-1]):
        inner = f"({inner} * {t} + ({c}))"
    return f"(ln({t}) + {inner})"


def _steps_sql(components: int, steps: int) -> str:
    """Steps of the mixture's fit in SQL: `m{i}` has `segment, k, w, mu, s` after i of them, `e{i}` the terms of each row and component."""
    u = "(abs(z) / sqrt(2.0))"
    tail = f"({_inner_sql(u)} - {u} * {u} - ln(2.0))"
    survival = f"CASE WHEN z >= 0 THEN {tail} ELSE ln(1 - exp({tail})) END"
    ahead = f"CASE WHEN z >= 0 THEN sqrt(2.0 / pi()) * exp(-{_inner_sql(u)}) ELSE exp(-z * z / 2.0 - 0.5 * ln(2 * pi()) - ({survival})) END"
    low, high = gaps.LEAST_SIGMA, gaps.MOST_SIGMA
    out = [
        "gc AS (SELECT segment, ln(greatest(CAST(gap AS DOUBLE), 1.0)) AS x, censored, count(*) AS n FROM gp GROUP BY ALL)",
        f"""m0 AS (SELECT segment, k, 1.0 / {components} AS w, mean + s * (2.0 * k - {components - 1}) / {components} AS mu, s FROM (SELECT segment, sum(n * x) / sum(n) AS mean,
            least(greatest(sqrt(greatest(sum(n * x * x) / sum(n) - power(sum(n * x) / sum(n), 2), 0)), {low}), {high}) AS s FROM gc GROUP BY 1), range({components}) r(k))""",
    ]
    for i in range(steps):
        out += [
            f"""e{i} AS (SELECT *, n * exp(term - whole) AS part, CASE WHEN censored THEN s * ahead ELSE x - mu END AS f1, CASE WHEN censored THEN s * s * (1 + z * ahead) ELSE (x - mu) * (x - mu) END AS f2 FROM (
                SELECT *, most + ln(sum(exp(term - most)) OVER (PARTITION BY segment, x, censored)) AS whole, {ahead} AS ahead FROM (SELECT *, max(term) OVER (PARTITION BY segment, x, censored) AS most FROM (
                SELECT *, ln(greatest(w, 1e-300)) + CASE WHEN censored THEN {survival} ELSE -z * z / 2.0 - ln(s) - 0.5 * ln(2 * pi()) END AS term FROM (SELECT gc.*, k, w, mu, s, (x - mu) / s AS z FROM gc JOIN m{i} USING (segment))))))""",
            f"""m{i + 1} AS (SELECT segment, k, held / total AS w, CASE WHEN held > 1e-9 THEN mu + shift ELSE mu END AS mu, CASE WHEN held > 1e-9 THEN least(greatest(sqrt(greatest(f2 / greatest(held, 1e-12) - shift * shift, 0)), {low}), {high}) ELSE s END AS s
                FROM (SELECT segment, k, any_value(mu) AS mu, any_value(s) AS s, sum(part) AS held, sum(part * f1) / greatest(sum(part), 1e-12) AS shift, sum(part * f2) AS f2 FROM e{i} GROUP BY 1, 2) JOIN (SELECT segment, sum(n) AS total FROM gc GROUP BY 1) USING (segment))""",
        ]
    out.append(f"l AS (SELECT segment, sum(n * whole) FILTER (k = 0) AS log_likelihood, CAST(sum(n) FILTER (k = 0) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (k = 0 AND censored), 0) AS BIGINT) AS n_censored FROM e{steps - 1} GROUP BY 1)")
    return ", ".join(out)


_GAP_STEPS, _MIXED, _MIXED_STEPS = 12, 3, 4


@query(f"WITH {O}, {GAPS}, {_steps_sql(1, _GAP_STEPS)} SELECT segment, round(mu, 6) AS mu, round(s, 6) AS sigma, n, n_censored FROM m{_GAP_STEPS} JOIN l USING (segment)")
def r15_log_normal_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """One log-normal per segment, gaps that are still open counted by their chance of being longer."""
    fitted = gaps.fit_gap_mixture(_gaps(spark, sf), "segment", steps=_GAP_STEPS, settled=-1.0)
    return rounded(fitted.select("segment", "mu", "sigma", "n", "n_censored"))


@query(f"WITH {O}, {GAPS}, {_steps_sql(_MIXED, _MIXED_STEPS)} SELECT segment, CAST(row_number() OVER (PARTITION BY segment ORDER BY mu) AS INT) AS component, round(w, 5) AS weight, round(mu, 5) AS mu, round(s, 5) AS sigma, round(log_likelihood, 3) AS log_likelihood, n, n_censored FROM m{_MIXED_STEPS} JOIN l USING (segment)")
def r15_gap_mixture_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The first steps of a mixture's fit, as SQL can follow them."""
    fitted = rounded(gaps.fit_gap_mixture(_gaps(spark, sf), "segment", _MIXED, steps=_MIXED_STEPS, settled=-1.0), 5)
    return fitted.withColumn("log_likelihood", F.round("log_likelihood", 3))


@query()
def r15_gap_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """A mixture per segment fitted until it settles, and its chance that the next order comes within 30 days of a silence of 30."""
    fitted = written(gaps.fit_gap_mixture(_gaps(spark, sf), "segment", _MIXED, steps=40, settled=1e-6), "fitted-gaps")
    at = lambda day, name: gaps.mixture_survival(fitted, "segment", F.lit(day)).select("segment", F.col("survival").alias(name))
    chance = at(30, "now").join(at(60, "then"), "segment").select("segment", (1.0 - F.col("then") / F.col("now")).alias("next_30"))
    return rounded(fitted.join(chance, "segment"))


@query(f"""WITH {O}, {GAPS}, {KM}, h AS (SELECT segment, -ln(greatest(min(survival) FILTER (gap <= 30), 1e-9)) AS h1, -ln(greatest(min(survival) FILTER (gap <= 120), 1e-9)) AS h2 FROM km GROUP BY 1) SELECT segment, round(0.2 * (h2 - h1), 5) AS hazard, round(sqrt(0.2 * 0.5) * (h2 - h1), 5) AS blended FROM h""")
def r14_qualified_hazard(spark: SparkSession, sf: str) -> DataFrame:
    """The hazard from day 30 to day 120 of a gap, for a fifth of the events."""
    curve = readout.kaplan_meier(_gaps(spark, sf), "segment")
    at = lambda day: -F.log(F.greatest(F.min(F.when(F.col("gap") <= day, F.col("survival"))), F.lit(1e-9)))
    hazards = curve.groupBy("segment").agg(at(30).alias("h1"), at(120).alias("h2"))
    share = F.lit(0.2)
    return rounded(hazards.select("segment", readout.qualified_hazard(share, F.col("h1"), F.col("h2")).alias("hazard"), readout.qualified_hazard(share, F.col("h1"), F.col("h2"), F.lit(0.5), 0.5).alias("blended")), 5)


@query(f"WITH {O}, {rq.SCORED}, m AS (SELECT median(past_sum) AS m FROM scored WHERE n_past > 0) SELECT entity_id, round(CASE WHEN n_past = 0 THEN m ELSE past_sum END, 4) AS pred FROM scored, m")
def r16_cold_fill(spark: SparkSession, sf: str) -> DataFrame:
    frame = rq.scored(spark, sf).select("entity_id", F.col("past_sum").alias("pred"), "n_past")
    return rounded(readout.cold_fill(frame, "pred", F.col("n_past") == 0).select("entity_id", "pred"), 4)


@query(f"""WITH {O}, {rq.SCORED}, b AS (SELECT c_mktsegment AS segment, min(next_sum) AS lo, quantile_cont(next_sum, 0.9) AS hi FROM scored JOIN customer ON c_custkey = entity_id GROUP BY 1)
    SELECT entity_id, round(least(greatest(past_sum * 2, lo), hi), 4) AS pred FROM scored JOIN customer ON c_custkey = entity_id JOIN b ON segment = c_mktsegment""")
def r17_clamp_to_observed(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions clipped per segment to targets up to the segment's 90 % quantile."""
    segments = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("segment"))
    frame = rq.scored(spark, sf).join(segments, "entity_id")
    high = frame.groupBy("segment").agg(F.percentile("next_sum", F.lit(0.9)).alias("target"))
    low = frame.groupBy("segment").agg(F.min("next_sum").alias("target"))
    done = readout.clamp_to_observed(frame.withColumn("pred", F.col("past_sum") * 2), "pred", high.unionByName(low), "segment")
    return rounded(done.select("entity_id", "pred"), 4)


# probes -----------------------------------------------------------------------------------------------------------

_FEATURES = ["recent", "past", "idle_days"]
#: Rows that the logistic probe is fitted on; all rows are scored.
PROBE_SAMPLE = 20_000


def _probe_frame(spark: SparkSession, sf: str, cutoff: int) -> DataFrame:
    return rq.scored(spark, sf, cutoff).select("entity_id", F.log1p("pred").alias("recent"), F.log1p("n_past").alias("past"), F.log1p(F.coalesce(F.col("idle") / DAY, F.lit(1e4))).alias("idle_days"), F.col("y").cast("double").alias("label"), F.col("next_sum").alias("target"))


def _listed(spark: SparkSession, rows: list[tuple[str, float]], name: str, value: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias(name), F.lit(float(v)).alias(value)) for n, v in rows])))


def _candidate_features(spark: SparkSession, sf: str, cutoff: int, k: int, positives: bool = False) -> DataFrame:
    """Features of suppliers' k highest ranked parts at a cutoff, and of the positives, if asked for.

    `label` tells what ships in the horizon after the cutoff. Scores, activity
    and rankings are written once each.
    """
    scores = written(rq._scores(spark, sf, cutoff), "scores")
    activity = written(fq._activity(spark, sf, cutoff).filter(F.col("cutoff") == cutoff), "activity")
    candidates = written(rq._linear(spark, sf, cutoff, k, scores, activity).select("query_id", "candidate"), "ranked")
    truth = fq._supplier_pairs(spark, sf, cutoff).select("query_id", "candidate")
    lines = events.before(SHOP, read_database(spark, sf, SHOP), cutoff)["lineitem"]
    past = lines.filter(F.col("t") < cutoff).select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("candidate"), "t")
    return pairs.labelled_features(candidates.unionByName(truth) if positives else candidates, past, scores, truth, activity, cutoff)


def _keyed(frame: DataFrame) -> DataFrame:
    return frame.withColumn("key", F.xxhash64("query_id", "candidate"))


def _fit_rows(spark: SparkSession, sf: str, cutoff: int) -> DataFrame:
    """Positives and the highest ranked negatives, which a better score has to put below them."""
    return _candidate_features(spark, sf, cutoff, 20, positives=True)


@query()
def l10_refit_combination(spark: SparkSession, sf: str) -> DataFrame:
    """C and raw coefficients of the pair score, from positives and the highest ranked negatives."""
    best, coefficients = probe.refit_combination(_keyed(_fit_rows(spark, sf, CUT)), list(fq.WEIGHTS), "label", "key")
    return _listed(spark, [("C", best), *coefficients.items()], "name", "value")


#: Candidates of each query that both sets of coefficients rank.
SHORTLIST = 200


def held_out_ranking(known: DataFrame, asked: DataFrame, truth: DataFrame, given: dict[str, float], k: int = 20, **kwargs) -> DataFrame:
    """`coefficients, n_queries, map`: the given weights and those refitted on `known`, each ranking the rows of `asked`.

    `known` has `label, key` and the weights' columns, `asked` has `query_id,
    candidate` and these columns, of a later time and picked without a look at
    `truth`, of which what isn't among them is missed. Ties go to the smaller
    candidate.
    """
    _, refitted = probe.refit_combination(known, list(given), "label", "key", **kwargs)
    arms = []
    for name, weights in (("given", given), ("refitted", refitted)):
        score = sum((F.lit(float(w)) * F.col(c) for c, w in weights.items()), F.lit(0.0))
        ranked = ranking.top(asked.withColumn("score", F.round(score, 9)), "query_id", k, F.desc("score"), "candidate")
        arms.append(metrics.map_at_k(ranked, truth, k).select(F.lit(name).alias("coefficients"), "n_queries", "map"))
    return arms[0].unionByName(arms[1])


@query()
def l10_held_out(spark: SparkSession, sf: str) -> DataFrame:
    """The given and the refitted pair score, refitted a horizon before the cutoff, by their MAP over a shortlist at the cutoff."""
    known = sinks.settled(lambda: _fit_rows(spark, sf, CUT - D), "fit-rows")
    asked = sinks.settled(lambda: _candidate_features(spark, sf, CUT, SHORTLIST).drop("label"), "candidates")
    truth = written(fq._supplier_pairs(spark, sf).select("query_id", "candidate"), "truth")
    return rounded(held_out_ranking(_keyed(known), asked, truth, fq.WEIGHTS))


@query()
def p1_p3_logistic_probe(spark: SparkSession, sf: str) -> DataFrame:
    """A balanced logistic probe on a seeded sample, C by stratified folds over the published grid.

    It is fitted a horizon before the cutoff; its AUROC is over all rows at
    the cutoff, beside that over all rows of the time it was fitted at.
    """
    known, asked = (_probe_frame(spark, sf, cutoff) for cutoff in (CUT - D, CUT))
    best, coefficients = probe.refit_combination(probe.support_sample(known, "entity_id", PROBE_SAMPLE, seed=4), _FEATURES, "label", "entity_id", grid=probe.PROBE_C, folds=5)
    model_score = sum((F.lit(v) * F.col(n) for n, v in coefficients.items()), F.lit(0.0))
    found = [metrics.auroc(frame.select(F.col("label").alias("y"), model_score.alias("pred"))) for frame in (asked, known)]
    return found[0].crossJoin(found[1].withColumnRenamed("auroc", "auroc_known")).withColumn("c", F.lit(float(best)))


@query()
def p4_p5_median_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Next sums at the cutoff by a median regression fitted a horizon before."""
    frame, best, _ = probe.median_regression(_probe_frame(spark, sf, CUT - D), _probe_frame(spark, sf, CUT), _FEATURES, "target", "entity_id")
    return frame.select("entity_id", "target", "pred").withColumn("fitted", F.lit(best != "constant")).withColumn("chosen", F.lit(best))


@query()
def p4_linear_median(spark: SparkSession, sf: str) -> DataFrame:
    """The price of a line by absolute-loss regression on what is known of it: coefficients, penalty and errors.

    It is fitted on what shipped in the horizon before the last one before the
    cutoff. `held_out` and `held_out_constant` are mean absolute errors over
    the last horizon's lines, of the regression and of the median of the lines
    that it was fitted on.
    """
    parts = read_table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("retail"))
    lines = lambda until: tq.shipped(spark, sf, until - D, until).join(parts, "l_partkey").select(F.expr(SHOP["lineitem"].key).alias("row_key"), F.col("l_quantity").alias("quantity"), "retail", F.col("l_discount").alias("discount"), F.col("l_extendedprice").alias("target"))
    known, asked = lines(CUT - D), lines(CUT)
    line = robust.linear_l1(known, ["quantity", "retail", "discount"], "target", "row_key")
    middle = ranges.exact_quantile(known, F.col("target"), 0.5) or 0.0
    errors = line.predict(asked).agg(F.avg(F.abs(F.col("pred") - F.col("target"))).alias("line"), F.avg(F.abs(F.col("target") - middle)).alias("constant")).first()
    rows = [("intercept", line.intercept), *line.coefficients.items(), ("alpha", line.alpha), ("cv_error", line.error), ("cv_constant", line.constant_error), ("held_out", errors["line"]), ("held_out_constant", errors["constant"])]
    return _listed(spark, rows, "name", "value")


@query()
def p6_p7_pool_against_composed(spark: SparkSession, sf: str) -> DataFrame:
    """AUROC of the pool's best and of the composed Poisson readout on the same rows, after the time of fitting, and the pool's by folds."""
    best, result, found, failed = probe.auto_pool(_probe_frame(spark, sf, CUT - D), _probe_frame(spark, sf, CUT), _FEATURES, "label", "entity_id")
    composed = rates(spark, sf).select("entity_id", readout.p_more_than(F.col("total"), 0).alias("composed"))
    both = result.select("entity_id", "y", "pred").join(composed, "entity_id").persist()
    rows = [("fitted_" + best, metrics.auroc(both).first()["auroc"]), ("composed", metrics.auroc(both.select("y", F.col("composed").alias("pred"))).first()["auroc"]), *((f"cv_{n}", v) for n, v in found.items())]
    both.unpersist()
    missing = [(f"not fitted: {n}: {why}", float("nan")) for n, why in failed.items()]
    return _listed(spark, [(n, 0.5 if v is None else v) for n, v in rows] + missing, "readout", "auroc")


# task tables and sinks --------------------------------------------------------------------------------------------


@query(f"WITH {O}, g AS (SELECT {CUT} - j * {D} AS cutoff, j FROM range(1, 4) r(j)) SELECT c_custkey AS entity, cutoff, CASE WHEN count(t) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM customer CROSS JOIN g LEFT JOIN o ON o_custkey = c_custkey AND t > cutoff AND t <= cutoff + {D} GROUP BY ALL")
def s2_task_table(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a customer orders in the horizon after each of three cutoffs."""
    customers = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"))
    points = customers.select("entity_id", F.explode(F.array(*[F.lit(CUT - j * D).cast("long") for j in (1, 2, 3)])).alias("t_q")).withColumn("horizon_s", F.lit(D).cast("long")).withColumn("query_id", F.struct("entity_id", "t_q"))
    done = wl.answers({"ordered": wl.WindowQuery(("orders",))}, {"orders": partial(tq.orders_log, spark, sf)}, points)
    return done.select(F.col("query_id.entity_id").alias("entity"), F.col("query_id.t_q").alias("cutoff"), F.col("answer").alias("label"))


def _here(sf: str) -> str:
    """A short name of a data folder, the same in every process."""
    return hashlib.sha256(sf.encode()).hexdigest()[:8]


@query(f"""WITH {O}, l AS (SELECT *, CAST(epoch(l_shipdate) AS BIGINT) AS t FROM lineitem), x AS (SELECT 'events' AS part, t FROM o WHERE t <= {CUT} UNION ALL SELECT 'events', t FROM l WHERE t <= {CUT}
    UNION ALL SELECT 'history_customer', t FROM o WHERE t <= {CUT} AND o_custkey IS NOT NULL UNION ALL SELECT 'history_orders', t FROM l WHERE t <= {CUT} AND l_orderkey IS NOT NULL UNION ALL SELECT 'history_orders', t FROM o WHERE t <= {CUT})
    SELECT part, count(*) AS n_rows, max(t) AS last_t FROM x GROUP BY 1""")
def s3_materialize_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a corpus with their rows, written once and read again; its name and its build take the same flags."""
    flags = {"self_rows": True}
    tables = read_database(spark, sf, SHOP)
    frames = {"events": events.event_stream(SHOP, tables, CUT)} | {f"history_{e}": events.histories(SHOP, tables, e, CUT, **flags) for e in ("customer", "orders")}
    version = sinks.data_version(spark, [f"{sf}/{t.name}.parquet" for t in SHOP.tables])
    root, name = sinks.shared_folder(spark), sinks.corpus_name(f"shop-{_here(sf)}", CUT, version=version, **flags)
    sinks.materialize_corpus(spark, root, name, frames)
    again = sinks.materialize_corpus(spark, root, name, frames)
    arms = [frame.agg(F.lit(part).alias("part"), F.count("*").alias("n_rows"), F.max("t").alias("last_t")) for part, frame in again.items()]
    return reduce(DataFrame.unionByName, arms)


@query()
def s4_keyed_predictions(spark: SparkSession, sf: str) -> DataFrame:
    frame = rates(spark, sf).select(F.col("entity_id").alias("entity"), F.lit(CUT).cast("long").alias("cutoff"), F.col("total").alias("pred"))
    path = f"{sinks.shared_folder(spark)}/predictions-{_here(sf)}"
    sinks.write_keyed_predictions(frame, path, ["entity", "cutoff"])
    return spark.read.parquet(path)


@query(f"WITH {O}, {RATES} SELECT entity_id AS entity, CAST({CUT} AS BIGINT) AS cutoff, round(total, 6) AS pred FROM r")
def s5_assemble_submission(spark: SparkSession, sf: str) -> DataFrame:
    frame = rates(spark, sf).select(F.col("entity_id").alias("entity"), F.lit(CUT).cast("long").alias("cutoff"), "total")
    return rounded(sinks.assemble_submission(frame.select("entity", "cutoff"), frame, ["entity", "cutoff"], "total"))


@query(f"""WITH {O}, {rq.SCORED}, m AS (SELECT avg(next_sum) AS a FROM scored), x AS (SELECT CAST(count(*) AS DOUBLE) AS n, round(avg(abs(next_sum - past_sum)), 4) AS mae, round(1 - sum(power(next_sum - past_sum, 2)) / sum(power(next_sum - a, 2)), 6) AS r2 FROM scored, m)
    SELECT 'shop' AS dataset, 'customer_ltv' AS task, 'test' AS split, 'last_window' AS model, metric, value FROM x UNPIVOT (value FOR metric IN (n, mae, r2))""")
def s6_metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.metric_rows(rq.m3_mae_r2(spark, sf), "shop", "customer_ltv", "test", "last_window")
