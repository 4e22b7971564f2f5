"""Features of candidates and of (query, candidate) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.exprs import DAY, count_if
from tidelog.sources.sinks import written

WEEK = 7 * DAY
#: Rows that a task puts together by query or source.
TASK_ROWS = 500_000


def _dealt(frame: DataFrame, rows: int, key: str) -> DataFrame:
    """By the key to tasks of TASK_ROWS, whose memory holds them; what their files weigh is a tenth of that, so Spark would take fewer."""
    return frame.repartition(max(-(-rows // TASK_ROWS), frame.sparkSession.sparkContext.defaultParallelism), key)


def candidate_activity(cutoffs: DataFrame, history: DataFrame, candidates: DataFrame) -> DataFrame:
    """`cutoff, entity_id` with total, recent, trend and staleness, strictly before each cutoff.

    Recent is [c - 7 d, c), the time before it [c - 28 d, c - 7 d). The cutoffs
    are a short list given by the caller; that bounds what is broadcast.
    """
    age = F.col("cutoff") - F.col("t")
    seen = history.join(F.broadcast(cutoffs), F.col("t") < F.col("cutoff"))
    counts = seen.groupBy("cutoff", "entity_id").agg(
        F.count("*").alias("total"), count_if(age <= WEEK).alias("recent"), count_if((age > WEEK) & (age <= 4 * WEEK)).alias("earlier"), F.max("t").alias("last")
    )
    every = candidates.crossJoin(F.broadcast(cutoffs))
    filled = every.join(counts, ["cutoff", "entity_id"], "left").fillna(0, ["total", "recent", "earlier"])
    return filled.select(
        "cutoff",
        "entity_id",
        F.log1p("total").alias("total"),
        F.log1p("recent").alias("recent"),
        (F.log1p("recent") - F.log1p(F.col("earlier") / 3)).alias("trend"),
        F.coalesce(F.exp(-(F.col("cutoff") - F.col("last")) / (14 * DAY)), F.lit(0.0)).alias("staleness"),
    )


def pair_history(past: DataFrame, candidates: DataFrame) -> DataFrame:
    """`query_id, candidate` with repeat, log1p of times and exp(-days since / 7).

    `past` has `query_id, t_q, candidate, t`.
    """
    seen = past.groupBy("query_id", "candidate").agg(F.count("*").alias("n"), F.max("t").alias("last"))
    joined = candidates.join(seen, ["query_id", "candidate"], "left")
    recency = F.exp(-(F.col("t_q") - F.col("last")) / (7 * DAY))
    return joined.select("query_id", "candidate", F.when(F.col("n") > 0, 1).otherwise(0).alias("repeat"), F.log1p(F.coalesce("n", F.lit(0))).alias("times"), F.coalesce(recency, F.lit(0.0)).alias("recency"))


def link_pairs(fact: DataFrame, src: list[str], dst: list[str]) -> DataFrame:
    """`src, dst, t` of every row that holds both links, for all combinations of slots."""
    arms = F.array(*[F.struct(F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst")) for a in src for b in dst])
    return fact.select("t", F.inline(arms)).filter("src is not null and dst is not null")


def cooccurrence(pairs: DataFrame, topk: int = 32, most_links: int = 500, items: DataFrame | None = None) -> DataFrame:
    """`item, other, weight`: sources that link to both, the topk others of each item, or only of those in `items`.

    Sources with over `most_links` links, repeats counted, say nothing of
    likeness and are left out, which also bounds the pairs of a source. Links
    go to their sources once; what is needed of these is written as a pair of
    short lists, so the links' files are gone before pairs are counted.
    """
    asked = pairs.select("src", "dst").withColumn("asked", F.lit(True))
    if items is not None:
        wanted = items.select(F.col("item").alias("dst")).distinct().withColumn("asked", F.lit(True))
        asked = pairs.select("src", "dst").join(wanted, "dst", "left")
    links = _dealt(asked, pairs.count(), "src").groupBy("src", "dst").agg(F.count("*").alias("n"), F.max("asked").alias("asked"))
    kept = links.withColumn("links", F.sum("n").over(W.partitionBy("src"))).filter(F.col("links") <= most_links)
    lists = kept.groupBy("src").agg(F.collect_list(F.when(F.col("asked"), F.col("dst"))).alias("items"), F.collect_list("dst").alias("others"))
    held = written(lists.filter((F.size("items") > 0) & (F.size("others") > 1)).drop("src"), "links")
    both = held.select(F.explode("items").alias("item"), "others").select("item", F.explode("others").alias("other")).filter("item <> other")
    weights = both.groupBy("item", "other").agg(F.count("*").alias("weight"))
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("weight"), "other"))
    return weights.withColumn("place", place).filter(F.col("place") <= topk).drop("place")


def prior_items(past: DataFrame, most: int = 8) -> DataFrame:
    """`query_id, item, back`: the last destinations, repeats kept."""
    back = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("t"), F.desc("row_key"), "item"))
    return past.withColumn("back", back).filter(F.col("back") <= most).select("query_id", "item", "back")


def cooc_score(prior: DataFrame, cooc: DataFrame) -> DataFrame:
    """`query_id, candidate, score`: summed weights from a query's prior items; a repeated item counts again.

    A query's rows come from one task, so that what counts them has little to shuffle.
    """
    met = prior.join(cooc, "item").select("query_id", F.col("other").alias("candidate"), "weight").repartition("query_id")
    return met.groupBy("query_id", "candidate").agg(F.sum("weight").cast("long").alias("score"))


def pair_features(pairs: DataFrame, activity: DataFrame, history: DataFrame, scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """All features of `query_id, t_q, candidate` pairs and their weighted sum."""
    wide = (
        pairs.join(history, ["query_id", "candidate"], "left")
        .join(scores, ["query_id", "candidate"], "left")
        .join(activity.withColumnsRenamed({"cutoff": "t_q", "entity_id": "candidate"}), ["t_q", "candidate"], "left")
        .withColumn("cooc", F.log1p(F.coalesce("score", F.lit(0))))
        .fillna(0)
    )
    score = F.lit(0.0)
    for name, weight in weights.items():
        score = score + F.lit(weight) * F.col(name)
    return wide.select("query_id", "t_q", "candidate", *weights, score.alias("linear"))


def labelled_features(candidates: DataFrame, past: DataFrame, scores: DataFrame, truth: DataFrame, activity: DataFrame, t_q: int) -> DataFrame:
    """`query_id, candidate, label` and all features of the distinct `query_id, candidate` pairs, at one time.

    `past` has `query_id, candidate, t` of events before t_q, `scores` a score,
    `activity` is by `entity_id`, and `truth` has the pairs of label 1. All that
    is known of a pair goes to its query as narrow rows in one shuffle and is
    put together there, and a query's rows come from one task.
    """
    names = ["total", "recent", "trend", "staleness"]
    rows = candidates.select("query_id", "candidate").join(activity.select(F.col("entity_id").alias("candidate"), *names), "candidate", "left")
    none = [F.lit(None).cast("double").alias(n) for n in names]
    kinds = ("asked", "past", "score", "true")
    tagged = lambda frame, kind, value, more: frame.select("query_id", "candidate", F.lit(kinds.index(kind)).alias("kind"), value.cast("long").alias("value"), *more)
    known = tagged(past, "past", F.col("t"), none).unionByName(tagged(scores, "score", F.col("score"), none)).unionByName(tagged(truth, "true", F.lit(1), none))
    met = tagged(rows, "asked", F.lit(1), names).unionByName(known.filter("query_id is not null and candidate is not null"))
    n_rows = sum(frame.count() for frame in (candidates, past, scores, truth))
    of = lambda kind: F.when(F.col("kind") == kinds.index(kind), F.col("value"))
    per = _dealt(met, n_rows, "query_id").groupBy("query_id", "candidate").agg(
        F.max(of("asked")).alias("asked"), F.count(of("past")).alias("n"), F.max(of("past")).alias("last"), F.max(of("score")).alias("score"), F.max(of("true")).alias("true"), *[F.max(n).alias(n) for n in names]
    )
    recency = F.exp(-(F.lit(t_q) - F.col("last")) / (7 * DAY))
    return per.filter("asked = 1").select(
        "query_id",
        "candidate",
        F.coalesce("true", F.lit(0)).cast("double").alias("label"),
        *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names],
        (F.col("n") > 0).cast("int").alias("repeat"),
        F.log1p("n").alias("times"),
        F.coalesce(recency, F.lit(0.0)).alias("recency"),
        F.log1p(F.coalesce("score", F.lit(0))).alias("cooc"),
    )
