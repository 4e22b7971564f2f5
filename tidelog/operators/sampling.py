"""Negatives, proposals and training sets. Draws depend on a seed and keys, so they survive repartitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.exprs import uniform
from tidelog.functions.ranges import running_before

#: Shares of uniform, popularity and two-hop draws in the mixture.
MIXTURE = (0.4, 0.3, 0.3)
#: Entities that one shard of packed rows holds.
SHARD_ENTITIES = 200_000


def popularity(counts: DataFrame) -> DataFrame:
    """`entity_id, p, low, high`: shares of links + 1, and their cumulative intervals."""
    mass = counts.withColumn("mass", F.col("n_links") + 1)
    total = mass.agg(F.sum("mass").alias("total"))
    run = running_before(mass, "entity_id", F.col("mass"), "before").crossJoin(F.broadcast(total))
    return run.select("entity_id", (F.col("mass") / F.col("total")).alias("p"), (F.col("before") / F.col("total")).alias("low"), ((F.col("before") + F.col("mass")) / F.col("total")).alias("high"))


def draw_by_cdf(draws: DataFrame, cdf: DataFrame, u: str, cells: int = 1024) -> DataFrame:
    """Each draw's entity: the interval [low, high) that holds u.

    Intervals are listed in the equal cells they meet, at most cells plus
    entities rows, and joined on the cell; with as many cells as entities a
    draw meets two intervals on average.
    """
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
    listed = cdf.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    keyed = draws.withColumn("cell", cell(F.col(u)))
    return keyed.join(listed, "cell").filter((F.col(u) >= F.col("low")) & (F.col(u) < F.col("high"))).select(*draws.columns, "entity_id")


def negatives(queries: DataFrame, entities: DataFrame, cdf: DataFrame, n: int, seed: int) -> DataFrame:
    """`query_id, i, candidate`: half uniform over the catalogue, half by popularity.

    `entities` has `entity_id, row_index` with 0, 1, ... as indexes.
    """
    size = entities.agg(F.max("row_index") + 1).first()[0] or 0
    draws = queries.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn("u", uniform(seed, "query_id", "i"))
    flat = draws.filter(F.col("i") < n // 2).withColumn("row_index", F.floor(F.col("u") * size)).join(entities, "row_index").select("query_id", "i", F.col("entity_id").alias("candidate"))
    by_mass = draw_by_cdf(draws.filter(F.col("i") >= n // 2), cdf, "u", max(1024, size)).select("query_id", "i", F.col("entity_id").alias("candidate"))
    return flat.unionByName(by_mass)


def mixture(pairs: DataFrame, cdf: DataFrame, two_hop: DataFrame, catalogue: int, shares: tuple[float, float, float] = MIXTURE) -> DataFrame:
    """`query_id, candidate, q, log_q`: the exact probability of each pair under the mixture.

    `two_hop` has `query_id, candidate, share`. Where there is none at all,
    call with shares whose last is 0; they are scaled to 1.
    """
    flat, popular, near = (s / sum(shares) for s in shares)
    joined = pairs.join(cdf.select(F.col("entity_id").alias("candidate"), "p"), "candidate").join(two_hop, ["query_id", "candidate"], "left")
    q = F.lit(flat / catalogue) + F.lit(popular) * F.col("p") + F.lit(near) * F.coalesce("share", F.lit(0.0))
    return joined.withColumn("q", q).select("query_id", "candidate", "q", F.log(F.greatest(F.col("q"), F.lit(1e-12))).alias("log_q"))


def two_hop_shares(scores: DataFrame) -> DataFrame:
    """`query_id, candidate, share`: scores over their sum per query."""
    total = scores.groupBy("query_id").agg(F.sum("score").alias("total"))
    return scores.join(total.filter("total > 0"), "query_id").select("query_id", "candidate", (F.col("score") / F.col("total")).alias("share"))


def without_hits(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Candidates that aren't positives of their query."""
    return candidates.join(truth, ["query_id", "candidate"], "left_anti")


def enumerate_catalogue(queries: DataFrame, catalogue: DataFrame, n_negatives: int, size: int) -> DataFrame | None:
    """Every (query, candidate) where the catalogue is no larger than 8 + n_negatives; else None.

    That bound is also what makes it safe to broadcast.
    """
    if size > 8 + n_negatives:
        return None
    return queries.crossJoin(F.broadcast(catalogue))


def shared_pool(entities: DataFrame, cdf: DataFrame, n: int, seed: int, shares: tuple[float, float] = (4 / 7, 3 / 7)) -> DataFrame:
    """`i, candidate, q`: one pool for all queries, drawn with replacement, q its exact chance per draw."""
    size = entities.agg(F.max("row_index") + 1).first()[0] or 0
    flat = round(n * shares[0])
    draws = entities.sparkSession.range(n).withColumnRenamed("id", "i").withColumn("u", uniform(seed, "i"))
    uniform_part = draws.filter(F.col("i") < flat).withColumn("row_index", F.floor(F.col("u") * size)).join(entities, "row_index").select("i", "entity_id")
    popular_part = draw_by_cdf(draws.filter(F.col("i") >= flat), cdf, "u", max(1024, size)).select("i", "entity_id")
    chance = F.lit(shares[0] / max(1, size)) + F.lit(shares[1]) * F.col("p")
    return uniform_part.unionByName(popular_part).join(cdf.select("entity_id", "p"), "entity_id").select("i", F.col("entity_id").alias("candidate"), chance.alias("q"))


def mixed_correction(n_local: int, q_local: Column, n_shared: int, q_shared: Column) -> Column:
    """log(N Q_local + S Q_shared): the weight of a candidate that either route could have drawn."""
    return F.log(F.greatest(n_local * q_local + n_shared * q_shared, F.lit(1e-12)))


def shortlist(history: DataFrame, popular: DataFrame, two_hop: DataFrame, queries: DataFrame, n_pop: int, n_hop: int) -> DataFrame:
    """`query_id, candidate`: a query's own items, the most popular ones and its strongest two-hop ones, once each."""
    top = popular.orderBy(F.desc("n_links"), "entity_id").limit(n_pop).select(F.col("entity_id").alias("candidate"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "candidate"))
    near = two_hop.withColumn("place", place).filter(F.col("place") <= n_hop).select("query_id", "candidate")
    return history.select("query_id", "candidate").unionByName(queries.select("query_id").crossJoin(F.broadcast(top))).unionByName(near).distinct()


def history_tails(history: DataFrame, most: int) -> DataFrame:
    """The last events of each entity, with `back` from 1 for the latest."""
    back = F.row_number().over(W.partitionBy("entity_id").orderBy(F.desc("t"), F.desc("row_key")))
    return history.withColumn("back", back).filter(F.col("back") <= most)


def pack_sequences(history: DataFrame, max_len: int, seed: int, shards: int | None = None) -> DataFrame:
    """`shard, row_id, place, entity_id, row_key, t`: last events of entities laid end to end into rows of max_len.

    An entity gives its last max_len / 2 events; entities come in an order
    fixed by the seed. An event past its row's end is cut off with the rest of
    its entity's, as rows don't run over. There is a shard for every
    SHARD_ENTITIES entities, so that none has to be sorted in one task.
    """
    tail = history_tails(history, max_len // 2)
    sizes = tail.groupBy("entity_id").agg(F.count("*").alias("n"))
    shards = shards or max(16, -(-sizes.count() // SHARD_ENTITIES))
    order = F.xxhash64(F.lit(seed), "entity_id")
    sharded = sizes.withColumn("shard", F.pmod(order, F.lit(shards)).cast("int")).withColumn("ord", order)
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("ord", "entity_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sharded.withColumn("start", before).select("entity_id", "shard", "n", F.floor(F.col("start") / max_len).alias("row_id"), (F.col("start") % max_len).alias("offset"))
    placed = tail.join(starts, "entity_id").withColumn("place", (F.col("offset") + F.col("n") - F.col("back")).cast("int"))
    return placed.filter(F.col("place") < max_len).select("shard", "row_id", "place", "entity_id", "row_key", "t")


def entity_rows(history: DataFrame, max_len: int) -> DataFrame:
    """`entity_id, length, events`: one row per entity, its last max_len events in order, as (row_key, t)."""
    tail = history_tails(history, max_len)
    events = F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("place"), "row_key", "t")))
    rows = tail.groupBy("entity_id").agg(F.count("*").alias("length"), events.alias("events"))
    return rows.withColumn("events", F.transform("events", lambda e: F.struct(e["row_key"].alias("row_key"), e["t"].alias("t"))))


def sample_by(frame: DataFrame, column: str, shares: dict[str, float], key: str, seed: int) -> DataFrame:
    """Rows kept with the share of their group, by a draw fixed per key."""
    share = F.lit(0.0)
    for value, p in shares.items():
        share = F.when(F.col(column) == value, p).otherwise(share)
    return frame.filter(uniform(seed, column, key) < share)


def eligible_entities(history: DataFrame, least: int) -> DataFrame:
    """`entity_id, n` of entities with enough events."""
    return history.groupBy("entity_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
