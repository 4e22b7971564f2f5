"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mix has the golden-ratio point frac(i * 0.618...), which the
cumulative target shares map to a source; the k-th slot of a source takes the
k-th block of it. Blocks are cut from the source's documents, shuffled by a
digest of their ids and laid end to end as often as the mix may take them, so
that all blocks hold the same number of words but a source's last one, which is
cut to the word where its target ends. A source's slots beyond that stay empty,
and the few blocks that it has no slot for follow at the end. Because the points have low
discrepancy, every stretch of the mix has close to the target shares, not only
the whole. Points are whole numbers modulo 2 ** 60, as exact for the last slot
as for the first.

Every ordering is dealt in two levels (chunks of slots, buckets of documents),
so the largest source doesn't meet in one task.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import WORD, cut, table, word_count

#: Bits of a point, and the golden ratio's fractional part in them.
POINT_BITS = 60
GOLDEN = (math.isqrt(5 << 2 * POINT_BITS) - (1 << POINT_BITS)) // 2
#: Words in a block, and how often the mix may take a word.
BLOCK_WORDS, MOST_REPEATS = 64, 3


def document_sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """`doc_id, source, size` (words) of every row; a null text has none."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))


def source_targets(sizes: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source: `source, place, weight, source_size, target, low, high`.

    Sources by code point, null last, weigh 1, 2, 3 and again; together they
    get as many words as there are. A target stops at `most` times its source;
    what is cut off is shared by weight among the rest until none is above.
    That is one level: in the order of cap / weight, the level from each
    source on is what the earlier caps leave over the weight still open, and
    its largest value holds. `low` and `high` are cumulative shares.
    The windows hold one row per source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")).withColumn("place", F.row_number().over(by_name)).withColumn("weight", (F.col("place") - 1) % 3 + 1)
    by_cap = W.orderBy(F.col("source_size") / F.col("weight"), "place")
    earlier, everything = by_cap.rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left_over = F.sum("source_size").over(everything) - F.coalesce(F.sum(most * F.col("source_size")).over(earlier), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    levels = totals.withColumn("level", left_over.cast("double") / open_weight.cast("double"))
    level = F.greatest(F.max("level").over(everything), F.lit(0.0))
    targets = levels.withColumn("target", F.least((most * F.col("source_size")).cast("double"), level * F.col("weight")))
    before = by_name.rowsBetween(W.unboundedPreceding, -1)
    whole = F.sum("source_size").over(everything)
    low = F.try_divide(F.coalesce(F.sum("target").over(before), F.lit(0.0)), whole)
    return targets.withColumn("low", low).withColumn("high", F.coalesce(F.lead("low").over(by_name), F.lit(2.0))).drop("level")


def golden_point(slot: Column) -> Column:
    """The slot's point in [0, 1): slot * GOLDEN modulo 2 ** 60, by halves so that no product overflows."""
    half = POINT_BITS // 2
    low_bits = F.lit((1 << half) - 1)
    high, low = F.lit(GOLDEN >> half), F.lit(GOLDEN & ((1 << half) - 1))
    slot_high, slot_low = F.shiftright(slot, half), slot.bitwiseAND(low_bits)
    upper = (slot_high * low + slot_low * high).bitwiseAND(low_bits)
    whole = (F.shiftleft(upper, half) + slot_low * low).bitwiseAND(F.lit((1 << POINT_BITS) - 1))
    return whole.cast("double") / F.lit(float(1 << POINT_BITS))


def slot_points(spark: SparkSession, sources: DataFrame, words: int, block: int = BLOCK_WORDS) -> DataFrame:
    """`slot, place, chunk`: the source of each slot.

    Slots map to sources over equal cells of [0, 1): every interval is listed
    in the cells that it meets, which bounds the join by cells plus sources.
    """
    slots = words // block + (words % block > 0)
    cells, chunk = max(1024, slots >> 14), max(4096, math.isqrt(slots))
    tasks = max(spark.sparkContext.defaultParallelism, slots >> 20)
    points = spark.range(0, slots, 1, tasks).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * cells))
    last = F.least(F.floor(F.col("high") * cells), F.lit(cells - 1))
    meets = sources.filter("low < high and target > 0").select("place", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * cells), F.greatest(last, F.floor(F.col("low") * cells)))).alias("cell"))
    return points.join(meets, "cell").filter("point >= low and point < high").select("slot", "place", F.floor(F.col("slot") / chunk).alias("chunk"))


def schedule(spark: SparkSession, sources: DataFrame, words: int, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix as `slot, place, block_no`: which block of its source fills each slot.

    The block is the slot's rank among its source's. Ranks come from counts per
    chunk of slots and a running number inside.
    """
    dealt = slot_points(spark, sources, words, block)
    counts = dealt.groupBy("place", "chunk").agg(F.count("*").alias("n"))
    by_chunk = W.partitionBy("place").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("place", "chunk", F.coalesce(F.sum("n").over(by_chunk), F.lit(0)).alias("start"))
    inside = F.row_number().over(W.partitionBy("place", "chunk").orderBy("slot")) - 1
    ranked = dealt.withColumn("inside", inside).join(starts, ["place", "chunk"])
    return ranked.select("slot", "place", (F.col("start") + F.col("inside")).alias("block_no"))


def filled_slots(sources: DataFrame, slots: DataFrame, words: int, block: int) -> tuple[DataFrame, DataFrame]:
    """`place, takes` of each source, and `place, block_no, slot` of each block in the mix.

    A source takes its target to the word, in blocks of which the last is cut.
    Block k is in the source's k-th slot; later slots stay empty. Points may
    leave a source a few slots short: the blocks without one follow after the
    last slot, by place. The window holds one row per source.
    """
    counts = slots.groupBy("place").agg(F.count("*").alias("slots"))
    takes = F.round("target").cast("long")
    blocks = F.floor((takes + block - 1) / block)
    own = sources.join(counts, "place", "left").select("place", takes.alias("takes"), F.coalesce("slots", F.lit(0)).alias("slots"), blocks.alias("blocks"))
    own = own.withColumn("missing", F.greatest(F.col("blocks") - F.col("slots"), F.lit(0)))
    earlier = W.orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    closing = own.withColumn("before", F.coalesce(F.sum("missing").over(earlier), F.lit(0))).filter("missing > 0")
    closing = closing.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("missing") - 1)))
    last = words // block + (words % block > 0)
    closing = closing.select("place", (F.col("slots") + F.col("k")).alias("block_no"), (F.lit(last) + F.col("before") + F.col("k")).alias("slot"))
    within = slots.join(own.select("place", "blocks"), "place").filter("block_no < blocks").select("place", "block_no", "slot")
    return own.select("place", "takes"), within.unionByName(closing)


def shuffled_order(doc_id: Column) -> Column:
    """Sort key of the shuffle: a digest of the id, so reruns agree."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def lay_out(sizes: DataFrame, sources: DataFrame, documents: int) -> DataFrame:
    """`doc_id, size, place, ..., start`: each document's words in its shuffled source.

    Buckets follow the shuffle's order; their sums are run up first, then the
    documents inside each. About sqrt(documents) rows meet at either level.
    """
    buckets = max(1, math.isqrt(documents))
    part = F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    keyed = (
        sizes.join(sources.drop("low", "high"), sizes["source"].eqNullSafe(sources["source"]))
        .select("doc_id", "size", "place", "source_size", "target", shuffled_order(F.col("doc_id")).alias("order"))
        .withColumn("bucket", F.floor(part * buckets))
    )
    by_bucket = W.partitionBy("place").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = keyed.groupBy("place", "bucket").agg(F.sum("size").alias("n"))
    starts = sums.select("place", "bucket", F.coalesce(F.sum("n").over(by_bucket), F.lit(0)).alias("bucket_start"))
    inside = W.partitionBy("place", "bucket").orderBy("order", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(inside), F.lit(0))
    return keyed.withColumn("before", before).join(starts, ["place", "bucket"]).select("doc_id", "size", "place", "source_size", "target", (F.col("bucket_start") + F.col("before")).alias("start"))


def _taken(docs: DataFrame, block: int, most: int) -> tuple[DataFrame, DataFrame]:
    """`doc_id, size, place, source_size, target, taken, first_slot` of every row, and the sources' rows."""
    spark = docs.sparkSession
    sizes = cut(document_sizes(docs), "mix-sizes")
    sources = cut(source_targets(sizes, most), "mix-sources")
    documents, words = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    laid = lay_out(sizes, sources, documents)
    slots = cut(schedule(spark, sources, words, block), "mix-slots")
    takes, blocks = filled_slots(sources, slots, words, block)
    takes = cut(takes, "mix-takes")
    # a source's words lie end to end `most` times; blocks are cut from all of it
    rounds = laid.filter("size > 0").join(takes, "place").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    begin = F.col("start") + F.col("round") * F.col("source_size")
    rounds = rounds.withColumn("begin", begin).filter((F.col("round") == 0) | (F.col("begin") < F.col("takes")))
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)
    pieces = rounds.withColumn("block_no", F.explode(F.sequence(first, last)))
    end = F.least(F.col("begin") + F.col("size"), (F.col("block_no") + 1) * block, F.col("takes"))
    overlap = F.greatest(end - F.greatest(F.col("begin"), F.col("block_no") * block), F.lit(0))
    pieces = pieces.select("place", "start", "doc_id", "size", "source_size", "target", "block_no", overlap.alias("overlap"))
    taken = (
        pieces.join(blocks, ["place", "block_no"], "left")
        .groupBy("place", "start", "doc_id", "size", "source_size", "target")
        .agg(F.sum(F.when(F.col("slot").isNotNull(), F.col("overlap")).otherwise(0)).cast("long").alias("taken"), F.min(F.when(F.col("overlap") > 0, F.col("slot"))).alias("first_slot"))
    )
    columns = ["doc_id", "size", "place", "source_size", "target", "taken", "first_slot"]
    nothing = laid.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("first_slot", F.lit(None).cast("long"))
    return taken.select(columns).unionByName(nothing.select(columns)), sources


def mix(docs: DataFrame, block: int = BLOCK_WORDS, most: int = MOST_REPEATS) -> DataFrame:
    """`doc_id, size, source_size, target, taken, first_slot` for every row of documents.

    `taken` is how many of the document's words the mix takes, repeats counted,
    at most `most` times its size; `first_slot` is the slot in which they
    begin, null if there are none. Null texts have size 0 and nothing taken;
    a null source is a source of its own, after all others. Repeated rows are
    laid out one after the other, each with its own share; of rows that are
    alike it doesn't matter which gets which. An empty table gives an empty
    result. Only two numbers, of rows and of words, reach the driver.
    """
    return _taken(docs, block, most)[0].drop("place")


def repeat_rules(taken: DataFrame, sources: DataFrame) -> DataFrame:
    """`source, place, base, last_id, last_order`: how often the mix takes the rows of each source.

    The mix goes around a source's shuffled rows and stops somewhere: rows
    before that place in the shuffle come once more than the `base` of those
    after it. `last_order` is the sort key of the row where it stops, and
    `last_id` its doc_id; both null where all rows come equally often.
    """
    base = taken.groupBy("place").agg(F.min(F.expr("taken div size")).alias("base"))
    more = taken.join(base, "place").filter("taken > base * size")
    last = more.groupBy("place").agg(F.max(F.struct(shuffled_order(F.col("doc_id")).alias("order"), "doc_id")).alias("last"))
    ruled = sources.select("place", "source").join(base, "place").join(last, "place", "left")
    return ruled.select("source", "place", "base", F.col("last.doc_id").alias("last_id"), F.col("last.order").alias("last_order"))


def repeat_documents(docs: DataFrame) -> DataFrame:
    """`documents` as mixed: each row as often as the mix takes it, whole.

    A row comes floor(taken / size) times, and once more where the rest of
    that division, as a part of 1, is above its own fixed draw in [0, 1).
    Rows that the mix takes nothing of are left out. The input's columns travel
    in one struct, so extra ones may have any name. Rows learn how often they
    come from their source's rule, one row a source; only those with the id
    at which the mix of their source stops are told apart by a shuffle.
    """
    taken, sources = _taken(docs, BLOCK_WORDS, MOST_REPEATS)
    taken = cut(taken.filter("size > 0").select("doc_id", "size", "place", "taken"), "mix-taken")
    rules = cut(repeat_rules(taken, sources), "mix-rules")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("draw"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    share = F.col("taken") / F.col("size")
    copies = (F.floor(share) + (share - F.floor(share) > draw).cast("long")).alias("copies")
    # rows of one source, id and size are told apart by their place among them
    nth = F.row_number().over(W.partitionBy("place", "doc_id", "size").orderBy("taken")).alias("nth")
    stops = rules.filter("last_order is not null").select("place", "last_id")
    at_stop = taken.join(stops, "place").filter(F.col("doc_id").eqNullSafe(F.col("last_id"))).select("place", "doc_id", "size", copies, nth)
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    worded = docs.select(row).filter(F.col("row.text").rlike(WORD)).select("row", F.col("row.doc_id").cast("long").alias("mix_id"), F.col("row.source").cast("string").alias("mix_source"))
    ruled = worded.join(rules, F.col("mix_source").eqNullSafe(rules["source"]))
    stopped = F.col("last_order").isNotNull() & F.col("mix_id").eqNullSafe(F.col("last_id"))
    before = F.coalesce(shuffled_order(F.col("mix_id")) < F.col("last_order"), F.lit(False))
    clear = ruled.filter(~stopped).select("row", (F.col("base") + before.cast("long")).alias("copies"))
    edge = ruled.filter(stopped).select("row", "place", F.col("mix_id").alias("doc_id"), word_count(F.col("row.text")).alias("size"))
    edge = edge.withColumn("nth", F.row_number().over(W.partitionBy("place", "doc_id", "size").orderBy("row.text"))).alias("e")
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("place", "doc_id", "size", "nth")]
    edge = edge.join(at_stop.alias("s"), reduce(Column.__and__, same)).select("row", "copies")
    often = clear.unionByName(edge).filter("copies > 0")
    return often.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")


def op2_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` mixed to the target shares."""
    return mix(table(spark, sf_dir, "documents"))


#: Written from the closed form: a source's first `takes` laid-out words are taken, around and around;
#: a document begins in the slot of the block that its first word is in.
OP2_SQL = rf"""
WITH d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s0 AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), s1 AS (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s0
), s2 AS (
    SELECT *, CAST((place - 1) % 3 + 1 AS BIGINT) AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS words FROM s1
), s3 AS (
    SELECT *, CAST(words - coalesce(sum(3 * source_size) OVER e, 0) AS DOUBLE)
              / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER e, 0) AS DOUBLE) AS level
    FROM s2 WINDOW e AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s4 AS (
    SELECT *, least(CAST(3 * source_size AS DOUBLE), greatest(max(level) OVER (), 0.0) * weight) AS target FROM s3
), s5 AS (
    SELECT *, coalesce(sum(target) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) / words AS low FROM s4
), s AS (
    SELECT *, coalesce(lead(low) OVER (ORDER BY place), 2.0) AS high FROM s5
), slots AS (
    SELECT i AS slot, CAST(CAST(CAST(i AS HUGEINT) * {GOLDEN} % {1 << POINT_BITS} AS BIGINT) AS DOUBLE) / CAST({1 << POINT_BITS} AS DOUBLE) AS point
    FROM range(CAST((SELECT (coalesce(max(words), 0) + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} FROM s) AS BIGINT)) t(i)
), dealt AS (
    SELECT place, slot, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS block_no
    FROM slots JOIN s ON point >= low AND point < high WHERE target > 0
), counted AS (
    SELECT place, count(*) AS n FROM dealt GROUP BY place
), takes AS (
    SELECT s.*, coalesce(n, 0) AS n, CAST(round(target) AS BIGINT) AS takes,
           greatest((CAST(round(target) AS BIGINT) + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} - coalesce(n, 0), 0) AS missing
    FROM s LEFT JOIN counted USING (place)
), closing AS (
    SELECT place, n, (words + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} + sum(missing) OVER (ORDER BY place) - missing AS after, unnest(range(CAST(missing AS BIGINT))) AS k FROM takes
), filled AS (
    SELECT place, block_no, slot FROM dealt
    UNION ALL SELECT place, n + k, after + k FROM closing
), laid AS (
    SELECT d.doc_id, d.size, t.place, t.source_size, t.target, t.takes,
           coalesce(sum(d.size) OVER (PARTITION BY t.place ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM d JOIN takes t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT l.doc_id, l.size, l.source_size, l.target, CASE WHEN l.size > 0 AND start < takes THEN CAST(f.slot AS BIGINT) END AS first_slot,
       CAST(CASE WHEN size = 0 THEN 0 ELSE takes // source_size * size + least(greatest(takes % source_size - start, 0), size) END AS BIGINT) AS taken
FROM laid l LEFT JOIN filled f ON f.place = l.place AND f.block_no = start // {BLOCK_WORDS}
"""
