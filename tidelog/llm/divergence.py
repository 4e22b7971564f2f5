"""How far the sources of a language differ in what words they use.

One `bytes.translate` lowers letters and blanks separators, `bytes.split` and a
Counter per document give its terms. Tasks add documents up before anything is
shuffled, so what travels is (language, source, term) with two counts. All
later work is on these sparse counts and in whole numbers: a share is a count
smoothed by five in parts of 10^9, and two sources differ by the sum of the
absolute differences of their shares.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import cut, in_slices, table

#: Letters are lowered, bytes of other characters than ASCII stay, all else becomes a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: A term is kept from so many documents of its language on; counts are smoothed by ADDED; shares are in parts of UNIT; so many terms of a source are listed.
LEAST_DOCUMENTS, ADDED, UNIT, MOST_TERMS = 30, 5, 1_000_000_000, 50
#: A task sends its counts on when it holds so many, or so many bytes of terms.
HELD, HELD_BYTES = 300_000, 16 << 20
#: Terms and sources that meet in one task when sources are compared; parts that the counts of one source are dealt to.
BLOCK_TERMS, TILE_SOURCES, PARTS = 4096, 256, 32


def document_terms(text: bytes) -> Counter:
    """How often each term stands in one document's UTF-8 bytes."""
    return Counter(text.translate(TABLE).split())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`lang, source, term, n, documents`, added up over what the task has seen since it last sent; the term '' stands for any document."""
    held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    entries = size = 0

    def send() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            whole = pa.array(list(terms), pa.binary()).cast(pa.string())
            n, documents = (pa.array([v[i] for v in terms.values()], pa.int64()) for i in (0, 1))
            same = [pa.array([name], pa.string()).take(pa.array(np.zeros(len(terms), np.int32))) for name in (lang, source)]
            yield pa.RecordBatch.from_arrays([*same, whole, n, documents], ["lang", "source", "term", "n", "documents"])
        held.clear()

    for batch in (part for whole in batches for part in in_slices(whole, 2)):
        groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        for group, text in zip(groups, batch.column(2).cast(pa.binary())):
            terms = held.setdefault(group, {})
            terms.setdefault(b"", [0, 0])[1] += 1
            for term, n in document_terms(text.as_py()).items():
                if (sums := terms.get(term)) is None:
                    terms[term] = [n, 1]
                    entries, size = entries + 1, size + len(term)
                else:
                    sums[0] += n
                    sums[1] += 1
            if entries >= HELD or size >= HELD_BYTES:
                yield from send()
                entries = size = 0
    yield from send()


def kept_counts(df: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """`lang, source, term, n, whole, first` of the terms in at least `least` documents of their language.

    `n` is the count in the source, `whole` in the language, `first` marks one
    row of each (lang, term). The term '' with n = 0 has a row for every
    (lang, source) that occurs.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    sent = df.select(empty("lang"), empty("source"), empty("text")).mapInArrow(_counted, "lang string, source string, term string, n long, documents long")
    # dealt by term, so that the sums of a source and those of its language need one shuffle
    sums = sent.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    same = W.partitionBy("lang", "term")
    told = sums.withColumns({"whole": F.sum("n").over(same), "held_by": F.sum("documents").over(same), "first": F.row_number().over(same.orderBy("source")) == 1})
    return told.filter((F.col("term") == "") | (F.col("held_by") >= least)).drop("documents", "held_by")


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT (n + ADDED) / (total + ADDED terms)), exactly; null where nothing is kept."""
    return F.expr(f"1 + (cast({UNIT} AS decimal(20,0)) * ({n} + {ADDED})) div nullif(cast({total} + {ADDED} * {terms} AS decimal(20,0)), 0)")


def _distances(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of absolute differences of each two sources, over the terms of one block; a term that a source lacks has its share of nothing.

    Terms that neither tile has aren't here, so two sources begin with the
    difference of their shares of nothing for each term of the language, in
    block 0, and a term that is here replaces one of these.
    """
    sources, at = np.unique(rows["source"].to_numpy(), return_inverse=True)
    tile, rest = np.zeros(len(sources), np.int64), np.zeros(len(sources), np.int64)
    tile[at] = rows["tile"]
    listed = rows["term"].notna().to_numpy()
    rest[at[~listed]] = rows["p"].to_numpy()[~listed]
    codes, terms = pd.factorize(rows["term"].to_numpy()[listed])
    shares = np.repeat(rest[:, None], len(terms), axis=1)
    shares[at[listed], codes] = rows["p"].to_numpy()[listed]
    low, high, block, kept = (int(rows[c].iloc[0]) for c in ("low", "high", "block", "terms"))
    unseen = (kept if block == 0 else 0) - len(terms)
    left, right = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
    out = []
    for one in left:
        others = right[right > one] if low == high else right
        if len(others):
            out.append(pd.DataFrame({"a": sources[one], "b": sources[others], "value": np.abs(shares[others] - shares[one]).sum(axis=1) + unseen * np.abs(rest[others] - rest[one])}))
    nothing = np.zeros(0, object)
    done = pd.concat(out) if out else pd.DataFrame({"a": nothing, "b": nothing, "value": np.zeros(0, np.int64)})
    done.insert(0, "lang", np.full(len(done), rows["lang"].iloc[0], dtype=object))
    return done


def source_divergence(df: DataFrame, least: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS) -> DataFrame:
    """`lang, source, part, item, value, rank`: how sources differ from each other, and terms that they overuse.

    `df` has `lang, source, text`; null counts as ''. A row is a document,
    repeated ones too; other columns are ignored. Part `pair` has every other
    source of the language with the summed difference of shares, 0 where the
    language keeps no term; part `term` the `most_terms` terms whose share is
    furthest above the language's. Equal values go by the item's UTF-8. An
    empty table has no rows; a language with one source has no pairs.
    """
    counts = cut(kept_counts(df, least), "term-counts")
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if(F.col("first") & (F.col("term") != "")).alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    stats = cut(totals.join(langs, "lang"), "source-totals")

    # one source may hold a third of all counts: its totals go to PARTS parts, its counts to one of them each
    part = F.pmod(F.hash("term"), F.lit(PARTS))
    dealt = stats.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    both = counts.filter("term <> ''").withColumn("part", part).join(dealt, ["lang", "source", "part"])
    rated = cut(both.select("lang", "source", "term", "terms", share("n", "total", "terms").alias("p"), share("whole", "lang_total", "terms").alias("q")), "term-shares")

    order = lambda value, item: W.partitionBy("lang", "source").orderBy(F.desc(value), item)
    over = rated.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = over.withColumn("rank", F.row_number().over(order("value", "item"))).filter(F.col("rank") <= most_terms)

    # blocks of terms times tiles of sources; every source is in every block of its language, with its share of nothing
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("terms") / BLOCK_TERMS))
    tiles = stats.groupBy("lang").agg(F.ceil(F.count("*") / TILE_SOURCES).alias("tiles"))
    tile = F.pmod(F.xxhash64("source"), F.col("tiles"))
    shares = rated.select("lang", "terms", F.pmod(F.xxhash64("term"), blocks).alias("block"), "source", "term", "p")
    absent = stats.select("lang", "terms", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.coalesce(share("0", "total", "terms"), F.lit(0)).cast("long").alias("p"))
    placed = shares.unionByName(absent).join(tiles, "lang").withColumn("tile", tile)
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    found = met.groupBy("lang", "block", "low", "high").applyInPandas(_distances, "lang string, a string, b string, value long")
    summed = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = summed.select("lang", "value", F.inline(ways)).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.withColumn("rank", F.row_number().over(order("value", "item"))).unionByName(terms)


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit over every whole text of `documents`."""
    return source_divergence(table(spark, sf_dir, "documents"))


OP11_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS whole FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
    v AS (SELECT lang, count(*) AS terms, sum(whole) AS lang_total FROM k GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
    f AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, whole, terms, lang_total, sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
          FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    p AS (SELECT lang, source, term, n, CAST(1 + (CAST({UNIT} AS HUGEINT) * (n + {ADDED})) // CAST(total + {ADDED} * terms AS HUGEINT) AS BIGINT) AS p,
          CAST(1 + (CAST({UNIT} AS HUGEINT) * (whole + {ADDED})) // CAST(lang_total + {ADDED} * terms AS HUGEINT) AS BIGINT) AS q FROM f),
    pr AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    al AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source
           UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM al) WHERE part = 'pair' OR rank <= {MOST_TERMS}"""
