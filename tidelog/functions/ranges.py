"""Orderings in two levels: ranges of a key, and rows inside each."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.sources.sinks import written

#: Rows that a range should hold, and the fewest and most ranges that a key is cut into; as many bounds reach the driver.
PART_ROWS, FEWEST_PARTS, MOST_PARTS = 1_000_000, 8, 10_000
#: So many distinct values, with their counts, may reach the driver when a quantile is looked up.
FEW_VALUES = 10_000
#: Approximate quantiles are off by one of so many parts of the rows; a piece of a column is divided at so many quantiles.
ACCURACY, GRID = 50_000, 500


def parts_for(rows: int) -> int:
    """How many ranges a frame of so many rows is cut into."""
    return min(MOST_PARTS, max(FEWEST_PARTS, -(-rows // PART_ROWS)))


def with_part(frame: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Adds `part`, the range of a numeric key, from approximate quantiles.

    As many ranges as the rows ask for, unless `parts` is given. The bounds are
    numbers in the plan, so every use of the result agrees on them, recomputed
    or not; a key's range is found by halving, so many bounds cost little.
    """
    parts = parts or parts_for(frame.count())
    at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = frame.agg(F.percentile_approx(key, at, max(1000, 10 * parts)).alias("b")).first()["b"] if parts > 1 else []
    bounds = sorted(set(found or []))
    if not bounds:
        return frame.withColumn("part", F.lit(0))
    held, last = F.array(*map(F.lit, bounds)), F.lit(len(bounds))
    fits = lambda ahead: (ahead <= last) & (F.element_at(held, F.least(ahead, last)) < F.col(key))
    # a fold over the steps, as each step written out would hold the one before it several times
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(len(bounds).bit_length()))])
    part = F.aggregate(steps, F.lit(0), lambda part, step: F.when(fits(part + step), part + step).otherwise(part))
    return frame.withColumn("part", part)


def exact_quantiles(frame: DataFrame, value: Column, shares: Sequence[float]) -> list[float | None]:
    """Interpolated quantiles of a column's values; nulls don't count, and without values they are None.

    All shares are looked up together. The values are written once; one pass
    finds approximate quantiles on both sides of each wanted place, one counts
    what lies between and at these points, which tells places that fall on a
    point, and one counts the distinct values of the pieces that hold the other
    places. Pieces that hold more than FEW_VALUES rows are divided once more
    before that. So no buffer holds all of a column's values, and the passes
    don't go with the number of shares.
    """
    values = written(frame.select(value.cast("double").alias("v")).filter("v is not null and not isnan(v)"), "values")
    probes = sorted({min(1.0, max(0.0, s + d)) for s in shares for d in (-2.0 / ACCURACY, 0.0, 2.0 / ACCURACY)})
    first = values.agg(F.count("*").alias("n"), F.approx_count_distinct("v").alias("distinct"), F.percentile_approx("v", F.array(*map(F.lit, probes)), ACCURACY).alias("at")).first()
    n = first["n"]
    if not n:
        return [None] * len(shares)
    wanted = {k for s in shares for k in (int(s * (n - 1)), min(int(s * (n - 1)) + 1, n - 1))}
    found: dict[int, float] = {}
    pieces = [_Piece(-math.inf, math.inf, 0)]  # of values that the places not yet found lie in
    points = sorted(set(first["at"]))
    while wanted - found.keys() and first["distinct"] > FEW_VALUES // 2:
        counted = _between(values, pieces, points)
        pieces, points = [], []
        for piece, n_rows, grid in counted:
            inside = [k for k in wanted - found.keys() if piece.below <= k < piece.below + n_rows]
            if piece.low == piece.high:
                found |= dict.fromkeys(inside, piece.low)
            elif inside:
                pieces.append(piece)
                if n_rows > FEW_VALUES:
                    points += {g for k in inside for g in _beside(grid, (k - piece.below) / n_rows) if piece.low < g < piece.high}
        if not points:
            break
    if left := wanted - found.keys():
        held = values.filter(_within(pieces)).groupBy("v").agg(F.count("*").alias("n")).collect()
        for piece in pieces:
            seen = piece.below
            for v, many in sorted((r["v"], r["n"]) for r in held if (piece.low < r["v"] or piece.low == -math.inf) and (r["v"] < piece.high or piece.high == math.inf)):
                found |= {k: v for k in left if seen <= k < seen + many}
                seen += many
    out = []
    for s in shares:
        place = s * (n - 1)
        low, high = found[int(place)], found[min(int(place) + 1, n - 1)]
        out.append(low if low == high else low + (place - int(place)) * (high - low))
    return out


def exact_quantile(frame: DataFrame, value: Column, share: float) -> float | None:
    """One interpolated quantile of a column's values."""
    return exact_quantiles(frame, value, [share])[0]


class _Piece(NamedTuple):
    """Values strictly between two bounds, or a bound itself where both are the same, and how many rows lie below.

    Where a bound is infinite, infinite values are inside.
    """

    low: float
    high: float
    below: int


def _within(pieces: list[_Piece]) -> Column:
    above = lambda p: F.col("v") > p.low if p.low > -math.inf else F.lit(True)
    under = lambda p: F.col("v") < p.high if p.high < math.inf else F.lit(True)
    return reduce(lambda a, b: a | b, [above(p) & under(p) for p in pieces], F.lit(False))


def _between(values: DataFrame, pieces: list[_Piece], points: list[float]) -> list[tuple[_Piece, int, list[float]]]:
    """The pieces cut at the points: each new piece with its rows and a grid of its approximate quantiles, in one pass."""
    bounds = sorted({b for b in (*points, *(b for p in pieces for b in (p.low, p.high))) if abs(b) < math.inf})
    held = F.array(*map(F.lit, bounds)).cast("array<double>")
    # cell 2 i lies before bound i, cell 2 i + 1 is bound i
    cell = 2 * F.size(F.filter(held, lambda b: b < F.col("v"))) + F.when(F.array_contains(held, F.col("v")), 1).otherwise(0)
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    rows = values.filter(_within(pieces)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.percentile_approx("v", grid, 4 * GRID).alias("grid")).collect()
    counted = {r["cell"]: r for r in rows}
    out = []
    for piece in pieces:
        below = piece.below
        for c in range(2 * len(bounds) + 1):
            low, high = (bounds[c // 2],) * 2 if c % 2 else (bounds[c // 2 - 1] if c else -math.inf, bounds[c // 2] if c // 2 < len(bounds) else math.inf)
            if c in counted and piece.low <= low and high <= piece.high and not (low == high and low in (piece.low, piece.high)):
                out.append((_Piece(low, high, below), counted[c]["n"], counted[c]["grid"]))
                below += counted[c]["n"]
    return out


def _beside(grid: list[float], share: float) -> tuple[float, float]:
    """Grid values on both sides of a share, wide enough for the grid's error."""
    at = share * GRID
    return grid[max(0, math.floor(at) - 1)], grid[min(GRID, math.ceil(at) + 1)]


def running_sums(frame: DataFrame, key: str, amounts: dict[str, Column]) -> DataFrame:
    """Adds under each name the sum of its amount over all rows with a smaller key; keys are distinct.

    Ranges are summed first, then rows inside each, so no task sees all rows;
    the sums are one row a range, MOST_PARTS at most.
    """
    dealt = with_part(frame.withColumns({f"_amount_{n}": a for n, a in amounts.items()}), key)
    sums = dealt.groupBy("part").agg(*[F.sum(f"_amount_{n}").alias(n) for n in amounts])
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_start_{n}") for n in amounts])
    inside = W.partitionBy("part").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    run = dealt.withColumns({f"_inside_{n}": F.coalesce(F.sum(f"_amount_{n}").over(inside), F.lit(0)) for n in amounts}).join(F.broadcast(starts), "part")
    own = [c for c in frame.columns if c not in amounts]
    return run.select(*own, *[(F.col(f"_start_{n}") + F.col(f"_inside_{n}")).alias(n) for n in amounts])


def running_before(frame: DataFrame, key: str, amount: Column, name: str) -> DataFrame:
    """Adds the sum of `amount` over all rows with a smaller key; keys are distinct."""
    return running_sums(frame, key, {name: amount})
