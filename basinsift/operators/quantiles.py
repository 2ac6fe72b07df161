"""Exact order statistics from histograms: ranges are narrowed until they hold one value, so no task keeps the values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a round and range.
BINS = 2048


def _spread(values: DataFrame) -> tuple[int, float | None, float | None]:
    """Number of values, the least and the greatest."""
    return tuple(values.agg(F.count("*"), F.min("v"), F.max("v")).first())


def _finite(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("double").alias("v")).filter(F.abs("v") < F.lit(math.inf))


def _range_of(ends: list[float], first: int = 0) -> Column:
    """The number of the first range that doesn't end before ``v``, by halving, so that a row takes as many tests as the logarithm of their number."""
    if len(ends) == 1:
        return F.lit(first)
    half = len(ends) // 2
    return F.when(F.col("v") <= ends[half - 1], _range_of(ends[:half], first)).otherwise(_range_of(ends[half:], first + half))


def at_ranks(df: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The values of the given ranks (from 0) among the finite numbers of a column.

    Each round counts the rows of every open range in ``BINS`` bins, in one job, and keeps of each range the bin that holds the
    rank, from its least to its greatest value.  These lie in different bins of the next round, so every round narrows the range.
    Open ranges have no value in common, so a row is counted once in a round, however many ranks there are.
    """
    values = _finite(df, column)
    return _narrowed(values, ranks, *_spread(values)[1:])


def _narrowed(values: DataFrame, ranks: list[int], low: float, high: float) -> dict[int, float]:
    found: dict[int, float] = {}
    open_ranges = {rank: (low, high, 0) for rank in ranks}  # least and greatest value, and rows before
    while open_ranges := {r: x for r, x in open_ranges.items() if r not in found}:
        for rank, (a, b, _) in open_ranges.items():
            if a == b:
                found[rank] = a
        todo = sorted({(a, b) for a, b, _ in open_ranges.values() if a != b})
        if not todo:
            continue
        at = values.withColumn("range", _range_of([b for _, b in todo]))
        a, b = (F.element_at(F.lit(list(ends)), F.col("range") + 1) for ends in zip(*todo, strict=True))
        # Halves keep the width of any range finite.
        place = F.least(F.lit(BINS - 1), F.floor((F.col("v") / 2 - a / 2) / (b / 2 - a / 2) * BINS))
        counted = at.filter(F.col("v").between(a, b)).groupBy("range", place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        bins: dict[tuple[float, float], list] = {x: [] for x in todo}
        for r in sorted(counted.collect(), key=lambda r: (r["range"], r["bin"])):  # ``BINS`` rows for each range
            bins[todo[r["range"]]].append(r)
        for rank, (a, b, before) in list(open_ranges.items()):
            for r in bins.get((a, b), []):
                if before + r["n"] > rank:
                    open_ranges[rank] = (r["a"], r["b"], before)
                    break
                before += r["n"]
    return found


def exact(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Quantiles between the two nearest order statistics, in proportion; nulls and numbers that aren't finite don't count, none of an empty column."""
    values = _finite(df, column)
    n, low, high = _spread(values)
    if not n:
        return [None] * len(shares)
    places = [share * (n - 1) for share in shares]
    found = _narrowed(values, sorted({r for p in places for r in (math.floor(p), math.ceil(p))}), low, high)
    return [found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in places]
