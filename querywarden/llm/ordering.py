"""Global row numbers without a single-task sort.

Rows are dealt into ranges of the key (bounds: quantiles over all rows, so
their number is a parameter, not a function of the data), numbered inside
each range by a window, and shifted by the count of all earlier ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions


def range_bounds(df: DataFrame, key: str, n_ranges: int | None = None) -> list[int]:
    """Up to ``n_ranges - 1`` ascending bounds that cut ``key`` into ranges of like counts."""
    n = n_ranges or shuffle_partitions(df.sparkSession)
    if n < 2:
        return []
    cuts = [i / n for i in range(1, n)]
    got = df.agg(F.percentile_approx(key, cuts, 20 * n).alias("q")).first()["q"]
    return sorted(set(got or []))


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are <= ``key`` (binary search; a null key is in range 0)."""
    if not bounds:
        return F.lit(0)
    n = len(bounds)
    steps = [1 << i for i in range(n.bit_length() - 1, -1, -1)]
    arr = F.lit(bounds) if len(bounds) > 1 else F.array(F.lit(bounds[0]))
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda acc, s: F.when(
            (acc + s <= n) & (F.get(arr, acc + s - 1) <= key), acc + s).otherwise(acc),
    )


def with_row_number(df: DataFrame, key: str, ties: list[str], out: str = "row_no",
                    n_ranges: int | None = None) -> tuple[DataFrame, int]:
    """Add gapless row numbers 0..N-1 in ascending (``key``, ``ties``); also returns N.

    Null keys come first. Rows equal in the key and all ties are
    interchangeable: they get neighbouring numbers in any order.
    """
    bounds = range_bounds(df, key, n_ranges)
    ranged = df.withColumn("_range", range_of(F.col(key), bounds))
    counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    offsets, total = [], 0
    for i in range(len(bounds) + 1):
        offsets.append(total)
        total += counts.get(i, 0)
    offs = F.array(*[F.lit(o).cast("long") for o in offsets])
    w = Window.partitionBy("_range").orderBy(F.col(key).asc_nulls_first(),
                                             *[F.col(t).asc_nulls_first() for t in ties])
    numbered = ranged.withColumn(out, F.row_number().over(w) - 1 + F.get(offs, F.col("_range")))
    return numbered.drop("_range"), total
