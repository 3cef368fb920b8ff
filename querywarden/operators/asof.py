"""As-of join: each row with the newest version of its key at or before its time.

The rows' times are cut into ranges of like counts (quantiles over all
rows), and the rows and versions of a (key, range) meet in one window, so a
key with a third of all rows is spread over the ranges. What a range must
know of earlier ones is one row: the key's last version before it, from a
summary of one row for each (key, range). No row is joined with more than
one version, and nothing is gathered but the bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _range_of(at: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at or before ``at``, by halving."""
    if not bounds:
        return F.lit(0)
    listed, steps = F.array(*[F.lit(b) for b in bounds]), []
    step = 1 << (len(bounds).bit_length() - 1)
    while step:
        steps.append(F.lit(step))
        step >>= 1
    return F.aggregate(F.array(*steps), F.lit(0), lambda n, s: F.when(
        (n + s <= len(bounds)) & (F.get(listed, n + s - 1) <= at), n + s).otherwise(n))


def asof_join(rows: DataFrame, versions: DataFrame, key: str, at: str, valid_from: str,
              columns: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``rows`` with ``columns`` of ``versions``; null where a key has no version yet.

    ``at`` and ``valid_from`` are longs (microseconds, line numbers). A version
    counts from ``valid_from`` on, that moment included; of several versions
    of a key and moment the one with the greatest columns counts. A null key
    or ``at`` has no version. Rows equal in key and ``at`` share a window.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cuts = [i / n for i in range(1, n)]
    got = rows.agg(F.percentile_approx(at, cuts, 20 * n).alias("q")).first()["q"] if cuts else None
    bounds = sorted(set(got or []))
    value = F.struct(*[F.col(c) for c in columns])
    left = rows.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct("*").alias("_row")) \
        .withColumn("_r", F.when(F.col("_t").isNotNull(), _range_of(F.col("_t"), bounds)))
    right = versions.where(F.col(key).isNotNull() & F.col(valid_from).isNotNull()) \
        .select(F.col(key).alias("_k"), F.col(valid_from).alias("_t"), value.alias("_v")) \
        .withColumn("_r", _range_of(F.col("_t"), bounds))
    # one row a (key, range): its last version; and which (key, range) have rows
    last = right.groupBy("_k", "_r").agg(F.max(F.struct("_t", "_v")).alias("_m")) \
        .select("_k", "_r", F.col("_m._v").alias("_v"), F.lit(False).alias("_asked"))
    asked = left.where(F.col("_k").isNotNull() & F.col("_r").isNotNull()).select("_k", "_r").distinct() \
        .select("_k", "_r", F.lit(None).cast(last.schema["_v"].dataType).alias("_v"), F.lit(True).alias("_asked"))
    before = Window.partitionBy("_k").orderBy("_r").rangeBetween(Window.unboundedPreceding, -1)
    carried = last.unionByName(asked).withColumn("_c", F.last("_v", ignorenulls=True).over(before)) \
        .where(F.col("_asked") & F.col("_c").isNotNull()) \
        .select("_k", F.lit(None).cast("long").alias("_t"), "_r", F.col("_c").alias("_v"))
    side = carried.unionByName(right.select("_k", F.col("_t").cast("long").alias("_t"), "_r", "_v")).select(
        "_k", "_t", "_r", F.lit(0).alias("_side"), "_v", F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    both = left.select("_k", F.col("_t").cast("long").alias("_t"), "_r", "_side",
                       F.lit(None).cast(last.schema["_v"].dataType).alias("_v"), "_row").unionByName(side)
    so_far = Window.partitionBy("_k", "_r").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.last("_v", ignorenulls=True).over(so_far)
    known = F.col("_row").isNotNull() & F.col("_k").isNotNull() & F.col("_t").isNotNull()
    out = both.withColumn("_f", found).where("_side = 1")
    return out.select("_row.*", *[F.when(known, F.col("_f")[c]).alias(c) for c in columns])
