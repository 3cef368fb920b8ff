"""Compute derived columns once per row, where the optimizer cannot inline them.

Catalyst pushes a filter on a derived column down through projections (and
shuffles) by substituting the expression that produced it. For cheap
expressions that is a win; for a regex chain it means the chain runs twice,
once in the filter below the exchange and once in the projection above.

``fence`` packs the derived columns into one struct behind a guard that is
always true but not deterministic (``spark_partition_id() >= 0``; a ``rand()`` comparison would be folded away by the optimizer). Catalyst neither pushes
filters through nor duplicates a non-deterministic projection, so each
expression is evaluated once per row, above the exchange. A projection keeps
its child's partitioning, so a later aggregate or join on the same key does
not shuffle again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SLOT = "_fenced"


def fence(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    row = F.struct(*[F.col(c).alias(c) for c in cols])
    keep = [F.col(c) for c in df.columns if c not in cols]
    guarded = df.select(*keep, F.when(F.spark_partition_id() >= 0, row).alias(_SLOT))
    return guarded.select(*[F.col(f"{_SLOT}.{c}").alias(c) if c in cols else F.col(c)
                            for c in df.columns])
