"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, scratch_path  # noqa: F401  (materialise: for the operators)

#: Words in the sense of the near-duplicate and language-model contracts:
#: everything between the ASCII white-space bytes 0x20 and 0x09-0x0D.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c) -> Column:
    """Lower-case A-Z only (``lower`` would also change other letters)."""
    return F.translate(F.col(c) if isinstance(c, str) else c, UPPER, LOWER)


def lower_az(c) -> Column:
    """``ascii_lower``, several times faster on texts that are ASCII throughout."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name inside the cluster's shared checkpoint folder."""
    return scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of Spark's default file system, if it has none: tasks then open what Spark writes."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``materialise``, and where the table is, for ``discard``; the shuffles that made it are let go."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    release_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose result is written.

    It does so when the driver's JVM collects its garbage, which by itself
    may come long after the disk is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def id_hash_mod(doc_id, m: int) -> Column:
    """``crc32(doc_id as text) mod m``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


def keep_freed_memory() -> None:
    """Let a worker's freed arrays be used again instead of going back to the system.

    The C library hands freed blocks back above a threshold that starts low
    and follows the largest block freed so far; until then each large array
    is faulted in page by page anew, which takes longer than the work on it.
    """
    import numpy as np

    np.empty(1 << 21, np.uint64)


def give_back_memory() -> None:
    """Return what a worker has freed to the system, before it waits for a task of another stage or begins one."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):          # another C library
        pass


#: Bytes that Spark hands to a Python worker at once where rows are wide.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands rows to Python in batches of ``BATCH_BYTES``, or its own smaller setting.

    A batch is made whole outside the JVM's heap, in buffers that double as
    they fill, and the worker holds it once more: at Spark's default of 64 MB
    that is hundreds of MB for an executor's tasks. Results don't depend on it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, "64m"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def sorted_groups(batches, keys: int):
    """Complete groups of rows that arrive sorted by their first ``keys`` columns.

    Yields (columns as numpy arrays, group starts and the end); a group that
    goes on in the next batch is held back until it is complete.
    """
    import numpy as np

    held = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        n = len(cols[0])
        if not n:
            continue
        new = np.zeros(n, bool)
        new[0] = True
        for c in cols[:keys]:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        if len(starts) > 1:
            yield [c[:starts[-1]] for c in cols], starts
        held = [c[starts[-1]:].copy() for c in cols]
    if held:
        yield held, np.array([0, len(held[0])])
