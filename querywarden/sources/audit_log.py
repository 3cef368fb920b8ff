"""Audit log files: sink (S7) and source with physical line numbers.

Layout: one text file per chain segment under ``<path>/<chain>=<id>/segment=<n>/``,
lines in chain order. Reading assigns each line its 1-based physical line
number within its file (blank lines keep their numbers), even when a large
file is split across tasks: splits are ordered by their start offset and
rows within a split by ``monotonically_increasing_id``. On a shared file
system tasks write and read the segments themselves (``segment_files``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..operators.asof import asof_join
from . import segment_files as SF


#: Segments of a chain that one task writes; a longer chain is dealt out to several.
SEGMENTS_A_TASK = 64


def write_audit_log(lines: DataFrame, path: str, chain_key: str = "user_id",
                    mode: str = "overwrite") -> None:
    """Write ``line`` values, one file per (chain, segment), in ``seq`` order.

    The work is the number of files, not of bytes: the number of tasks stays
    as set and is not cut down to fit the bytes. A run of ``SEGMENTS_A_TASK``
    segments of a chain goes to one task, which makes the chain's folder once.
    """
    spark = lines.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.select(chain_key, "segment", "seq", "line").repartition(
        n, chain_key, F.floor(F.col("segment") / SEGMENTS_A_TASK))
    whole = mode == "overwrite" and spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    root = SF.on_disk(spark, path) if whole else None
    if root is None:
        dealt.sortWithinPartitions(chain_key, "segment", "seq").select(chain_key, "segment", "line") \
            .write.mode(mode).partitionBy(chain_key, "segment").text(path)
        return
    # a folder's lines must follow one another: null and "" have the same
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (chain_key, "segment")]
    SF.write_segments(dealt.sortWithinPartitions(text[0], "segment", "seq").select(text[0], text[1], "line"),
                      root, [chain_key, "segment"])


def read_audit_log(spark: SparkSession, path: str | list[str], keys: str | None = None) -> DataFrame:
    """``line``, the partition columns found under a directory, ``file, line_no``.

    ``keys`` names the folders of a log of ``write_audit_log`` and their types
    (``user_id bigint, segment bigint``); nothing is inferred from the files
    then, and on a shared file system the tasks list and read them.
    """
    if keys is None:
        return numbered_lines(spark.read.text(path))
    kinds = ST.StructType.fromDDL(keys)
    root = SF.on_disk(spark, path)
    logs = numbered_lines(spark.read.text(path)) if root is None else SF.read_segments(spark, root, kinds.names)
    return logs.select("line", *[F.col(f.name).cast(f.dataType) for f in kinds], "file", "line_no")


def _least_split(spark: SparkSession) -> int:
    """Files of up to so many bytes are never split, by the session's settings."""
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    return min(size(spark.conf.get(f"spark.sql.files.{k}")) for k in ("openCostInBytes", "maxPartitionBytes"))


def numbered_lines(text: DataFrame) -> DataFrame:
    """Rows of ``spark.read.text`` with ``file`` and ``line_no`` (physical, from 1).

    Small files, read whole, are opened once. Files that may be split are read
    a second time, for the lines of their splits.
    """
    raw = text.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_blk"),
        (F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("_part"),
        F.monotonically_increasing_id().alias("_mid"),
    ).withColumnRenamed("value", "line")
    # number the lines inside each split, then add the lines of the splits before it
    inside = F.row_number().over(Window.partitionBy("file", "_blk").orderBy("_mid"))
    splits = text.where(F.col("_metadata.file_size") > _least_split(text.sparkSession)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_blk")) \
        .groupBy("file", "_blk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "_blk", F.coalesce(before, F.lit(0)).alias("_before"))
    out = raw.withColumn("line_no", inside).join(splits, ["file", "_blk"], "left")
    earlier = F.when(~F.col("_part"), F.lit(0)).otherwise(
        F.coalesce("_before", F.raise_error(F.lit("a split of a log file was not counted")).cast("bigint")))
    return out.select(*[c for c in raw.columns if c not in ("_blk", "_mid", "_part")],
                      (F.col("line_no") + earlier).cast("bigint").alias("line_no"))


def _qualified(spark: SparkSession, paths: list[str]) -> dict[str, str | None]:
    """For each path the form in which Spark reports it (one slash after ``file:``), or None if there is no such file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        out[p] = re.sub("^file:/+", "file:/", fs.makeQualified(hp).toUri().toString()) if fs.exists(hp) else None
    return out


def verify_log_files(spark: SparkSession, paths: list[str], seed: str = "") -> DataFrame:
    """A9 over named log files: one report row per path, as given, in any order.

    A path that does not exist is reported as valid with 0 entries ("log file
    does not exist"), a file without a non-blank line as an intact chain of 0
    entries; the others are read with physical line numbers and verified in
    one job. A file that cannot be read fails the job.
    """
    from ..operators import audit as A

    at = _qualified(spark, paths)
    asked = spark.createDataFrame([(p, q) for p, q in at.items()], "path string, _file string")
    present = [p for p, q in at.items() if q is not None]
    schema = "file string, valid boolean, entries bigint, broken_at bigint, cause string, detail string"
    report = spark.createDataFrame([], schema)
    if present:
        logs = read_audit_log(spark, present).select("file", "line_no", "line")
        report = A.verify_long(logs, "file", "line_no", seed=seed)
    report = report.withColumn("file", F.regexp_replace("file", "^file:/+", "file:/"))
    none = F.when(F.col("_file").isNull(), F.lit("log file does not exist")).otherwise(
        F.lit("chain intact: 0 entries verified"))
    return asked.join(report, asked["_file"] == report["file"], "left").select(
        F.col("path").alias("file"), F.coalesce("valid", F.lit(True)).alias("valid"),
        F.coalesce("entries", F.lit(0)).cast("bigint").alias("entries"), "broken_at", "cause",
        F.coalesce("detail", none).alias("detail"))


def log_heads(lines: DataFrame, chain_key: str, segment: str = "segment", line_no: str = "line_no") -> DataFrame:
    """A5 from log lines: what ``build_chain`` needs to go on with each chain.

    ``seed_hash`` is the ``entry_hash`` of the last non-blank line of the last
    segment; "" where that line is no JSON object or has none. ``seed_seq``
    counts the chain's non-blank lines, ``seed_bytes`` the bytes of its last
    segment with line ends. Partial aggregation: a long chain is not gathered.
    """
    from .requests import one_json_value
    from ..functions import text as T

    entry = ~T.py_is_blank("line")
    per = lines.groupBy(chain_key, segment).agg(
        F.sum(F.octet_length("line") + 1).alias("_bytes"),
        F.count(F.when(entry, F.lit(1))).alias("_n"),
        F.max_by("line", F.when(entry, F.col(line_no))).alias("_last"))
    # a blank last segment holds no entry: the last one with an entry seeds, the last one is open
    last = F.when(F.col("_n") > 0, F.col(segment))
    heads = per.groupBy(chain_key).agg(
        F.max_by("_last", last).alias("_last"), F.max_by("_bytes", segment).cast("bigint").alias("seed_bytes"),
        F.max(segment).cast("bigint").alias("seed_segment"), F.sum("_n").cast("bigint").alias("seed_seq"))
    good = F.json_object_keys("_last").isNotNull() & one_json_value(F.col("_last"))
    return heads.withColumn("seed_hash", F.when(good, F.coalesce(
        F.get_json_object("_last", "$.entry_hash"), F.lit(""))).otherwise(F.lit(""))).drop("_last")


# ---------------------------------------------------------------------------
# Bucketed layout: files by hash of (chain, segment), with an index
# ---------------------------------------------------------------------------

def write_bucketed_log(lines: DataFrame, path: str, chain_key: str = "user_id", append: int = 0, buckets: int = 16) -> None:
    """S7 in ``buckets`` files an append, whatever the number of chains; an append is written once.

    ``lines/append=N/bucket=B`` holds the lines of that bucket's segments, one
    after the other; ``index/append=N`` has a row for each segment: its file,
    first and last line there, entries, bytes, the ``prev_hash`` of its first
    entry and the ``entry_hash`` of its last. A segment goes on in a later
    append where a chain is resumed. ``lines`` (with ``seq``, ``segment``,
    ``prev_hash``, ``entry_hash``, ``line``) is read twice: pass a written table.
    """
    bucket = F.pmod(F.xxhash64(chain_key, "segment"), F.lit(buckets)).cast("int")
    order = [chain_key, "segment", "seq"]
    rows = lines.select(*order, "prev_hash", "entry_hash", "line", bucket.alias("bucket"))
    base = path.rstrip("/")
    rows.repartition("bucket").sortWithinPartitions("bucket", *order).select("bucket", "line") \
        .write.mode("overwrite").partitionBy("bucket").text(f"{base}/lines/append={append}")
    # a file's segments follow one another, so their first and last lines follow from their sizes; the lines are not sorted again
    upto = F.sum("entries").over(Window.partitionBy("bucket").orderBy(chain_key, "segment"))
    index = rows.groupBy(chain_key, "segment", "bucket").agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("line") + 1).alias("bytes"),
        F.min_by("prev_hash", "seq").alias("first_prev"), F.max_by("entry_hash", "seq").alias("last_hash"))
    index = index.withColumn("last_line", upto.cast("bigint")).withColumn("first_line", F.col("last_line") - F.col("entries") + 1) \
        .select(chain_key, "segment", "bucket", "first_line", "last_line", "entries", "bytes", "first_prev", "last_hash")
    index.write.mode("overwrite").parquet(f"{base}/index/append={append}")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of all appends of a bucketed log."""
    return spark.read.parquet(f"{path.rstrip('/')}/index")


def index_heads(index: DataFrame, chain_key: str = "user_id") -> DataFrame:
    """A5 from the index alone: what ``build_chain`` needs to go on with each chain. No log line is read."""
    per = index.groupBy(chain_key, "segment").agg(
        F.sum("bytes").alias("_bytes"), F.sum("entries").alias("_n"), F.max_by("last_hash", "append").alias("_last"))
    return per.groupBy(chain_key).agg(
        F.max_by("_last", "segment").alias("seed_hash"), F.max_by("_bytes", "segment").cast("bigint").alias("seed_bytes"),
        F.max("segment").cast("bigint").alias("seed_segment"), F.sum("_n").cast("bigint").alias("seed_seq"))


def index_breaks(index: DataFrame, chain_key: str = "user_id") -> DataFrame:
    """A7 over whole segments, from the index alone: those whose first entry does not link to the last one before."""
    w = Window.partitionBy(chain_key).orderBy("segment", "append")
    linked = F.lag("last_hash", 1, "").over(w)
    return index.withColumn("expected", linked).where(F.col("first_prev") != F.col("expected")) \
        .select(chain_key, "segment", "append", "expected", "first_prev")


def read_bucketed_log(spark: SparkSession, path: str, chain_key: str = "user_id") -> DataFrame:
    """``chain_key, segment, line_no`` (from 1 in the segment, over all appends), ``line``.

    Lines find their segment by an as-of join on the index's first lines; a
    line beyond a file's last indexed one counts to its last segment.
    """
    base = path.rstrip("/")
    file_of = F.concat_ws("/", F.col("append").cast("string"), F.col("bucket").cast("string"))
    before = F.sum("entries").over(Window.partitionBy(chain_key, "segment").orderBy("append").rowsBetween(Window.unboundedPreceding, -1))
    index = read_index(spark, path).withColumns({"_file": file_of, "_skip": F.col("first_line") - 1 - F.coalesce(before, F.lit(0))})
    lines = numbered_lines(spark.read.text(f"{base}/lines")).withColumn("_file", file_of).select("_file", "line_no", "line")
    found = asof_join(lines, index, "_file", "line_no", "first_line", [chain_key, "segment", "_skip"])
    return found.select(chain_key, F.col("segment").cast("bigint").alias("segment"),
                        (F.col("line_no") - F.col("_skip")).cast("bigint").alias("line_no"), "line")
