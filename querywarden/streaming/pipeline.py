"""Structured Streaming wrappers.

Row-wise operators (sanitize, decisions, result cleaning) are applied to a
streaming DataFrame directly. The sequential pieces of state are carried
between micro-batches as ``state.KeyedState`` under a base directory:

* release spacing: ``carry`` holds (scope, last release);
* audit chain: ``heads`` holds (chain, last entry hash, open segment bytes);
* k-anonymity (``operators.distinct_users``): ``users`` holds (text, its k
  least users).

Batch N reads the state before N, writes only the keys it changes, and
overwrites its own outputs, so a retried batch reproduces the same rows
(exactly-once with an idempotent sink). The base directory must be shared
storage on a cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import inbound as I
from ..plans import search as S
from ..sources import policy as P
from ..operators import traffic as TR
from .state import KeyedState


def _version(base: str, name: str, batch_id: int) -> str:
    return f"{base.rstrip('/')}/{name}/batch_id={batch_id}"


def spacing_batch_writer(base: str, scope: str = "user_id", ts: str = "ts", order: str = "query_id",
                         window_s: float | str = 5.0, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function writing release times and the last release of each scope of the batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = KeyedState(base, "carry", (scope,), f"{scope} {dict(batch.dtypes)[scope]}, last_release_us bigint", buckets)
        carry = state.read(spark, batch_id, state.touched(batch))
        # the batch scan, so a scope that fills a micro-batch is spread over many tasks
        out = TR.min_spacing(batch, scope, ts, order, window_s, last=carry)
        out.write.mode("overwrite").parquet(_version(base, "releases", batch_id))
        done = spark.read.parquet(_version(base, "releases", batch_id))
        state.write(done.groupBy(scope).agg(F.max("release_us").alias("last_release_us")), batch_id)

    return write


def audit_batch_writer(base: str, chain_key: str = "user_id", order=("ts", "query_id"),
                       max_segment_bytes: int | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function appending chain lines and the heads of the batch's chains.

    The batch must carry the audit record columns (see ``audit.audit_records``).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = KeyedState(base, "heads", (chain_key,), f"{chain_key} {dict(batch.dtypes)[chain_key]}, seed_hash string, "
                           "seed_bytes bigint, seed_segment bigint, seed_seq bigint", buckets)
        heads = state.read(spark, batch_id, state.touched(batch))
        lines = A.build_chain(A.entry_parts(batch), chain_key, list(order), heads=heads,
                              max_segment_bytes=max_segment_bytes)
        lines = lines.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        lines.write.mode("overwrite").parquet(_version(base, "lines", batch_id))
        state.write(A.chain_heads(spark.read.parquet(_version(base, "lines", batch_id)), chain_key), batch_id)

    return write


def decisions_batch_writer(base: str, policy_paths: dict,
                           key: str = "query_id") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: re-read the policy files, decide, write the batch.

    Policies are re-read at the start of every micro-batch, so edits to a
    policy file apply from the next batch on (hot reload).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        pol = P.load_policies(spark, policy_paths)
        out = S.decide(batch, pol, n_policy_rows=len(policy_paths), key=key)
        (out.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite").parquet(_version(base, "decisions", batch_id)))

    return write


def results_batch_writer(base: str, body: str = "body",
                         set_key: str = "set_id") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for result-set streams.

    Parsing, the top-k slice and cleaning are row-wise; the per-set context
    needs a grouping, which runs here on the micro-batch (a set arrives as
    one JSON body, so it never spans batches). Writes cleaned rows and
    per-set summaries by batch id.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        flat = I.sanitize_results(I.results_from_json(batch, body, set_key))
        flat.write.mode("overwrite").parquet(_version(base, "results", batch_id))
        done = batch.sparkSession.read.parquet(_version(base, "results", batch_id))
        I.set_summary(done, set_key).write.mode("overwrite").parquet(
            _version(base, "contexts", batch_id))

    return write


def windowed_counts(stream: DataFrame, ts: str = "ts", seconds: float = 5.0,
                    watermark: str = "10 minutes", user: str = "user_id") -> DataFrame:
    """O13 on a stream: tumbling windows, emitted once the watermark passes them; equal to ``batch_windows``.

    Users are counted exactly: queries are counted per (window, user) first,
    then those rows per window, so the state is one row a window and user and
    no window's users are gathered. Rows older than the watermark are dropped
    by Spark and counted in the query progress (``late_rows``); to keep them,
    split the stream with ``late_split_writer``.
    """
    dur = f"{int(seconds * 1000)} milliseconds"
    per_user = (stream.withWatermark(ts, watermark)
                .groupBy(F.window(ts, dur).alias("w"), F.col(user).alias("_user"))
                .agg(F.count(F.lit(1)).alias("_n")))
    agg = per_user.groupBy(F.window(F.window_time("w"), dur).alias("w")).agg(
        F.sum("_n").alias("n_queries"), F.count("_user").alias("n_users"))
    return agg.select(F.unix_micros(F.col("w.start")).alias("window_start_us"),
                      F.unix_micros(F.col("w.end")).alias("window_end_us"),
                      F.col("n_queries").cast("bigint").alias("n_queries"),
                      F.col("n_users").cast("bigint").alias("n_users"))


def late_split_writer(base: str, ts: str = "ts", delay_s: float = 600.0,
                      window_s: float | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: rows on time in ``on_time/batch_id=N``, late ones in ``late/batch_id=N``.

    The watermark for batch N is the greatest time of the batches before it
    less the delay, as Spark's own. A row is late if it is older than that;
    with ``window_s``, if its tumbling window of that length has ended by
    then. A row without a time is late. Every row is in one of the tables.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = KeyedState(base, "watermark", ("stream",), "stream string, latest_us bigint", 1)
        before = state.read(spark, batch_id).first()
        at = F.unix_micros(ts)
        if window_s is not None:
            w = int(round(window_s * 1_000_000))
            at = F.floor(at / w) * w + w - 1
        mark = None if before is None else before["latest_us"] - int(round(delay_s * 1_000_000))
        late = F.col(ts).isNull() if mark is None else F.col(ts).isNull() | (at < mark)
        batch = batch.persist()
        try:
            batch.where(~late).write.mode("overwrite").parquet(_version(base, "on_time", batch_id))
            batch.where(late).write.mode("overwrite").parquet(_version(base, "late", batch_id))
            latest = batch.agg(F.max(F.unix_micros(ts)).alias("m")).first()["m"]
        finally:
            batch.unpersist()
        known = [v for v in (latest, None if before is None else before["latest_us"]) if v is not None]
        state.write(spark.createDataFrame([("", max(known))] if known else [], "stream string, latest_us bigint"), batch_id)

    return write


def late_rows(query) -> int:
    """Rows dropped by the watermark over the recorded progress of a streaming query."""
    total = 0
    for p in query.recentProgress:
        for op in p.get("stateOperators", []) if isinstance(p, dict) else p.stateOperators:
            total += (op.get("numRowsDroppedByWatermark", 0) if isinstance(op, dict)
                      else op.numRowsDroppedByWatermark)
    return total


def run_available(stream: DataFrame, writer: Callable[[DataFrame, int], None],
                  checkpoint: str) -> None:
    """Process everything currently available, then stop (``availableNow``)."""
    q = (stream.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
