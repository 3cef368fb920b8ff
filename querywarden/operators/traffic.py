"""Cover traffic and timing: decoys, cover queries, jitter, release spacing.

Randomness is replaced by seeded md5 bits so plans are reproducible and the
same numbers come out of Spark and DuckDB. Nothing here sleeps: delays
become computed offsets and release times.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from .outbound import padded

DEFAULT_SEED = "querywarden"
MICROS = 1_000_000


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def decoy_gap_ms(seed: str, key, seq) -> Column:
    """Gap before decoy ``seq``: integer ms, uniform on the closed gap range."""
    lo, hi = R.DECOY_GAP_MS
    return T.seeded_unit_ms(lo, hi, F.lit(seed), F.lit("gap"), _s(key), _s(seq))


def jitter_ms(seed: str, key) -> Column:
    """Integer ms delay before the real query."""
    lo, hi = R.JITTER_MS
    return T.seeded_unit_ms(lo, hi, F.lit(seed), F.lit("jitter"), _s(key))


def decoy_rows(key: str, count: str, seed: str = DEFAULT_SEED,
               decoys: Sequence[str] = R.DECOY_QUERIES) -> Column:
    """O14 + O15: array of (decoy_seq, decoy_id, text, gap_ms, offset_ms) in send order.

    ``min(count, len(decoys))`` distinct decoys, uniform without replacement:
    decoy ``i`` is one draw from md5(seed:decoy:key:i) among those not drawn
    yet, so the work is that of the chosen few. The gaps are summed as the
    rows are built. Row-local on a constant array: no join or shuffle, and
    it runs on streams.
    """
    texts = F.array(*[F.lit(t) for t in decoys])
    ids = F.sequence(F.lit(0), F.lit(len(decoys) - 1))
    row = "struct<decoy_seq:bigint,decoy_id:bigint,text:string,gap_ms:bigint,offset_ms:bigint>"

    def step(acc, seq):
        left = F.size(acc["left"])
        bits = F.conv(F.substring(F.md5(F.concat_ws(
            ":", F.lit(seed), F.lit("decoy"), _s(key), _s(seq))), 1, 8), 16, 10).cast("bigint")
        drawn = F.struct(F.element_at(acc["left"], (bits % left).cast("int") + 1).alias("id"),
                         decoy_gap_ms(seed, key, seq).alias("gap"))
        return F.transform(F.array(drawn), lambda d: F.struct(
            F.array_except(acc["left"], F.array(d["id"])).alias("left"),
            (acc["ms"] + d["gap"]).alias("ms"),
            F.concat(acc["rows"], F.array(F.struct(
                seq.alias("decoy_seq"), d["id"].cast("bigint").alias("decoy_id"),
                F.element_at(texts, d["id"] + 1).alias("text"), d["gap"].alias("gap_ms"),
                (acc["ms"] + d["gap"]).alias("offset_ms")))).alias("rows")))[0]

    n = F.greatest(F.lit(0), F.least(F.col(count), F.lit(len(decoys)))).cast("bigint")
    start = F.struct(ids.alias("left"), F.lit(0).cast("bigint").alias("ms"),
                     F.array().cast(f"array<{row}>").alias("rows"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1).cast("bigint"), n), start, step,
                                     lambda acc: acc["rows"])).otherwise(F.array().cast(f"array<{row}>"))


def decoy_plan(df: DataFrame, key: str = "query_id", count: str = "decoys_sent",
               seed: str = DEFAULT_SEED, decoys: Sequence[str] = R.DECOY_QUERIES) -> DataFrame:
    """O14 + O15: one row per decoy with its gap, running offset and padded length."""
    out = df.select(key, F.inline(decoy_rows(key, count, seed, decoys)))
    return out.withColumn("padded_len", F.octet_length(padded("text")).cast("bigint"))


def total_decoy_ms(key: str, count: str, seed: str = DEFAULT_SEED) -> Column:
    """Sum of the gaps of all decoys of a query (0 without decoys)."""
    n = F.greatest(F.lit(0), F.least(F.col(count), F.lit(len(R.DECOY_QUERIES)))).cast("bigint")
    return F.when(n > 0, F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), n), F.lit(0).cast("bigint"),
        lambda acc, j: acc + decoy_gap_ms(seed, key, j),
    )).otherwise(F.lit(0).cast("bigint"))


def cover_plan(df: DataFrame, key: str = "query_id", category: str = "category") -> DataFrame:
    """One padded cover query for each query that generalises to a category."""
    return df.where(F.col(category).isNotNull()).select(
        key, F.col(category).alias("text"),
        F.octet_length(padded(category)).cast("bigint").alias("padded_len"),
    )


def outbound_plan(decisions: DataFrame, key: str = "query_id",
                  seed: str = DEFAULT_SEED) -> DataFrame:
    """Every outgoing request in send order: cover, decoys, then the real query.

    ``decisions`` needs ``status, query, categories, category, decoys_sent``.
    Each query's requests are built as one array and exploded once, so the
    decision plan is evaluated a single time (no union of three branches).
    Offsets exclude the release-spacing wait, which ``min_spacing`` computes.
    """
    ok = decisions.where(F.col("status") == 200)
    req = "struct<kind:string,seq:bigint,text:string,categories:string,offset_ms:bigint>"

    def make(kind, seq, text, cats, offset):
        return F.struct(F.lit(kind).alias("kind"), seq.cast("bigint").alias("seq"),
                        text.alias("text"), cats.alias("categories"),
                        offset.cast("bigint").alias("offset_ms"))

    cover = F.when(F.col("category").isNotNull(), F.array(make(
        "cover", F.lit(0), F.col("category"), F.lit("general"), F.lit(0)))
    ).otherwise(F.array().cast(f"array<{req}>"))
    decoys = F.transform(decoy_rows(key, "decoys_sent", seed), lambda d: make(
        "decoy", d["decoy_seq"], d["text"], F.lit("general"), d["offset_ms"]))
    real = F.array(make("real", F.col("decoys_sent") + 1, F.col("query"), F.col("categories"),
                        total_decoy_ms(key, "decoys_sent", seed) + jitter_ms(seed, key)))
    # ``inline`` emits the struct fields as columns; selecting fields of an
    # exploded struct instead makes Catalyst rebuild the array per field.
    out = ok.select(key, F.inline(F.concat(cover, decoys, real)))
    return out.select(key, "kind", "seq", "text",
                      F.octet_length(padded("text")).cast("bigint").alias("padded_len"),
                      "categories", F.lit(R.SEARCH_LANGUAGE).alias("language"),
                      F.lit(R.SEARCH_SAFESEARCH).alias("safesearch"), "offset_ms")


# ---------------------------------------------------------------------------
# K1 [ext]: k-anonymity
# ---------------------------------------------------------------------------

def k_anonymous(df: DataFrame, text: str = "query", user: str = "user_id",
                k: int = 5, materialize: bool = True, approx_rsd: float | None = None) -> DataFrame:
    """Keep rows whose text was issued by at least ``k`` distinct users.

    The input feeds both the count and the join back; with ``materialize``
    it is checkpointed once (into ``spark.checkpoint.dir``), so expensive
    upstream work such as redaction is not evaluated twice and lineage is
    cut. The distinct count is a two-level aggregate (partial counts per map
    task), so a hot text never ships its rows to one task; the join back
    relies on AQE's skew-join split for hot texts. ``approx_rsd`` switches
    to a HyperLogLog estimate (one partial-aggregated shuffle instead of the
    two of an exact distinct count); counts near ``k`` may then be off.
    """
    if materialize:
        from ..session import ensure_checkpoint_dir

        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    distinct = (F.countDistinct(user) if approx_rsd is None
                else F.approx_count_distinct(user, approx_rsd))
    counts = (df.groupBy(text).agg(distinct.alias("n_users"))
                .where(F.col("n_users") >= k))
    return df.join(counts, on=text, how="inner").withColumn(
        "n_users", F.col("n_users").cast("bigint"))


# ---------------------------------------------------------------------------
# O13 [ext]: tumbling batch windows
# ---------------------------------------------------------------------------

def batch_windows(df: DataFrame, ts: str = "ts", seconds: float = R.POLICY_DEFAULTS["batch_window"],
                  user: str = "user_id") -> DataFrame:
    """Tumbling windows of ``seconds``; counts per window (streams: add a watermark)."""
    dur = f"{int(seconds * 1000)} milliseconds"
    w = df.groupBy(F.window(ts, dur).alias("w")).agg(
        F.count(F.lit(1)).alias("n_queries"), F.countDistinct(user).alias("n_users"))
    return w.select(
        F.unix_micros(F.col("w.start")).alias("window_start_us"),
        F.unix_micros(F.col("w.end")).alias("window_end_us"),
        F.col("n_queries").cast("bigint").alias("n_queries"),
        F.col("n_users").cast("bigint").alias("n_users"),
    )


# ---------------------------------------------------------------------------
# Minimum spacing between releases
# ---------------------------------------------------------------------------
#
# release_j = max(arrival_j, release_{j-1} + w_j), first release immediate,
# where w_j is the window of request j. Unrolled with S_j = w_1 + ... + w_j:
# release_j = S_j + max_{i<=j}(arrival_i - S_i), a running max (for a fixed
# window S_j = j*w). ``min_spacing_window`` states this with one window
# function per scope; it is exact but puts a whole scope in one task.
# ``min_spacing`` computes the same running max as a two-pass scan over
# range partitions, so a hot scope (or a single global scope) is spread
# over many tasks.

def _window_us(window) -> Column:
    """Per-row window in integer microseconds from seconds (number or column name)."""
    w = F.lit(float(window)) if isinstance(window, (int, float)) else F.col(window)
    return F.round(w.cast("double") * MICROS).cast("bigint")


def min_spacing_window(df: DataFrame, scope: str | None, ts: str = "ts", order: str = "query_id",
                       window_s: float | str = 5.0) -> DataFrame:
    from pyspark.sql.window import Window

    part = [scope] if scope else []
    win = Window.partitionBy(*part).orderBy(ts, order)
    upto = win.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({"_a": F.unix_micros(F.col(ts)), "_w": _window_us(window_s)})
    df = df.withColumn("_S", F.sum("_w").over(upto))
    out = df.withColumn("release_us", F.col("_S") + F.max(F.col("_a") - F.col("_S")).over(upto))
    return out.select(
        *([scope] if scope else []), order, F.col("_a").alias("arrival_us"), "release_us",
        (F.col("release_us") - F.col("_a")).alias("delay_us"))


def _scope_runs(batch):
    """(scope, slice) of each run of equal scopes in a batch sorted by scope."""
    scopes = batch.column("_scope").to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.append(True, scopes[1:] != scopes[:-1])) if len(scopes) else []
    for s, e in zip(starts, np.append(starts[1:], len(scopes)) if len(scopes) else []):
        yield scopes[s], slice(s, e)


def _scan_summary():
    """Per partition: window sum and max(a - S_local) for its first and last scope.

    Rows are sorted by scope, so only the first and the current scope are kept.
    """

    def run(batches):
        import pyarrow as pa

        first = now = None  # [pid, scope, window sum, max]
        for b in batches:
            a, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_a", "_w"))
            for sc, at in _scope_runs(b):
                if now is None or sc != now[1]:
                    now = [b.column("_pid")[0].as_py(), sc, 0, np.iinfo(np.int64).min]
                    first = first or now
                upto = now[2] + np.cumsum(w[at])
                now[2:] = int(upto[-1]), max(now[3], int((a[at] - upto).max()))
        rows = [] if now is None else [first] if first is now else [first, now]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))],
            names=["_pid", "_scope", "wsum", "mx"])

    return run


def _scan_apply(carry_bc, scope_name: str, order_name: str):
    """Second pass: prefix window sums and running max, continuing the carry.

    ``carry_bc`` is a broadcast of {(partition, scope): (window sum before,
    max so far)}: at most two entries per partition, shipped once per
    executor. Scope and order values pass through as Arrow columns, so nulls
    and large integers stay what they are.
    """

    def run(batches):
        import pyarrow as pa

        carry, scope, total, top = carry_bc.value, None, 0, 0
        for b in batches:
            a, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_a", "_w"))
            release = np.empty(len(a), np.int64)
            for sc, at in _scope_runs(b):
                if sc != scope:
                    scope = sc
                    total, top = carry.get((b.column("_pid")[0].as_py(), sc), (0, np.iinfo(np.int64).min))
                upto = total + np.cumsum(w[at])
                peak = np.maximum.accumulate(np.maximum(a[at] - upto, top))
                total, top = int(upto[-1]), int(peak[-1])
                release[at] = upto + peak
            yield pa.RecordBatch.from_arrays(
                [b.column("_scope_val"), b.column("_o"), pa.array(a), pa.array(release), pa.array(release - a),
                 b.column("_rank")],
                names=[scope_name, order_name, "arrival_us", "release_us", "delay_us", "_rank"])

    return run


def min_spacing(df: DataFrame, scope: str | None, ts: str = "ts", order: str = "query_id",
                window_s: float | str = 5.0, partitions: int | None = None,
                last: DataFrame | None = None) -> DataFrame:
    """O12 as a distributed running max; ``window_s`` is seconds or a column of seconds.

    1. Range-partition by (scope, arrival, order) and sort within partitions;
       a hot scope spans several partitions. The result is checkpointed so
       both passes read identical partitions and lineage is cut.
    2. Pass one emits, per partition, the window sum and local max for its
       first and last scope only (any scope crossing a boundary is one of
       those), so the summary holds at most two rows per partition.
    3. Carries (window sum before, max so far) are a prefix over that
       summary and reach the tasks as a broadcast.
    4. Pass two finishes the running max with numpy inside each partition.

    ``last`` (scope, ``last_release_us``) goes on from earlier releases: each
    is a first arrival of its scope with no window of its own.
    A null scope is a scope of its own. Rows without an arrival time have no
    place in the schedule and are left out.
    """
    from ..session import ensure_checkpoint_dir

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)  # the cluster's shared dir; a scratch one only if unset
    scope_col = F.coalesce(F.concat(F.lit("="), F.col(scope).cast("string")), F.lit("")) if scope else F.lit("")
    scope_val = F.col(scope) if scope else F.lit(None).cast("string")
    base = df.select(
        scope_col.alias("_scope"), scope_val.alias("_scope_val"),
        F.unix_micros(F.col(ts)).alias("_a"), F.col(order).alias("_o"),
        _window_us(window_s).alias("_w"), F.lit(1).alias("_rank")).where(F.col("_a").isNotNull())
    if last is not None:
        base = base.unionByName(last.select(
            scope_col.alias("_scope"), scope_val.alias("_scope_val"), F.col("last_release_us").alias("_a"),
            F.lit(None).cast(dict(df.dtypes)[order]).alias("_o"), F.lit(0).cast("bigint").alias("_w"), F.lit(0).alias("_rank")))
    n_parts = partitions or max(spark.sparkContext.defaultParallelism,
                                int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = (base.repartitionByRange(n_parts, "_scope", "_rank", "_a", "_o")
                  .sortWithinPartitions("_scope", "_rank", "_a", "_o")
                  .withColumn("_pid", F.spark_partition_id())
                  .checkpoint(eager=True))

    summary = ranged.mapInArrow(
        _scan_summary(), "_pid int, _scope string, wsum long, mx long").toPandas()
    carry = {}
    if not summary.empty:
        summary = summary.sort_values(["_scope", "_pid"])
        for sc, g in summary.groupby("_scope", sort=False, dropna=False):
            off, cmax = 0, None
            for pid, wsum, mx in g[["_pid", "wsum", "mx"]].itertuples(index=False):
                if cmax is not None:
                    carry[(int(pid), sc)] = (off, cmax)
                shifted = int(mx) - off
                cmax = shifted if cmax is None else max(cmax, shifted)
                off += int(wsum)

    scope_name = scope or "scope"
    scope_type = dict(df.dtypes).get(scope, "string") if scope else "string"
    order_type = dict(df.dtypes)[order]
    schema = (f"`{scope_name}` {scope_type}, `{order}` {order_type}, arrival_us long, "
              f"release_us long, delay_us long, _rank int")
    carry_bc = spark.sparkContext.broadcast(carry)
    out = ranged.mapInArrow(_scan_apply(carry_bc, scope_name, order), schema).where("_rank = 1").drop("_rank")
    return out if scope else out.drop(scope_name)
