"""The outbound half of a search request as one Spark plan.

Order per request: policy switch (403, not audited) -> sanitize (422,
audited blocked) -> if dp: uniqueness (auto-block 422, audited blocked;
warn adds a warning), generalise (cover query), decoys -> jitter -> pad.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.fence import fence
from ..operators import outbound as O
from ..operators import traffic as TR
from ..sources import policy as P


def decide(queries: DataFrame, policy_df: DataFrame | None, n_policy_rows: int | None = None,
           key: str = "query_id", seed: str = TR.DEFAULT_SEED) -> DataFrame:
    """Per query: status (200/403/422), reason, sanitised text and the dp plan inputs.

    ``queries`` needs ``raw, categories, policy_id`` and ``key``; without
    ``policy_df`` they carry their policy's columns (``attach_policy_asof``).
    """
    df = queries if policy_df is None else P.attach_policy(queries, policy_df, n_rows=n_policy_rows)
    df = O.sanitize(df, "raw")
    on_dp = F.col("enabled") & ~F.col("blocked") & F.col("dp_enabled")
    rare = O.rare_terms(df.select("*"), "query")
    df = rare.withColumns({
        "rare_matches": F.when(on_dp, F.col("rare_matches")),
        "unique": F.when(on_dp, F.col("unique")),
    })
    df = O.uniqueness_decision(df)
    status = (F.when(~F.col("enabled"), F.lit(403))
              .when(F.col("blocked"), F.lit(422))
              .when(F.col("uniqueness_action") == "block", F.lit(422))
              .otherwise(F.lit(200)))
    df = df.withColumn("status", status)
    ok = F.col("status") == 200
    ok_dp = ok & F.col("dp_enabled")
    df = df.withColumns({
        "reason": F.when(F.col("status") == 403, F.lit("web search is disabled in policy"))
                   .when(F.col("blocked"), F.col("reason"))
                   .when(F.col("uniqueness_action") == "block", F.lit(R.REASON_UNIQUE))
                   .otherwise(F.lit("")),
        "category": F.when(ok_dp, O.category_of("query")),
        "decoys_sent": F.when(ok_dp, F.greatest(F.lit(0), F.least(
            F.col("decoy_count"), F.lit(len(R.DECOY_QUERIES))))).otherwise(0).cast("bigint"),
        "jitter_ms": F.when(ok, TR.jitter_ms(seed, key)),
        "padded": F.when(ok, O.padded("query")),
        "audited": F.col("status") != 403,
        "audit_blocked": F.col("status") == 422,
    })
    # fence only what filters test (it carries the whole chain); the rest stays
    # lazy so queries that do not read it never compute it
    return fence(df, ["status", "reason", "uniqueness_action", "audited", "audit_blocked"])


def responses(decisions: DataFrame, summary: DataFrame, key: str = "query_id",
              set_key: str = "set_id") -> DataFrame:
    """One response row per query.

    Searched queries (200) carry ``results`` (kept rows in rank order),
    ``context``, ``query_used``, ``redactions``, ``decoys_sent`` and an
    optional ``uniqueness_warning``; refused ones carry ``error``.
    ``summary`` is ``inbound.set_summary`` keyed by result set = query id.
    """
    joined = decisions.join(summary.withColumnRenamed(set_key, key), on=key, how="left")
    ok = F.col("status") == 200
    empty = F.array().cast("array<struct<title:string,snippet:string,url:string,source:string>>")
    return joined.select(
        key, "status",
        F.when(F.col("status") == 403, F.lit("web search is disabled in policy"))
         .when(F.col("status") == 422, F.concat(F.lit("query blocked: "), F.col("reason")))
         .alias("error"),
        F.when(ok, F.coalesce(F.col("results"), empty)).alias("results"),
        F.when(ok, F.coalesce(F.col("context"), F.lit(""))).alias("context"),
        F.when(ok, F.col("query")).alias("query_used"),
        # a sanitize block reports the redaction count, a uniqueness block its matches
        F.when(ok | F.col("blocked"), F.col("n_redactions")).cast("bigint").alias("redactions"),
        F.when((F.col("status") == 422) & ~F.col("blocked"), F.col("rare_matches"))
         .alias("unique_matches"),
        F.when(ok, F.col("decoys_sent")).cast("bigint").alias("decoys_sent"),
        F.when(ok, F.col("uniqueness_warning")).alias("uniqueness_warning"),
    )


def write_responses(resp: DataFrame, path: str, key: str = "query_id") -> None:
    """S8 sink: JSON lines with the response body as nested JSON (nulls omitted)."""
    body = F.to_json(F.struct(*[c for c in resp.columns if c not in (key, "status")]))
    resp.select(key, "status", body.alias("body")).write.mode("overwrite").json(path)


def search_batch(queries: DataFrame, policy_df: DataFrame, result_bodies: DataFrame | None = None,
                 n_policy_rows: int | None = None, key: str = "query_id",
                 chain_key: str = "user_id", heads: DataFrame | None = None,
                 max_segment_bytes: int | None = R.AUDIT_SEGMENT_BYTES,
                 seed: str = TR.DEFAULT_SEED, materialize: bool = True) -> dict:
    """The whole request flow for a batch of queries, as DataFrames.

    ``queries``: ``key, user_id (chain_key), ts, raw, categories, policy_id``.
    ``result_bodies``: ``set_id`` (= query id) and ``body`` (backend JSON).
    Returns ``decisions``, ``plan`` (outgoing requests), ``results`` (cleaned
    rows), ``summary`` (per-set results and context), ``responses`` and
    ``audit`` (chained entries, continuing ``heads`` if given). Decisions
    are checkpointed once when ``materialize`` so the outputs share them.
    """
    from ..operators import audit as A
    from ..operators import inbound as I

    dec = decide(queries, policy_df, n_policy_rows, key, seed)
    if materialize:
        from ..session import ensure_checkpoint_dir

        ensure_checkpoint_dir(dec.sparkSession)
        dec = dec.checkpoint(eager=True)
    spark = dec.sparkSession
    if result_bodies is None:
        result_bodies = spark.createDataFrame([], "set_id bigint, body string")
    results = I.sanitize_results(I.results_from_json(result_bodies, "body", "set_id"))
    summary = I.set_summary(results)
    resp = responses(dec, summary, key)
    counts = summary.select(F.col("set_id").alias(key), F.col("n_results").alias("_n"))
    audited = dec.where(F.col("audited")).join(counts, on=key, how="left").withColumn(
        "results_returned",
        F.when(F.col("status") == 200, F.coalesce(F.col("_n"), F.lit(0))).otherwise(0))
    rec = A.audit_records(audited).select(chain_key, key, "ts", "event", *A.RECORD_FIELDS)
    audit = A.build_chain(A.entry_parts(rec), chain_key, ["ts", key], heads=heads,
                          max_segment_bytes=max_segment_bytes)
    return {"decisions": dec, "plan": TR.outbound_plan(dec, key, seed), "results": results,
            "summary": summary, "responses": resp, "audit": audit}
