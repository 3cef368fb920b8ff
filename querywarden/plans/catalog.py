"""Registered queries: a Spark plan per operator and, where SQL can say it, DuckDB SQL.

Every query reads the whole input tables of ``sf_dir`` (no sampling, id
subsets or row caps). Column names and integer types (BIGINT) are the same
on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import distinct_users as DU
from ..operators import inbound as I
from ..operators import outbound as O
from ..operators import traffic as TR
from ..session import materialise, scratch_path, spread
from ..sources import audit_log as AL
from ..sources import policy as P
from ..sources import requests as RQ
from ..sources import tables as TB
from . import reports as RP
from . import search as S

K_ANON = 5
SPACING_SCOPE_WINDOW_S = 5 * 3600.0  # per-user spacing, long enough to delay some releases
SPACING_GLOBAL_WINDOW_S = 240.0      # one global release queue, as a single process has
SEGMENT_BYTES = 8192                 # small rotation size so the test data rotates
SEED = TR.DEFAULT_SEED
KEYS = ["src", "id", "line_no"]


# ---------------------------------------------------------------------------
# shared Spark inputs
# ---------------------------------------------------------------------------

def _sanitized(spark, sf, findings=False) -> DataFrame:
    """Queries cut to the query limit; document lines, which are not queries, in full."""
    limit = F.when(F.col("src") == "events", F.lit(O.R.MAX_QUERY_LENGTH))
    return O.sanitize(TB.combined_queries(spark, sf), "raw", findings=findings, max_length=limit)


def _f1_passed(spark, sf) -> DataFrame:
    return O.sanitize(spread(TB.query_log(spark, sf)), "raw").where(~F.col("blocked"))


def _decisions(spark, sf) -> DataFrame:
    q = spread(TB.query_log(spark, sf).withColumn("policy_id", F.expr(TB.USER_POLICY_SQL)))
    return S.decide(q, P.policies(spark), n_policy_rows=len(P.POLICY_PROFILES), seed=SEED)


def _top_results(spark, sf) -> DataFrame:
    return I.sanitize_results(I.top_results(TB.result_rows(spark, sf)))


def _audited(spark, sf) -> DataFrame:
    dec = _decisions(spark, sf).where(F.col("audited"))
    counts = (_top_results(spark, sf).where(F.col("kept"))
              .groupBy(F.col("set_id").alias("query_id")).agg(F.count(F.lit(1)).alias("_n")))
    dec = dec.join(counts, on="query_id", how="left").withColumn(
        "results_returned",
        F.when(F.col("status") == 200, F.coalesce(F.col("_n"), F.lit(0))).otherwise(0))
    return A.audit_records(dec)


def _parts(spark, sf) -> DataFrame:
    # only what the chain is made of enters the Python fold (its input cannot be pruned)
    return A.entry_parts(_audited(spark, sf)).select(
        "user_id", "query_id", "ts", "timestamp", "canon_prefix", "canon_suffix", "line_prefix")


def _chain(spark, sf, max_segment_bytes=None) -> DataFrame:
    return A.build_chain(_parts(spark, sf), "user_id", ["ts", "query_id"], max_segment_bytes=max_segment_bytes)


# ---------------------------------------------------------------------------
# outbound
# ---------------------------------------------------------------------------

def pii_findings(spark, sf):
    df = _sanitized(spark, sf, findings=True)
    numbered = F.transform("findings", lambda f, i: F.struct(
        (i + 1).cast("bigint").alias("finding_no"), f["placeholder"].alias("placeholder"),
        f["match"].alias("match")))
    return df.select(*KEYS, F.inline(numbered))


def pii_redacted_queries(spark, sf):
    return _sanitized(spark, sf).select(*KEYS, "query", "n_redactions")


def pii_redact_documents(spark, sf):
    docs = spread(TB.table(spark, sf, "documents").select("doc_id", "text"))
    red = O.redact_pii(docs, "text", findings=False, out="redacted")
    return red.select("doc_id", "redacted", "n_redactions")


def pii_findings_by_type(spark, sf):
    return RP.findings_by_type(_sanitized(spark, sf, findings=True))


def query_gate(spark, sf):
    return _sanitized(spark, sf).select(*KEYS, "query", "n_redactions", "high_risk_count",
                                        "blocked", "reason")


def query_gate_summary(spark, sf):
    return RP.outcome_summary(_sanitized(spark, sf))


def outcome_rollup(spark, sf):
    return RP.outcome_rollup(_sanitized(spark, sf))


def rare_terms(spark, sf):
    df = O.rare_terms(_f1_passed(spark, sf), "query")
    return df.select("query_id", "unique",
                     F.size("rare_matches").cast("bigint").alias("n_matches"),
                     F.array_join("rare_matches", " | ").alias("matches"))


def uniqueness_decision(spark, sf):
    d = _decisions(spark, sf).where(F.col("enabled") & ~F.col("blocked"))
    return d.select("query_id", "policy_id", "dp_enabled", "uniqueness_mode",
                    "uniqueness_action", "uniqueness_warning")


def generalised_queries(spark, sf):
    return O.generalise(_f1_passed(spark, sf), "query").select("query_id", "query", "category")


def category_counts(spark, sf):
    return RP.category_counts(generalised_queries(spark, sf))


def k_anonymous_queries(spark, sf):
    base = _f1_passed(spark, sf).select("query_id", "user_id", "query")
    kept = TR.k_anonymous(base, "query", "user_id", K_ANON)
    return kept.select("query_id", "user_id", "query", "n_users")


def k_anonymous_daily(spark, sf):
    """K1 over daily slices: how many users of a text are known by the end of each day that has it, up to K_ANON."""
    base = _f1_passed(spark, sf).select("query", "user_id", F.unix_date(F.to_date("ts")).cast("bigint").alias("day"))
    return DU.users_by_slice(base, "query", "day", "user_id", K_ANON)


def padded_queries(spark, sf):
    df = _sanitized(spark, sf).where(~F.col("blocked"))
    df = O.pad(df, "query", "padded")
    return df.select(*KEYS, F.octet_length("query").cast("bigint").alias("byte_len"),
                     F.octet_length("padded").cast("bigint").alias("padded_len"), "padded")


def policy_gate(spark, sf):
    return _decisions(spark, sf).select(
        "query_id", "policy_id", "enabled", "dp_enabled", "decoy_count", "uniqueness_mode",
        "batch_window", "status", "reason")


def policy_gate_asof(spark, sf):
    """S5 as the service applies it, re-read for each request: the policy version valid at the query's time."""
    q = TB.query_log(spark, sf).withColumn("policy_id", F.expr(TB.USER_POLICY_SQL))
    versions = P.parse_policies(TB.policy_versions(spark, sf))
    dec = S.decide(spread(P.attach_policy_asof(q, versions)), None, seed=SEED)
    return dec.select("query_id", "policy_id", "enabled", "dp_enabled", "decoy_count", "uniqueness_mode",
                      "batch_window", "status", "reason")


def decoy_plan(spark, sf):
    ok = _decisions(spark, sf).where((F.col("status") == 200) & (F.col("decoys_sent") > 0))
    return TR.decoy_plan(ok, "query_id", "decoys_sent", SEED)


def cover_plan(spark, sf):
    ok = _decisions(spark, sf).where(F.col("status") == 200)
    return TR.cover_plan(ok, "query_id", "category")


def jittered(spark, sf):
    ok = _decisions(spark, sf).where(F.col("status") == 200)
    return ok.select("query_id", F.col("jitter_ms").cast("bigint").alias("jitter_ms"),
                     F.octet_length("padded").cast("bigint").alias("padded_len"))


def outbound_plan(spark, sf):
    return TR.outbound_plan(_decisions(spark, sf), "query_id", SEED)


def _events(spark, sf):
    return TB.events(spark, sf).select(F.col("event_id").alias("query_id"), "user_id", "ts")


def min_spacing_schedule(spark, sf):
    return TR.min_spacing(_events(spark, sf), "user_id", "ts", "query_id", SPACING_SCOPE_WINDOW_S)


def min_spacing_global(spark, sf):
    return TR.min_spacing(_events(spark, sf), None, "ts", "query_id", SPACING_GLOBAL_WINDOW_S)


def _departures(spark, sf) -> DataFrame:
    """Searched queries with the time at which they are ready for the release gate.

    A dp-enabled query first waits out its decoys' gaps. Written once: the
    range sampling and the schedule would each run the decision plan again.
    """
    dec = _decisions(spark, sf).where(F.col("status") == 200)
    gaps = F.when(F.col("dp_enabled"), TR.total_decoy_ms("query_id", "decoys_sent", SEED)).otherwise(F.lit(0))
    return materialise(dec.select(
        "query_id", "dp_enabled", "batch_window", F.col("jitter_ms").cast("bigint").alias("jitter_ms"),
        F.timestamp_micros(F.unix_micros("ts") + gaps * 1000).alias("ready")), "departures")


def _released(ready: DataFrame) -> DataFrame:
    return TR.min_spacing(ready.where("dp_enabled").select("query_id", "ready", "batch_window"), None, "ready",
                          "query_id", "batch_window")


def release_schedule(spark, sf):
    """O12 as the service applies it: searched, dp-enabled queries, after their
    decoys, in one global queue, each spaced by its own policy's batch window."""
    return _released(_departures(spark, sf))


def send_schedule(spark, sf):
    """When each real query leaves: ready, then the release gate (dp-enabled queries), then its jitter."""
    ready = _departures(spark, sf)
    out = ready.join(_released(ready).select("query_id", "release_us"), "query_id", "left")
    at = F.coalesce("release_us", F.unix_micros("ready"))
    return out.select("query_id", F.unix_micros("ready").alias("ready_us"), at.alias("gate_us"),
                      (at + F.col("jitter_ms") * 1000).alias("send_us"))


def batch_windows(spark, sf):
    return TR.batch_windows(_events(spark, sf), "ts")


def request_intake(spark, sf):
    ev = spread(TB.events(spark, sf).select("event_id", "user_id", "props"))
    bodies = ev.select(F.col("event_id").alias("query_id"), F.expr(RQ.REQUEST_BODY_SQL).alias("body"))
    out = O.sanitize(RQ.parse_requests(bodies), "raw")
    return out.select("query_id", "status", "raw", "categories",
                      F.when(F.col("status") == 200, F.col("query")).alias("query"),
                      F.when(F.col("status") == 200, F.col("reason")).alias("reason"))


# ---------------------------------------------------------------------------
# inbound
# ---------------------------------------------------------------------------

def clean_results(spark, sf):
    return _top_results(spark, sf).where(F.col("kept")).select(
        "set_id", "rnk", "title", "snippet", "url", "source")


def injection_flags(spark, sf):
    return _top_results(spark, sf).select("set_id", "rnk", "title_rule", "snippet_rule",
                                          "injected")


def injection_by_rule(spark, sf):
    df = I.top_results(TB.result_rows(spark, sf))
    df = df.withColumns({"title": I.clean_text("title"), "snippet": I.clean_text("content")})
    return RP.injection_by_rule(df)


def quarantined_results(spark, sf):
    return _top_results(spark, sf).where(F.col("injected")).select(
        "set_id", "rnk", "title", "snippet", "url",
        F.coalesce("title_rule", "snippet_rule").alias("rule_id"))


def engine_filtered_results(spark, sf):
    """Result sets by the policy of their query (query id = set id), engines first, then the top results."""
    policy = TB.query_log(spark, sf).select(F.col("query_id").alias("set_id"), F.expr(TB.USER_POLICY_SQL).alias("policy_id"))
    rows = TB.result_engines(spark, sf).join(policy, "set_id", "left")
    allowed = spark.createDataFrame(list(TB.ALLOWED_ENGINES), "policy_id string, engines array<string>")
    kept = I.engine_filter(rows, allowed, n_rows=len(TB.ALLOWED_ENGINES))
    return I.sanitize_results(I.top_results(kept)).where(F.col("kept")).select(
        "set_id", "rnk", "policy_id", "engine", "title", "snippet", "url", "source")


def context_strings(spark, sf):
    return I.build_context(_top_results(spark, sf))


# ---------------------------------------------------------------------------
# audit
# ---------------------------------------------------------------------------

def audit_records(spark, sf):
    return _audited(spark, sf).select(
        "query_id", "user_id", F.unix_micros("ts").alias("ts_us"), "event", "query_hash",
        "query_length", "redactions_count", "results_returned", "blocked")


def audit_chain(spark, sf):
    return _chain(spark, sf).select("user_id", "seq", "query_id", "timestamp", "prev_hash",
                                    "entry_hash", "line")


def _halves(spark, sf):
    """Entry parts, written once, and the test for the first half of the time range."""
    span = TB.events(spark, sf).agg(((F.min(F.unix_micros("ts")) + F.max(F.unix_micros("ts"))) / 2).cast("bigint").alias("m"))
    return materialise(_parts(spark, sf), "entry-parts"), F.unix_micros("ts") <= F.lit(span.first()["m"])


def audit_chain_resumed(spark, sf):
    """A5: chain the first half of the time range, then resume from the heads.

    Every record is chained exactly once; the result must equal one pass.
    """
    parts, early = _halves(spark, sf)
    cols = ["user_id", "seq", "query_id", "timestamp", "prev_hash", "entry_hash", "segment", "segment_bytes", "line"]
    first = materialise(A.build_chain(parts.where(early), "user_id", ["ts", "query_id"]).select(*cols), "first-half")
    rest = A.build_chain(parts.where(~early), "user_id", ["ts", "query_id"], heads=A.chain_heads(first, "user_id"))
    return first.unionByName(rest.select(*cols)).drop("segment", "segment_bytes")


def audit_resume_from_log(spark, sf):
    """A5 from log files: write the first half of the time range as bucketed log files, read the
    heads from their index and chain the rest on; all entries together equal one pass."""
    import uuid

    parts, early = _halves(spark, sf)
    cols = ["user_id", "seq", "query_id", "timestamp", "prev_hash", "entry_hash", "segment", "line"]
    first = materialise(A.build_chain(parts.where(early), "user_id", ["ts", "query_id"],
                                      max_segment_bytes=SEGMENT_BYTES).select(*cols), "first-half")
    path = scratch_path(spark, f"audit-log-{uuid.uuid4().hex}")
    AL.write_bucketed_log(first, path, "user_id")
    rest = A.build_chain(parts.where(~early), "user_id", ["ts", "query_id"], heads=AL.index_heads(AL.read_index(spark, path)),
                         max_segment_bytes=SEGMENT_BYTES).select(*cols)
    return first.unionByName(rest)


def audit_bucketed_roundtrip(spark, sf):
    """S7, A5, S6 with bucketed files: two appends, the second resumed from the index of the first, read
    back through the index; each segment is verified."""
    import uuid

    parts, early = _halves(spark, sf)
    path = scratch_path(spark, f"audit-log-{uuid.uuid4().hex}")
    for n, (half, heads) in enumerate(((early, None), (~early, AL.index_heads))):
        seeds = heads(AL.read_index(spark, path)) if heads else None
        chain = A.build_chain(parts.where(half), "user_id", ["ts", "query_id"], heads=seeds, max_segment_bytes=SEGMENT_BYTES)
        AL.write_bucketed_log(materialise(chain.select("user_id", "segment", "seq", "prev_hash", "entry_hash", "line"), "append"),
                              path, "user_id", append=n)
    return A.verify(AL.read_bucketed_log(spark, path), ["user_id", "segment"], "line_no")


def audit_segment_names(spark, sf):
    """The names of closed segments."""
    return A.segment_names(_chain(spark, sf, SEGMENT_BYTES), "user_id")


def audit_segments(spark, sf):
    c = _chain(spark, sf, SEGMENT_BYTES)
    return c.select("user_id", "seq", "segment",
                    (F.octet_length("line") + 1).cast("bigint").alias("line_bytes"))


def _lines(spark, sf, max_segment_bytes=None):
    """Chain lines with physical line numbers per (chain, segment) file."""
    c = _chain(spark, sf, max_segment_bytes)
    if max_segment_bytes is None:
        return c.select("user_id", F.lit(0).cast("bigint").alias("segment"),
                        F.col("seq").alias("line_no"), "line")
    from pyspark.sql import Window
    w = Window.partitionBy("user_id", "segment").orderBy("seq")
    return c.select("user_id", "segment", F.row_number().over(w).cast("bigint").alias("line_no"),
                    "line")


def audit_verify(spark, sf):
    return A.verify_long(_lines(spark, sf), "user_id", "line_no")


def tamper(lines: DataFrame) -> DataFrame:
    """Deterministic damage by chain id: edit, delete, swap, invalid JSON, blank, none."""
    kind = F.col("user_id") % 6
    edited = F.regexp_replace("line", '"query_length":(\\d+)', '"query_length":999999')
    out = lines.withColumn("line", F.when((kind == 0) & (F.col("line_no") == 3), edited)
                           .when((kind == 3) & (F.col("line_no") == 4), F.lit("{not json"))
                           .when((kind == 4) & (F.col("line_no") == 2), F.lit("   "))
                           .otherwise(F.col("line")))
    out = out.where(~((kind == 1) & (F.col("line_no") == 5)))
    swapped = (F.when((kind == 2) & (F.col("line_no") == 2), F.lit(3))
               .when((kind == 2) & (F.col("line_no") == 3), F.lit(2))
               .otherwise(F.col("line_no")))
    return out.withColumn("line_no", swapped.cast("bigint"))


def audit_verify_tampered(spark, sf):
    return A.verify_long(tamper(_lines(spark, sf)), "user_id", "line_no")


def audit_verify_segments(spark, sf):
    """A10: each rotated file checked alone (parity: later files break at line 1)."""
    return A.verify(_lines(spark, sf, SEGMENT_BYTES), ["user_id", "segment"], "line_no")


def audit_verify_chained_segments(spark, sf):
    """A10 fix: the ordered segments of a chain verified as one chain."""
    return A.verify_chained(_lines(spark, sf, SEGMENT_BYTES), "user_id", "segment", "line_no").drop(
        "broken_segment")


def audit_verify_chained_tampered(spark, sf):
    """A10 with damage: the first break of each rotated chain, and the file that holds it."""
    return A.verify_chained(tamper(_lines(spark, sf, SEGMENT_BYTES)), "user_id", "segment", "line_no")


def canonical_events(spark, sf):
    """A2 in its generic form: whole events as JSON objects of mixed keys and nesting."""
    ev = TB.table(spark, sf, "events").select("event_id", F.expr(TB.EVENT_JSON_SQL).alias("body"))
    return ev.select("event_id", A.canonical_json("body").alias("canonical"))


def search_responses(spark, sf):
    """Response fields per query (results of set ``query_id``, their fields and rows
    joined by control characters)."""
    resp = S.responses(_decisions(spark, sf), I.set_summary(_top_results(spark, sf)))
    return resp.select("query_id", "status", "error", "context", "query_used", "redactions",
                       "decoys_sent", "uniqueness_warning",
                       F.size("unique_matches").cast("bigint").alias("n_unique_matches"),
                       F.when(F.col("status") == 200, F.size("results")).cast("bigint")
                       .alias("n_results"),
                       F.when(F.col("status") == 200, F.array_join(F.transform("results", lambda r: F.concat_ws(
                           "\x1f", r["title"], r["snippet"], r["url"], r["source"])), "\x1e")).alias("results"))


def audit_log_roundtrip(spark, sf):
    """S7 then S6: write rotated per-chain log files, read them back, verify each file."""
    import uuid

    path = scratch_path(spark, f"audit-log-{uuid.uuid4().hex}")
    AL.write_audit_log(_chain(spark, sf, SEGMENT_BYTES), path, "user_id")
    logs = AL.read_audit_log(spark, path, "user_id bigint, segment bigint")
    return A.verify(logs, ["user_id", "segment"], "line_no")


def clean_results_json(spark, sf):
    """S4 + I1-I9: result sets as one JSON body per set, parsed, limited, cleaned."""
    rows = TB.result_rows(spark, sf)
    item = F.struct(F.col("rnk").alias("o"), F.struct("title", "content", "url").alias("r"))
    bodies = rows.groupBy("set_id").agg(F.to_json(F.struct(F.transform(
        F.sort_array(F.collect_list(item)), lambda x: x["r"]).alias("results"))).alias("body"))
    flat = I.sanitize_results(I.results_from_json(bodies, "body", "set_id"))
    return flat.where(F.col("kept")).select("set_id", "rnk", "title", "snippet", "url", "source")


def audit_rollup(spark, sf):
    return RP.audit_rollup(audit_records(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pii_findings": pii_findings,
    "pii_redacted_queries": pii_redacted_queries,
    "pii_redact_documents": pii_redact_documents,
    "pii_findings_by_type": pii_findings_by_type,
    "query_gate": query_gate,
    "query_gate_summary": query_gate_summary,
    "outcome_rollup": outcome_rollup,
    "rare_terms": rare_terms,
    "uniqueness_decision": uniqueness_decision,
    "generalised_queries": generalised_queries,
    "category_counts": category_counts,
    "k_anonymous_queries": k_anonymous_queries,
    "k_anonymous_daily": k_anonymous_daily,
    "padded_queries": padded_queries,
    "policy_gate": policy_gate,
    "policy_gate_asof": policy_gate_asof,
    "request_intake": request_intake,
    "decoy_plan": decoy_plan,
    "cover_plan": cover_plan,
    "jittered": jittered,
    "outbound_plan": outbound_plan,
    "min_spacing_schedule": min_spacing_schedule,
    "min_spacing_global": min_spacing_global,
    "release_schedule": release_schedule,
    "send_schedule": send_schedule,
    "batch_windows": batch_windows,
    "clean_results": clean_results,
    "injection_flags": injection_flags,
    "injection_by_rule": injection_by_rule,
    "quarantined_results": quarantined_results,
    "engine_filtered_results": engine_filtered_results,
    "context_strings": context_strings,
    "audit_records": audit_records,
    "audit_chain": audit_chain,
    "audit_chain_resumed": audit_chain_resumed,
    "audit_resume_from_log": audit_resume_from_log,
    "audit_segments": audit_segments,
    "audit_segment_names": audit_segment_names,
    "audit_bucketed_roundtrip": audit_bucketed_roundtrip,
    "audit_verify": audit_verify,
    "audit_verify_tampered": audit_verify_tampered,
    "audit_verify_segments": audit_verify_segments,
    "audit_verify_chained_segments": audit_verify_chained_segments,
    "audit_verify_chained_tampered": audit_verify_chained_tampered,
    "canonical_events": canonical_events,
    "search_responses": search_responses,
    "audit_log_roundtrip": audit_log_roundtrip,
    "clean_results_json": clean_results_json,
    "audit_rollup": audit_rollup,
}
