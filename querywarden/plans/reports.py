"""Report tables over operator outputs (all partial-aggregated, one row per group)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import inbound as I


def findings_by_type(sanitized: DataFrame, findings: str = "findings") -> DataFrame:
    """Findings and queries per placeholder.

    Each row first reduces its findings to (placeholder, count) pairs, so the
    distinct-query count needs no shuffle keyed by query.
    """
    df = sanitized.where(F.size(findings) > 0)
    phs = F.transform(findings, lambda f: f["placeholder"])
    per_row = F.transform(F.array_distinct(phs), lambda p: F.struct(
        p.alias("placeholder"), F.size(F.filter(phs, lambda x: x == p)).alias("n")))
    return df.select(F.inline(per_row)).groupBy("placeholder").agg(
        F.sum("n").cast("bigint").alias("n_findings"),
        F.count(F.lit(1)).alias("n_queries"))


def outcome_summary(sanitized: DataFrame) -> DataFrame:
    """Rows per (blocked, reason)."""
    return sanitized.groupBy("blocked", "reason").agg(F.count(F.lit(1)).alias("n"))


def outcome_rollup(sanitized: DataFrame) -> DataFrame:
    """ROLLUP(status, reason) with the grouping level (0 detail, 1 status, 3 total)."""
    df = sanitized.withColumn(
        "status", F.when(F.col("blocked"), F.lit("blocked")).otherwise(F.lit("passed")))
    return df.rollup("status", "reason").agg(
        F.grouping_id().cast("bigint").alias("grouping_level"),
        F.count(F.lit(1)).alias("n"))


def category_counts(generalised: DataFrame, category: str = "category") -> DataFrame:
    return (generalised.where(F.col(category).isNotNull())
            .groupBy(category).agg(F.count(F.lit(1)).alias("n")))


def injection_by_rule(results: DataFrame, title: str = "title", snippet: str = "snippet") -> DataFrame:
    """Result rows matching each injection rule (a row counts once per rule it hits)."""
    hits = results.select(F.explode(I.injection_hits([title, snippet])).alias("rule_id"))
    return hits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_results"))


def audit_rollup(records: DataFrame, ts_us: str = "ts_us") -> DataFrame:
    """Daily audit counts: entries, blocked entries, results returned."""
    r = records.withColumn("day", F.to_date(F.timestamp_micros(ts_us)).cast("string"))
    return r.groupBy("day").agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.count(F.when(F.col("blocked"), 1)).alias("n_blocked"),
        F.sum("results_returned").cast("bigint").alias("n_results"))
