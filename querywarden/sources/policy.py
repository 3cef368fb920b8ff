"""Policy source (S5) and its defaults (O11) as a small broadcastable table.

A policy file is configuration, read driver-side; only its handful of
fields become a DataFrame, re-read each time a job (or micro-batch) starts.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators.asof import asof_join

POLICY_SCHEMA = ("policy_id string, enabled boolean, dp_enabled boolean, decoy_count int, "
                 "uniqueness_mode string, batch_window double")

# FIXED VALUES: the example profiles, plus coverage rows: "allow", a
# dp-disabled row, and "strict" (search on, auto-block) so the uniqueness
# block path is reachable.
POLICY_PROFILES: tuple[tuple, ...] = (
    ("reference", True, True, 2, "warn", 5.0),
    ("standalone", True, True, 2, "warn", 5.0),
    ("appliance", False, True, 5, "auto-block", 10.0),
    ("none", True, True, 2, "warn", 5.0),
    ("allow", True, True, 2, "allow", 5.0),
    ("nodp", True, False, 2, "warn", 5.0),
    ("strict", True, True, 5, "auto-block", 10.0),
)

# A policy table this small is always safe to broadcast; larger ones are
# left to AQE, which broadcasts only after measuring the runtime size.
BROADCAST_MAX_ROWS = 10_000


def policy_from_mapping(policy_id: str, doc: Mapping | None, configured: bool = True) -> tuple:
    """Resolve one parsed policy document with the service's defaults.

    ``configured=False`` means no policy path at all: search is enabled.
    A configured but missing/empty file gives ``{}``: search is disabled.
    """
    doc = dict(doc or {})
    search = doc.get("search", {}) or {}
    dp = search.get("differential_privacy", {}) or {}
    enabled = True if not configured else bool(search.get("enabled", False))
    return (
        policy_id,
        enabled,
        bool(dp.get("enabled", R.POLICY_DEFAULTS["dp_enabled"])),
        int(dp.get("decoy_count", R.POLICY_DEFAULTS["decoy_count"])),
        str(dp.get("uniqueness_mode", R.POLICY_DEFAULTS["uniqueness_mode"])),
        float(dp.get("batch_window", R.POLICY_DEFAULTS["batch_window"])),
    )


def read_policy_file(path: str | None) -> tuple[dict, bool]:
    """(document, configured) for a YAML policy path; missing file -> ({}, True)."""
    if not path:
        return {}, False
    if not os.path.exists(path):
        return {}, True
    import yaml  # PyYAML; only needed when files are read

    with open(path, encoding="utf-8") as fh:
        return (yaml.safe_load(fh) or {}), True


def load_policies(spark: SparkSession, paths: Mapping[str, str | None]) -> DataFrame:
    """Policy table from ``{policy_id: yaml path or None}``."""
    rows = [policy_from_mapping(pid, *read_policy_file(p)) for pid, p in paths.items()]
    return spark.createDataFrame(rows, POLICY_SCHEMA)


POLICY_COLUMNS = ("enabled", "dp_enabled", "decoy_count", "uniqueness_mode", "batch_window")


def parse_policies(documents: DataFrame, policy_id: str = "policy_id", body: str = "body") -> DataFrame:
    """Adds the policy columns read from YAML text, one policy document a row.

    As with files: what a document leaves out has its default, an empty one
    switches search off. Text that is no YAML, or no mapping, counts as
    empty, so a damaged policy switches search off as well.
    """
    schema = "enabled boolean, dp_enabled boolean, decoy_count int, uniqueness_mode string, batch_window double"

    @F.pandas_udf(schema)
    def parsed(texts: pd.Series) -> pd.DataFrame:
        import yaml

        def fields(text):
            try:
                doc = yaml.safe_load(text or "")
                return policy_from_mapping("", doc if isinstance(doc, Mapping) else {})[1:]
            except (yaml.YAMLError, AttributeError, TypeError, ValueError):
                return policy_from_mapping("", {})[1:]
        return pd.DataFrame([fields(t) for t in texts], columns=list(POLICY_COLUMNS))

    return documents.withColumn("_p", parsed(body)).select("*", "_p.*").drop("_p")


def attach_policy_asof(df: DataFrame, versions: DataFrame, ts: str = "ts", key: str = "policy_id",
                       valid_from: str = "valid_from") -> DataFrame:
    """Each row with its policy as it stood at the row's time; before its first version like a missing file."""
    timed = df.withColumn("_at", F.unix_micros(ts))
    dated = versions.withColumn("_from", F.unix_micros(valid_from))
    return with_defaults(asof_join(timed, dated, key, "_at", "_from", POLICY_COLUMNS).drop("_at"))


def policies(spark: SparkSession, profiles=POLICY_PROFILES) -> DataFrame:
    return spark.createDataFrame(list(profiles), POLICY_SCHEMA)


def attach_policy(df: DataFrame, policy_df: DataFrame, key: str = "policy_id",
                  n_rows: int | None = None) -> DataFrame:
    """Left-join policy columns; unknown policy ids behave like a missing file.

    The policy side is broadcast only when its row count is known to be small.
    """
    side = F.broadcast(policy_df) if n_rows is not None and n_rows <= BROADCAST_MAX_ROWS else policy_df
    return with_defaults(df.join(side, on=key, how="left"))


def with_defaults(joined: DataFrame) -> DataFrame:
    """Policy columns that a row lacks: those of a missing file."""
    return joined.withColumns({
        "enabled": F.coalesce(F.col("enabled"), F.lit(False)),
        "dp_enabled": F.coalesce(F.col("dp_enabled"), F.lit(R.POLICY_DEFAULTS["dp_enabled"])),
        "decoy_count": F.coalesce(F.col("decoy_count"), F.lit(R.POLICY_DEFAULTS["decoy_count"])),
        "uniqueness_mode": F.coalesce(F.col("uniqueness_mode"),
                                      F.lit(R.POLICY_DEFAULTS["uniqueness_mode"])),
        "batch_window": F.coalesce(F.col("batch_window"),
                                   F.lit(R.POLICY_DEFAULTS["batch_window"])),
    })


def policies_values_sql(profiles=POLICY_PROFILES) -> str:
    """The same profiles as a SQL VALUES list (for the oracle)."""
    def lit(v):
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return f"CAST({v} AS INTEGER)"
    rows = ",\n  ".join("(" + ", ".join(lit(v) for v in p) + ")" for p in profiles)
    return (f"SELECT * FROM (VALUES\n  {rows}) AS p(policy_id, enabled, dp_enabled, "
            "decoy_count, uniqueness_mode, batch_window)")
