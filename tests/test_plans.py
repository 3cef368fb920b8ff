"""Plan-shape regression tests: the performance properties the design relies on."""

import re

import pytest

import __spark_entry__ as E
from locations import SF_SMALL
from querywarden.functions import rules as R
from querywarden.plans import catalog


def _plans(spark, name):
    qe = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution()
    return qe.optimizedPlan().toString(), qe.executedPlan().toString()


def test_redaction_plan_is_linear(spark):
    for name in ("pii_findings", "pii_redacted_queries", "query_gate"):
        optimized, _ = _plans(spark, name)
        # one replace per rule plus the strip; never the exponential inlining
        assert optimized.count("regexp_replace") <= len(R.PII_RULES) + 2, name


@pytest.mark.parametrize("name", ["rare_terms", "padded_queries", "decoy_plan", "clean_results"])
def test_no_regex_pushed_into_scans(spark, name):
    _, physical = _plans(spark, name)
    for filters in re.findall(r"DataFilters: (\[[^\]]*\])", physical):
        assert "RLIKE" not in filters and "regexp" not in filters, filters


def test_map_side_top_k(spark):
    _, physical = _plans(spark, "clean_results")
    assert "WindowGroupLimit" in physical and "Partial" in physical


def test_policy_join_is_broadcast(spark):
    _, physical = _plans(spark, "policy_gate")
    assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical


def test_no_cartesian_products(spark):
    for name in catalog.QUERIES:
        _, physical = _plans(spark, name)
        assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical, name


def test_scans_are_pruned(spark):
    _, physical = _plans(spark, "query_gate")
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", physical)
    assert schemas
    for sc in schemas:
        assert "props" not in sc and "event_type" not in sc and "lang" not in sc, sc
