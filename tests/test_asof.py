"""As-of joins, dated policies, engine lists, bucketed logs and segment names against plain Python."""

import datetime as dt
import random
import tempfile
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from querywarden.operators import audit as A
from querywarden.operators import inbound as I
from querywarden.operators.asof import asof_join
from querywarden.sources import audit_log as AL
from querywarden.sources import policy as P


@pytest.mark.parametrize("ranges", [1, 2, 7])
def test_asof_join_against_bisection(spark, ranges):
    rnd = random.Random(ranges)
    keys = [None, "hot", "hot", "hot", "a", "b", "unknown"]
    rows = [(i, rnd.choice(keys), rnd.choice([None, *range(-20, 60)]), "x") for i in range(400)]
    versions = [(rnd.choice([None, "hot", "a", "b", "never asked"]), rnd.choice([None, *range(-10, 50)]), rnd.randrange(9),
                 rnd.choice([None, "v", "w"])) for _ in range(60)]
    left = spark.createDataFrame(rows, "i int, k string, t long, value string").repartition(3)
    right = spark.createDataFrame(versions, "k string, since long, n int, name string").repartition(2)
    got = asof_join(left, right, "k", "t", "since", ["n", "name"], ranges=ranges).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"i", "k", "t", "value", "n", "name"}
    order = lambda v: (v[0], v[1], v[2] is not None, v[2] or "")
    for r in got:
        mine = sorted([(s, n, name) for k, s, n, name in versions if k == r.k and s is not None and k is not None], key=order)
        at = bisect_right([m[0] for m in mine], r.t) if r.t is not None else 0
        assert (r.n, r.name) == (mine[at - 1][1:] if at else (None, None)), r
    assert asof_join(left, right.limit(0), "k", "t", "since", ["n"], ranges=ranges).where("n is not null").count() == 0
    assert asof_join(left.limit(0), right, "k", "t", "since", ["n"], ranges=ranges).collect() == []


def test_policies_from_yaml_text_as_of_a_time(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    bodies = [("a", day(2), "search:\n  enabled: true\n"), ("a", day(4), "search:\n  enabled: true\n  differential_privacy:\n    enabled: false\n"
               "    decoy_count: 7\n    uniqueness_mode: auto-block\n    batch_window: 1.5\n"),
              ("a", day(6), ""), ("a", day(8), "search: [not, closed"), ("a", day(10), "just text"), ("a", day(12), None),
              ("a", day(14), "search:\n  enabled: true\n  differential_privacy: none\n"), ("b", day(1), "search: {enabled: true}")]
    versions = P.parse_policies(spark.createDataFrame(bodies, "policy_id string, valid_from timestamp, body string"))
    asked = [(n, "a", day(n)) for n in range(1, 16)] + [(100, "b", day(3)), (101, "none such", day(3)), (102, None, day(3)), (103, "b", None)]
    got = {r.i: (r.enabled, r.dp_enabled, r.decoy_count, r.uniqueness_mode, r.batch_window) for r in P.attach_policy_asof(
        spark.createDataFrame(asked, "i int, policy_id string, ts timestamp"), versions).collect()}
    off, on = (False, True, 2, "warn", 5.0), (True, True, 2, "warn", 5.0)
    assert [got[n] for n in (1, 2, 3)] == [off, on, on] and got[4] == got[5] == (True, False, 7, "auto-block", 1.5)
    assert all(got[n] == off for n in (*range(6, 16), 101, 102, 103)) and got[100] == on


def test_engine_lists(spark):
    lists = [("some", ["x", "y", None, "x"]), ("none", []), ("open", None), (None, ["x"])]
    allowed = spark.createDataFrame(lists, "policy_id string, engines array<string>")
    rows = [(p, e) for p in ("some", "none", "open", "unknown", None) for e in ("x", "z", None)]
    df = spark.createDataFrame(rows, "policy_id string, engine string")
    want = [(p, e) for p, e in rows if p in ("open", "unknown", None) or (p, e) == ("some", "x")]
    for n in (None, 4):
        got = [tuple(r) for r in I.engine_filter(df, allowed, n_rows=n).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def chain_lines(spark, rows, heads=None):
    recs = spark.createDataFrame(rows, "user_id bigint, id bigint, ts timestamp, query_hash string")
    recs = recs.select("*", F.lit("web_search").alias("event"), F.lit(3).cast("bigint").alias("query_length"),
                       F.lit(0).cast("bigint").alias("redactions_count"), F.lit(1).cast("bigint").alias("results_returned"), F.lit(False).alias("blocked"))
    return A.build_chain(A.entry_parts(recs), "user_id", ["ts", "id"], heads=heads, max_segment_bytes=1000)


def entries(first, last):
    at = dt.datetime(2024, 3, 1)
    return [(u, i, at + dt.timedelta(seconds=i // 12), f"h{i}") for u in (1, 2, 3, None) for i in range(first, last)]


def test_bucketed_log_resumes_from_its_index_and_reads_back(spark):
    path = tempfile.mkdtemp(prefix="qw-log-") + "/log"
    whole = {(r.user_id, r.seq): r for r in chain_lines(spark, entries(0, 40)).collect()}
    AL.write_bucketed_log(chain_lines(spark, entries(0, 23)), path, append=0, buckets=3)
    heads = {r.user_id: r for r in AL.index_heads(AL.read_index(spark, path)).collect()}
    assert {(u, h.seed_hash, h.seed_seq, h.seed_segment, h.seed_bytes) for u, h in heads.items()} == \
        {(u, whole[u, 23].entry_hash, 23, whole[u, 23].segment, whole[u, 23].segment_bytes) for u in (1, 2, 3, None)}
    AL.write_bucketed_log(chain_lines(spark, entries(23, 40), AL.index_heads(AL.read_index(spark, path))), path, append=1, buckets=3)
    files = spark.read.text(f"{path}/lines").select("_metadata.file_path").distinct().count()
    assert files <= 6                          # not the number of chains and segments
    got = {(r.user_id, r.segment, r.line_no): r.line for r in AL.read_bucketed_log(spark, path).collect()}
    want = {}
    for (u, seq), r in sorted(whole.items(), key=lambda x: (str(x[0][0]), x[0][1])):
        n = sum(k[:2] == (u, r.segment) for k in want) + 1
        want[u, r.segment, n] = r.line
    assert got == want
    report = A.verify_chained(AL.read_bucketed_log(spark, path), "user_id", "segment", "line_no").collect()
    assert all(r.valid and r.entries == 40 for r in report)
    assert AL.index_breaks(AL.read_index(spark, path)).collect() == []
    spoiled = AL.read_index(spark, path).withColumn("last_hash", F.when((F.col("user_id") == 2) & (F.col("segment") == 1), "x").otherwise(F.col("last_hash")))
    assert {(r.user_id, r.segment) for r in AL.index_breaks(spoiled).collect()} <= {(2, 1), (2, 2)} and AL.index_breaks(spoiled).count() >= 1


def test_segment_names(spark):
    at = ["2024-01-01T00:00:07.179575+00:00", "2024-01-01T00:00:07+00:00", "2024-01-01T00:00:08.5+00:00"]
    rows = [(1, 0, 1, at[0]), (1, 0, 2, at[0]), (1, 1, 3, at[1]), (1, 2, 4, at[1]), (1, 3, 5, at[0]), (1, 4, 6, at[2]), (1, 5, 7, at[2]),
            (None, 0, 1, at[0]), (None, 1, 2, at[2]), (2, 0, 1, at[0])]
    df = spark.createDataFrame(rows, "user_id bigint, segment bigint, seq bigint, timestamp string")
    got = {(r.user_id, r.segment): (r.name, r.entries) for r in A.segment_names(df, "user_id").collect()}
    assert got == {(1, 0): ("20240101-000007", 2), (1, 1): ("20240101-000007-0002", 1), (1, 2): ("20240101-000007-0003", 1),
                   (1, 3): ("20240101-000008", 1), (1, 4): ("20240101-000008-0002", 1), (1, 5): (None, 1),
                   (None, 0): ("20240101-000008", 1), (None, 1): (None, 1), (2, 0): (None, 1)}
    names = [got[1, s][0] for s in range(5)]
    assert names == sorted(set(names))
