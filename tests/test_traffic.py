"""O12 spacing scan vs the sequential recurrence; O14-O18 properties; K1."""

import random

from pyspark.sql import functions as F

from querywarden.functions import rules as R
from querywarden.operators import traffic as TR


def _sequential(rows, w_us):
    out, last = {}, {}
    for scope, a, qid in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        prev = last.get(scope)
        rel = a if prev is None else max(a, prev + w_us)
        last[scope] = rel
        out[qid] = rel
    return out


def _df(spark, rows):
    df = spark.createDataFrame(rows, "scope string, a long, query_id long")
    return df.withColumn("ts", F.timestamp_micros("a"))


def test_spacing_scan_matches_recurrence_with_hot_scope(spark):
    rnd = random.Random(7)
    rows = [("hot", rnd.randrange(0, 10**9), i) for i in range(3000)]
    rows += [(f"s{i % 40}", rnd.randrange(0, 10**9), 3000 + i) for i in range(2000)]
    w = 250_000
    out = TR.min_spacing(_df(spark, rows), "scope", "ts", "query_id", w / 1e6, partitions=16)
    got = {r.query_id: r.release_us for r in out.collect()}
    assert got == _sequential(rows, w)
    win = TR.min_spacing_window(_df(spark, rows), "scope", "ts", "query_id", w / 1e6)
    assert {r.query_id: r.release_us for r in win.collect()} == got


def test_spacing_global_scope(spark):
    rnd = random.Random(3)
    rows = [("", rnd.randrange(0, 10**8), i) for i in range(4000)]
    out = TR.min_spacing(_df(spark, rows), None, "ts", "query_id", 0.05, partitions=12)
    got = {r.query_id: r.release_us for r in out.collect()}
    assert got == _sequential(rows, 50_000)


def test_decoys_distinct_and_bounded(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([0, 1, 2, 5, 80, 200])],
                               "query_id long, decoys_sent long")
    plan = TR.decoy_plan(df, "query_id", "decoys_sent").collect()
    per = {}
    for r in plan:
        per.setdefault(r.query_id, []).append(r)
    assert sorted(len(v) for v in per.values()) == [1, 2, 5, 80, 80]
    for v in per.values():
        v.sort(key=lambda r: r.decoy_seq)
        assert len({r.decoy_id for r in v}) == len(v)
        lo, hi = R.DECOY_GAP_MS
        assert all(lo <= r.gap_ms <= hi for r in v)
        run = 0
        for r in v:
            run += r.gap_ms
            assert r.offset_ms == run
            assert r.text in R.DECOY_QUERIES and r.padded_len == 256


def test_jitter_range(spark):
    df = spark.range(2000).withColumnRenamed("id", "query_id")
    vals = [r.j for r in df.select(TR.jitter_ms("s", "query_id").alias("j")).collect()]
    assert min(vals) >= R.JITTER_MS[0] and max(vals) <= R.JITTER_MS[1]


def test_k_anonymity(spark):
    rows = [(i, i % 7, "common") for i in range(50)] + [(100 + i, i, f"rare {i}") for i in range(5)]
    df = spark.createDataFrame(rows, "query_id long, user_id long, query string")
    kept = TR.k_anonymous(df, "query", "user_id", 5).collect()
    assert {r.query for r in kept} == {"common"} and len(kept) == 50
    assert all(r.n_users == 7 for r in kept)


def test_k_anonymity_approx(spark):
    rows = [(i, i % 40, "common") for i in range(400)] + [(1000 + i, 1, "one user") for i in range(50)]
    df = spark.createDataFrame(rows, "query_id long, user_id long, query string")
    kept = TR.k_anonymous(df, "query", "user_id", 5, approx_rsd=0.05).collect()
    assert {r.query for r in kept} == {"common"} and len(kept) == 400
    assert all(abs(r.n_users - 40) <= 4 for r in kept)


def test_spacing_per_row_windows(spark):
    rnd = random.Random(21)
    rows = [("hot" if i % 3 else f"s{i % 17}", rnd.randrange(0, 10**8), i, rnd.choice([0.05, 0.1, 0.02]))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "scope string, a long, query_id long, w double")
    df = df.withColumn("ts", F.timestamp_micros("a"))
    got = {r.query_id: r.release_us for r in
           TR.min_spacing(df, "scope", "ts", "query_id", "w", partitions=11).collect()}
    win = {r.query_id: r.release_us for r in
           TR.min_spacing_window(df, "scope", "ts", "query_id", "w").collect()}
    want, last = {}, {}
    for scope, a, qid, w in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        prev = last.get(scope)
        rel = a if prev is None else max(a, prev + round(w * 1_000_000))
        last[scope] = rel
        want[qid] = rel
    assert got == want and win == want


def test_spacing_goes_on_from_last_releases_with_null_scopes(spark):
    rnd = random.Random(12)
    big = 9007199254740993
    rows = [(rnd.choice([None, "a", "b"]), rnd.randrange(10**8), big + i) for i in range(900)]
    w = 400_000
    whole = _sequential([(r[0] or "", *r[1:]) for r in rows], w)
    got = TR.min_spacing(_df(spark, rows), "scope", "ts", "query_id", w / 1e6, partitions=5).collect()
    assert {r.query_id: r.release_us for r in got} == whole
    assert {r.query_id: r.scope for r in got} == {r[2]: r[0] for r in rows}
    cut = 5 * 10**7
    first = TR.min_spacing(_df(spark, [r for r in rows if r[1] < cut]), "scope", "ts", "query_id", w / 1e6, partitions=3)
    last = first.groupBy("scope").agg(F.max("release_us").alias("last_release_us"))
    rest = TR.min_spacing(_df(spark, [r for r in rows if r[1] >= cut]), "scope", "ts", "query_id", w / 1e6, partitions=5, last=last)
    assert {r.query_id: r.release_us for r in first.collect() + rest.collect()} == whole
