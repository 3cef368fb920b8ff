"""Carried state: equal to batch results after every batch, the same when retried, written by what changes."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from querywarden.operators import distinct_users as D
from querywarden.streaming import pipeline as SP
from querywarden.streaming import state as ST


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(2)


def value_of(state, spark, batch_id=None):
    return {r.k: r.v for r in state.read(spark, batch_id).collect()}


def test_newest_values_retries_and_expiry(spark):
    state = ST.KeyedState(tempfile.mkdtemp(prefix="qw-state-"), "s", ("k",), "k string, v bigint", buckets=4, max_versions=3)
    rnd, want, history = random.Random(1), {}, []
    assert value_of(state, spark) == {}
    for batch in range(9):
        changed = {rnd.choice([None, "", *"abcdefghijklmnop"]): rnd.randrange(100) for _ in range(3)}
        if batch == 4:
            changed = {}
        for attempt in range(2 if batch in (2, 5) else 1):  # a batch that is tried again with other values first
            rows = [(k, v if attempt or batch not in (2, 5) else -1) for k, v in changed.items()]
            if batch in (2, 5) and not attempt:
                rows.append(("only in the failed try", -1))
            state.write(frame(spark, rows, "k string, v bigint"), batch)
        want |= changed
        history.append(dict(want))
        assert value_of(state, spark) == want
        if batch:
            assert value_of(state, spark, batch) == history[batch - 1]
    assert state._committed(spark) == [7, 8]
    listed = {(v, b) for n in (7, 8) for b, v, _ in state._manifest(spark, n + 1)}
    on_disk = {(int(f.split("=")[1]), int(p.split("=")[1])) for f in ST._list(spark, f"{state.root}/data")
               for p in ST._list(spark, f"{state.root}/data/{f}") if p.startswith("bucket=")}
    assert on_disk == listed


def test_written_rows_follow_the_batches_not_the_keys(spark):
    state = ST.KeyedState(tempfile.mkdtemp(prefix="qw-state-"), "s", ("k",), "k bigint, v bigint", buckets=8)
    state.write(spark.range(20_000).select(F.col("id").alias("k"), F.lit(0).cast("bigint").alias("v")), 0)
    written = 0
    for batch in range(1, 7):
        state.write(spark.range(batch * 10, batch * 10 + 10).select(F.col("id").alias("k"), F.lit(batch).cast("bigint").alias("v")), batch)
        written += sum(rows for _, v, rows in state._manifest(spark, batch + 1) if v in (2 * batch, 2 * batch + 1))
    assert written == 60                       # six batches of ten rows, no bucket written anew
    got = {r.k: r.v for r in state.read(spark).collect()}
    assert len(got) == 20_000 and got[15] == 1 and got[69] == 6 and got[5] == 0
    some = state.read(spark, buckets=state.touched(spark.range(3).select(F.col("id").alias("k"))))
    assert {0, 1, 2} <= {r.k for r in some.collect()} and some.count() < 20_000


def test_fields_of_nested_schemas():
    assert ST._fields("a string, b array<struct<h:bigint,u:int>>, c decimal(3,1)") == \
        ["a string", "b array<struct<h:bigint,u:int>>", "c decimal(3,1)"]


def queries(rnd, n):
    return [(i, rnd.choice(["a", "b", "hot", "hot", None, ""]) if i % 5 else f"t{rnd.randrange(30)}",
             rnd.choice([None, *range(8)]), rnd.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("k", [1, 3])
def test_k_anonymity_state_equals_batch_after_every_batch(spark, k):
    base, rows = tempfile.mkdtemp(prefix="qw-kanon-"), queries(random.Random(k), 300)
    write = D.k_anonymity_writer(base, k=k, buckets=4)
    state = D.user_state(base, buckets=4)
    for batch in range(3):
        part = frame(spark, [r for r in rows if r[3] == batch], "query_id bigint, query string, user_id bigint, part int")
        write(part, batch)
        if batch == 1:
            write(part, batch)                 # tried again
        users = {}
        for r in rows:
            if r[3] <= batch and r[1] is not None and r[2] is not None:
                users.setdefault(r[1], set()).add(r[2])
        got = {r.text: {u.user for u in r.users} for r in state.read(spark).collect()}
        assert {t: len(u) for t, u in got.items()} == {t: min(k, len(u)) for t, u in users.items()}
        assert all(u <= users[t] for t, u in got.items())
        released = {r.query_id for r in spark.read.parquet(f"{base}/released/batch_id={batch}").collect()}
        assert released == {r[0] for r in rows if r[3] == batch and len(users.get(r[1], ())) >= k}


def test_least_users_do_not_depend_on_the_order_of_merging(spark):
    rows = queries(random.Random(9), 400)
    df = frame(spark, rows, "query_id bigint, query string, user_id bigint, part int")
    whole = {r.query: r.users for r in D.least_users(df, ["query"], k=4).collect()}
    parts = D.least_users(df, ["query", "part"], k=4)
    for order in ([0, 1, 2, 3], [3, 1, 0, 2]):
        have = {}
        for p in order:
            one = parts.where(F.col("part") == p).select("query", "users")
            old = spark.createDataFrame(list(have.items()), "query string, old array<struct<h:bigint,user:bigint>>")
            both = one.join(old, one["query"].eqNullSafe(old["query"]), "full").select(
                F.coalesce(one["query"], old["query"]).alias("q"), D.merged(F.col("old"), F.col("users"), 4).alias("u"))
            have = {r.q: r.u for r in both.collect()}
        assert have == whole


def test_users_by_slice(spark):
    rows = queries(random.Random(4), 300)
    got = D.users_by_slice(frame(spark, rows, "query_id bigint, query string, user_id bigint, part int"), "query", "part", k=3).collect()
    want = {}
    for text in {r[1] for r in rows if r[1] is not None}:
        seen = set()
        for part in range(4):
            mine = {r[2] for r in rows if r[1] == text and r[3] == part and r[2] is not None}
            seen |= mine
            if mine:
                want[text, part] = (min(3, len(seen)), len(seen) >= 3)
    assert {(r.query, r.part): (r.known_users, r.released) for r in got} == want


def test_k_anonymity_stream(spark):
    base, rows = tempfile.mkdtemp(prefix="qw-kanon-"), queries(random.Random(6), 200)
    schema = "query_id bigint, query string, user_id bigint, part int"
    for part in range(4):
        frame(spark, [r for r in rows if r[3] == part], schema).coalesce(1).write.parquet(f"{base}/in/f{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    SP.run_available(stream, D.k_anonymity_writer(f"{base}/out", k=2, buckets=4), f"{base}/ck")
    have = {r.text: len(r.users) for r in D.user_state(f"{base}/out", buckets=4).read(spark).collect()}
    users = {}
    for r in rows:
        if r[1] is not None and r[2] is not None:
            users.setdefault(r[1], set()).add(r[2])
    assert have == {t: min(2, len(u)) for t, u in users.items()}
