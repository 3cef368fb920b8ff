"""K1, incremental: bounded sets of users that tell exactly whether a text has ``k`` of them.

A text's set holds its ``k`` least users by (hash, user). Sets merge: the
``k`` least of two sets' union are the ``k`` least of both inputs. A set
below ``k`` entries holds every user, so "at least k distinct users" is
exact, whatever the order and number of the batches, and a hot text never
takes more than ``k`` entries a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.state import KeyedState


def _entry(user: str) -> Column:
    return F.struct(F.xxhash64(user).alias("h"), F.col(user).alias("user"))


def least_users(df: DataFrame, by: list[str], user: str = "user_id", k: int = 5) -> DataFrame:
    """``by`` and ``users``: for each group the ``k`` least of its distinct users. Null users do not count.

    The rank is cut to ``k`` before the shuffle as well (a group limit), so
    no task receives more than ``k`` rows of a group from each other task.
    """
    pairs = df.where(F.col(user).isNotNull()).select(*by, _entry(user).alias("_u")).distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_u"))
    return pairs.withColumn("_r", rank).where(F.col("_r") <= k).groupBy(*by).agg(F.sort_array(F.collect_list("_u")).alias("users"))


def merged(a: Column, b: Column, k: int) -> Column:
    """The set of two sets' users (either may be null)."""
    none = F.slice(F.coalesce(a, b), 1, 0)
    return F.slice(F.sort_array(F.array_union(F.coalesce(a, none), F.coalesce(b, none))), 1, k)


def users_by_slice(df: DataFrame, text: str, slice_column: str, user: str = "user_id", k: int = 5) -> DataFrame:
    """For each text and slice (a day, say) that has it: how many users are known by the end of it, up to ``k``.

    Sets are made for each (text, slice) on their own and merged in the order
    of slices, as a job run once a slice would; a text's fold reads ``k``
    entries a slice.
    """
    sets = least_users(df.where(F.col(text).isNotNull()), [text, slice_column], user, k)
    listed = sets.groupBy(text).agg(F.sort_array(F.collect_list(F.struct(F.col(slice_column).alias("s"), "users"))).alias("days"))
    first = F.struct(F.slice(F.col("days")[0]["users"], 1, 0).alias("users"), F.slice(
        F.transform("days", lambda d: F.struct(d["s"].alias("s"), F.size(d["users"]).cast("bigint").alias("n"))), 1, 0).alias("seen"))

    def step(acc, day):
        users = merged(acc["users"], day["users"], k)
        return F.transform(F.array(users), lambda u: F.struct(u.alias("users"), F.concat(acc["seen"], F.array(F.struct(
            day["s"].alias("s"), F.size(u).cast("bigint").alias("n")))).alias("seen")))[0]

    folded = listed.select(text, F.inline(F.aggregate("days", first, step)["seen"]))
    return folded.select(text, F.col("s").alias(slice_column), F.col("n").alias("known_users"), (F.col("n") >= k).alias("released"))


def user_state(base: str, text_type: str = "string", user_type: str = "bigint", buckets: int = 64) -> KeyedState:
    return KeyedState(base, "users", ("text",), f"text {text_type}, users array<struct<h:bigint,user:{user_type}>>", buckets)


def k_anonymity_writer(base: str, text: str = "query", user: str = "user_id", k: int = 5,
                       buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: keeps each text's set, and writes the batch's rows whose text has ``k`` users by now.

    Texts that had ``k`` users already, or got none new, are not written to
    the state again. Rows without a text are never released. Releases are in
    ``released/batch_id=N``; ``user_state(base).read(spark)`` is the state.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, types = batch.sparkSession, dict(batch.dtypes)
        state = user_state(base, types[text], types[user], buckets)
        batch = batch.where(F.col(text).isNotNull()).persist()
        try:
            sets = least_users(batch.select(F.col(text).alias("text"), user), ["text"], user, k)
            before = state.read(spark, batch_id, state.touched(batch.select(F.col(text).alias("text"))))
            both = sets.join(before.select("text", F.col("users").alias("_old")), "text", "left") \
                .select("text", merged(F.col("_old"), F.col("users"), k).alias("users"), "_old")
            state.write(both.where(~F.col("users").eqNullSafe(F.col("_old"))).select("text", "users"), batch_id)
            now = state.read(spark, batch_id + 1, state.touched(batch.select(F.col(text).alias("text"))))
            enough = now.where(F.size("users") >= k).select(F.col("text").alias("_t"))
            batch.join(enough, batch[text] == F.col("_t"), "left_semi").write.mode("overwrite") \
                .parquet(f"{base.rstrip('/')}/released/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return write
