"""Sharding by a Feistel permutation with cycle walking.

A row's place follows from its global row number alone: the permutation is
keyed by a seed, so the shuffle is reproducible, any row's shard and slot
can be computed without moving data, and the inverse leads from (shard,
slot) back to the row number.

The domain is a grid of ``a x b`` cells with ``a = ceil(sqrt(N))`` and
``b = ceil(N / a)``; each round adds a keyed function of one coordinate to
the other, modulo that side, which is a bijection of the grid. Fewer than
``a`` cells lie beyond N; a row that lands there walks on (applies the
permutation again) until it falls below N.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import with_row_number

PRIME = 2147483647
MULTIPLIER = 48271
#: Longest walk that the expression makes; a longer one raises an error. The
#: chance is below N ** (-WALK / 2); for N < WALK ** 2 it is impossible.
WALK = 64


def round_keys(seed: int, rounds: int = 6) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:8], "little") % PRIME
            for i in range(rounds)]


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(n - 1) + 1) if n > 0 else 1
    return a, max(1, -(-n // a))


def _mix(x: Column, key: int) -> Column:
    t = (x + F.lit(key).cast("long")) % PRIME
    return t * t % PRIME * MULTIPLIER % PRIME


def _div(x: Column, n: int) -> Column:
    """Whole-number division of non-negative longs (``/`` would go through doubles)."""
    return F.call_function("div", x, F.lit(n).cast("long"))


def _once(x: Column, a: int, b: int, keys: list[int]) -> Column:
    left, right = _div(x, b), x % b
    for i, k in enumerate(keys):
        if i % 2 == 0:
            left = (left + _mix(right, k)) % a
        else:
            right = (right + _mix(left, k)) % b
    return left * b + right


def _back(x: Column, a: int, b: int, keys: list[int]) -> Column:
    left, right = _div(x, b), x % b
    for i, k in reversed(list(enumerate(keys))):
        if i % 2 == 0:
            left = F.pmod(left - _mix(right, k), F.lit(a).cast("long"))
        else:
            right = F.pmod(right - _mix(left, k), F.lit(b).cast("long"))
    return left * b + right


def _walk(step, x: Column, n: int) -> Column:
    first = step(x)
    rest = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first,
                       lambda acc, _: F.when(acc < n, acc).otherwise(step(acc)))
    walked = F.when(rest < n, rest).otherwise(
        F.raise_error(F.lit("cycle walk too long; use another seed")).cast("long"))
    return F.when(first < n, first).otherwise(walked)


def permute(row_no: Column, n: int, seed: int = 42) -> Column:
    """The place of row ``row_no`` among ``n`` (0 <= row_no < n)."""
    a, b = grid(n)
    keys = round_keys(seed)
    return _walk(lambda x: _once(x, a, b, keys), row_no.cast("long"), n)


def unpermute(place: Column, n: int, seed: int = 42) -> Column:
    """The row number at ``place``: inverse of :func:`permute`."""
    a, b = grid(n)
    keys = round_keys(seed)
    return _walk(lambda x: _back(x, a, b, keys), place.cast("long"), n)


def permute_py(row_no: int, n: int, seed: int = 42) -> int:
    """The same permutation for one number, for readers that look up a single row."""
    a, b = grid(n)
    while True:
        left, right = divmod(row_no, b)
        for i, k in enumerate(round_keys(seed)):
            t = ((right if i % 2 == 0 else left) + k) % PRIME
            f = t * t % PRIME * MULTIPLIER % PRIME
            if i % 2 == 0:
                left = (left + f) % a
            else:
                right = (right + f) % b
        row_no = left * b + right
        if row_no < n:
            return row_no


def assign_shards(df: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text",
                  seed: int = 42) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    Law ``rows``: place ``p`` of the permuted order goes to shard ``p mod
    n_shards``, slot ``p div n_shards``, so shard counts differ by one at
    most and slots have no gap. Size: UTF-8 bytes of the text plus 16.

    Null text: no bytes (size 16, crc32 0). Null keys come first in row
    order; repeated keys are ordered by checksum, size and a text hash, and
    rows equal in all of these are interchangeable. An empty table gives an
    empty result. Other columns are not read, whatever their names.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(t) + 16).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(t).alias("_tie"),
    )
    numbered, n = with_row_number(rows, "doc_id", ["text_crc32", "size", "_tie"], "_row")
    place = permute(F.col("_row"), max(n, 1), seed)
    return numbered.withColumn("_place", place).select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_place") % n_shards).cast("int").alias("shard"),
        _div(F.col("_place"), n_shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def oracle_sql(n_shards: int, seed: int = 42) -> str:
    """DuckDB SQL for ``assign_shards`` on ``documents`` (unique ids)."""
    state = "SELECT r, step, a, b, n, x // b AS l, x % b AS q FROM walk, dims WHERE step = 0 OR x >= n"
    for i, k in enumerate(round_keys(seed)):
        to, of, side = ("l", "q", "a") if i % 2 == 0 else ("q", "l", "b")
        t = f"(({of} + {k}) % {PRIME})"
        new = f"({to} + {t} * {t} % {PRIME} * {MULTIPLIER} % {PRIME}) % {side}"
        state = (f"SELECT r, step, a, b, n, {new if to == 'l' else 'l'} AS l, {new if to == 'q' else 'q'} AS q "
                 f"FROM ({state}) s{i}")
    return f"""
WITH RECURSIVE crc_steps AS (
  SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8),
numbered AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS r FROM documents),
dims AS (
  SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b
  FROM (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM documents) d),
walk AS (
  SELECT r, CAST(r AS BIGINT) AS x, 0 AS step FROM numbered
  UNION ALL
  SELECT r, CAST(l * b + q AS BIGINT), step + 1 FROM ({state}) e),
placed AS (SELECT r, x FROM walk, dims WHERE step > 0 AND x < n),
sums AS (
  SELECT r, xor(list_reduce(
      list_transform(range(strlen(text)), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT)),
      lambda s, v: xor(t[(xor(s, v) & 255) + 1], s >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS crc
  FROM (SELECT r, text, hex(encode(text)) AS h FROM numbered) w, crc_table)
SELECT doc_id, CAST(strlen(text) + 16 AS BIGINT) AS size, CAST(coalesce(crc, 0) AS BIGINT) AS text_crc32, 'rows' AS law,
  CAST(x % {n_shards} AS INTEGER) AS shard, CAST(x // {n_shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN placed USING (r) JOIN sums USING (r)
"""
