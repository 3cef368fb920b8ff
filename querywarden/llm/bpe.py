"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves pre-tokens
that are tokens already, for a whole batch at once. Tier two: the others are
merged with a heap of candidate pairs over a linked list of bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back_memory
from .pretokens import PretokenCache, chunks, ragged

U = np.uint64
#: What a worker keeps of merged pre-tokens from batch to batch.
CACHE_BYTES = 40 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _mix(low, high, length, seed: int):
    h = (low ^ U(seed)) * U(0x9E3779B97F4A7C15)
    h ^= h >> U(32)
    h = (h ^ high) * U(0xC2B2AE3D27D4EB4F)
    h ^= h >> U(29)
    h = (h + length.astype(np.uint64)) * U(0x165667B19E3779F9)
    return h ^ (h >> U(32))


class MinimalPerfectHash:
    """Maps n distinct keys (two words and a length) to 0..n-1 without gaps: hash and displace.

    Keys fall into buckets of four on average; from the fullest bucket on,
    each gets the smallest displacement that sends its keys to free slots.
    Buckets of one key name their slot directly (stored as ``-1 - slot``).
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, shift: np.ndarray | None = None):
        self.n = n = len(low)
        self.buckets = max(1, n // 4)
        if shift is not None:  # found before
            self.shift = shift
            return
        h, g = _mix(low, high, length, 1), _mix(low, high, length, 2)
        where = (h % U(self.buckets)).astype(np.int64)
        self.shift = np.zeros(self.buckets, np.int64)
        free = np.ones(n, bool)
        order = np.argsort(where, kind="stable")
        sizes = np.bincount(where, minlength=self.buckets)
        ends = np.cumsum(sizes)
        step = 256
        for b in np.argsort(-sizes, kind="stable"):
            k = int(sizes[b])
            if k <= 1:
                break
            mine = g[order[ends[b] - k:ends[b]]]
            d = 0
            while True:
                tries = np.arange(d, d + step, dtype=np.uint64)
                slots = self._slot(mine[None, :], tries[:, None])
                good = free[slots].all(axis=1)
                ranked = np.sort(slots[good], axis=1)
                apart = (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if apart.any():
                    pick = int(np.flatnonzero(good)[np.argmax(apart)])
                    self.shift[b] = d + pick
                    free[slots[pick]] = False
                    break
                d += step
        ones = np.flatnonzero(sizes == 1)
        self.shift[ones] = -1 - np.flatnonzero(free)[:len(ones)]

    def _slot(self, g, d):
        x = (g ^ (d * U(0x9E3779B97F4A7C15))) * U(0xD6E8FEB86659FD93)
        return ((x ^ (x >> U(32))) % U(self.n)).astype(np.int64)

    def __call__(self, low, high, length) -> np.ndarray:
        d = self.shift[(_mix(low, high, length, 1) % U(self.buckets)).astype(np.int64)]
        hashed = self._slot(_mix(low, high, length, 2), np.maximum(d, 0).astype(np.uint64))
        return np.where(d < 0, -1 - d, hashed)


def words_of(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of up to 16 bytes as two little-endian words and a length."""
    raw = np.frombuffer(b"".join(t.ljust(16, b"\0") for t in tokens), "<u8").reshape(-1, 2)
    return raw[:, 0].copy(), raw[:, 1].copy(), np.fromiter(map(len, tokens), np.int64, len(tokens))


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge a pre-token's bytes, lowest rank first, leftmost first among equals.

    The parts form a linked list (``after``, ``before``); the heap holds
    (rank, left part, end of the pair) and entries whose pair has changed
    since are skipped.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []
    for i in range(n - 1):
        r = ranks.get(word[i:i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            r = ranks.get(word[i:end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        p = before[i]
        if p >= 0:
            r = ranks.get(word[p:stop])
            if r is not None:
                heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int], shift: np.ndarray | None = None):
        self.ranks = ranks
        short = [t for t in ranks if len(t) <= 16]
        low, high, length = words_of(short)
        self.mph = MinimalPerfectHash(low, high, length, shift)
        slot = self.mph(low, high, length)
        self.low, self.high, self.length, self.id = (np.empty(len(short), x) for x in ("<u8", "<u8", np.int64, np.int64))
        self.low[slot], self.high[slot], self.length[slot] = low, high, length
        self.id[slot] = [ranks[t] for t in short]
        by_id = sorted(ranks.items(), key=lambda x: x[1])
        size = by_id[-1][1] + 1
        self.bytes_len = np.zeros(size, np.int64)
        self.bytes_len[[i for _, i in by_id]] = [len(t) for t, _ in by_id]
        self.bytes_at = np.cumsum(self.bytes_len) - self.bytes_len
        self.blob = np.frombuffer(b"".join(t for t, _ in by_id), np.uint8)

    def known(self, low, high, length) -> np.ndarray:
        """Tier one: the id of each key that is a token, else -1 (the stored key is compared)."""
        if not len(low):
            return np.zeros(0, np.int64)
        s = self.mph(low, high, length)
        hit = (self.low[s] == low) & (self.high[s] == high) & (self.length[s] == length)
        return np.where(hit, self.id[s], -1)

    def cache(self) -> PretokenCache:
        ranks = self.ranks
        return PretokenCache(lambda words: [merge(w, ranks) for w in words], self.known, max_bytes=CACHE_BYTES)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids one after the other, and the end of each id's bytes."""
        lens = self.bytes_len[ids]
        return self.blob[ragged(self.bytes_at[ids], lens)], np.cumsum(lens)


def _decimal_codec(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [b"%d," % i for i in range(n)]
    lens = np.fromiter(map(len, parts), np.int64, n)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lens) - lens, lens


def encode_column(df: DataFrame, ranks_path: str, text: str = "text", digests: bool = True,
                  with_ids: bool = False, batch_chars: int = 1_000_000) -> DataFrame:
    """Encode whole texts; adds ``n_tokens`` and, as asked, ``ids``, ``ids_sha256``, ``decoded_sha256``.

    Added columns replace columns of the same name; all others are kept.
    A null text counts as the empty text: no ids. The rank table is read on
    the driver (its size is that of the vocabulary) and broadcast. Runs as
    one pass over the rows, without a shuffle; memory is bounded by
    ``batch_chars`` or the longest text.
    """
    import pyarrow as pa

    spark: SparkSession = df.sparkSession
    ranks = read_ranks(ranks_path)
    # plain data: a worker builds the codec from it once and keeps it beside it, with its cache
    sent = spark.sparkContext.broadcast({"ranks": ranks, "shift": Codec(ranks).mph.shift})
    added = {"n_tokens": "long"}
    if with_ids:
        added["ids"] = "array<int>"
    if digests:
        added |= {"ids_sha256": "string", "decoded_sha256": "string"}
    keep = [c for c in df.columns if c not in added]
    names = [f"c{i}" for i in range(len(keep))]
    # text first under a name of its own: clashing or odd column names do no harm
    source = df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"),
                       *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)])
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(n, source.schema[n].dataType) for n in names]
                          + [T.StructField(k, T._parse_datatype_string(v)) for k, v in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()                     # of stages that this worker had before
        here = sent.value
        if "codec" not in here:
            here["codec"] = Codec(here["ranks"], here["shift"])
            here["cache"] = here["codec"].cache()
        codec, cache = here["codec"], here["cache"]
        blob, at, lens = _decimal_codec(len(codec.bytes_len))
        for batch in batches:
            done = 0
            for texts in chunks(batch.column(0).to_pylist(), batch_chars):
                ids, offsets = cache.encode(texts)
                cols = {"n_tokens": pa.array(np.diff(offsets), pa.int64())}
                if with_ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
                if digests:
                    width = lens[ids]
                    said = blob[ragged(at[ids], width)]
                    said_end = np.concatenate([[0], np.cumsum(width)])
                    raw, raw_end = codec.decode(ids)
                    raw_end = np.concatenate([[0], raw_end])
                    a, b = [], []
                    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                        # without the comma after the last id
                        a.append(hashlib.sha256(said[said_end[s]:max(said_end[s], said_end[e] - 1)]).hexdigest())
                        b.append(hashlib.sha256(raw[raw_end[s]:raw_end[e]]).hexdigest())
                    cols |= {"ids_sha256": pa.array(a), "decoded_sha256": pa.array(b)}
                kept = [batch.column(i + 1).slice(done, len(texts)) for i in range(len(names))]
                done += len(texts)
                yield pa.RecordBatch.from_arrays(kept + [cols[k] for k in added], names=names + list(added))

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], *added)
