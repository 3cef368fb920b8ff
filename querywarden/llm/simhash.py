"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

Two fingerprints within ``radius`` bits agree on at least one of ``radius +
1`` bit fields, so comparing all pairs inside each (field, value) bucket
misses none. A bucket is ordered by population count and cut into pieces of
about ``PIECE`` fingerprints; a unit of work is a pair of pieces, and pairs
whose population counts differ beyond the radius are skipped, as are pairs
of tiles inside a unit. Tiles are compared with numpy exclusive-or and bit
counts. A unit returns a spanning forest of its links, never all pairs.

Equal fingerprints are compared once, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components

PIECE, TILE = 4096, 512


def fold(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of texts from their shingles' hashes, ``counts`` of them for each text:
    a bit is 1 if it is set in over half of them; no shingle gives 0."""
    out = np.zeros(len(counts), np.uint64)
    have = np.flatnonzero(counts)
    if len(have):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(counts) - counts)[have]
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        over = (2 * sums > counts[have][:, None]).astype(np.uint8)
        out[have] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingle_hashes(text: str, size: int, seed: int = 42) -> list[int]:
    """XXH64 of each word shingle: A-Z in lower case, words between ASCII white space, joined by blanks."""
    import xxhash

    words = text.encode("utf-8").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [h(joined, seed)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[:len(words) - size]]
    return [h(joined[s:e], seed) for s, e in zip(starts, ends[size - 1:])]


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) for each row; null text: no words."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, hashes, counts = [], [], []

            def done():
                got.append(fold(np.array(hashes, np.uint64), np.array(counts, np.int64)))
                hashes.clear()
                counts.clear()

            for t in batch.column(1):
                h = shingle_hashes(t.as_py() or "", size)
                hashes += h
                counts.append(len(h))
                if len(hashes) > 200_000:
                    done()
            done()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(got).view(np.int64))], names=["doc_id", "fp"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(
        run, "doc_id long, fp long")


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def _union(parent: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    while len(p):
        p, q = _find(parent, p), _find(parent, q)
        apart = p != q
        p, q = p[apart], q[apart]
        if len(p):
            np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))


def links(fps: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """Spanning forest of the links of a unit, as index pairs (node, root).

    ``side``: all 0, or 0 and 1 for the two pieces of a pair; then only pairs
    across the sides are compared (each piece is also a unit by itself).
    """
    n = len(fps)
    pops = np.bitwise_count(fps).astype(np.int64)
    parent = np.arange(n)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    left, right = (x[np.argsort(pops[x], kind="stable")] for x in (left, right))
    for i in range(0, len(left), TILE):
        a = left[i:i + TILE]
        for j in range(i if left is right or not side.any() else 0, len(right), TILE):
            b = right[j:j + TILE]
            if pops[b[0]] - pops[a[-1]] > radius:
                break
            if pops[a[0]] - pops[b[-1]] > radius:
                continue
            p, q = np.nonzero(np.bitwise_count(fps[a][:, None] ^ fps[b][None, :]) <= radius)
            p, q = a[p], b[q]
            apart = parent[p] != parent[q]
            _union(parent, p[apart], q[apart])
    root = _find(parent, np.arange(n))
    node = np.flatnonzero(root != np.arange(n))
    return np.stack([node, root[node]], axis=1)


def near_links(distinct_fps: DataFrame, radius: int = 4, piece: int = PIECE) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) that span all pairs within ``radius`` bits."""
    import pyarrow as pa

    fields = radius + 1
    cut = [64 * i // fields for i in range(fields + 1)]
    value = lambda i: F.shiftrightunsigned("fp", cut[i]).bitwiseAND(
        F.lit((1 << (cut[i + 1] - cut[i])) - 1).cast("long"))
    spread = distinct_fps.select("fp", F.bit_count("fp").alias("pop"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("field"), value(i).alias("value")) for i in range(fields)])).alias("x")) \
        .select("fp", "pop", "x.field", "x.value")

    # buckets beyond one piece: where each population count begins in the bucket's order
    bucket = Window.partitionBy("field", "value")
    hist = spread.groupBy("field", "value", "pop").agg(F.count("*").alias("n"))
    hist = hist.withColumn("total", F.sum("n").over(bucket)).where(F.col("total") > piece).withColumn(
        "before", F.coalesce(F.sum("n").over(bucket.orderBy("pop").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hist = materialise(hist, "pieces")
    of = lambda x: F.floor(x / piece).cast("int")
    pieces = hist.select("field", "value", "pop", F.explode(F.sequence(
        of(F.col("before")), of(F.col("before") + F.col("n") - 1))).alias("piece")) \
        .groupBy("field", "value", "piece").agg(F.min("pop").alias("lo"), F.max("pop").alias("hi"))
    p, q = (pieces.select("field", "value", F.col("piece").alias(x), F.col("lo").alias(f"{x}_lo"), F.col("hi").alias(f"{x}_hi"))
            for x in ("i", "j"))
    units = p.join(q, ["field", "value"]).where((F.col("i") <= F.col("j")) & (F.col("j_lo") - F.col("i_hi") <= radius))
    roles = units.select("field", "value", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(
        F.col("i").alias("piece"), F.lit(0).alias("side")))).otherwise(F.array(
            F.struct(F.col("i").alias("piece"), F.lit(0).alias("side")),
            F.struct(F.col("j").alias("piece"), F.lit(1).alias("side"))))).alias("r")) \
        .select("field", "value", "i", "j", "r.piece", "r.side")

    placed = spread.join(hist.select("field", "value", "pop", "n", "before"), ["field", "value", "pop"], "left") \
        .withColumn("piece", of(F.col("before") + F.pmod(F.xxhash64("fp"), F.col("n"))))
    small = placed.where("before is null").select("field", "value", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "fp")
    large = placed.where("before is not null").join(roles, ["field", "value", "piece"]).select(
        "field", "value", "i", "j", "side", "fp")
    keys = ["field", "value", "i", "j"]
    work = small.unionByName(large).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forest(fps, side, starts):
            out = []
            for s, e in zip(starts[:-1], starts[1:]):
                if e - s > 1:
                    pairs = links(fps[s:e], side[s:e], radius)
                    if len(pairs):
                        out.append(fps[s:e][pairs])
            if out:
                a, b = np.concatenate(out).view(np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(6)]
            cols = [np.concatenate(x) for x in zip(held, cols)] if held else cols
            key = cols[:4]
            new = np.zeros(len(key[0]), bool)
            new[:1] = True
            for k in key:
                new[1:] |= k[1:] != k[:-1]
            starts = np.flatnonzero(new)
            if not len(starts):
                continue
            yield from forest(cols[5].view(np.uint64), cols[4], starts)  # all but the last unit
            held = [c[starts[-1]:] for c in cols]
        if held:
            yield from forest(held[5].copy().view(np.uint64), held[4], np.array([0, len(held[5])]))

    return work.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row; components over links of ``radius`` bits at most.

    ``component_id`` is the least doc_id that can be reached, itself
    included. Null, empty and blank texts have fingerprint 0, which is linked
    like any other. Rows with a null id take part and are no component's
    least id (a component of such rows alone has a null one). Repeated rows
    each get their row; an empty table gives an empty result. Other columns
    are not read.
    """
    fps = materialise(fingerprints(df, key, text, size), "fingerprints")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    reps = materialise(reps, "distinct-fingerprints")
    roots = connected_components(near_links(reps.select("fp"), radius))
    rooted = reps.join(roots, reps["fp"] == roots["node"], "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(of, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
