"""Document fingerprints from closed syncmers over words.

Text is cut into pieces of up to ``PIECE`` characters between white space
(so text without blanks has pieces too). A k-mer is ``K`` pieces in a row,
an inner substring ``S`` of them. A k-mer is a closed syncmer if the least
hash of its inner substrings lies at its first or last one. The choice looks
at nothing outside the k-mer, so equal passages choose equal anchors
wherever they stand. A fingerprint holds the ``SIZE`` least distinct anchor
hashes of the whole text (all of them in a short text); likeness is the
bottom-k estimate of the share of common anchors, exact for short texts.

DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import range_bounds, range_of
from .common import shuffle_partitions

K, S, SIZE, PIECE = 5, 2, 64, 16
TOKEN = r"[^\x20\x09-\x0D]{1,%d}" % PIECE


def _from(arr: Column, skip: int, less: int) -> Column:
    """``arr`` without its first ``skip`` elements, cut to ``size(arr) - less`` elements."""
    return F.slice(arr, F.lit(skip + 1), F.greatest(F.size(arr) - less, F.lit(0)))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: array of (pos, hash), the closed syncmers by position.

    A text of 1 to K-1 pieces is one anchor as a whole; an empty or null one has none.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c != out]
    step = df.select(*keep, F.transform(
        F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0)),
        lambda w: F.xxhash64(w)).alias("_h"))
    h = F.col("_h")
    step = step.select(*keep, "_h", F.zip_with(_from(h, 0, 1), _from(h, 1, 1), lambda a, b: F.xxhash64(a, b)).alias("_m"))
    m = F.col("_m")  # hashes of the inner substrings of S = 2 pieces; a k-mer of 5 pieces has 4
    inner = F.zip_with(_from(m, 1, 3), _from(m, 2, 3), lambda a, b: F.least(a, b))
    edge = F.zip_with(_from(m, 0, 3), _from(m, 3, 3), lambda a, b: F.least(a, b))
    kmer = F.zip_with(F.zip_with(_from(m, 0, 3), _from(m, 3, 3), lambda a, b: F.xxhash64(a, b)),
                      _from(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), 2, 2),
                      lambda a, b: F.xxhash64(a, b))
    chosen = F.zip_with(kmer, F.zip_with(edge, inner, lambda e, i: e <= i), lambda x, yes: F.when(yes, x))
    marked = F.transform(chosen, lambda x, i: F.struct(i.alias("pos"), x.alias("hash")))
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(h).alias("hash")))
    none = F.array().cast("array<struct<pos:int,hash:bigint>>")
    return step.select(*keep, F.when(F.size(h) >= K, F.filter(marked, lambda x: x["hash"].isNotNull()))
                       .when(F.size(h) > 0, whole).otherwise(none).alias(out))


def sketch(anchors: Column) -> Column:
    """The SIZE least distinct anchor hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(anchors["hash"])), 1, SIZE)


def as_text(sk: Column) -> Column:
    return F.array_join(F.transform(sk, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the least hashes of both sketches together that are in both; 1 if both are empty."""
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, SIZE)
    return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(least, F.array_intersect(a, b))) / F.size(least))


def match_positions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Positional matching: pairs of documents and how many anchors they share at each shift.

    Both sides: ``doc_id, anchors``. Returns ``left_id, right_id, shift, votes``.
    Both sides are joined by hash, so an anchor makes as many rows as pairs of
    its places; callers leave out anchors that are too frequent for that.
    """
    l, r = (d.select(F.col("doc_id").alias(f"{n}_id"), F.explode("anchors").alias("a"))
            .select(f"{n}_id", F.col("a.hash").alias("hash"), F.col("a.pos").alias(f"{n}_pos"))
            for d, n in ((left, "left"), (right, "right")))
    return l.join(r, "hash").groupBy(
        "left_id", "right_id", (F.col("right_pos") - F.col("left_pos")).alias("shift")).agg(F.count("*").alias("votes"))


def with_next(df: DataFrame, key: str, tie: str, carry: list[str]) -> DataFrame:
    """Add ``next_<c>`` for each ``c`` of ``carry``: its value in the next row by ascending
    ``key`` (nulls first, then ``tie``); after the last row comes the first.

    Rows are dealt into key ranges; the first row of each range is copied to
    the end of the range before it, so one shuffle and a window per range do.
    """
    n = 4 * shuffle_partitions(df.sparkSession)
    ranged = df.withColumn("_range", range_of(F.col(key), range_bounds(df, key, n)))
    firsts = {r["_range"]: r["f"] for r in ranged.groupBy("_range").agg(
        F.min(F.struct(F.col(key).isNotNull().alias("a"), F.col(key).alias("k"), F.col(tie).alias("t"))).alias("f")).collect()}
    order = sorted(firsts)
    if not order:
        return ranged.select(*df.columns, *[F.col(c).alias(f"next_{c}") for c in carry])
    size = order[-1] + 1
    before = {r: order[i - 1] for i, r in enumerate(order)}
    array = lambda f, kind: F.array(*[F.lit(f(i)).cast(kind) for i in range(size)])
    at = F.col("_range")
    first = F.get(array(lambda i: firsts[i]["k"] if i in firsts else None, "long"), at).eqNullSafe(F.col(key)) \
        & F.get(array(lambda i: firsts[i]["t"] if i in firsts else None, "long"), at).eqNullSafe(F.col(tie))
    home = F.struct(at.alias("r"), F.lit(0).alias("copy"))
    guest = F.struct(F.get(array(lambda i: before.get(i), "int"), at).alias("r"), F.lit(1).alias("copy"))
    dealt = ranged.select(*df.columns, F.explode(F.when(first, F.array(home, guest)).otherwise(F.array(home))).alias("_at"))
    w = Window.partitionBy("_at.r").orderBy("_at.copy", F.col(key).asc_nulls_first(), tie)
    return dealt.select(*df.columns, "_at", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry]) \
        .where("_at.copy = 0").drop("_at")


def fingerprint_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness.

    Edited: the last ``n_chars div 2`` code points replaced by the first as
    many (or all) of the next document. Null text: empty (no anchors, empty
    fingerprint; two empty fingerprints are alike, likeness 1). Null keys
    come first; repeated keys are ordered by a hash of the text. The next of
    a single row is the row itself. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    near = with_next(_sketched(rows, "text", "sk"), "doc_id", "tie", ["text", "sk"])
    n = F.length("text")
    edited = near.select("doc_id", n.cast("long").alias("n_chars"), "sk", "next_sk", F.concat(
        F.expr("substring(text, 1, length(text) - length(text) div 2)"),
        F.expr("substring(next_text, 1, cast(length(text) div 2 as int))")).alias("edited"))
    both = _sketched(edited.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)), "edited", "edited_sk")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sk")).alias("fingerprint"),
        as_text(F.col("edited_sk")).alias("edited_fingerprint"),
        likeness(F.col("sk"), F.col("edited_sk")).alias("near_edited"),
        likeness(F.col("sk"), F.col("next_sk")).alias("near_next"))


def _sketched(df: DataFrame, text: str, out: str) -> DataFrame:
    keep = [c for c in df.columns if c != out]
    return with_anchors(df, text, "_anchors").select(*keep, sketch(F.col("_anchors")).alias(out))
