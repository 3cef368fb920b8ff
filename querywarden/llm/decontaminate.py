"""Benchmark decontamination: a prefix-filtered join of item windows with document words.

A window is ``width`` consecutive words of an item (an item of fewer words,
but not none, is one window). A window is contained in a document only if
all its words are, so a prefix of one token is enough: the word of the
window that is rarest in the corpus. Candidates come from joining document
words with these rarest words; length and position bounds drop those that
stick out of the document; the rest are compared word by word.

Everything is DataFrame expressions. Texts are lower-cased (A-Z alone) as a
whole before they are cut into words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az

#: What parts words: all ASCII but lower-case letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Windows and window words up to this many are broadcast (some tens of MB);
#: larger benchmarks are joined by a shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def windows(items: DataFrame, width: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: ``win`` (words joined by blanks), ``win_len``, ``items`` (ids as strings)."""
    w = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("ws")) \
        .where(F.size("ws") > 0)
    starts = w.select("item", "ws", F.explode(F.sequence(
        F.lit(1), F.greatest(F.size("ws") - (width - 1), F.lit(1)))).alias("s"))
    one = starts.select("item", F.slice("ws", F.col("s"), F.lit(width)).alias("part"))
    return one.groupBy(F.array_join("part", " ").alias("win")).agg(
        F.max(F.size("part")).alias("win_len"), F.sort_array(F.collect_set("item")).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans``.

    ``n_hit``: words inside any occurrence of a window; ``spans``: the
    occurrences as (start, length) in words, ascending; ``n_items``: items
    with occurring windows; ``items_sha256``: digest of their ids as sorted
    strings, comma-joined (of the empty string if none).

    A null or empty text has no words. Repeated rows each get their row, null
    keys too. An item without words, or whose id is null, counts for no item
    (the words of the latter are still hit). With no items or no documents
    the result has no hits or no rows. Other columns are not read.
    """
    keyed = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).select(
        "doc_id", F.xxhash64("t").alias("h1"), F.crc32(F.col("t").cast("binary")).alias("h2"),
        words(F.col("t")).alias("ws"))

    win = windows(items, width).persist()
    n_win = win.count()
    win_words = win.select("win", F.posexplode(F.split("win", " ")).alias("off", "word"))
    vocabulary = win_words.select(F.col("word").alias("w")).distinct()
    rarity = keyed.select(F.explode("ws").alias("w")) \
        .join(_small(vocabulary, n_win * width), "w", "left_semi").groupBy("w").count()
    # the rarest word of each window; a window with a word that no document has cannot occur
    ranked = win_words.withColumnRenamed("word", "w").join(_small(rarity, n_win * width), "w", "left") \
        .groupBy("win").agg(
            F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "w", "off")).alias("r"))
    prefixes = ranked.where("r.n > 0").join(win, "win").select(
        F.col("r.w").alias("w"), F.col("r.off").alias("off"), "win", "win_len", "items")

    at = keyed.select("doc_id", "h1", "h2", "ws", F.posexplode("ws").alias("pos", "w"))
    start = F.col("pos") - F.col("off")
    hits = at.join(_small(prefixes, n_win), "w") \
        .where((start >= 0) & (start + F.col("win_len") <= F.size("ws"))) \
        .where(F.array_join(F.slice("ws", start + 1, F.col("win_len")), " ") == F.col("win")) \
        .select("doc_id", "h1", "h2", F.struct(start.alias("start"), F.col("win_len").alias("length")).alias("span"), "items")
    per_doc = hits.groupBy("doc_id", "h1", "h2").agg(
        F.sort_array(F.collect_set("span")).alias("spans"), F.collect_set("items").alias("items"))
    per_doc = per_doc.select(
        F.col("doc_id").alias("k"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), "spans",
        F.size(F.array_distinct(F.flatten(F.transform(
            "spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))).cast("long").alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten("items"))).alias("ids"))

    base = keyed.select("doc_id", "h1", "h2", F.size("ws").cast("long").alias("n_words"))
    joined = base.join(per_doc, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("h1") == F.col("k1"))
                       & (F.col("h2") == F.col("k2")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("ids", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("ids", none), ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"))


ORACLE = r"""
WITH dw AS (
  SELECT rowid_ AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(list_slice(ws, s, s + 9), ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM bw WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
dwin AS (
  SELECT r, s, n, array_to_string(list_slice(ws, s, s + n - 1), ' ') AS win
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM dw, lens WHERE len(ws) >= n)),
hits AS (SELECT r, s, dwin.n AS n, item FROM dwin JOIN wins ON dwin.win = wins.win AND dwin.n = wins.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit
        FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
