"""Operator 13: how the sources of a language differ in their terms.

Every lang has a CountVectorizer of its own (``minDF`` documents, the
greatest vocabulary an integer can state, so nothing is cut), whose sparse
vectors are summed by (lang, source). The sums are smoothed to integer
shares; pairs of sources are evaluated in tiles of the sparse sums.

All arithmetic is in integers: counts and shares are longs, the division is
one of decimals.

Scale: the text is cut into words once and kept as a table in one folder
per lang; a fit reads its own lang's folder. A group's sums are partial
aggregates keyed by (source, term), so a source with a third of all rows is
added up on the map side. Postings (one row for each source and term that
occurs in it) are dealt by block of terms and pair of source tiles, each
unit holding at most TILE sources by BLOCK terms a side. The driver sees one
row a lang, and the vocabulary that CountVectorizer itself gathers there.

Defined results: null text, lang and source count as ''. A lang of fewer
than ``min_docs`` documents, or without a term in so many, has no kept term:
its pairs have the value 0 and it has no term rows. Repeated rows count as
often as they occur. An empty table gives an empty result. Further columns
of the table are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, lower_az, materialise

#: What parts two terms: ASCII characters other than letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MAX_VOCABULARY = 2**31 - 1
#: Each document of a lang also has this term (no text can have it), so that a fit never finds nothing.
EVERY_DOCUMENT = " "
#: A unit of pair evaluation: so many sources a side, so many terms.
TILE, BLOCK = 128, 1024
#: A table of the langs up to so many bytes goes to all tasks.
SMALL_TABLE = 4 << 20

RESULT = "lang string, source string, part string, item string, value long, rank int"


def word_table(docs: DataFrame) -> tuple[DataFrame, list[tuple[int, str, int]]]:
    """The words of every document in one folder a lang, and (number, lang, documents) of the langs."""
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    langs = [(i, r["lang"], r["count"]) for i, r in enumerate(rows.groupBy("lang").count().orderBy("lang").collect())]
    numbers = spark.createDataFrame([(i, lang) for i, lang, _ in langs], "lang_no int, lang string")
    if sum(len(lang.encode()) + 16 for _, lang, _ in langs) <= SMALL_TABLE:
        numbers = F.broadcast(numbers)         # else the texts are shuffled by lang
    words = F.array_append(F.array_remove(F.split(lower_az("text"), BETWEEN), ""), F.lit(EVERY_DOCUMENT))
    out = rows.join(numbers, "lang").select("lang_no", "source", words.alias("words"))
    path = fresh_path(spark, "words")
    out.write.partitionBy("lang_no").parquet(path)
    return spark.read.schema("source string, words array<string>, lang_no int").parquet(path), langs


def lang_counts(rows: DataFrame, min_docs: int) -> tuple[DataFrame, int]:
    """(source, term, count) of one lang's kept terms, and how many those are."""
    spark = rows.sparkSession
    model = CountVectorizer(inputCol="words", outputCol="vector", minDF=float(min_docs), vocabSize=MAX_VOCABULARY).fit(rows)
    kept = [(i, t) for i, t in enumerate(model.vocabulary) if t != EVERY_DOCUMENT]
    terms = spark.createDataFrame(kept, "term_no int, term string")
    vector = F.unwrap_udt("vector")
    sums = model.transform(rows).select("source", vector["indices"].alias("terms"), vector["values"].alias("n")) \
        .mapInArrow(_added, "source string, term_no int, n long").groupBy("source", "term_no").agg(F.sum("n").alias("count"))
    return sums.join(terms, "term_no").select("source", "term", "term_no", "count"), len(kept)


def _added(batches):
    """Sums of the sparse vectors of each batch, by source and term."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        source = batch.column(0).dictionary_encode()
        index, value = (batch.column(k).flatten().to_numpy() for k in (1, 2))
        if not len(index):
            continue
        size = int(index.max()) + 1
        key = np.repeat(source.indices.to_numpy().astype(np.int64), batch.column(1).value_lengths().to_numpy()) * size + index
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        key, total = key[order][first], np.add.reduceat(value[order].astype(np.int64), first)
        yield pa.RecordBatch.from_arrays([source.dictionary.take(pa.array(key // size)), pa.array((key % size).astype(np.int32)),
                                          pa.array(total)], names=["source", "term_no", "n"])


def share(count: Column, total: Column, terms: Column, smoothing: int, scale: int) -> Column:
    """1 + floor(scale (count + smoothing) / (total + smoothing terms)), exactly."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    over = wide(F.lit(scale), 11) * wide(count + smoothing, 19)
    under = wide(total + smoothing * terms, 19)
    return F.call_function("div", over, under) + 1


def _unit_sums(key, table):
    """For the sources a of one tile and b of another: sums of |pa - pb| - |za - zb| over a block's terms."""
    import numpy as np
    import pyarrow as pa

    side, src, term, p, z = (table[c].to_numpy() for c in ("side", "source_no", "term_no", "p", "z"))
    terms, column = np.unique(term, return_inverse=True)

    def dense(mine):
        ids, first, row = np.unique(src[mine], return_index=True, return_inverse=True)
        zero = z[mine][first]
        full = np.repeat(zero[:, None], len(terms), axis=1)
        full[row, column[mine]] = p[mine]
        return ids, zero, full

    a_ids, a_zero, a = dense(side == 0)
    b_ids, b_zero, b = dense(side == 1)
    out = np.empty((len(a_ids), len(b_ids)), np.int64)
    for i in range(len(a_ids)):
        out[i] = np.abs(a[i][None, :] - b).sum(1) - np.abs(a_zero[i] - b_zero) * len(terms)
    return pa.table({"lang_no": np.full(out.size, key[0].as_py(), np.int32), "a_no": np.repeat(a_ids, len(b_ids)),
                     "b_no": np.tile(b_ids, len(a_ids)), "d": out.ravel()})


def _alone(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """Units: every posting goes to both sides of the pairs of tiles that its source's tile is in.

    A tile of sources without a term of the block must still be met by the
    others' postings; its sources join the unit with their zero share only.
    """
    tiles = groups.groupBy("lang_no").agg(((F.max("source_no") / TILE).cast("int") + 1).alias("tiles"))
    tile = (F.col("source_no") / TILE).cast("int")
    dealt = postings.join(tiles, "lang_no").withColumn("block", (F.col("term_no") / BLOCK).cast("int"))
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    as_a = dealt.select("*", F.lit(0).alias("side"), tile.alias("ta"), F.explode(others).alias("tb")).where("ta <= tb")
    as_b = dealt.select("*", F.lit(1).alias("side"), F.explode(others).alias("ta"), tile.alias("tb")).where("ta <= tb")
    return as_a.unionByName(as_b)


def pair_values(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang_no, a_no, b_no, value) for each ordered pair of a lang's sources: the sum of |pa - pb| over all its kept terms.

    ``groups``: lang_no, source_no, terms, z (share of a term that does not
    occur). ``postings``: the same with term_no and p, where the term occurs.
    Terms that occur in neither of two sources give terms x |za - zb| in sum;
    the units correct that by the terms that occur in one of them.
    """
    cols = ["lang_no", "source_no", "term_no", "p", "z"]
    # each source appears in each unit of its tile once, also without a posting there: term -1 with its zero share
    absent = groups.where("terms > 0").select("lang_no", "source_no", F.lit(-1).alias("term_no"), F.col("z").alias("p"), "z")
    blocks = postings.select("lang_no", (F.col("term_no") / BLOCK).cast("int").alias("block")).distinct()
    units = _alone(postings.select(*cols), groups)
    extra = _alone(absent, groups).drop("block").join(blocks, "lang_no")
    schema = "lang_no int, a_no int, b_no int, d long"
    part = units.unionByName(extra).groupBy("lang_no", "block", "ta", "tb").applyInArrow(_unit_sums, schema)
    half = part.where("a_no < b_no").groupBy("lang_no", "a_no", "b_no").agg(F.sum("d").alias("d"))
    a = groups.select("lang_no", F.col("source_no").alias("a_no"), F.col("z").alias("za"), "terms")
    b = groups.select("lang_no", F.col("source_no").alias("b_no"), F.col("z").alias("zb"))
    value = F.col("d") + F.col("terms") * F.abs(F.col("za") - F.col("zb"))
    got = half.join(a, ["lang_no", "a_no"]).join(b, ["lang_no", "b_no"]).select("lang_no", "a_no", "b_no", value.alias("value"))
    none = groups.where("terms = 0").select("lang_no", F.col("source_no").alias("a_no")) \
        .join(groups.where("terms = 0").select("lang_no", F.col("source_no").alias("b_no")), "lang_no") \
        .where("a_no < b_no").select("lang_no", "a_no", "b_no", F.lit(0).cast("long").alias("value"))
    both = got.unionByName(none)
    return both.unionByName(both.select("lang_no", F.col("b_no").alias("a_no"), F.col("a_no").alias("b_no"), "value"))


def source_divergence(docs: DataFrame, min_docs: int = 30, smoothing: int = 5, scale: int = 10**9, top: int = 50) -> DataFrame:
    """For each (lang, source): its distance to each other source of the lang, and the ``top`` terms it has beyond the lang's share."""
    spark = docs.sparkSession
    words, langs = word_table(docs)
    if not langs:
        return spark.createDataFrame([], RESULT)
    tables, sizes = [], {}
    for no, _, n_docs in langs:
        if n_docs < min_docs:
            continue
        counts, sizes[no] = lang_counts(words.where(F.col("lang_no") == no).select("source", "words"), min_docs)
        tables.append(materialise(counts.select(F.lit(no).alias("lang_no"), "source", "term", "term_no", "count"), "llm-term-counts"))
    empty = spark.createDataFrame([], "lang_no int, source string, term string, term_no int, count long")
    counts = reduce(DataFrame.unionByName, tables, empty)
    names = spark.createDataFrame([(no, lang, sizes.get(no, 0)) for no, lang, _ in langs], "lang_no int, lang string, terms long")

    number = F.row_number().over(Window.partitionBy("lang_no").orderBy("source")) - 1
    totals = counts.groupBy("lang_no", "source").agg(F.sum("count").alias("total"))
    groups = words.select("lang_no", "source").distinct().join(totals, ["lang_no", "source"], "left").join(names, "lang_no")
    groups = groups.select("lang_no", "lang", "source", number.alias("source_no"), "terms", F.coalesce("total", F.lit(0)).alias("total"))
    zero = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.greatest("terms", F.lit(1)), smoothing, scale)).otherwise(0)
    groups = materialise(groups.withColumn("z", zero.cast("long")), "llm-source-groups")

    lang_terms = counts.groupBy("lang_no", "term_no").agg(F.sum("count").alias("lang_count"))
    lang_total = groups.groupBy("lang_no").agg(F.sum("total").alias("lang_total"))
    q = share(F.col("lang_count"), F.col("lang_total"), F.col("terms"), smoothing, scale)
    p = share(F.col("count"), F.col("total"), F.col("terms"), smoothing, scale)
    postings = materialise(counts.join(groups, ["lang_no", "source"]).withColumn("p", p), "llm-postings")

    by_value = [F.col("value").desc(), F.col("item").asc()]
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_value)).alias("rank")
    item = groups.select("lang_no", F.col("source_no").alias("b_no"), F.col("source").alias("item"))
    pairs = pair_values(postings, groups).join(item, ["lang_no", "b_no"]) \
        .join(groups.select("lang_no", F.col("source_no").alias("a_no"), "lang", "source"), ["lang_no", "a_no"]) \
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    over = postings.join(lang_terms, ["lang_no", "term_no"]).join(lang_total, "lang_no").withColumn("value", F.col("p") - q) \
        .where("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    terms = over.select("*", rank).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


#: The whole result in DuckDB SQL.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row_no, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT row_no, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row_no) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
counted AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
totals AS (SELECT lang, source, sum(c) AS n FROM counted GROUP BY ALL),
lang_counted AS (SELECT lang, term, sum(c) AS c FROM counted GROUP BY ALL),
lang_totals AS (SELECT lang, sum(c) AS n FROM counted GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
        1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(t.n, 0) + 5 * s.v) AS p
      FROM grp g JOIN kept k ON g.lang = k.lang JOIN sizes s ON s.lang = g.lang
      LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
      LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
q AS (SELECT l.lang, l.term, 1 + (1000000000::HUGEINT * (l.c + 5)) // (t.n + 5 * s.v) AS q
      FROM lang_counted l JOIN lang_totals t ON t.lang = l.lang JOIN sizes s ON s.lang = l.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
          FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT m.lang, m.source, o.source AS item, sum(abs(m.p - o.p)) AS value
                     FROM p m JOIN p o ON m.lang = o.lang AND m.term = o.term AND m.source <> o.source GROUP BY ALL) x
          ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, p.p - q.q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term
          WHERE p.c > 0 AND p.p > q.q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
           UNION ALL
           SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
