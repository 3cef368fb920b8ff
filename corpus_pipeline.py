"""Corpus pipeline: language, near-duplicates, repeated passages, benchmark leaks, token ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns what it keeps, with the columns of ``documents`` (the last one
returns token counts and digests). ``run`` applies them to ``documents``,
writing each stage's result to the shared folder and reading it back.

Empty tables give empty results at every stage; columns beyond those of
``documents`` are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querywarden.llm import bpe, decontaminate, language, repeats, simhash
from querywarden.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: ``lang`` becomes the predicted language; texts without a letter (or null) go.

    The classifier learns from the rows' own labels, on the bounded sample
    of ``language.ROWS_PER_LABEL`` rows a label.
    """
    docs = docs.select(*COLUMNS)
    kept = language.predict(docs, language.train(docs)).where("lang_pred != 'und'")
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (4-word shingles, 4 bits): the document with a group's least id stays.

    Rows are told apart by their text, so missing and repeated ids do no harm:
    a row without an id stays only where no row of its group has one, and of
    rows equal in id and text one stays.
    """
    docs = docs.select(*COLUMNS)
    text = F.xxhash64("text")
    groups = simhash.near_duplicates(docs.withColumn("_text", text), key="_text", size=4, radius=4) \
        .select(F.col("doc_id").alias("_text"), "component_id").distinct()
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text")
    first = docs.select("doc_id", text.alias("_text")).join(groups, "_text").groupBy("component_id").agg(F.min(place).alias("m")) \
        .select(F.col("m.doc_id").alias("_id"), F.col("m._text").alias("_first"))
    kept = docs.withColumn("_text", text).join(
        first, (F.col("_text") == F.col("_first")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("_text", "doc_id").orderBy("source", "lang", "n_chars"))
    return kept.withColumn("_n", nth).where("_n = 1").select(*COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: passages of 50 words or more that an earlier document has are cut out.

    A document that is nothing but repeated passages goes.
    """
    clean = repeats.remove_repeats(docs.select(*COLUMNS))
    return clean.where(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))) \
        .withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a hit window of any item go.

    The decision is one of the text, and rows are told apart by it: missing
    and repeated ids do no harm.
    """
    docs = docs.select(*COLUMNS).withColumn("_text", F.xxhash64("text"))
    hit = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), key="_text") \
        .where("contaminated").select(F.col("doc_id").alias("_text")).distinct()
    return docs.join(hit, "_text", "left_anti").select(*COLUMNS)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: token count and digests of ids and decoded bytes of each document left."""
    encoded = bpe.encode_column(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language_stage),
    ("simhash_dedup", near_duplicate_stage),
    ("substring_dedup", repeats_stage),
    ("decontaminate", decontaminate_stage),
    ("byte_bpe", encode_stage),
]

#: Learnt predictions, component search and BPE have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
