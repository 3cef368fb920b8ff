"""The registered queries: those with SQL against DuckDB, the pipeline stage by stage against brute force."""

import hashlib

import duckdb
import public_tokenizers as P
import pytest
import tiktoken
from test_llm_duplicates import fingerprint_by_hand, groups_by_hand
from test_llm_text import hits_by_hand

import __spark_entry__ as E
import corpus_pipeline as cp
from querywarden.llm import bpe, catalog

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n in catalog.QUERIES) == list(range(1, 14))
    assert "pipeline" in E.queries() and set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    res = con.execute(catalog.ORACLE_SQL[name])
    cols = [d[0] for d in res.description]
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, res.fetchall()))


def test_pipeline_stages_by_hand(spark):
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, kept = {r.doc_id: r.text for r in docs.collect()}, {}
    for name, stage in cp.STAGES:
        got = stage(spark, docs, SF).collect()
        if name == "language_id":
            assert {r.doc_id for r in got} == {i for i, t in before.items() if any(c.isalpha() for c in t or "")}
            assert all(r.text == before[r.doc_id] for r in got)
        elif name == "simhash_dedup":
            ids = sorted(before)
            label = groups_by_hand([fingerprint_by_hand(before[i]) for i in ids])
            assert sorted(r.doc_id for r in got) == [ids[g] for g in sorted(set(label))]
        elif name == "substring_dedup":
            first, repeated = {}, set()
            for i in sorted(before):
                w = before[i].encode().lower().split()
                for k in range(len(w) - 49):
                    if first.setdefault(tuple(w[k:k + 50]), i) < i:
                        repeated.add(i)
            for i in set(before) - {r.doc_id for r in got} - repeated:  # near copies: most short shingles stand in one earlier text
                mine = before[i].encode().lower().split()
                mine = {tuple(mine[k:k + 4]) for k in range(len(mine) - 3)}
                best = 0
                for j in (j for j in before if j < i):
                    w = before[j].encode().lower().split()
                    best = max(best, len(mine & {tuple(w[k:k + 4]) for k in range(len(w) - 3)}) / len(mine))
                assert best > 0.4, i
            now = {r.doc_id: r.text for r in got}
            assert all(now[i] != before[i] for i in repeated if i in now)
            for i, t in now.items():  # nothing that an earlier document has is left
                w = t.encode().lower().split()
                assert not any(tuple(w[k:k + 50]) in first and first[tuple(w[k:k + 50])] < i for k in range(len(w) - 49))
        elif name == "decontaminate":
            assert {r.doc_id for r in got} == {i for i, t in before.items() if not hits_by_hand(t, bench)[1]}
        else:
            enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")),
                                    special_tokens={})
            for r in got:
                ids = enc.encode_ordinary(before[r.doc_id])
                assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                assert r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest()
            assert {r.doc_id for r in got} == set(before)
            break
        docs = spark.createDataFrame(got, docs.schema)
        before = {r.doc_id: r.text for r in got}


def staged(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_decontamination_goes_by_text_not_by_id(spark):
    leaked = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    clean = "nothing of any benchmark is in this line of words " * 3
    rows = [(None, leaked), (5, leaked), (5, clean), (6, clean), (None, clean), (7, None)]
    got = cp.decontaminate_stage(spark, staged(spark, rows), SF)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, rows[2:]))
    assert got.columns == cp.COLUMNS


def test_one_row_of_each_group_also_where_ids_are_missing_or_repeated(spark):
    import random

    rnd = random.Random(1)
    text = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    rows = [(5, a), (None, a), (9, a), (7, b), (7, c), (None, d), (None, d), (3, c), (8, b), (8, b), (1, None), (2, ""), (4, None)]
    got = cp.near_duplicate_stage(spark, staged(spark, rows), SF)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, [(5, a), (7, b), (3, c), (None, d), (1, None)]))
    assert got.columns == cp.COLUMNS


def test_a_million_characters_through_the_stages(spark):
    word = "abcde fghij "
    rows = [(1, word * 90_000), (2, "x" * 1_000_000), (3, "\u4e2d" * 200_000 + " end"), (4, "a plain short line of text here")]
    docs = staged(spark, rows)
    for name, stage in cp.STAGES[1:]:
        docs = cp.materialise(stage(spark, docs, SF), "long-texts")
    assert {r.doc_id for r in docs.collect()} >= {1, 2, 4} and docs.where("doc_id = 2").first().n_tokens > 1000
