"""The derived inputs reach every rule, category and limit; large keyword tables give what the chain gives."""

import random
import time

from locations import SF_SMALL
from pyspark.sql import functions as F

from querywarden.functions import rules as R
from querywarden.functions import text as T
from querywarden.operators import outbound as O
from querywarden.plans import catalog as C


def test_every_rare_term_rule_and_category_has_hits(spark):
    passed = C._f1_passed(spark, SF_SMALL).cache()
    hits = passed.agg(*[F.sum(F.size(T.extract_all("query", r.pattern, r.case_insensitive))).alias(r.rule_id) for r in R.RARE_TERM_RULES]).first()
    assert all(hits[r.rule_id] > 0 for r in R.RARE_TERM_RULES), hits
    assert {r.category for r in O.generalise(passed, "query").select("category").distinct().collect()} == \
        {None, *(cat for _, cat in R.CATEGORY_KEYWORDS)}
    passed.unpersist()


def test_a_context_is_cut_at_its_limit(spark):
    contexts = [r.context for r in C.context_strings(spark, SF_SMALL).collect()]
    cut = [c for c in contexts if c.endswith(R.CONTEXT_TRUNCATION)]
    assert cut and all(len(c) == R.MAX_CONTEXT_LENGTH + len(R.CONTEXT_TRUNCATION) for c in cut)
    assert any(c and c not in cut for c in contexts)


def test_large_keyword_tables_equal_the_chain(spark, monkeypatch):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abé ") for _ in range(n))
    keywords = [(word(rnd.randrange(1, 5)), f"c{i}") for i in range(60)]
    texts = [None, "", *(word(rnd.randrange(12)).upper() for _ in range(800))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, query string").repartition(3)
    chain = {r.i: r.category for r in O.generalise(df, "query", keywords=keywords).collect()}
    monkeypatch.setattr(O, "CHAIN_KEYWORDS", 3)
    for table in (keywords, [*keywords[:10], ("", "always"), *keywords[10:]]):
        got = {r.i: r.category for r in O.generalise(df, "query", keywords=table).collect()}
        first = lambda t: next((c for k, c in table if k in t.lower()), None)
        assert got == {i: None if t is None else first(t) for i, t in enumerate(texts)}
        if table is keywords:
            assert got == chain
    assert {r.category for r in O.generalise(df, "query", keywords=[("", "x")] * 5).collect()} == {"x", None}


def test_ten_thousand_keywords_take_no_longer_than_a_few(spark):
    rnd = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = [("".join(rnd.choice(letters) for _ in range(9)), f"c{i}") for i in range(10_000)]
    df = spark.range(40_000).select(F.concat(F.md5(F.col("id").cast("string")), F.lit(" "), F.sha2(F.col("id").cast("string"), 256)).alias("query"))

    def seconds(keywords):
        out = O.generalise(df, "query", keywords=keywords).agg(F.count("category"))
        out.collect()
        began = time.time()
        O.generalise(df, "query", keywords=keywords).agg(F.count("category")).collect()
        return time.time() - began

    assert seconds(many) < 2 * seconds(many[:27] + [("0" * 40, "never")] * 38) + 2
