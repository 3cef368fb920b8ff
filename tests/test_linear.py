"""Linear forms of rules: the same matches as the fixed rules, and no more time than the text's length asks for."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from querywarden.functions import linear, regex
from querywarden.functions import rules as R
from querywarden.functions import text as T
from querywarden.operators import inbound as I
from querywarden.operators import outbound as O

RULES = {r.name: r for r in R.PII_RULES}


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)


def both(spark, rule, texts):
    """(linear hits, linear text, plain hits, plain text) of each text, the plain ones by the rule as Java runs it."""
    hits, text = T.rule_hits("t", rule)
    plain = T.extract_all("t", rule.pattern, rule.case_insensitive)
    replaced = T.replace_all("t", rule.pattern, rule.placeholder, rule.case_insensitive)
    return frame(spark, texts).select("t", hits.alias("a"), text.alias("b"), plain.alias("c"), replaced.alias("d")).collect()


def test_which_rules_have_a_form():
    assert [r.name for r in R.PII_RULES if linear.form_of(r.pattern, r.case_insensitive)] == ["email", "address"]
    assert linear.form_of(r"[a-z@]+@[a-z]+\.[a-z]+", False) is None     # the sign is in the run
    assert linear.form_of(r"[a-z]+@[a-z.]+\.[a-z]+", False) is None     # the dot is in the label


@pytest.mark.parametrize("name, alphabet", [
    ("email", ["a", "B7", ".", "-", "_", "+", "@", "@", "x.y", " ", "é", "\n"]),
    ("address", ["1", "12", "1234567", " ", " ", "  ", "Main", "o'x-y.", "St", "Street", "court", "LN", "_", ",", "\n", "é", "\x1c", "٣", "ſt"]),
])
def test_random_texts_give_the_same_matches(spark, name, alphabet):
    rnd = random.Random(name)
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(26))) for _ in range(4000)]
    texts += ["a@b.c_d@e.f", "a@b.c+d@e.f x", "a@b@c.d", "12 Main St_x", "12 Main St 14 Oak Rd, 5 x", "7 a 8 b Court 9 c", "1 St", "", "1 a St."]
    rule = RULES[name]
    rows = both(spark, rule, texts)
    assert any(r.a for r in rows)
    for r in rows:
        assert (r.a, r.b) == (r.c, r.d), r.t
        want = re.findall(rule.pattern, r.t, re.I if rule.case_insensitive else 0)
        if "\x1c" not in r.t:
            assert r.a == want and r.b == re.sub(rule.pattern, rule.placeholder, r.t, flags=re.I if rule.case_insensitive else 0), r.t


def test_random_texts_through_the_whole_chain(spark):
    rnd = random.Random(7)
    words = ["12", "Main", "St", "a@b.co", "x", "555-123-4567", "[ADDRESS]", "4111 1111 1111 1111", "routing 123456789", ",", "_", "born 1/2/1990"]
    texts = [rnd.choice([" ", "", ", "]).join(rnd.choice(words) for _ in range(rnd.randrange(12))) for _ in range(1500)]
    got = O.redact_pii(frame(spark, texts).withColumn("query", F.col("t")), "query").collect()
    for r in got:
        text, found = r.t, []
        for rule in R.PII_RULES:
            flags = re.I if rule.case_insensitive else 0
            found += [(rule.placeholder, m) for m in re.findall(rule.pattern, text, flags)]
            text = re.sub(rule.pattern, rule.placeholder, text, flags=flags)
        assert (r.query, [tuple(f) for f in r.findings]) == (text, found), r.t


def test_long_runs_take_no_longer_than_their_length(spark):
    million = 1_000_000
    texts = ["A" * million + " mail x@y.zz", "a@" * (million // 2) + " mail x@y.zz", "x@" + "b" * million, "a.b_" * (million // 4) + "@",
             "5 Main St, " + " ".join(f"{i} word" for i in range(20_000)), " ".join(f"{i} word" for i in range(20_000)) + " Court tail " + "7 a " * 20_000,
             "<" * million, "<b>" + "<" * million, "x" + " " * million + "y"]
    for df in (O.redact_pii(O.normalise(frame(spark, texts), "t", max_length=None), "query"),
               frame(spark, texts).select(F.array(I.clean_text("t")).alias("findings"), T.py_strip("t").alias("query"))):
        df.limit(0).collect()
        began = time.time()
        rows = df.select(F.size("findings").alias("n"), F.length("query").alias("m")).collect()
        assert len(rows) == len(texts) and time.time() - began < 2 * len(texts)


def test_tags_up_to_the_last_end(spark):
    texts = ["a<b>c", "<", ">", "<>", "<<>", "a<b", "a<b>c<d", "x>y<z", None, "", "<a><b> 5 < 3 and 4 > 2 <"]
    tag = regex.adapt(R.HTML_TAG)
    for r in frame(spark, texts).select("t", T.strip_tags("t", tag, " ").alias("s")).collect():
        assert r.s == (None if r.t is None else re.sub(R.HTML_TAG, " ", r.t))


def test_blanks_at_both_ends(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice([" ", "\n", "\x1c", "　", "a", "é"]) for _ in range(rnd.randrange(9))) for _ in range(2000)]
    for r in frame(spark, texts).select("t", T.py_strip("t").alias("s")).collect():
        assert r.s == r.t.strip()
