"""Hand-written expected rows, and properties against Python's ``re``."""

import random
import re

import pytest

from querywarden.functions import rules as R
from querywarden.operators import outbound as O

OK, EMPTY, RISK, RATIO = "", R.REASON_EMPTY, R.REASON_HIGH_RISK, R.REASON_TOO_MUCH_PII

# raw text, cleaned query, (placeholder, match) in order, reason
CASES = [
    ("how tall is the eiffel tower", "how tall is the eiffel tower", [], OK),
    ("mail ann.lee+x@mail.example.org please now", "mail [EMAIL] please now", [("[EMAIL]", "ann.lee+x@mail.example.org")], OK),
    ("ring (415) 555-0199 after lunch today", "ring ([PHONE] after lunch today", [("[PHONE]", "415) 555-0199")], OK),
    ("ring 415 555 0199 after lunch", "ring [PHONE] after lunch", [("[PHONE]", "415 555 0199")], OK),
    ("is 078-05-1120 a number in use", "is [SSN] a number in use", [("[SSN]", "078-05-1120")], OK),
    ("pay with 5500 0000 0000 0004 at once", "pay with [CARD] at once", [("[CARD]", "5500 0000 0000 0004")], OK),
    ("close acct: 99887766 for good today", "close [BANK_ACCOUNT] for good today", [("[BANK_ACCOUNT]", "acct: 99887766")], OK),
    ("ABA 011000015 belongs to which bank", "[ROUTING] belongs to which bank", [("[ROUTING]", "ABA 011000015")], OK),
    ("account 1234567890", "account [PHONE]", [("[PHONE]", "1234567890")], OK),
    ("passport renewal fee in euros", "[PASSPORT] fee in euros", [("[PASSPORT]", "passport renewal")], OK),
    ("go to 7 North Elm Lane at noon", "go to [ADDRESS] at noon", [("[ADDRESS]", "7 North Elm Lane")], OK),
    ("two on the court but no number", "two on the court but no number", [], OK),
    ("from 12 Oak St to 14 Pine Ave by bus", "from [ADDRESS] by bus", [("[ADDRESS]", "12 Oak St to 14 Pine Ave")], OK),
    ("ping 10.20.30.40 fails since monday", "ping [IP] fails since monday", [("[IP]", "10.20.30.40")], OK),
    ("DOB: 3/4/1985 of the author please", "[DOB] of the author please", [("[DOB]", "DOB: 3/4/1985")], OK),
    ("key sk-ABCDEFGHIJKLMNOPQRST leaked in logs", "key [API_KEY] leaked in logs", [("[API_KEY]", "sk-ABCDEFGHIJKLMNOPQRST")], OK),
    ("sha 0123456789abcdef0123456789abcdef of what file", "sha [HEX_TOKEN] of what file",
     [("[HEX_TOKEN]", "0123456789abcdef0123456789abcdef")], OK),
    ("078-05-1120 and also aba 011000015 in one line", "[SSN] and also [ROUTING] in one line",
     [("[SSN]", "078-05-1120"), ("[ROUTING]", "aba 011000015")], RISK),
    ("[CARD] [SSN] as typed by a person", "[CARD] [SSN] as typed by a person", [], RISK),
    ("a@b.example 415-555-0199 hi", "[EMAIL] [PHONE] hi", [("[EMAIL]", "a@b.example"), ("[PHONE]", "415-555-0199")], RATIO),
    ("[q] [r] s", "[q] [r] s", [], RATIO),
    ("[q] r", "[q] r", [], OK),
    (" \t \x1c ", "", [], EMPTY),
    ("", "", [], EMPTY),
    (None, "", [], EMPTY),
    ("　 wide blanks \x1f", "wide blanks", [], OK),
    ("z" * 199 + "yx", "z" * 199 + "y", [], OK),
]


@pytest.fixture(scope="module")
def sanitized(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, raw string")
    return {r.id: r for r in O.sanitize(df, "raw", findings=True).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_expected_rows(sanitized, i):
    raw, query, found, reason = CASES[i]
    got = sanitized[i]
    assert got.query == query
    assert [(f.placeholder, f.match) for f in got.findings] == found
    assert got.n_redactions == len(found)
    assert (got.reason, got.blocked) == (reason, reason != "")


ATOMS = ["415", "0199", "12", "-", ".", " ", "  ", " ", "\x1c", "@", "b", "Q", "mail.example", "acct", "Account:",
         "aba ", "Passport#", "BORN ", "birthday:", "pk-", "api-key=", "0fedcba9" * 4, "Elm", "Road", "Dr", "lane", "/",
         "(", ")", "+1", "٤١٥", "１２", "ü", "[IP]", "\n", "9.8.7.6", "5500 0000 0000 0004", "ſ", "K"]


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ATOMS) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("rule", R.PII_RULES, ids=lambda r: r.name)
def test_each_rule_matches_like_python(spark, rule):
    texts = random_texts(250, rule.name)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, query string")
    rx = re.compile(rule.pattern, re.I if rule.case_insensitive else 0)
    for r in O.redact_pii(df, rules=[rule], gate=None, guards=None).collect():
        assert [f.match for f in r.findings] == rx.findall(texts[r.i]), repr(texts[r.i])
        assert r.query == rx.sub(rule.placeholder, texts[r.i])


def test_gate_and_guards_change_nothing(spark):
    texts = random_texts(400, 3) + [c[0] for c in CASES if c[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, query string")
    plain = {r.i: r for r in O.redact_pii(df, gate=None, guards=None).collect()}
    for r in O.redact_pii(df).collect():
        assert (r.query, r.findings) == (plain[r.i].query, plain[r.i].findings), repr(texts[r.i])
    step = df
    for rule in R.PII_RULES:  # the chain is its rules one after the other
        step = O.redact_pii(step, rules=[rule], gate=None, guards=None, findings=False).drop("n_redactions")
    assert {r.i: r.query for r in step.collect()} == {i: r.query for i, r in plain.items()}


def test_only_queries_are_cut(spark):
    from pyspark.sql import functions as F

    tail = "word " * 60 + "write to far@end.example"
    df = spark.createDataFrame([("events", tail), ("documents", tail)], "src string, raw string")
    got = {r.src: r for r in O.sanitize(df, "raw", max_length=F.when(F.col("src") == "events", F.lit(200))).collect()}
    assert got["events"].n_redactions == 0 and len(got["events"].query) == 200
    assert got["documents"].n_redactions == 1 and got["documents"].query.endswith("write to [EMAIL]")
    assert O.sanitize(df, "raw", max_length=None).where("n_redactions = 1").count() == 2


def test_document_lines_are_read_in_full(spark):
    from querywarden.plans import catalog as C

    rows = C.pii_redacted_queries(spark, "/root/testdata/sf0.001").where("src = 'documents'")
    assert rows.selectExpr("max(length(query)) AS n").first().n > 200


def test_long_plain_text(spark):
    """20,000 words without punctuation after a number: no deep recursion, and the last suffix is found."""
    texts = ["call 5 " + "word " * 20000, "call 5 " + "word " * 20000 + "street", "9 " + "a " * 5000 + "Ct x 8 b Ln"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: (r.out, r.n_redactions) for r in O.redact_pii(df, "t", findings=False, out="out").collect()}
    assert got == {0: (texts[0], 0), 1: ("call [ADDRESS]", 1), 2: ("[ADDRESS]", 1)}


ADDRESSES = ["1 a St", "1 a  St", "1  St", "1 St", "1 St St", "12345678 x Rd", "5 o'hara-smith. ave", "5 x,y Ave", "5 x y\x1cAve",
             "5 x Avenues", "5 x Ave.", "7 x Dr 8 y", "7 x Dr 8 y Dr", "77 -. Ln", "1 é Ln", "1 a é Ln 2 b Ct", "3 x LANE\nnext"]


def test_address_edges(spark):
    rule = next(r for r in R.PII_RULES if r.name == "address")
    df = spark.createDataFrame(list(enumerate(ADDRESSES)), "i int, query string")
    for r in O.redact_pii(df, rules=[rule], gate=None).collect():
        assert [f.match for f in r.findings] == re.findall(rule.pattern, ADDRESSES[r.i], re.I), ADDRESSES[r.i]


def test_rare_terms_categories_padding(spark):
    rows = [  # text, rare matches, padded length in bytes
        ("why Mary Shelley wrote it", ["Mary Shelley"], 256),
        ("shops near 40 baker st, and 7 Elm Ct", ["Elm Ct", "7 Elm Ct"], 256),
        ("ticket QX-20931 is open", ["QX-20931"], 256),
        ("trial for a rare  disease in case no 812", ["rare  disease", "case no 812"], 256),
        ("nothing to see", [], 256),
        ("n" * 256, [], 256), ("n" * 257, [], 512), ("é" * 300, [], 1024), ("é" * 600, [], 1200),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, query string")
    for r in O.pad(O.rare_terms(df, "query"), "query").collect():
        text, rare, size = rows[r.i]
        assert list(r.rare_matches) == rare and r.unique == bool(rare)
        assert r.padded.startswith(text) and not r.padded[len(text):].strip(" ")
        assert len(r.padded.encode()) == size


def test_every_keyword_generalises(spark):
    df = spark.createDataFrame([(k, f"About {k.upper()} now") for k, _ in R.CATEGORY_KEYWORDS], "k string, query string")
    got = {r.k: r.category for r in O.generalise(df, "query").collect()}
    # no keyword holds another one of another category, so each gives its own
    assert got == dict(R.CATEGORY_KEYWORDS)
    assert O.generalise(spark.createDataFrame([("plain words",)], "query string"), "query").first().category is None


def test_uniqueness_decision(spark):
    rows = [("Mary Shelley again", True, "warn"), ("Mary Shelley again", True, "auto-block"),
            ("Mary Shelley again", True, "allow"), ("Mary Shelley again", False, "auto-block"),
            ("nothing rare", True, "auto-block")]
    df = spark.createDataFrame(rows, "query string, dp_enabled boolean, uniqueness_mode string")
    out = O.uniqueness_decision(O.rare_terms(df, "query")).collect()
    assert [r.uniqueness_action for r in out] == ["warn", "block", "none", "none", "none"]
    assert out[0].uniqueness_warning == R.UNIQUENESS_WARNING_PREFIX + "Mary Shelley"
