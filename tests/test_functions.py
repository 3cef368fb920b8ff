"""Column helpers that reproduce Python string/JSON semantics."""

import json
import random

from querywarden.functions import text as T


def test_json_string_matches_json_dumps(spark):
    rnd = random.Random(9)
    pool = ['"', "\\", "\n", "\r", "\t", "\b", "\f", "\x00", "\x1f", "\x7f", "\x80", "é", "ß",
            " ", "퟿", "", "\U0001F600", "\U00010000", "a", "Z", " ", "/", "~"]
    texts = ["", None] + pool + ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 12)))
                                 for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.j for r in df.select("i", T.json_string("t").alias("j")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == json.dumps(t), repr(t)


def test_python_string_semantics(spark):
    texts = ["  a b\t", "\x1c x \x1f", "　y ", "", "   ", None, "a  b\n\nc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = {r.i: r for r in df.select(
        "i", T.py_strip("t").alias("s"), T.py_is_blank("t").alias("b"),
        T.py_split("t").alias("sp"), T.py_collapse_ws("t").alias("c")).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        if t is None:
            assert r.b
            continue
        assert r.s == t.strip() and r.b == (not t.strip())
        assert list(r.sp) == t.split() and r.c == " ".join(t.split())
