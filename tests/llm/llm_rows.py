"""Rows that every operator has to take: nulls, empty and odd texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, score double, `odd.name` string, _text string"


def sentence(rnd, n):
    return " ".join("".join(rnd.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rnd.randrange(1, 4)))
                    for _ in range(n))


def texts():
    rnd = random.Random(5)
    base = sentence(rnd, 90)
    return [base, base, base + " end", None, "", "   \n", "a", "1234 !!", "Ünïcödé ça va <|im_end|> 中文 😀 it's we'll",
            "x" * 5000, sentence(rnd, 400), sentence(rnd, 30) + "\n" + base + "\n" + sentence(rnd, 30), "<|endoftext|> tail"]


def rows(extra_null_id=True):
    out = [(i, t, "en" if i % 3 else "de", "s", len(t or ""), 7, 0.5, "odd", "clash") for i, t in enumerate(texts())]
    out.append(out[0])                        # a repeated row
    out.append((1, "other text of a repeated id", None, None, None, None, None, None, None))
    if extra_null_id:
        out.append((None, "a row without an id", "en", None, 1, 1, 1.0, None, None))
    return out


def frame(spark, extra_null_id=True):
    return spark.createDataFrame(rows(extra_null_id), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
