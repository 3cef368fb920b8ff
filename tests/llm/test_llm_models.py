"""Language ID and language-model scoring."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import empty, frame, rows
from pyspark.sql import functions as F

from querywarden.llm import gru, language, lm
from querywarden.llm.common import id_hash_mod

SF = "/root/testdata/sf0.001"


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    m = language.Ftrl(50, 2, l1=0.5)
    for _ in range(400):
        y = int(rng.integers(2))
        f = np.array([y, 2 + int(rng.integers(40)), 50])
        m.learn(f, np.ones(3), y)
    w = m.weights()
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]
    assert (w[2:50] == 0).mean() > 0.8


def test_temperature_finds_the_likeliest():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3)) * 2
    y = np.array([rng.choice(3, p=language.softmax(r)) for r in logits])
    assert abs(language.temperature(logits * 3, y) - 3) < 0.4


def test_grams_do_not_cross_texts():
    letters = language.fold_table()
    alone = [language.Grams([t], letters) for t in ("Ab c", "", "!!", "xyz")]
    both = language.Grams(["Ab c", "", "!!", "xyz"], letters)
    table = np.random.default_rng(0).normal(size=(language.DIMS, 2))
    assert np.allclose(both.sums(table), np.concatenate([a.sums(table) for a in alone]))
    assert both.has_letter.tolist() == [True, False, False, True]
    assert np.array_equal(both.present(), sum(a.present().astype(int) for a in alone))


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang") \
        .withColumn("held_out", id_hash_mod("doc_id", 4) == 2)
    model = language.train(docs.where("not held_out"))
    got = language.predict(docs, model).where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got)


def test_language_edges(spark):
    model = language.train(frame(spark))
    got = language.predict(frame(spark), model).collect()
    assert len(got) == len(rows())
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in ("en", "de")) == letters and (letters or (r["lang_pred"], r["score"]) == ("und", 0.0))
    nothing = language.train(empty(spark))
    assert nothing == {"labels": []}
    assert {r["lang_pred"] for r in language.predict(frame(spark), nothing).collect()} == {"und"}
    assert language.predict(empty(spark), model).count() == 0


def small_model():
    rng = np.random.default_rng(0)
    prior = np.where(np.arange(2 * gru.WORDS).reshape(2, gru.WORDS) < 50, 1 / 50, 0)
    p = {k: v.astype(np.float64) for k, v in gru.new_params(60, np.ones(4) / 4, prior).items()}
    for k in p:
        if k != "bw":
            p[k] = p[k] + rng.normal(0, 0.3, p[k].shape)
    return p, rng


def test_gradients():
    p, rng = small_model()
    xs = [rng.integers(0, 60, 3) for _ in range(5)]
    cls = rng.integers(0, 4, 15)
    word = np.where(cls < 2, rng.integers(0, 18, 15), -1)
    keep = [np.ones(3) for _ in range(5)]
    keep[2][1] = 0
    h = rng.normal(0, 0.5, (3, gru.H))
    _, g, _ = gru.gradients(p, xs, cls, word, keep, h)
    for k in p:
        for _ in range(3):
            i = tuple(int(rng.integers(0, s)) for s in p[k].shape)
            if k == "x":
                i = (int(xs[1][0]), i[1])
            old, e = p[k][i], 1e-5
            if k == "bw" and old < -1e8:
                continue
            p[k][i] = old + e
            up = gru.gradients(p, xs, cls, word, keep, h)[0]
            p[k][i] = old - e
            down = gru.gradients(p, xs, cls, word, keep, h)[0]
            p[k][i] = old
            assert (up - down) / (2 * e) == pytest.approx(g[k][i], rel=1e-3, abs=1e-7)


def test_state_is_carried_and_batching_changes_nothing():
    p, rng = small_model()
    lengths = [1, 300, 7, 0, 129, 64, 2]
    n = sum(lengths)
    inputs, cls = rng.integers(0, 60, n), rng.integers(0, 4, n)
    word = np.where(cls < 2, rng.integers(0, 18, n), -1)
    all_ = gru.score(p, inputs, cls, word, lengths, n_lanes=3, window=16)
    at = 0
    for m in lengths:
        one = gru.score(p, inputs[at:at + m], cls[at:at + m], word[at:at + m], [m], n_lanes=1, window=1000) if m else np.zeros(0)
        assert np.allclose(all_[at:at + m], one, atol=1e-5)
        at += m


def test_output_is_a_distribution():
    p, rng = small_model()
    h = np.repeat(rng.normal(size=(1, gru.H)), 52, axis=0)
    cls = np.array([0] * 32 + [1] * 18 + [2, 3])
    word = np.array(list(range(32)) + list(range(18)) + [-1, -1])
    assert np.exp(gru.output(p, h, cls, word)[0]).sum() == pytest.approx(1)


def words(t):
    return (t or "").encode().lower().split() + [None]


@pytest.mark.parametrize("head", [0, 5, 200_000])
def test_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (head,))
    data = [r for r in rows() if r[0] not in (1,)] + [(100 + i, random.Random(i).choice(["the end", "of the", "zz é. yy"]) * i, *[None] * 7)
                                                      for i in range(12)]
    df = spark.createDataFrame(data, frame(spark).schema).repartition(3)
    got = lm.score_documents(df, id_hash_mod("doc_id", 7) == 2).collect()
    assert len(got) == len(data)
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    c = Counter(w for r in data if not out(r[0]) for w in words(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if r[0] is None else r[0], out(r[0]), len(words(r[1])), sum(c[w] > 0 for w in words(r[1])), n,
                   sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(r[1]))) for r in data)
    have = sorted((-1 if r["doc_id"] is None else r["doc_id"], *(r[k] for k in ("held_out", "n_tokens", "n_known", "train_tokens", "base_score"))) for r in got)
    for a, b in zip(have, want):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_scores_of_nothing(spark):
    assert lm.score_documents(empty(spark), F.lit(False)).count() == 0
    got = lm.score_documents(frame(spark), F.lit(True)).collect()  # nothing to learn from
    assert len(got) == len(rows()) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in got)


def test_model_beats_unigrams_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = lm.score_documents(docs, id_hash_mod("doc_id", 7) == 2).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_no_label_is_left_out(spark, monkeypatch):
    df = spark.createDataFrame([(i, "some text", x) for i, x in enumerate("abc")], "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "MAX_LABELS", 3)
    assert language.train(df)["labels"] == ["a", "b", "c"]
    monkeypatch.setattr(language, "MAX_LABELS", 2)
    with pytest.raises(ValueError, match="more than 2 labels"):
        language.train(df)


def test_every_token_of_a_part_is_learnt_from_once(monkeypatch):
    rng = np.random.default_rng(2)
    prior = np.where(np.arange(2 * gru.WORDS).reshape(2, gru.WORDS) < 50, 1 / 50, 0)
    lengths = [5, 40, 0, 1, 17, 90, 3]
    n = sum(lengths)
    numbers = rng.integers(0, 50, n)
    counted, plain = [], gru.output
    monkeypatch.setattr(gru, "output", lambda p, h, cls, word, g=None: (counted.append(len(cls)), plain(p, h, cls, word, g))[1])
    trainer = gru.Trainer(gru.new_params(60, np.ones(4) / 4, prior), n_lanes=3, window=8)
    trainer.part(numbers, numbers // gru.WORDS, numbers % gru.WORDS, lengths)
    assert sum(counted) == n


def test_weights_depend_on_every_training_row(spark):
    texts = [f"a b{i} c d e{i % 3} " * (3 + i) for i in range(5)]
    share = lambda rows: spark.createDataFrame(rows, "t string, h long").repartition(2)
    rows = [(t, 3 * i) for i, t in enumerate(texts)]          # two in the first two rounds, the others later
    vocab = lm.vocabulary(lm.count_tokens(share(rows)), len(rows))
    whole = lm.flat(lm.fit(share(rows), vocab))
    for i in range(len(rows)):
        other = [(("d c " * 9, h) if k == i else (t, h)) for k, (t, h) in enumerate(rows)]
        assert np.abs(lm.flat(lm.fit(share(other), vocab)) - whole).max() > 1e-6
    assert np.allclose(lm.flat(lm.shaped(whole, lm.fit(share(rows), vocab))), whole, atol=1e-5)


def test_weights_are_averaged_by_tokens(spark):
    """Rows in two partitions: the mean of what each comes to alone, by its tokens."""
    rows = [("a b a c " * 20, 15), ("c c b " * 5, 15)]
    parts = lambda r: spark.createDataFrame(spark.sparkContext.parallelize(r, len(r)), "t string, h long")
    vocab = lm.vocabulary(lm.count_tokens(parts(rows)), 2)
    first, second = (lm.flat(lm.fit(parts([r]), vocab)) for r in rows)
    both = lm.flat(lm.fit(parts(rows), vocab))
    n = [len(t.split()) + 1 for t, _ in rows]
    assert np.allclose(both, (first * n[0] + second * n[1]) / sum(n), atol=1e-5)


def test_words_and_numbers_of_texts():
    rnd = random.Random(3)
    texts = ["", " ", "  A", "a  ", *("".join(rnd.choices(" \t\n\v\f\r\x1c\x85\xa0 aZÉéİß.\x00\U0001F600", k=rnd.randint(0, 12))) for _ in range(2000))]
    split = [t.encode().lower().split() for t in texts]
    words_, lengths = lm.words_of(pa.array(texts))
    assert lengths.tolist() == [len(x) for x in split] and [w.encode() for w in words_.to_pylist()] == [w for x in split for w in x]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    parts = list(lm.slices(batch, 0, 500))
    assert len(parts) > 10 and sum((p.column(0).to_pylist() for p in parts), []) == texts
    head = [("a", 9), ("aa", 5), ("é", 4)]
    v = lm.Vocabulary.of(lm.Vocabulary(head, len(texts), [("zz", 3, 2)], (4, 4), 100, 10).state())
    numbers, lengths, known, n_rare, beyond = v.encode(pa.array(texts))
    want, rare = [], []
    for x in split:
        rare.append([w for w in x if w.decode() not in dict(head)])
        for w in x:
            i = [h for h, _ in head].index(w.decode()) if w.decode() in dict(head) else -1
            want.append((i, v.input_of[i] if i >= 0 else v.n_direct + v.tail_class(w)))
        want.append((-1, v.end))
    assert list(zip(known.tolist(), numbers.tolist())) == want
    assert n_rare.tolist() == [len(x) for x in rare] and [w.encode() for w in beyond.to_pylist()] == [w for x in rare for w in x]
    assert lengths.tolist() == [len(x) + 1 for x in split]


def test_long_documents_do_not_run_alone(monkeypatch):
    lengths = ([800] + [4] * 400) * 8
    numbers = np.arange(sum(lengths))
    documents = lambda: iter(np.split(numbers, np.cumsum(lengths)[:-1]))
    parts = list(lm.parts_of(documents(), 2000, 256))
    assert len(parts) == 1                        # eight before, each with one lane of 800 steps beside short ones
    assert np.array_equal(np.concatenate(parts[0]), numbers)
    monkeypatch.setattr(lm, "MOST_TOKENS", 5000)
    bounded = list(lm.parts_of(documents(), 2000, 256))
    assert len(bounded) == 4 and np.array_equal(np.concatenate(sum(bounded, [])), numbers)
    assert [len(p) for p in lm.parts_of(documents(), 2000, 1)][0] == 302  # one lane is as long as the part


def test_small_rounds_are_gathered(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lm, "one_round", lambda texts, sent, params, n: (seen.append(texts.rdd.getNumPartitions()), params)[1])
    vocab = lm.vocabulary(lm.count_tokens(spark.createDataFrame([("a b",)], "t string")), 1)
    for tasks, want in ((32, [8, 12, 16, 32]), (4, [4, 4, 4, 4])):
        seen.clear()
        lm.fit(spark.createDataFrame([("a", i) for i in range(64)], "t string, h long").repartition(tasks), vocab)
        assert seen == want
