"""SimHash groups, connected components, repeated passages and the pipeline."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm_rows import empty, frame, rows, sentence, texts

from querywarden.llm import common, components, repeats, simhash


def fingerprint_by_hand(text, size=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_by_hand(fps, radius=4):
    label = list(range(len(fps)))
    while True:
        new = [min(label[j] for j in range(len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= radius) for i in range(len(fps))]
        if new == label:
            return label
        label = new


def test_near_duplicates(spark):
    data = rows()
    got = simhash.near_duplicates(frame(spark)).collect()
    fps = [fingerprint_by_hand(r[1]) for r in data]
    label = groups_by_hand(fps)
    least = {g: min((data[i][0] for i in range(len(data)) if label[i] == g and data[i][0] is not None), default=None) for g in set(label)}
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    want = sorted(((r[0], f"{f:016x}", least[g]) for r, f, g in zip(data, fps, label)), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("piece", [8, 64, 4096])
def test_links_span_all_close_pairs(spark, piece):
    rnd = random.Random(2)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):  # clusters, so buckets are full and pieces are many
        c = rnd.getrandbits(64)
        for _ in range(14):
            fps.add(c)
            c ^= 1 << rnd.randrange(64)
            if rnd.random() < 0.3:
                c ^= 1 << rnd.randrange(64)
    fps = sorted(fps)
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    got = simhash.near_links(spark.createDataFrame(signed, "fp long").repartition(4), 4, piece)
    cc = {r["node"]: r["root"] for r in components.connected_components(got).collect()}
    label = groups_by_hand(fps)
    by = {}
    for (f,), g in zip(signed, label):
        by.setdefault(g, set()).add(cc.get(f, f))
    assert all(len(v) == 1 for v in by.values()) and len(set().union(*by.values())) == len(by)


def test_components_of_a_long_path(spark):
    n = 200
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = list(zip(order, order[1:])) + [(1000, 1001), (1001, 1000), (7, 7), (None, 3)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {**{i: 0 for i in range(1, n)}, 1001: 1000}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fenwick_chain_equals_quadratic_search():
    rnd = random.Random(4)
    for _ in range(60):
        seg = np.array(sorted((rnd.randrange(200), rnd.randrange(200), rnd.randrange(8, 20)) for _ in range(rnd.randrange(1, 14))))
        best = []
        for i, (s, o, n) in enumerate(seg.tolist()):
            gain = max([best[j] - repeats.GAP_COST * (s - x - m + o - y - m) for j, (x, y, m) in enumerate(seg[:i].tolist())
                        if x + m <= s and y + m <= o], default=0)
            best.append(n + max(gain, 0))
        top = repeats.chains(seg)[0]
        score = 0.0
        for a, i in enumerate(top):
            s, o, n = seg[i]
            if a:
                x, y, m = seg[top[a - 1]]
                score -= repeats.GAP_COST * (s - x - m + o - y - m)
            score += n
        assert score == pytest.approx(max(best))


def test_repeats(spark):
    rnd = random.Random(6)
    p, q = sentence(rnd, 60), sentence(rnd, 70)
    fuzzy = p.split()
    fuzzy[30] = "changed"
    fuzzy.insert(45, "inserted")
    t = {1: sentence(rnd, 40) + "\n" + p + "\n" + sentence(rnd, 20), 2: q, 3: sentence(rnd, 100),
         4: "Intro words. " + p + " outro.", 5: sentence(rnd, 10) + " " + " ".join(fuzzy), 6: q + " " + q,
         7: " ".join(p.split()[:49]) + " x", 8: None, 9: "", 10: p}
    df = spark.createDataFrame([(i, x, "s") for i, x in t.items()] + [(None, p, "s"), (4, t[4], "s")],
                               "doc_id long, text string, start string").repartition(4)
    got = {(r["doc_id"], r["start"], r["words"], r["source_id"], r["source_start"]) for r in repeats.find_repeats(df).collect()}
    assert (4, 2, 60, 1, 40) in got and (10, 0, 60, 1, 40) in got
    assert (6, 0, 70, 2, 0) in got and (6, 70, 70, 2, 0) in got
    five = [x for x in got if x[0] == 5]
    assert five and all(x[3] == 1 for x in five) and sum(x[2] for x in five) >= 58
    assert {x[0] for x in got} == {4, 5, 6, 10}
    clean = repeats.remove_repeats(df)
    assert clean.columns == df.columns and clean.count() == 12
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert left[4] == "Intro words. outro." and left[10] == "" and left[6] == "" and left[8] is None and left[None] == p
    assert all(left[i] == t[i] for i in (1, 2, 3, 7, 9))


def test_repeats_edges(spark):
    got = repeats.find_repeats(frame(spark)).collect()
    t = texts()
    assert {r["doc_id"] for r in got} == {1, 2, 11}
    assert repeats.remove_repeats(frame(spark)).count() == len(rows())
    assert {r["text"] for r in repeats.remove_repeats(frame(spark)).where("doc_id = 11").collect()} == {
        t[11].split("\n")[0] + "\n" + t[11].split("\n")[2]}
    assert repeats.find_repeats(empty(spark)).count() == 0 and repeats.remove_repeats(empty(spark)).count() == 0


def test_repeats_of_long_words(spark):
    rnd = random.Random(7)
    address = lambda: "https://example.org/" + "".join(rnd.choice("abcdefgh") for _ in range(90))
    p = [address() for _ in range(50)]
    t = {1: [address() for _ in range(300)] + p + [address() for _ in range(300)], 2: ["one", "two"] + p + ["three"]}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in t.items()], "doc_id long, text string")
    assert [tuple(r) for r in repeats.find_repeats(df).collect()] == [(2, 2, 50, 1, 300, 50, 50)]


def test_repeats_put_together_from_known_pieces(spark):
    # every seed of a 60-word passage of 50 and 60 was seen before, in pieces of 30 words from 1 and 2 or more documents
    rnd = random.Random(8)
    p, new = sentence(rnd, 60).split(), lambda: sentence(rnd, 60).split()
    t = {i: new() + p[(i - 1) * 10:(i - 1) * 10 + 30] + new() for i in range(1, 5)}
    t |= {50: new() + p + new(), 60: new() + p + new(), 70: ["a"] + p[:52]}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in t.items()], "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["start"], r["words"], r["source_id"], r["source_start"]) for r in repeats.find_repeats(df).collect()}
    assert got == {(60, 60, 60, 50, 60), (70, 1, 52, 50, 60)}


def test_repeats_of_short_chains(spark):
    # the opening of a passage of 2 and 3 was seen in 1; one word is changed: no chain is long, one shared seed has to do
    rnd, t, want = random.Random(9), {}, set()
    for i in range(0, 120, 3):
        p, new = sentence(rnd, 56).split(), lambda: sentence(rnd, 60).split()
        changed = p[:38] + ["changed"] + p[39:]
        t |= {i: new() + p[:20], i + 1: new() + p + new(), i + 2: new() + changed + new()}
        seeds = [set(repeats.seeds_of([w.encode() for w in t[i + k]])[0].tolist()) for k in range(3)]
        if (seeds[1] & seeds[2]) - seeds[0]:
            want.add((i + 2, i + 1))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in t.items()], "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["source_id"]) for r in repeats.find_repeats(df).collect() if r["start"] <= 60 and r["start"] + r["words"] >= 116}
    assert len(want) > 10 and want - got == set()


@pytest.mark.parametrize("similarity, least", [(0.8, 0.9), (0.85, 0.95), (0.9, 0.98)])
def test_recall_of_changed_passages(similarity, least):
    # 60 words, some of them changed, against an alignment from every pair of equal words
    rnd, there, found = random.Random(10), 0, 0
    for _ in range(200):
        word = lambda: b"%d" % rnd.randrange(10**6)
        p = [word() for _ in range(60)]
        q = list(p)
        for i in rnd.sample(range(3, 57), round(60 * (1 - similarity))):
            q[i] = word()
        a, b = ([*(word() for _ in range(60)), *x, *(word() for _ in range(60))] for x in (p, q))
        number = {}
        x, y = (np.array([number.setdefault(w, len(number)) for w in t]) for t in (a, b))
        if not any(repeats.passages(*repeats.align(x, y, [(s, s, 1)]), 50, 0.8) for s in np.flatnonzero(x == y).tolist()):
            continue
        there += 1
        (ha, pa), (hb, pb) = repeats.seeds_of(a), repeats.seeds_of(b)
        at = dict(zip(hb.tolist(), pb.tolist()))
        hits = [(s, at[h]) for h, s in zip(ha.tolist(), pa.tolist()) if h in at]
        if hits:
            seg = repeats.segments(*(np.array(c) for c in zip(*hits)))
            cs = [{"chain": [dict(zip("son", r)) for r in seg[c].tolist()], "rep": 1, "lo": 0, "there": b" ".join(b)} for c in repeats.chains(seg)]
            found += bool(repeats._aligned(b" ".join(a).decode(), cs, 50, 0.8))
    assert there > 20 and found >= least * there


def test_open_windows():
    pos = np.arange(100, 190, 4)
    one, none = np.ones(len(pos), int), repeats.open_windows(np.arange(0, 20, 2), np.ones(10, int), np.zeros(10, int), 50)
    assert none == []
    ends = repeats.open_windows(pos, one, one, 50)
    inside = (100, int(pos[-1]) + repeats.K - 50)  # the first and the last window of one exact match
    assert all(s + n <= inside[0] or s > inside[1] for s, n in ends)
    two = repeats.open_windows(pos, np.where(pos < 140, 1, 2), one, 50)
    assert {i for s, n in two for i in range(s, s + n)} >= set(range(100, 140))


def test_all_exact_repeats_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first, cover, found = {}, {}, {}
    for r in sorted(docs.select("doc_id", "text").collect()):
        w = (r["text"] or "").encode().lower().split()
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i:i + 50]), r["doc_id"]) < r["doc_id"]:
                cover.setdefault(r["doc_id"], set()).update(range(i, i + 50))
    for r in repeats.find_repeats(docs).collect():
        found.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["words"]))
    assert all(c <= found.get(d, set()) for d, c in cover.items())


def test_pipeline(spark):
    import corpus_pipeline as cp

    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = frame(spark).select(*cp.COLUMNS)
    sizes = []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        if name != "byte_bpe":
            assert docs.columns == cp.COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and bench.count()
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    none = empty(spark).select(*cp.COLUMNS)
    for _, stage in cp.STAGES:
        none = stage(spark, none, "/root/testdata/sf0.001")
    assert none.count() == 0


def test_chains_reach_workers_row_by_row(spark):
    """No row of the JVM holds all chains of a document; batches may end anywhere."""
    kind = pa.struct([("rep", pa.int64()), ("there", pa.binary())])
    rows_ = [(None, "n", None), (-(1 << 63), None, (0, b"a" * 30)), (-(1 << 63), "low", None)]
    for d in range(1, 6):
        rows_ += [(d, None, (r, b"b" * (r + 1))) for r in range(d - 1)]
        rows_ += [(d, f"t{d}-{i}", None) for i in range(1 + d % 2)]        # rows may repeat an id
    want = [(t, [c[0] for x, _, c in rows_ if c and x == d]) for d, t, _ in rows_ if t]
    for many in (1, 2, 3, 7, 100):
        for size in (1, 6, 1000):
            batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.string()), pa.array(
                [c and {"rep": c[0], "there": c[1]} for _, _, c in part], kind)], names=["_key", "_text", "_chain"])
                for part in (rows_[i:i + many] for i in range(0, len(rows_), many))]
            got = []
            for batch, which, lists in repeats._texts_with_chains(batches, size):
                chains = dict(zip(which.tolist(), lists.to_pylist()))
                assert len(chains) < 2 or sum(len(c["there"]) for x in chains.values() for c in x) <= size
                got += [(t, [c["rep"] for c in chains.get(i, [])]) for i, t in enumerate(batch.column("_text").to_pylist())]
            assert got == want
    p, q = sentence(random.Random(3), 60), sentence(random.Random(4), 55)
    docs = spark.createDataFrame([(1, p), (2, q), (3, f"x {p} y {q} z {p}"), (3, f"x {p} y {q} z {p} w"), (3, None), (None, p), (None, None), (4, q)], "doc_id long, text string")
    left = [(1, p), (2, q), (3, "x y z "), (3, "x y z w"), (3, None), (None, p), (None, None), (4, "")]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    try:
        for many in ("1", "2", old):
            spark.conf.set(name, many)
            clean = repeats.remove_repeats(docs)
            assert sorted(map(str, map(tuple, clean.collect()))) == sorted(map(str, left))
            plan = clean._jdf.queryExecution().executedPlan().toString()
            assert "ObjectHashAggregate" not in plan and plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") <= 2
    finally:
        spark.conf.set(name, old)


def test_workers_get_small_batches(spark):
    name, texts_ = "spark.sql.execution.arrow.maxBytesPerBatch", [sentence(random.Random(i), 3000) for i in range(400)]
    old = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string").coalesce(1)
        clean = repeats.remove_repeats(docs)
        assert int(spark.conf.get(name)) == common.BATCH_BYTES
        batches = docs.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in bs), "n long").collect()
        assert len(batches) > 1 and max(r["n"] for r in batches) < 2 * common.BATCH_BYTES
        assert {r["doc_id"]: r["text"] for r in clean.collect()} == dict(enumerate(texts_))
        spark.conf.set(name, "1m")
        common.small_batches(spark)
        assert spark.conf.get(name) == "1m"                               # a smaller setting stays
    finally:
        spark.conf.set(name, old)


def test_alignments_at_once_equal_one_by_one():
    rng = np.random.default_rng(5)
    vocab = np.array([f"w{i}" + "y" * int(i % 23) for i in range(400)])

    def one_by_one(text, cs):
        a, found, inside = np.array([hash(w) for w in repeats.words_of(text)]), [], set()
        for c in sorted(cs, key=lambda c: (c["chain"][0]["s"] - c["chain"][-1]["s"] - c["chain"][-1]["n"], c["rep"], c["chain"][0]["s"])):
            path = [(x["s"], x["o"] - c["lo"] * repeats.MARK, x["n"]) for x in c["chain"]]
            s, e = path[0][0], path[-1][0] + path[-1][2]
            if e <= len(a) and set(range(max(0, s - repeats.WINDOW + 1), min(len(a), e + repeats.WINDOW - 1))) <= inside:
                continue
            b = np.array([hash(w) for w in c["there"].lower().split()])
            for s, n, o, m, eq in repeats.passages(*repeats.align(a, b, path), 50, 0.8) + repeats.along_diagonals(a, b, path, 50, 0.8):
                found.append((s, n, c["rep"], o + c["lo"] * repeats.MARK, m, eq))
                inside |= set(range(s, s + n))
        return repeats._outermost(found)

    texts, chains_ = [], []
    for k in range(40):
        b = rng.choice(vocab, 300)
        a = np.concatenate([rng.choice(vocab, rng.integers(0, 60)), b[100:100 + rng.integers(20, 150)], rng.choice(vocab, 30)])
        change = rng.random(len(a)) < [0, 0, 0.03, 0.1][k % 4]
        a[change] = rng.choice(vocab, change.sum())
        a = np.delete(a, rng.integers(0, len(a), k % 3))
        (ha, pa), (hb, pb) = (repeats.seeds_of([w.encode() for w in t]) for t in (a, b))
        hits = np.array([(p, q) for h, p in zip(ha, pa) for q in pb[hb == h]], np.int64).reshape(-1, 2)
        seg = repeats.segments(*hits.T)
        chains_.append([{"rep": i, "lo": 0, "there": " ".join(b).upper().encode(), "chain": [dict(zip("son", r)) for r in seg[c].tolist()]}
                        for c in repeats.chains(seg) for i in (1, 2)] if len(seg) else [])
        texts.append(" ".join(a))
    got = repeats._aligned_texts(texts, repeats.Chains.from_rows(chains_), 50, 0.8)
    assert got == [one_by_one(t, cs) for t, cs in zip(texts, chains_)] and sum(map(bool, got)) > 10


@pytest.mark.parametrize("part", [3, 100, 1 << 18])
def test_word_numbers(monkeypatch, part):
    monkeypatch.setattr(repeats, "PART_BYTES", part)
    texts = ["", " one  Two\tone\x00 one ", "é ONE twotwotwotwotwotwo twotwotwotwotwotwO", "x" * 2000 + " " + "x" * 2001, "two"]
    numbers, many = repeats.word_numbers([t.encode() for t in texts])
    words = [w for t in texts for w in repeats.words_of(t)]
    assert many.tolist() == [len(repeats.words_of(t)) for t in texts]
    assert {(x == y) == (v == w) for x, v in zip(words, numbers.tolist()) for y, w in zip(words, numbers.tolist())} == {True}


def test_texts_are_dealt_out_once_for_both_joins(spark):
    rng = np.random.default_rng(9)
    t = [" ".join(rng.choice([f"v{i}" for i in range(5000)], 400)) for _ in range(6)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(t + [t[0], " ".join(t[1].split()[50:200])])], "doc_id long, text string")
    now = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = repeats.find_repeats(docs)
        assert {(r["doc_id"], r["start"], r["words"], r["source_id"]) for r in df.collect()} == {(6, 0, 400, 0), (7, 0, 150, 1)}
        assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", now)
