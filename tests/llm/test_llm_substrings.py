"""Removal of strings that start earlier, against every string in a dictionary; the transform against sorted suffixes."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from llm_rows import SCHEMA, empty, frame

from querywarden.llm import collection_bwt, substrings


def by_hand(rows, length):
    """(id, text) rows: each document's result; repeated ids in the order given."""
    seen, out = set(), []
    for id_, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            part = data[k:k + length]
            if part in seen:
                gone[k:k + length] = b"\1" * length
            seen.add(part)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((id_, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def frame_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, 3.0, "x", "y") for i, t in rows], SCHEMA).repartition(4)


def shared_by_hand(strings, least):
    places = defaultdict(set)
    for k, s in enumerate(strings):
        for i in range(len(s) - least + 1):
            places[s[i:i + least]].add((k, len(s) - i))
    return {frozenset(v) for v in places.values() if len(v) > 1}


@pytest.mark.parametrize("block", [3, 64, 1 << 18])
def test_shared_suffixes_of_random_strings(monkeypatch, block):
    monkeypatch.setattr(collection_bwt, "BLOCK", block)
    rnd = random.Random(block)
    for trial in range(25):
        least, alphabet = rnd.choice([2, 3, 5, 9]), b"ab" if trial % 2 else b"abcde\0\xf4"
        strings = [bytes(rnd.choice(alphabet) for _ in range(rnd.randrange(14))) for _ in range(rnd.randrange(1, 30))]
        text = np.frombuffer(b"".join(strings) + b"\0", np.uint8)
        owner, left, joined = collection_bwt.shared_suffixes(text, np.cumsum([len(s) for s in strings]), least)
        groups = np.split(np.stack([owner, left], 1), np.flatnonzero(~joined)[1:]) if len(owner) else []
        assert {frozenset(map(tuple, g.tolist())) for g in groups} == shared_by_hand(strings, least)
        order = [strings[o][len(strings[o]) - n:] for o, n in zip(owner, left)]
        assert order == sorted(order)


def corpus(seed, n=60):
    """Copies, near copies, shared passages in ever different surroundings, runs of one letter, text beyond ASCII."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé中") for _ in range(rnd.randrange(1, 6)))
    passage = " ".join(word() for _ in range(40))
    texts = []
    for i in range(n):
        t = " ".join(word() for _ in range(rnd.randrange(0, 120)))
        kind = i % 6
        if kind == 1 and texts:
            t = rnd.choice(texts)
        elif kind == 2 and texts:
            old = rnd.choice(texts)
            at = rnd.randrange(len(old) + 1)
            t = old[:at] + word() + old[at + 3:]
        elif kind == 3:
            t = t + passage[rnd.randrange(30):] + t[::-1]
        elif kind == 4:
            t = "x" * rnd.randrange(300) + t
        texts.append(t)
    return list(enumerate(texts))


@pytest.mark.parametrize("hot, strings, chunk", [(4096, 16384, 1 << 20), (1, 16384, 1 << 20), (2, 3, 150)])
def test_removed_bytes_by_hand(spark, monkeypatch, hot, strings, chunk):
    """Also with every shared anchor cut again, with collections of a few strings and with texts read in chunks."""
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "STRINGS", strings)
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    rows = corpus(hot)
    got = substrings.digest(substrings.remove_repeats(frame_of(spark, rows)))
    assert sorted(map(tuple, got.collect())) == sorted(by_hand(rows, 100))


def test_other_lengths(spark):
    rows = corpus(9, 40)
    for length in (40, 70):
        got = substrings.digest(substrings.remove_repeats(frame_of(spark, rows), length))
        assert sorted(map(tuple, got.collect())) == sorted(by_hand(rows, length))


def test_odd_rows(spark):
    """A null id comes before all; rows that repeat id and text are one document; repeated ids go by text hash."""
    odd = frame(spark)
    got = substrings.digest(substrings.remove_repeats(odd)).collect()
    assert len(got) == odd.count()
    rows = [r for r in odd.select("doc_id", "text").collect()]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes) for r in got) == \
        sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode())) for r in rows)
    first = [r for r in got if r.doc_id == 0]
    assert len(first) == 2 and first[0] == first[1] and first[0].n_removed == 0  # the repeated row: both keep their text
    copies = {r.doc_id: r for r in got if r.doc_id in (2, 11)}
    assert copies[2].n_spans == 1 and copies[2].n_bytes - copies[2].n_removed == len(" end")
    assert copies[11].n_spans == 1 and copies[11].n_removed > 300
    assert substrings.digest(substrings.remove_repeats(empty(spark))).collect() == []


def test_one_very_long_text(spark):
    rnd = random.Random(2)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(1_000_000))
    rows = [(0, base), (1, base[500_000:] + "y" * 300_000 + base[:500_000])]
    got = {r.doc_id: r for r in substrings.digest(substrings.remove_repeats(frame_of(spark, rows))).collect()}
    assert got[0].n_removed == 0 and got[1].n_bytes == 1_300_000
    assert got[1].n_bytes - got[1].n_removed == 1 and got[1].n_spans == 2  # the first y starts no string seen before
