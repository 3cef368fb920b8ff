"""Token files, byte-level BPE and sharding."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from llm_rows import empty, frame, rows
from tokenizers import Tokenizer

from querywarden.llm import bpe, pretokens, sharding, token_files

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(RANKS))


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_hash_is_minimal_and_perfect(codec):
    slots = codec.mph(codec.low, codec.high, codec.length)
    assert sorted(slots.tolist()) == list(range(len(slots)))


def test_hash_rejects_other_keys(codec):
    low, high, length = bpe.words_of([b"zzqzzq", b"\0", b"\0\0\0", b"the", b" the"])
    ids = codec.known(low, high, length)
    assert [i >= 0 for i in ids.tolist()] == [w in codec.ranks for w in (b"zzqzzq", b"\0", b"\0\0\0", b"the", b" the")]


def test_encoding_equals_library(codec, reference):
    rnd = random.Random(3)
    parts = ["'s", "'ll", "'RE", "'", "''", " ", "  ", "\n", "\t ", " ", "　", "é", "ß", "中", "١", "½", "-", "😀", "the", " there", "x" * 40]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(3000)]
    ids, at = codec.cache().encode(texts)
    raw, ends = codec.decode(ids)
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == reference.encode_ordinary(t), t
    assert raw.tobytes() == "".join(texts).encode()


def test_cache_bound_changes_nothing(codec, reference):
    small = pretokens.PretokenCache(lambda ws: [bpe.merge(w, codec.ranks) for w in ws], codec.known, max_entries=2)
    for t in ["one twoo threee", "fourrr fivve", "one twoo threee"]:
        assert small.encode([t])[0].tolist() == reference.encode_ordinary(t)


def test_encode_column(spark, reference):
    got = bpe.encode_column(frame(spark), RANKS, with_ids=True, batch_chars=100)
    assert got.columns[-4:] == ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert "odd.name" in got.columns and "_text" in got.columns
    out = got.collect()
    assert len(out) == len(rows())
    for r in out:
        t = r["text"] or ""
        ids = reference.encode_ordinary(t)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode_column(empty(spark), RANKS).count() == 0


def test_token_files(spark, tmp_path):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    folder = str(tmp_path / "tokens")
    token_files.write_tokens(frame(spark), folder, P.path("byte_bpe_50k.json"), n_files=3, frame_tokens=50)
    got = sorted(token_files.read_documents(spark, folder, ids=True).collect(), key=lambda r: r["start"])
    want = sorted(((r[0] if r[0] is not None else -1), tok.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows())
    assert [(r["doc_id"] if r["doc_id"] is not None else -1) for r in got] == [k for k, _ in want]
    assert sorted(r["ids"] for r in got) == sorted(ids for _, ids in want)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    some = token_files.read_documents(spark, folder, spark.createDataFrame([(2,), (10,), (99,)], "doc_id long"), ids=True).collect()
    assert sorted(r["doc_id"] for r in some) == [2, 10]
    assert {r["doc_id"]: r["ids"] for r in some} == {r["doc_id"]: r["ids"] for r in got if r["doc_id"] in (2, 10)}
    empty_folder = str(tmp_path / "none")
    token_files.write_tokens(empty(spark), empty_folder, P.path("byte_bpe_50k.json"))
    assert token_files.read_documents(spark, empty_folder).count() == 0


def test_file_is_plain_zstandard_and_damage_shows(tmp_path):
    import pyarrow.fs as fs
    import zstandard

    path = tmp_path / "f.zst"
    docs = [(5, np.arange(7, dtype=np.uint32)), (None, np.arange(100, dtype=np.uint32)), (9, np.zeros(0, np.uint32))]
    with open(path, "wb") as f:
        w = token_files.Writer(f, 8, 3)
        for k, ids in docs:
            w.add(k, ids)
        w.close()
    whole = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert whole == np.concatenate([x for _, x in docs]).astype("<u4").tobytes()
    data = bytearray(path.read_bytes())
    r = token_files.Reader(fs.LocalFileSystem().open_input_file(str(path)))
    assert [x.tolist() for _, x in r.documents(np.array([2, 0]))] == [docs[0][1].tolist(), []]
    data[int(r.start[1]) - 6] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception):
        token_files.Reader(fs.LocalFileSystem().open_input_file(str(path))).frame(0)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    r = spark.range(n).select("id", sharding.permute(F.col("id"), n).alias("p")) \
        .withColumn("back", sharding.unpermute(F.col("p"), n)).collect()
    assert sorted(x["p"] for x in r) == list(range(n))
    assert all(x["back"] == x["id"] and sharding.permute_py(x["id"], n) == x["p"] for x in r)


def test_shards(spark):
    got = sharding.assign_shards(frame(spark), 4).collect()
    assert len(got) == len(rows())
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted(
        (len((x[1] or "").encode()) + 16, zlib.crc32((x[1] or "").encode())) for x in rows())
    by = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    # the place follows from the row number: ascending id, nulls first
    ids = sorted(r["doc_id"] for r in got if r["doc_id"] is not None)
    place = {r["doc_id"]: r["slot"] * 4 + r["shard"] for r in got if ids.count(r["doc_id"]) == 1}
    order = [None] + ids
    assert all(sharding.permute_py(order.index(k), len(got)) == p for k, p in place.items())
    assert sharding.assign_shards(empty(spark), 4).count() == 0
