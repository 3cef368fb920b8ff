"""Log files on disk, physical line numbers, verification of files."""

import json
import os
import tempfile


from pyspark.sql import functions as F

from querywarden.operators import audit as A
from querywarden.sources import audit_log as AL
from querywarden.sources import segment_files as SF
from test_audit import _records


def test_write_read_verify(spark):
    base = tempfile.mkdtemp(prefix="qw-log-")
    lines = A.build_chain(A.entry_parts(_records(spark, 3, 9)), "chain", ["ts", "qid"],
                          max_segment_bytes=900)
    AL.write_audit_log(lines, f"{base}/log", "chain")
    logs = AL.read_audit_log(spark, f"{base}/log")
    got = {(r.chain, r.segment): r for r in A.verify(logs, ["chain", "segment"], "line_no").collect()}
    want = {(r.chain, r.segment) for r in lines.select("chain", "segment").distinct().collect()}
    assert set(got) == want
    assert all(got[k].valid == (k[1] == 0) for k in got)
    # each file holds its lines in chain order
    for (c, seg), r in got.items():
        d = f"{base}/log/chain={c}/segment={seg}"
        files = [f for f in os.listdir(d) if f.startswith("part-")]
        assert len(files) == 1
        text = open(os.path.join(d, files[0])).read().splitlines()
        hashes = [json.loads(x)["entry_hash"] for x in text]
        assert [json.loads(x)["prev_hash"] for x in text][1:] == hashes[:-1]


def test_line_numbers_count_blank_lines(spark):
    base = tempfile.mkdtemp(prefix="qw-log-")
    lines = A.build_chain(A.entry_parts(_records(spark, 1, 6)), "chain", ["ts", "qid"]).orderBy("seq")
    text = [r.line for r in lines.collect()]
    body = "\n".join(["", text[0], "  ", text[1]] + text[2:]) + "\n"
    os.makedirs(f"{base}/f")
    with open(f"{base}/f/a.jsonl", "w") as fh:
        fh.write(body)
    with open(f"{base}/f/b.jsonl", "w") as fh:
        fh.write(body.replace(text[3], text[3].replace('"web_search"', '"edited"')))
    logs = AL.read_audit_log(spark, f"{base}/f")
    res = {os.path.basename(r.file): r for r in A.verify(logs, "file", "line_no").collect()}
    assert res["a.jsonl"].valid and res["a.jsonl"].entries == 6
    # the edited fourth entry is on physical line 6: two blank lines come before it
    assert (res["b.jsonl"].broken_at, res["b.jsonl"].entries) == (6, 3)


def test_policy_reload_per_batch(spark, tmp_path):
    from querywarden.streaming import pipeline as SP

    pol = tmp_path / "p.yaml"
    pol.write_text("search:\n  enabled: true\n")
    writer = SP.decisions_batch_writer(str(tmp_path / "out"), {"t": str(pol)})
    batch = spark.createDataFrame([(1, "hello world", "general", "t")],
                                  "query_id long, raw string, categories string, policy_id string")
    writer(batch, 0)
    pol.write_text("search:\n  enabled: false\n")
    writer(batch, 1)
    out = spark.read.parquet(str(tmp_path / "out" / "decisions"))
    assert {r.batch_id: r.status for r in out.collect()} == {0: 200, 1: 403}


def test_line_numbers_across_split_files(spark):
    base = tempfile.mkdtemp(prefix="qw-split-")
    lines = [f'{{"n": {i}, "pad": "{"x" * (i % 37)}"}}' if i % 11 else "" for i in range(1, 1201)]
    with open(f"{base}/big.jsonl", "w") as fh:
        fh.write("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        assert spark.read.text(base).rdd.getNumPartitions() > 5  # the file is split
        logs = AL.read_audit_log(spark, base)
        got = {r.line_no: r.line for r in logs.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i + 1: ln for i, ln in enumerate(lines)}


def test_verify_log_files_with_missing(spark):
    base = tempfile.mkdtemp(prefix="qw-files-")
    lines = A.build_chain(A.entry_parts(_records(spark, 1, 5)), "chain", ["ts", "qid"]).orderBy("seq")
    text = "\n".join(r.line for r in lines.collect()) + "\n"
    for name, body in (("a.jsonl", text), ("b.jsonl", text.replace('"web_search"', '"x"', 1))):
        with open(f"{base}/{name}", "w") as fh:
            fh.write(body)
    for name, body in (("empty.jsonl", ""), ("blank names.jsonl", "\n  \n\n")):
        with open(f"{base}/{name}", "w") as fh:
            fh.write(body)
    names = ["a.jsonl", "b.jsonl", "none.jsonl", "empty.jsonl", "blank names.jsonl"]
    rep = AL.verify_log_files(spark, [f"{base}/{n}" for n in names])
    assert sorted(r.file for r in rep.collect()) == sorted(f"{base}/{n}" for n in names)
    for r in rep.where("file like '%empty.jsonl' or file like '%blank%'").collect():
        assert (r.valid, r.entries, r.broken_at, r.detail) == (True, 0, None, "chain intact: 0 entries verified")
    got = {os.path.basename(r.file): r for r in rep.collect()}
    assert got["a.jsonl"].valid and got["a.jsonl"].entries == 5
    assert not got["b.jsonl"].valid and got["b.jsonl"].broken_at == 1
    assert got["none.jsonl"].valid and got["none.jsonl"].entries == 0
    assert got["none.jsonl"].detail == "log file does not exist"


def test_log_heads(spark):
    rows = [("a", 0, 1, '{"entry_hash": "h1"}'), ("a", 0, 2, '{"entry_hash": "h2"}'), ("a", 0, 3, "  "),
            ("b", 0, 1, '{"entry_hash": "h1"}'), ("b", 1, 1, '{"entry_hash": "h3"} tail'),
            ("c", 0, 1, ""), ("d", 0, 1, '{"other": 1}'), ("e", 0, 1, '{"entry_hash": "h5"}'), ("e", 1, 1, "")]
    df = spark.createDataFrame(rows, "chain string, segment long, line_no long, line string")
    got = {r.chain: (r.seed_hash, r.seed_seq, r.seed_segment) for r in AL.log_heads(df, "chain").collect()}
    assert got == {"a": ("h2", 2, 0), "b": ("", 2, 1), "c": ("", 0, 0), "d": ("", 1, 0), "e": ("h5", 1, 1)}


def test_small_log_files_are_read_once(spark, tmp_path):
    lines = A.build_chain(A.entry_parts(_records(spark, 3, 9)), "chain", ["ts", "qid"], max_segment_bytes=900)
    AL.write_audit_log(lines, str(tmp_path / "log"), "chain")
    logs = AL.read_audit_log(spark, str(tmp_path / "log"))
    assert logs.count() == 27
    logs.collect()
    # the look at split files, by size, finds none: the join with it is gone from the plan that ran
    plan = logs._jdf.queryExecution().executedPlan()
    assert plan.toString().split("Initial Plan")[0].count("Join") == 0


def test_chain_folder_is_written_by_one_task(spark, tmp_path):
    """Short chains: all of a chain's segments come from the same task."""
    lines = A.build_chain(A.entry_parts(_records(spark, 5, 9)), "chain", ["ts", "qid"], max_segment_bytes=900)
    AL.write_audit_log(lines, str(tmp_path / "log"), "chain")
    tasks = {}
    for d, _, files in os.walk(tmp_path / "log"):
        for f in files:
            if f.startswith("part-"):
                tasks.setdefault(os.path.dirname(d), set()).add(f.split("-")[1])
    assert len(tasks) == 5 and all(len(t) == 1 for t in tasks.values())


def test_index_places_segments_in_their_files(spark, tmp_path):
    lines = A.build_chain(A.entry_parts(_records(spark, 6, 9)), "chain", ["ts", "qid"], max_segment_bytes=900)
    AL.write_bucketed_log(lines, str(tmp_path / "log"), "chain", buckets=2)
    index = AL.read_index(spark, str(tmp_path / "log"))
    for b in {r.bucket for r in index.collect()}:
        d = tmp_path / "log" / "lines" / "append=0" / f"bucket={b}"
        text = [x for f in os.listdir(d) if f.startswith("part-") for x in (d / f).read_text().splitlines()]
        entries = [json.loads(x) for x in text]
        at = 1
        for r in index.where(f"bucket = {b}").orderBy("chain", "segment").collect():
            assert (r.first_line, r.last_line) == (at, at + r.entries - 1)
            assert r.first_prev == entries[at - 1]["prev_hash"] and r.last_hash == entries[r.last_line - 1]["entry_hash"]
            assert r.bytes == sum(len(x) + 1 for x in text[at - 1:r.last_line])
            at = r.last_line + 1
        assert at == len(text) + 1


ODD_CHAINS = ["a", "b c", "x=1/%41#[y]", None, ""]


def _odd_lines(spark):
    """Chains with odd names; a chain's lines hold blank ones and letters beyond ASCII."""
    rows = [(c, s, q, f"{c!r} {s} {q} é" if q % 4 else "") for c in ODD_CHAINS for s in range(3) for q in range(s * 5, s * 5 + 5)]
    return spark.createDataFrame(rows, "chain string, segment long, seq long, line string")


def _as_set(df):
    return sorted(map(tuple, df.select("chain", "segment", "file", "line_no", "line").collect()), key=str)


def test_segments_are_read_as_by_spark(spark, tmp_path):
    """Files of the tasks and of Spark's own writer, read by the tasks and by Spark's own reader: the same rows."""
    lines, keys = _odd_lines(spark), "chain string, segment bigint"
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # a file goes on in the next batch
    try:
        AL.write_audit_log(lines, str(tmp_path / "own log"), "chain")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    # null and "" share a folder, which Spark's writer would begin twice
    lines.withColumn("chain", F.nullif("chain", F.lit(""))).repartition(1).sortWithinPartitions("chain", "segment", "seq") \
        .select("chain", "segment", "line").write.partitionBy("chain", "segment").text(str(tmp_path / "spark"))
    for name in ("own log", "spark"):
        at = str(tmp_path / name)
        own = _as_set(AL.read_audit_log(spark, at, keys))
        plain = AL.read_audit_log(spark, at).withColumn("segment", F.col("segment").cast("bigint"))
        assert own == _as_set(plain) and len(own) == 75
        assert {(r[0], r[1], r[4]) for r in own} == {(r.chain or None, r.segment, r.line) for r in lines.collect()}
    assert sorted(os.listdir(tmp_path / "own log")) == sorted(n for n in os.listdir(tmp_path / "spark") if not n.startswith("."))
    # with nothing left over beside it
    assert sorted(os.listdir(tmp_path)) == ["own log", "spark"]


def test_log_is_written_without_hadoop_files(spark, tmp_path):
    """No checksum file, and so no chmod process, for a segment; the log before is replaced as a whole."""
    lines = _odd_lines(spark)
    at = str(tmp_path / "log")
    AL.write_audit_log(lines, at, "chain")
    AL.write_audit_log(lines.where("segment < 2 and chain <> ''"), at, "chain")
    files = [f for _, _, names in os.walk(at) for f in names]
    assert sorted(f for f in files if not f.startswith("part-")) == ["_SUCCESS"] and len(files) == 7
    bad = lines.withColumn("line", F.when(F.col("seq") < 14, F.col("line")).otherwise(F.raise_error(F.lit("no line"))))
    try:
        AL.write_audit_log(bad, at, "chain")
        raise AssertionError("written")
    except Exception as e:
        assert "no line" in str(e)
    assert sorted(f for _, _, names in os.walk(at) for f in names) == sorted(files) and os.listdir(tmp_path) == ["log"]


def test_reading_a_log_makes_no_plan_of_its_files(spark, tmp_path):
    lines = _odd_lines(spark)
    AL.write_audit_log(lines, str(tmp_path / "log"), "chain")
    logs = AL.read_audit_log(spark, str(tmp_path / "log"), "chain string, segment bigint")
    assert logs.inputFiles() == [] and logs.count() == 75


def test_line_ends_and_bytes_as_by_spark(spark, tmp_path, monkeypatch):
    bodies = [b"", b"\n", b"a", b"a\r\nb\rc\n\nd", b"\xef\xbb\xbfa\n\xff\xfe\x00b\n", b"a\r", b"\r\n\r\n", b"ab\r\n" * 9 + b"\r\r\n", b"x\xc2\x85y\x0bz\n\xe2\x80\xa8"]
    for i, body in enumerate(bodies):
        os.makedirs(tmp_path / f"chain={i}" / "segment=0")
        (tmp_path / f"chain={i}" / "segment=0" / "part-0.txt").write_bytes(body)
    hexed = lambda df: sorted(map(tuple, df.selectExpr("cast(chain as bigint)", "line_no", "hex(cast(line as binary))").collect()))
    want = hexed(AL.read_audit_log(spark, str(tmp_path)))
    for size in (SF.READ_BYTES, 1, 2, 5):
        monkeypatch.setattr(SF, "READ_BYTES", size)  # shipped by value
        assert hexed(AL.read_audit_log(spark, str(tmp_path), "chain bigint, segment bigint")) == want
    assert hexed(AL.read_audit_log(spark, str(tmp_path), "chain bigint, segment bigint"))[0] == (1, 1, "")


def test_folder_names_are_sparks(spark):
    names = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for text in ("plain", "".join(map(chr, range(1, 128))), "é%41"):
        assert SF.folder_name("k", text) == f"k={names.escapePathName(text)}"
        assert SF.folder_value(SF.folder_name("k", text)) == text
    assert SF.folder_value(SF.folder_name("k", None)) is None


def test_append_adds_files(spark, tmp_path):
    lines = _odd_lines(spark)
    for mode in ("overwrite", "append"):
        AL.write_audit_log(lines, str(tmp_path / "log"), "chain", mode=mode)
    logs = AL.read_audit_log(spark, str(tmp_path / "log"), "chain string, segment bigint")
    assert logs.count() == 150
