"""Hash-chained audit log: records, chain building, segments and verification.

Entry format (one compact JSON object per line, keys in this order):
``timestamp, event, data, prev_hash, entry_hash``. ``entry_hash`` is the
SHA-256 hex of the canonical JSON (sorted keys, ``,``/``:`` separators,
ASCII-escaped) of ``{prev_hash, event, data, timestamp}``; the first entry of
a chain has ``prev_hash == ""``.

Scale notes. Building a chain is sequential by definition (each hash
covers the previous one), so work is parallel across chains: rows are
hash-partitioned by chain, sorted within partitions and folded by a
streaming ``mapInArrow`` that keeps the running hash of the current chain
(constant memory, any number and length of chains). Everything else (records, canonical JSON,
verification hashes, link checks) is row-parallel.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import rules as R
from ..functions import text as T

# ---------------------------------------------------------------------------
# A1: audit record
# ---------------------------------------------------------------------------

RECORD_FIELDS = ("query_hash", "query_length", "redactions_count", "results_returned", "blocked")


def audit_records(df: DataFrame, raw: str = "raw", n_redactions: str = "n_redactions",
                  results: str = "results_returned", blocked: str = "audit_blocked") -> DataFrame:
    """A1: record fields; the query text itself is never stored."""
    r = F.col(raw)
    return df.withColumns({
        "event": F.lit(R.AUDIT_EVENT),
        "query_hash": T.sha256_prefix(r, 16),
        "query_length": F.length(r).cast("bigint"),
        "redactions_count": F.col(n_redactions).cast("bigint"),
        "results_returned": F.col(results).cast("bigint"),
        "blocked": F.col(blocked),
    })


def _json_bool(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("null")).when(c, F.lit("true")).otherwise(F.lit("false"))


def _json_int(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def record_json(sort_keys: bool, src: Column | None = None) -> Column:
    """``data`` object of an audit record: canonical (sorted) or as written (field order).

    Values come from top-level columns, or from the fields of struct ``src``.
    """
    get = (lambda c: F.col(c)) if src is None else (lambda c: src[c])
    vals = {
        "query_hash": T.json_string(get("query_hash")),
        "query_length": _json_int(get("query_length")),
        "redactions_count": _json_int(get("redactions_count")),
        "results_returned": _json_int(get("results_returned")),
        "blocked": _json_bool(get("blocked")),
    }
    keys = sorted(vals) if sort_keys else list(RECORD_FIELDS)
    parts = [F.lit("{")]
    for i, k in enumerate(keys):
        parts += [F.lit(("," if i else "") + json.dumps(k) + ":"), vals[k]]
    parts.append(F.lit("}"))
    return F.concat(*parts)


def entry_parts(df: DataFrame, ts: str = "ts", event: str = "event") -> DataFrame:
    """Adds the hash-free pieces of each entry so the fold only concatenates and hashes.

    ``canon_prefix + prev_hash + canon_suffix`` is the canonical JSON;
    ``line_prefix + prev_hash + '","entry_hash":"' + entry_hash + '"}'`` is the line.
    """
    ev = T.json_string(F.col(event))
    # an ISO time holds nothing to escape
    at = F.coalesce(F.concat(F.lit('"'), F.col("timestamp"), F.lit('"')), F.lit("null"))
    return df.withColumn("timestamp", T.iso_utc(ts)).withColumns({
        "data": record_json(sort_keys=False),
        "canon_prefix": F.concat(F.lit('{"data":'), record_json(sort_keys=True),
                                 F.lit(',"event":'), ev, F.lit(',"prev_hash":"')),
        "canon_suffix": F.concat(F.lit('","timestamp":'), at, F.lit("}")),
    }).withColumn("line_prefix", F.concat(
        F.lit('{"timestamp":'), at, F.lit(',"event":'), ev,
        F.lit(',"data":'), F.col("data"), F.lit(',"prev_hash":"')))


# ---------------------------------------------------------------------------
# Chain fold with resume seeds and segment rotation
# ---------------------------------------------------------------------------

_PIECES = ("canon_prefix", "canon_suffix", "line_prefix", "seed_hash", "seed_bytes",
           "seed_segment", "seed_seq")


def _fold(chain_key: str, kept: Sequence[str], max_segment_bytes: int | None):
    """Fold rows sorted by chain. Only the current chain's state is held; the
    columns in ``kept`` pass through as Arrow data, so their nulls and large
    integers stay what they are. A null chain key is a chain like any other.
    """
    def run(batches):
        key, begun = None, False
        for b in batches:
            out = {c: [] for c in ("seq", "prev_hash", "entry_hash", "segment", "segment_bytes", "line")}
            rows = zip(b.column(chain_key).to_pylist(), *(b.column(c).to_pylist() for c in _PIECES))
            for k, cpre, csuf, lpre, seed, seed_bytes, seed_segment, seed_seq in rows:
                if not begun or not (k == key or (k != k and key != key)):  # the latter: NaN
                    key, begun = k, True
                    prev, seq, segment, used = seed or "", seed_seq or 0, seed_segment or 0, seed_bytes or 0
                h = hashlib.sha256((cpre + prev + csuf).encode("utf-8")).hexdigest()
                line = lpre + prev + '","entry_hash":"' + h + '"}'
                if max_segment_bytes is not None and used >= max_segment_bytes:
                    segment, used = segment + 1, 0
                used += len(line.encode("utf-8")) + 1
                seq += 1
                for c, v in zip(out.values(), (seq, prev, h, segment, used, line)):
                    c.append(v)
                prev = h
            made = [pa.array(v, pa.string() if c in ("prev_hash", "entry_hash", "line") else pa.int64())
                    for c, v in out.items()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *made], names=[*kept, *out])
    return run


def build_chain(df: DataFrame, chain_key: str, order: Sequence[str],
                heads: DataFrame | None = None, max_segment_bytes: int | None = None,
                partitions: int | None = None) -> DataFrame:
    """A4 (+A5 resume, +A6 rotation): chain entries in ``order`` within each chain.

    ``df`` needs ``canon_prefix, canon_suffix, line_prefix`` (see ``entry_parts``).
    ``heads`` (``chain_key, seed_hash[, seed_bytes, seed_segment, seed_seq]``)
    continues existing chains: the first new entry links to ``seed_hash``,
    numbering continues after ``seed_seq`` and rotation continues from the
    open segment. Adds ``seq``,
    ``prev_hash, entry_hash, segment, segment_bytes, line``.
    """
    spark = df.sparkSession
    if heads is not None:
        for c in ("seed_bytes", "seed_segment", "seed_seq"):
            if c not in heads.columns:
                heads = heads.withColumn(c, F.lit(0).cast("bigint"))
        heads = heads.select(F.col(chain_key).alias("_head_key"), "seed_hash", "seed_bytes", "seed_segment", "seed_seq")
        df = df.join(heads, F.col(chain_key).eqNullSafe(F.col("_head_key")), "left").drop("_head_key")
    else:
        df = df.withColumns({"seed_hash": F.lit(None).cast("string"),
                             "seed_bytes": F.lit(None).cast("bigint"),
                             "seed_segment": F.lit(None).cast("bigint"),
                             "seed_seq": F.lit(None).cast("bigint")})
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the fold needs only the order keys and the pre-built pieces; other
    # columns ride along because a Python function's input cannot be pruned
    ordered = df.repartition(n, chain_key).sortWithinPartitions(chain_key, *order)
    fields = [f for f in ordered.schema.fields if f.name not in _PIECES]
    schema = ST.StructType(fields + [ST.StructField(c, ST.LongType() if c in ("seq", "segment", "segment_bytes")
                                                    else ST.StringType())
                                     for c in ("seq", "prev_hash", "entry_hash", "segment", "segment_bytes", "line")])
    return ordered.mapInArrow(_fold(chain_key, [f.name for f in fields], max_segment_bytes), schema)


def chain_heads(entries: DataFrame, chain_key: str, seq: str = "seq") -> DataFrame:
    """A5: per chain, the last entry hash, open segment and its bytes (partial max_by)."""
    return entries.groupBy(chain_key).agg(
        F.max_by("entry_hash", seq).alias("seed_hash"),
        F.max_by("segment_bytes", seq).cast("bigint").alias("seed_bytes"),
        F.max_by("segment", seq).cast("bigint").alias("seed_segment"),
        F.max(seq).cast("bigint").alias("seed_seq"))


def segment_names(entries: DataFrame, chain_key: str, segment: str = "segment", seq: str = "seq",
                  timestamp: str = "timestamp") -> DataFrame:
    """Each segment's file name, from the time at which it was closed.

    A segment is closed by the first entry of the next one, at that entry's
    ``timestamp`` (ISO, UTC): ``20240131-235959``. Further segments that a
    chain closes within the same second get ``-0002``, ``-0003`` and so on, so
    names are unique in a chain and sort in its order. The open segment has
    no name yet (null). Adds up one row a segment before any window.
    """
    per = entries.groupBy(chain_key, segment).agg(F.min_by(timestamp, seq).alias("_begun"), F.count(F.lit(1)).alias("entries"))
    chain = Window.partitionBy(chain_key).orderBy(segment)
    second = F.regexp_replace(F.substring(F.lead("_begun").over(chain), 1, 19), "[-:]", "")
    per = per.withColumn("_at", F.replace(second, F.lit("T"), F.lit("-")))
    nth = F.row_number().over(Window.partitionBy(chain_key, "_at").orderBy(segment))
    name = F.when(nth == 1, F.col("_at")).otherwise(F.concat("_at", F.lit("-"), F.lpad(nth.cast("string"), 4, "0")))
    return per.select(chain_key, segment, F.col("entries").cast("bigint").alias("entries"), F.when(F.col("_at").isNotNull(), name).alias("name"))


# ---------------------------------------------------------------------------
# A2 generic / A7-A10: verification of JSONL lines
# ---------------------------------------------------------------------------

def canonical_text(value) -> str:
    """A2 for any JSON value: sorted keys, compact separators, ASCII-escaped."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


#: The hashed fields of an entry, and what a line that lacks one counts as having.
HASHED = {"prev_hash": "", "event": "", "data": {}, "timestamp": ""}


def stored_and_expected(entry: dict) -> tuple:
    """(stored previous hash, stored hash, recomputed hash) of a parsed line (A3)."""
    hashed = HASHED | {k: v for k, v in entry.items() if k in HASHED}
    return hashed["prev_hash"], entry.get("entry_hash", ""), hashlib.sha256(canonical_text(hashed).encode()).hexdigest()


@F.pandas_udf(ST.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """A2 as a column function: re-serialise JSON text canonically (null if invalid)."""
    def one(t):
        if t is None:
            return None
        try:
            return canonical_text(json.loads(t))
        except ValueError:
            return None
    return texts.map(one)


PARSED_SCHEMA = ST.StructType([
    ST.StructField("ok", ST.BooleanType()),
    ST.StructField("prev_repr", ST.StringType()),
    ST.StructField("entry_repr", ST.StringType()),
    ST.StructField("hash_ok", ST.BooleanType()),
    ST.StructField("expected16", ST.StringType()),
    ST.StructField("prev16", ST.StringType()),
    ST.StructField("entry16", ST.StringType()),
])


@F.arrow_udf(PARSED_SCHEMA)
def _parse_entries(lines: pa.Array) -> pa.Array:
    def one(line):
        if line is None:  # decided on the JVM fast path
            return None
        try:
            e = json.loads(line)
            if not isinstance(e, dict):
                raise ValueError("not an object")
        except (ValueError, TypeError):
            return {"ok": False}
        p, h, exp = stored_and_expected(e)
        return {"ok": True, "prev_repr": json.dumps(p), "entry_repr": json.dumps(h), "hash_ok": h == exp,
                "expected16": exp[:16], "prev16": str(p)[:16], "entry16": str(h)[:16]}

    kind = pa.struct([(f.name, pa.bool_() if f.name in ("ok", "hash_ok") else pa.string()) for f in PARSED_SCHEMA])
    if lines.null_count == len(lines):
        return pa.nulls(len(lines), kind)
    return pa.array([one(line) for line in lines.to_pylist()], kind)


def _mark(nb: DataFrame, keys, order, line_no: str, seed_repr: Column, seed16: Column) -> DataFrame:
    """Per non-blank parsed line: ``_rn``, ``_cause`` (null when good) and ``_detail``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    checked = nb.withColumns({
        "_exp_prev": F.coalesce(F.lag(F.col("_p.entry_repr"), 1).over(w), seed_repr),
        "_exp_prev16": F.coalesce(F.lag(F.col("_p.entry16"), 1).over(w), seed16),
        "_rn": F.row_number().over(w),
    })
    ok, link_bad = F.col("_p.ok"), F.col("_p.prev_repr") != F.col("_exp_prev")
    cause = (F.when(~ok, F.lit("invalid_json"))
             .when(link_bad, F.lit("chain_break"))
             .when(~F.col("_p.hash_ok"), F.lit("hash_mismatch")))
    detail = (F.when(~ok, F.format_string("line %d: invalid JSON", F.col(line_no)))
              .when(link_bad, F.format_string(
                  "line %d: chain break -- expected prev_hash=%s..., got %s...",
                  F.col(line_no), F.col("_exp_prev16"), F.col("_p.prev16")))
              .when(~F.col("_p.hash_ok"), F.format_string(
                  "line %d: hash mismatch -- computed %s..., stored %s...",
                  F.col(line_no), F.col("_p.expected16"), F.col("_p.entry16"))))
    return checked.withColumns({"_cause": cause, "_detail": detail})


#: Characters that stand for themselves in JSON, and whole numbers as ``json.dumps`` writes them.
_PLAIN, _WHOLE = r"([ !#-\[\]-~]*)", r"(0|-?[1-9][0-9]{0,17})"

#: A line exactly as ``build_chain`` writes it, of plain characters, and its canonical JSON by the groups found.
PLAIN_LINE = (r'\A\{"timestamp":"' + _PLAIN + r'","event":"' + _PLAIN + r'","data":\{"query_hash":"' + _PLAIN
              + r'","query_length":' + _WHOLE + r',"redactions_count":' + _WHOLE + r',"results_returned":' + _WHOLE
              + r',"blocked":(true|false)\},"prev_hash":"' + _PLAIN + r'","entry_hash":"' + _PLAIN + r'"\}\z')
PLAIN_CANON = ('{"data":{"blocked":$7,"query_hash":"$3","query_length":$4,"redactions_count":$5,"results_returned":$6},'
               '"event":"$2","prev_hash":"$8","timestamp":"$1"}')


def _fast_parse(line: Column, canon: Column) -> tuple[Column, Column]:
    """(usable, parsed) for lines written exactly as ``build_chain`` writes them.

    ``canon`` is ``line`` with ``PLAIN_LINE`` replaced by ``PLAIN_CANON``,
    bound once by the caller. A line that matches is rearranged, so it
    changes; its values are what ``json.loads`` would return, and the
    canonical hash is computed JVM-side. The last two strings hold no quote.
    """
    usable = F.coalesce(canon != line, F.lit(False))
    prev = F.substring_index(F.substring_index(line, '"', -6), '"', 1)
    entry = F.substring_index(F.substring_index(line, '"', -2), '"', 1)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    expected = F.sha2(canon, 256)
    parsed = F.struct(
        F.lit(True).alias("ok"),
        quoted(prev).alias("prev_repr"),
        quoted(entry).alias("entry_repr"),
        (entry == expected).alias("hash_ok"),
        F.substring(expected, 1, 16).alias("expected16"),
        F.substring(prev, 1, 16).alias("prev16"),
        F.substring(entry, 1, 16).alias("entry16"))
    return usable, parsed


def _parsed(lines: DataFrame, line: str) -> DataFrame:
    """Non-blank lines with ``_p``: JVM fast path, Python for everything else."""
    whole = F.col(line).startswith("{") & F.col(line).endswith("}")  # nothing to strip
    nb = lines.where(~T.py_is_blank(line)).withColumn("_l", F.when(whole, F.col(line)).otherwise(T.py_strip(line)))
    # match once per line: the always-true, non-deterministic guard keeps the
    # optimizer from inlining the match into each of its reads
    keep = F.spark_partition_id() >= 0
    nb = nb.withColumn("_c", F.when(keep, F.regexp_replace("_l", PLAIN_LINE, PLAIN_CANON)))
    usable, fast = _fast_parse(F.col("_l"), F.col("_c"))
    nb = nb.withColumn("_fs", F.when(keep, F.struct(usable.alias("u"), fast.alias("p"))))
    nb = nb.withColumns({"_fast": F.col("_fs.u"), "_fp": F.col("_fs.p")}).drop("_c", "_fs")
    slow = _parse_entries(F.when(~F.col("_fast"), F.col("_l")))
    return nb.withColumn("_p", F.when(F.col("_fast"), F.col("_fp")).otherwise(slow)).drop(
        "_l", "_fast", "_fp")


def _first_break(marked: DataFrame, keys, line_no: str) -> DataFrame:
    bad_key = F.when(F.col("_cause").isNotNull(), F.col("_rn"))
    return marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(F.struct(F.col(line_no).alias("ln"), F.col("_rn").alias("rn"),
                          F.col("_cause").alias("c"), F.col("_detail").alias("d")),
                 bad_key).alias("_b"),
    )


def verify(lines: DataFrame, file_key: Sequence[str] | str, order: Sequence[str] | str = "line_no",
           line: str = "line", line_no: str = "line_no", seed: str = "") -> DataFrame:
    """First break per file (or per chain of ordered segments, A10).

    ``lines`` has one row per physical line with its number. Blank lines are
    skipped but keep their numbers. Per line, in this order: invalid JSON,
    link (stored prev_hash equals the previous line's stored entry_hash, the
    first line links to ``seed``), recomputed hash. Before the first break
    every line is good, so the lag of stored hashes is the expected link and
    ``entries`` is the first bad line's rank minus one. Output per file:
    ``valid, entries, broken_at, cause, detail``. The window is per file;
    files are bounded by segment rotation (see ``verify_chained`` for a
    chain of many files).
    """
    keys = [file_key] if isinstance(file_key, str) else list(file_key)
    order = [order] if isinstance(order, str) else list(order)
    marked = _mark(_parsed(lines, line), keys, order, line_no,
                   F.lit(json.dumps(seed)), F.lit(seed[:16]))
    agg = _first_break(marked, keys, line_no)
    broken = F.col("_b").isNotNull()
    return agg.select(
        *keys,
        (~broken).alias("valid"),
        F.when(broken, F.col("_b.rn") - 1).otherwise(F.col("_n")).cast("bigint").alias("entries"),
        F.when(broken, F.col("_b.ln")).cast("bigint").alias("broken_at"),
        F.when(broken, F.col("_b.c")).alias("cause"),
        F.when(broken, F.col("_b.d")).otherwise(
            F.format_string("chain intact: %d entries verified", F.col("_n"))).alias("detail"),
    )


def verify_chained(lines: DataFrame, chain_key: str, segment: str = "segment",
                   line_no: str = "line_no", line: str = "line", seed: str = "") -> DataFrame:
    """A10 fix: a chain's ordered segment files verified as one chain.

    Each segment is checked on its own (windows stay bounded by rotation) and
    summed up in one row: its first line's link, its last stored hash, its
    first break. A window over these rows links each segment to the one
    before it and counts the entries before it; the chain's first break is
    a ``min_by`` over them. The lines are read once, and a chain holding a
    large share of all lines is spread over many tasks. Same output
    as ``verify`` keyed by ``chain_key``; ``broken_at`` is the line number
    inside ``broken_segment``.
    """
    keys = [chain_key, segment]
    # pass 1, one window per segment: every line but a segment's first is checked against the line before it
    marked = _mark(_parsed(lines, line), keys, [line_no], line_no, F.lit(None).cast("string"), F.lit(None).cast("string"))
    rn1 = F.col("_rn") == 1
    pick = lambda c: F.max(F.when(rn1, F.col(c)))
    bad = F.when(F.col("_cause").isNotNull(), F.col("_rn"))
    seg = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(F.struct(F.col(line_no).alias("ln"), F.col("_rn").alias("rn"), F.col("_cause").alias("c"),
                          F.col("_detail").alias("d")), bad).alias("_b"),
        F.max_by(F.struct(F.col("_p.entry_repr").alias("r"), F.col("_p.entry16").alias("h")), F.col("_rn")).alias("_last"),
        pick("_p.prev_repr").alias("_first"), pick("_p.prev16").alias("_first16"), pick(line_no).alias("_ln1"),
        F.max(F.when(rn1, F.col("_p.ok"))).alias("_ok1"))
    # pass 2, one row per segment: link its first line to the last stored hash before it
    ws = Window.partitionBy(chain_key).orderBy(segment)
    link = F.coalesce(F.lag("_last.r").over(ws), F.lit(json.dumps(seed)))
    link16 = F.coalesce(F.lag("_last.h").over(ws), F.lit(seed[:16]))
    earlier = F.coalesce(F.sum("_n").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seg = seg.withColumns({"_link": link, "_link16": link16, "_before": earlier})
    broken_link = F.col("_ok1") & (F.col("_first") != F.col("_link"))
    at = F.when(broken_link, F.struct(
        F.col("_ln1").alias("ln"), F.lit(1).alias("rn"), F.lit("chain_break").alias("c"),
        F.format_string("line %d: chain break -- expected prev_hash=%s..., got %s...", F.col("_ln1"), F.col("_link16"),
                        F.col("_first16")).alias("d"))).otherwise(F.col("_b"))
    seg = seg.select(chain_key, segment, "_n", "_before", at.alias("_b"))
    first = seg.groupBy(chain_key).agg(
        F.sum("_n").alias("_total"),
        F.min_by(F.struct(F.col(segment).alias("s"), "_before", F.col("_b").alias("b")),
                 F.when(F.col("_b").isNotNull(), F.col(segment))).alias("_f"))
    broken = F.col("_f").isNotNull()
    return first.select(
        chain_key,
        (~broken).alias("valid"),
        F.when(broken, F.col("_f._before") + F.col("_f.b.rn") - 1).otherwise(F.col("_total")).cast("bigint").alias("entries"),
        F.when(broken, F.col("_f.b.ln")).cast("bigint").alias("broken_at"),
        F.when(broken, F.col("_f.s")).cast("bigint").alias("broken_segment"),
        F.when(broken, F.col("_f.b.c")).alias("cause"),
        F.when(broken, F.col("_f.b.d")).otherwise(
            F.format_string("chain intact: %d entries verified", F.col("_total"))).alias("detail"),
    )


def verify_long(lines: DataFrame, file_key: str, line_no: str = "line_no", line: str = "line", seed: str = "",
                block_lines: int = 100_000) -> DataFrame:
    """A7-A9 for files of any length: ``verify`` with windows of ``block_lines`` lines at most."""
    blocks = lines.withColumn("_block", F.floor((F.col(line_no) - 1) / block_lines))
    return verify_chained(blocks, file_key, "_block", line_no, line, seed).drop("broken_segment")
