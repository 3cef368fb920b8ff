"""Inbound result operators: top-k, clean, validate URLs, drop injection, build context.

Result sets arrive either nested (one row per set with a JSON ``results``
array) or flat (one row per result with ``set_id, rnk``). Both shapes end
in the same flat, cleaned table.
"""

from __future__ import annotations

import html as _html
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import regex as X
from ..functions import rules as R
from ..functions import text as T
from ..functions.fence import fence


@F.pandas_udf(ST.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else _html.unescape(v))


# FIXED VALUES: common references decoded JVM-side; "&amp;" must stay last.
SIMPLE_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                   ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&"))
_SIMPLE_RE = "&(?:lt|gt|quot|#39|copy|middot|amp);"


def decode_entities(col) -> Column:
    """Full HTML5 entity decoding, exactly as ``html.unescape``.

    Text whose only '&' characters start one of ``SIMPLE_ENTITIES`` is
    decoded with nested ``replace`` (one left-to-right pass gives the same
    result, as no replacement creates or splits another reference before
    ``&amp;``, which goes last). Only text with other references (numeric,
    rarer names, missing semicolons) is sent to Python.
    """
    c = T._c(col)
    has_amp = c.contains("&")
    simple_only = ~F.regexp_replace(c, F.lit(_SIMPLE_RE), F.lit("")).contains("&")
    jvm = c
    for ent, ch in SIMPLE_ENTITIES:
        jvm = F.replace(jvm, F.lit(ent), F.lit(ch))
    py = _unescape(F.when(has_amp & ~simple_only, c))
    return F.when(~has_amp, c).when(simple_only, jvm).otherwise(py)


def engine_filter(results: DataFrame, allowed: DataFrame, key: str = "policy_id", engine: str = "engine",
                  n_rows: int | None = None) -> DataFrame:
    """I11 [ext]: rows whose engine the policy allows.

    ``allowed`` has ``key`` and ``engines`` (an array). A policy without a row,
    or whose array is null, allows every engine, also a row without one; an
    empty array allows none; a row without an engine passes no list. Both
    sides are joined by (policy, engine); ``allowed`` is broadcast only when
    it is known to be small (``n_rows``, its rows).
    """
    ruled = allowed.where(F.col("engines").isNotNull() & F.col(key).isNotNull())
    pairs = ruled.select(F.col(key).alias("_p"), F.explode("engines").alias("_e")).where(F.col("_e").isNotNull()).distinct()
    policies = ruled.select(F.col(key).alias("_q"), F.lit(True).alias("_ruled")).distinct()
    if n_rows is not None and n_rows <= 10_000:
        pairs, policies = F.broadcast(pairs), F.broadcast(policies)
    out = results.join(policies, F.col(key) == F.col("_q"), "left") \
        .join(pairs.withColumn("_hit", F.lit(True)), (F.col(key) == F.col("_p")) & (F.col(engine) == F.col("_e")), "left")
    return out.where(F.col("_ruled").isNull() | F.col("_hit").isNotNull()).drop("_q", "_ruled", "_p", "_e", "_hit")


def clean_text(col, max_length: int = R.MAX_SNIPPET_LENGTH) -> Column:
    """Tags -> space, decode entities, collapse whitespace, cap with '...'."""
    c = T._c(col)
    stripped = T.strip_tags(c, X.adapt(R.HTML_TAG), " ")
    collapsed = T.py_collapse_ws(decode_entities(stripped))
    capped = F.when(F.length(collapsed) > max_length,
                    F.concat(F.substring(collapsed, 1, max_length), F.lit("..."))
                    ).otherwise(collapsed)
    return F.when(c.isNull() | (c == ""), F.lit("")).otherwise(capped)


# ---------------------------------------------------------------------------
# URL scheme check and source host, following urllib's split rules
# ---------------------------------------------------------------------------

def _url_parts(col) -> tuple[Column, Column, Column]:
    """(scheme lower-cased, netloc, parse_error) for a URL column."""
    c = F.coalesce(T._c(col), F.lit(""))
    cleaned = F.regexp_replace(F.regexp_replace(c, r"^[\x{0}-\x{20}]+", ""), r"[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(cleaned, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    after = F.when(scheme != "", F.regexp_replace(cleaned, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
                   ).otherwise(cleaned)
    netloc = F.when(after.startswith("//"), F.regexp_extract(after, r"^//([^/?#]*)", 1)
                    ).otherwise(F.lit(""))
    has_open, has_close = netloc.contains("["), netloc.contains("]")
    bracket_ok = F.regexp_extract(netloc, r"\[([^\]]*)", 1).rlike(X.BRACKETED)
    # characters that become a part of the URL's own signs when normalised
    odd = netloc.rlike(r"[^\x{0}-\x{7f}]")
    error = (has_open != has_close) | (has_open & has_close & ~bracket_ok) | F.coalesce(_misleading(F.when(odd, netloc)), F.lit(False))
    return scheme, netloc, error | T._c(col).isNull()


@F.pandas_udf(ST.BooleanType())
def _misleading(netloc: pd.Series) -> pd.Series:
    """Whether NFKC makes one of ``/?#@:`` out of other characters of a host part (null: not asked)."""
    def check(host):
        if host is None:
            return None
        plain = host.translate(dict.fromkeys(map(ord, "@:#?")))
        normal = unicodedata.normalize("NFKC", plain)
        return normal != plain and any(c in normal for c in "/?#@:")
    return netloc.map(check)


def url_columns(df: DataFrame, url: str = "url") -> DataFrame:
    """I6 + I6b: ``url`` kept only for http/https (else ""), ``source`` host or 'unknown'."""
    scheme, netloc, error = _url_parts(url)
    ok = scheme.isin("http", "https") & ~error
    return df.withColumns({
        "source": F.when(ok, netloc).otherwise(F.lit("unknown")),
        url: F.when(ok, F.col(url)).otherwise(F.lit("")),
    })


# ---------------------------------------------------------------------------
# Injection rules
# ---------------------------------------------------------------------------

def injection_rule(col, rules: Sequence[R.PatternRule] = R.INJECTION_RULES) -> Column:
    """First matching rule id (rule order), or null."""
    expr = None
    for r in rules:
        cond = T.rlike(col, r.pattern, r.case_insensitive)
        expr = F.when(cond, F.lit(r.rule_id)) if expr is None else expr.when(cond, F.lit(r.rule_id))
    return expr


def injection_hits(cols: Sequence[str], rules: Sequence[R.PatternRule] = R.INJECTION_RULES) -> Column:
    """All rule ids matching any of ``cols`` (for per-rule reports)."""
    hits = []
    for r in rules:
        cond = None
        for c in cols:
            one = T.rlike(c, r.pattern, r.case_insensitive)
            cond = one if cond is None else cond | one
        hits.append(F.when(cond, F.lit(r.rule_id)))
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


# ---------------------------------------------------------------------------
# Set-level steps
# ---------------------------------------------------------------------------

def top_results(df: DataFrame, set_key: str = "set_id", order: str = "rnk",
                n: int = R.MAX_RESULTS) -> DataFrame:
    """I1 on flat rows: the first ``n`` raw results per set (dropped ones are not refilled)."""
    w = Window.partitionBy(set_key).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


RESULTS_JSON_SCHEMA = "results array<struct<title:string,content:string,url:string>>"


def results_from_json(df: DataFrame, body: str = "body", set_key: str = "set_id",
                      n: int = R.MAX_RESULTS) -> DataFrame:
    """S4 + I1 on nested input: parse, keep the first ``n`` results, then explode.

    The slice happens before the explode so dropped results are never
    materialised; missing ``results`` means an empty list.
    """
    parsed = df.withColumn("_r", F.from_json(F.col(body), RESULTS_JSON_SCHEMA)["results"])
    top = F.slice(F.coalesce(F.col("_r"), F.array().cast(
        "array<struct<title:string,content:string,url:string>>")), 1, n)
    return parsed.select(set_key, F.posexplode(top).alias("_p", "_x")).select(
        set_key, F.col("_p").cast("bigint").alias("rnk"),
        F.coalesce(F.col("_x.title"), F.lit("")).alias("title"),
        F.coalesce(F.col("_x.content"), F.lit("")).alias("content"),
        F.coalesce(F.col("_x.url"), F.lit("")).alias("url"))


def sanitize_results(df: DataFrame, title: str = "title", content: str = "content",
                     url: str = "url") -> DataFrame:
    """I2-I9 per result row (already limited by I1).

    Adds ``snippet, source, title_rule, snippet_rule, injected, kept``; nothing
    is dropped here so the quarantine and the kept rows come from one pass.
    """
    df = df.withColumns({title: clean_text(title), "snippet": clean_text(content)})
    df = url_columns(df, url)
    df = df.withColumns({
        "title_rule": injection_rule(title),
        "snippet_rule": injection_rule("snippet"),
    })
    injected = F.col("title_rule").isNotNull() | F.col("snippet_rule").isNotNull()
    df = df.withColumns({
        "injected": injected,
        "kept": ~injected & ((F.col(title) != "") | (F.col("snippet") != "")),
    })
    return fence(df, [title, "snippet", url, "source", "title_rule", "snippet_rule",
                      "injected", "kept"])


def context_block(pos: Column, r: Column) -> Column:
    snippet = F.when(r["snippet"] != "", F.concat(F.lit("\n    "), r["snippet"])).otherwise(F.lit(""))
    url = F.when(r["url"] != "", F.concat(F.lit("\n    Source: "), r["url"])).otherwise(F.lit(""))
    return F.concat(F.lit("["), (pos + 1).cast("string"), F.lit("] "), r["title"], snippet, url,
                    F.lit("\n"))


def set_summary(df: DataFrame, set_key: str = "set_id", order: str = "rnk",
                max_length: int = R.MAX_CONTEXT_LENGTH) -> DataFrame:
    """I10 plus the kept results: one row per set in a single aggregation.

    ``results`` holds the kept rows in rank order, ``n_results`` their count
    and ``context`` the string built from them (numbered from 1 over kept
    rows). A set is bounded by I1 (at most ``MAX_RESULTS`` rows), so
    collecting it is safe; sets with no kept rows get an empty list and "".
    """
    kept = F.when(F.col("kept"), F.struct(
        F.col(order).alias("o"), F.col("title").alias("title"),
        F.col("snippet").alias("snippet"), F.col("url").alias("url"),
        F.col("source").alias("source")))
    agg = df.groupBy(set_key).agg(F.sort_array(F.collect_list(kept)).alias("_k"))
    body = F.array_join(F.transform("_k", lambda r, i: context_block(i, r)), "\n")
    ctx = F.concat(F.lit(R.CONTEXT_HEADER), F.lit("\n"), body)
    capped = F.when(F.length(ctx) > max_length,
                    F.concat(F.substring(ctx, 1, max_length), F.lit(R.CONTEXT_TRUNCATION))
                    ).otherwise(ctx)
    return agg.select(
        set_key,
        F.transform("_k", lambda r: F.struct(r["title"].alias("title"), r["snippet"].alias("snippet"),
                                             r["url"].alias("url"), r["source"].alias("source"))
                    ).alias("results"),
        F.size("_k").cast("bigint").alias("n_results"),
        F.when(F.size("_k") > 0, capped).otherwise(F.lit("")).alias("context"),
    )


def build_context(df: DataFrame, set_key: str = "set_id", order: str = "rnk",
                  max_length: int = R.MAX_CONTEXT_LENGTH) -> DataFrame:
    """``set_id, n_results, context`` (see ``set_summary``)."""
    return set_summary(df, set_key, order, max_length).drop("results")
