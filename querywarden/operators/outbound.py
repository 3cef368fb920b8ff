"""Outbound query operators: normalise, redact, gate, flag, generalise, pad.

Every function maps a DataFrame to a DataFrame, adds columns and never
changes the row count; they run unchanged on streaming DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions.fence import fence


def normalise(df: DataFrame, raw: str = "raw", out: str = "query",
              max_length: int | Column | None = R.MAX_QUERY_LENGTH) -> DataFrame:
    """O1: strip Unicode whitespace and keep the first ``max_length`` code points.

    The cut belongs to search queries. ``max_length`` may be a column (null:
    no cut for that row) or None (no cut at all), for texts that are not.
    Adds ``_empty`` (null / blank input) used by the gate; blank input gives "".
    """
    text = T.py_strip(raw)
    if max_length is not None:
        cut = F.substring(text, F.lit(1), max_length if isinstance(max_length, Column) else F.lit(max_length))
        text = F.when(max_length.isNull(), text).otherwise(cut) if isinstance(max_length, Column) else cut
    return df.withColumn("_empty", T.py_is_blank(raw)).withColumn(
        out, F.when(F.col("_empty"), F.lit("")).otherwise(text))


def _let(value: Column, fn) -> Column:
    """Bind ``value`` once and build ``fn(bound)``: a one-element ``transform``.

    The bound variable can be referenced many times without copying the
    expression that produced it, so chained steps stay linear in plan size
    even when Catalyst collapses the projections.
    """
    return F.transform(F.array(value), fn)[0]


def redact_pii(df: DataFrame, col: str = "query", rules: Sequence[R.PiiRule] = R.PII_RULES,
               gate: str | None = R.PII_GATE, findings: bool = True,
               out: str = "query", guards: dict | None = R.PII_GUARDS) -> DataFrame:
    """O2 + O3: apply the rules in order, each on the text the earlier ones left.

    Adds ``n_redactions`` and, if ``findings``, ``findings`` as
    ``ARRAY<STRUCT<placeholder, match>>`` in rule order then text order.
    Rows failing the cheap ``gate`` (a superset of all rules) skip the chain,
    and each rule runs only where its ``guards`` entry (a necessary
    condition checked on the text that rule sees) holds.
    The state (text, findings or count) is one struct threaded through the
    steps, so every step reads its predecessor exactly once.
    """
    on = T.rlike(col, gate, case_insensitive=True) if gate is not None else F.lit(True)
    empty = F.array().cast("array<struct<placeholder:string,match:string>>")

    def guard_of(r, q):
        kind, value = (guards or {}).get(r.name, (None, None))
        if kind == "literal":
            return q.contains(value)
        if kind == "regex":
            return T.rlike(q, value, r.case_insensitive)
        return None

    def make_step(r):
        def step(x):
            q = x["q"]
            g = guard_of(r, q)
            hits, new_q = T.rule_hits(q, r)
            if findings:
                found = F.concat(x["f"], F.transform(hits, lambda h: F.struct(
                    F.lit(r.placeholder).alias("placeholder"), h.alias("match"))))
            else:
                found = x["f"] + F.size(hits)
            if g is not None:
                new_q = F.when(g, new_q).otherwise(q)
                found = F.when(g, found).otherwise(x["f"])
            return F.struct(new_q.alias("q"), found.alias("f"))
        return step

    # the whole chain is one nested expression: each step binds the previous
    # state once, so it stays linear in size and costs one projection
    state = F.when(on, F.struct(F.col(col).alias("q"),
                                (empty if findings else F.lit(0).cast("bigint")).alias("f")))
    for r in rules:
        state = _let(state, make_step(r))
    # non-deterministic always-true guard: the optimizer may not inline the
    # state into the two fields read below (it would run the chain twice)
    df = df.withColumn("_s", F.when(F.spark_partition_id() >= 0, state))
    n = F.size(F.col("_s.f")) if findings else F.col("_s.f")
    new_cols = {"n_redactions": F.coalesce(n, F.lit(0)).cast("bigint")}
    if findings:
        new_cols["findings"] = F.coalesce(F.col("_s.f"), empty)
    # ``_s`` is null exactly when the gate failed: the text is unchanged then
    new_cols[out] = F.coalesce(F.col("_s.q"), F.col(col))
    return df.withColumns(new_cols).drop("_s")


def high_risk_count(col: str = "query", rules: Sequence[R.PiiRule] = R.PII_RULES) -> Column:
    """Substring occurrences of the high-risk placeholders (user-typed ones count)."""
    q = F.col(col)
    counts = [T.count_occurrences(q, ph) for ph in R.high_risk_placeholders(rules)]
    guarded = sum(counts, F.lit(0).cast("bigint"))
    return F.when(q.contains("["), guarded).otherwise(F.lit(0).cast("bigint"))


def redacted_token_counts(col: str = "query") -> tuple[Column, Column]:
    """O5 inputs: (redacted tokens, all tokens) over Python-style whitespace tokens."""
    q = F.col(col)
    toks = T.py_split(q)
    red = F.size(F.filter(toks, lambda t: t.startswith("[") & t.endswith("]")))
    has = q.contains("[")
    return (F.when(has, red).otherwise(0).cast("bigint"),
            F.when(has, F.size(toks)).otherwise(0).cast("bigint"))


def risk_gate(df: DataFrame, col: str = "query",
              rules: Sequence[R.PiiRule] = R.PII_RULES) -> DataFrame:
    """O4 + O5 (after O1): ``blocked``, ``reason`` in the order empty, high-risk, ratio."""
    red, tot = redacted_token_counts(col)
    df = df.withColumns({
        "high_risk_count": high_risk_count(col, rules),
        "_red": red,
        "_tok": tot,
    })
    reason = (
        F.when(F.col("_empty"), F.lit(R.REASON_EMPTY))
        .when(F.col("high_risk_count") >= R.HIGH_RISK_MIN, F.lit(R.REASON_HIGH_RISK))
        .when((F.col("_tok") > 0) & (F.col("_red") * 2 > F.col("_tok")),
              F.lit(R.REASON_TOO_MUCH_PII))
        .otherwise(F.lit(""))
    )
    return (df.withColumn("reason", reason)
              .withColumn("blocked", F.col("reason") != "")
              .drop("_red", "_tok"))


def sanitize(df: DataFrame, raw: str = "raw", findings: bool = False,
             rules: Sequence[R.PiiRule] = R.PII_RULES,
             max_length: int | Column | None = R.MAX_QUERY_LENGTH) -> DataFrame:
    """``query, n_redactions[, findings], high_risk_count, blocked, reason``."""
    df = normalise(df, raw, "query", max_length)
    df = redact_pii(df, "query", rules, findings=findings)
    df = risk_gate(df, "query", rules).drop("_empty")
    return fence(df, ["query", "n_redactions", "findings", "high_risk_count", "reason", "blocked"])


# ---------------------------------------------------------------------------
# Rare terms and the uniqueness decision
# ---------------------------------------------------------------------------

def rare_terms(df: DataFrame, col: str = "query",
               rules: Sequence[R.PatternRule] = R.RARE_TERM_RULES) -> DataFrame:
    """``rare_matches`` (all matches, rule order then text order), ``unique``."""
    matches = F.concat(*[T.extract_all(col, r.pattern, r.case_insensitive) for r in rules])
    return df.withColumn("rare_matches", matches).withColumn(
        "unique", F.size("rare_matches") > 0
    )


def uniqueness_decision(df: DataFrame, dp_enabled: str = "dp_enabled",
                        mode: str = "uniqueness_mode") -> DataFrame:
    """``uniqueness_action`` (block / warn / none) and ``uniqueness_warning``.

    Needs ``unique`` and ``rare_matches`` (O6) and the policy columns.
    """
    hit = F.col(dp_enabled) & F.col("unique")
    action = (F.when(hit & (F.col(mode) == "auto-block"), F.lit("block"))
              .when(hit & (F.col(mode) == "warn"), F.lit("warn"))
              .otherwise(F.lit("none")))
    warning = F.when(
        action == "warn",
        F.concat(F.lit(R.UNIQUENESS_WARNING_PREFIX),
                 F.array_join(F.slice("rare_matches", 1, 3), ", ")),
    )
    return df.withColumn("uniqueness_action", action).withColumn("uniqueness_warning", warning)


# ---------------------------------------------------------------------------
# Generalisation and padding
# ---------------------------------------------------------------------------

#: Keyword tables up to this size are a chain of tests; larger ones are looked up in one pass over the text.
CHAIN_KEYWORDS = 64


def category_of(col: str = "query",
                keywords: Sequence[tuple[str, str]] = R.CATEGORY_KEYWORDS) -> Column:
    """First keyword (in table order) contained in the lower-cased text, else null."""
    ql = F.lower(F.col(col))
    if len(keywords) > CHAIN_KEYWORDS:
        return _first_keyword(keywords)(ql)
    expr = None
    for kw, cat in keywords:
        cond = ql.contains(kw)
        expr = F.when(cond, F.lit(cat)) if expr is None else expr.when(cond, F.lit(cat))
    return expr if expr is not None else F.lit(None).cast("string")


def _first_keyword(keywords: Sequence[tuple[str, str]]):
    """An Arrow function: the category of the first keyword, in table order, that a text contains.

    An Aho-Corasick automaton over all keywords, built once in each worker's
    function, finds every keyword in one pass, however many there are. An
    empty keyword is in every text.
    """
    import ahocorasick

    automaton, always = ahocorasick.Automaton(), len(keywords)
    for i, (kw, _) in enumerate(keywords):
        if not kw:
            always = min(always, i)
        elif kw not in automaton:
            automaton.add_word(kw, i)
    automaton.make_automaton()
    categories = [cat for _, cat in keywords]

    @F.pandas_udf("string")
    def lookup(texts: pd.Series) -> pd.Series:
        def first(text):
            if text is None:
                return None
            best = always
            for _, i in automaton.iter(text) if len(automaton) else ():
                if i < best:
                    best = i
            return categories[best] if best < len(categories) else None
        return texts.map(first)

    return lookup


def generalise(df: DataFrame, col: str = "query", out: str = "category",
               keywords: Sequence[tuple[str, str]] = R.CATEGORY_KEYWORDS) -> DataFrame:
    return df.withColumn(out, category_of(col, keywords))


def pad_target(byte_len: Column, buckets: Sequence[int] = R.PAD_BUCKETS) -> Column:
    expr = None
    for b in buckets:
        expr = F.when(byte_len <= b, F.lit(b)) if expr is None else expr.when(byte_len <= b, F.lit(b))
    return expr.otherwise(F.lit(buckets[-1]))


def padded(col, buckets: Sequence[int] = R.PAD_BUCKETS) -> Column:
    """Right-pad with spaces to the smallest bucket holding the UTF-8 byte length."""
    c = F.col(col) if isinstance(col, str) else col
    n = F.octet_length(c)
    target = pad_target(n, buckets)
    return F.when(n < target, F.concat(c, F.repeat(F.lit(" "), target - n))).otherwise(c)


def pad(df: DataFrame, col: str = "query", out: str = "padded",
        buckets: Sequence[int] = R.PAD_BUCKETS) -> DataFrame:
    return df.withColumn(out, padded(col, buckets))
