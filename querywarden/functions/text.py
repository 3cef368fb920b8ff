"""Column-expression helpers that reproduce Python string semantics JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import linear, regex


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """Python ``str.strip()`` (Unicode whitespace, not just spaces)."""
    return F.regexp_replace(_c(col), F.lit(regex.java_strip_pattern()), F.lit(""))


def py_is_blank(col) -> Column:
    """True for null, empty or whitespace-only strings."""
    c = _c(col)
    return c.isNull() | ~c.rlike(regex.not_ws_class())


def py_split(col) -> Column:
    """Python ``str.split()`` with no separator: whitespace runs, no empty tokens."""
    parts = F.split(_c(col), regex.ws_class() + "+")
    return F.filter(parts, lambda t: t != F.lit(""))


def py_collapse_ws(col) -> Column:
    """``re.sub(r"\\s+", " ", s).strip()``."""
    return py_strip(F.regexp_replace(_c(col), F.lit(regex.ws_class() + "+"), F.lit(" ")))


def count_occurrences(col, needle: str) -> Column:
    """Python ``str.count(needle)`` for a non-empty literal needle."""
    c = _c(col)
    return F.floor(
        (F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / F.lit(len(needle))
    ).cast("bigint")


def rlike(col, pattern: str, case_insensitive: bool = False) -> Column:
    return _c(col).rlike(regex.adapt(pattern, case_insensitive))


def extract_all(col, pattern: str, case_insensitive: bool = False) -> Column:
    """Python ``re.findall`` for patterns without capture groups."""
    return F.regexp_extract_all(_c(col), F.lit(regex.adapt(pattern, case_insensitive)), 0)


def replace_all(col, pattern: str, replacement: str, case_insensitive: bool = False) -> Column:
    """Python ``re.sub`` with a literal replacement."""
    safe = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(_c(col), F.lit(regex.adapt(pattern, case_insensitive)), F.lit(safe))


def rule_hits(col, rule) -> tuple[Column, Column]:
    """All matches of a rule, and the text with each replaced by the rule's placeholder, in one pass over the text.

    Rules with an entry in ``linear.FORMS`` are run in that form: the same
    matches, without Java trying again from every character.
    """
    c, form = _c(col), linear.form_of(rule.pattern, rule.case_insensitive)
    if form is None:
        return (extract_all(c, rule.pattern, rule.case_insensitive),
                replace_all(c, rule.pattern, rule.placeholder, rule.case_insensitive))
    if not form.pieces:
        safe = rule.placeholder.replace("\\", "\\\\").replace("$", "\\$")
        return F.regexp_extract_all(c, F.lit(form.pattern), 0), F.regexp_replace(c, F.lit(form.pattern), F.lit(safe))
    found = F.regexp_extract_all(c, F.lit(form.pattern), 1)
    pieces = F.regexp_extract_all(c, F.lit(form.pattern), 0)
    text = F.array_join(F.zip_with(pieces, found, lambda p, f: F.when(f == "", p).otherwise(F.lit(rule.placeholder))), "")
    return F.filter(found, lambda f: f != ""), text


def strip_tags(col, tag: str, by: str) -> Column:
    """Replace ``tag``, a pattern from ``<`` to the next ``>``, by ``by``.

    Only the text up to the last ``>`` is searched: beyond it each ``<``
    would look through all the rest for an end that is not there.
    """
    c = _c(col)
    tail = F.substring_index(c, ">", -1)
    head = F.substring(c, F.lit(1), F.length(c) - F.length(tail))
    return F.when(c.contains(">"), F.concat(F.regexp_replace(head, F.lit(tag), F.lit(by)), tail)).otherwise(c)


def sha256_prefix(col, n: int = 16) -> Column:
    """First ``n`` hex digits of SHA-256 over the UTF-8 bytes."""
    return F.substring(F.sha2(_c(col), 256), 1, n)


def seeded_unit_ms(lo: int, hi: int, *parts) -> Column:
    """Deterministic integer in [lo, hi] from md5 of the joined parts (DuckDB-equal)."""
    key = F.concat_ws(":", *[F.lit(p) if isinstance(p, (str, int)) else p for p in parts])
    bits = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    return (F.lit(lo) + bits % F.lit(hi - lo + 1)).cast("bigint")


def iso_utc(ts_col) -> Column:
    """``datetime.isoformat()`` of an aware UTC timestamp: fraction dropped when zero."""
    ts = _c(ts_col)
    micros = F.unix_micros(ts) % F.lit(1_000_000)
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.lpad(micros.cast("string"), 6, "0")
    return F.when(micros == 0, F.concat(base, F.lit("+00:00"))).otherwise(
        F.concat(base, F.lit("."), frac, F.lit("+00:00"))
    )


def json_string(col) -> Column:
    """JSON string literal as Python's ``json.dumps`` writes it (ASCII-escaped).

    Covers quote, backslash, control characters and non-ASCII (as \\uXXXX,
    surrogate pairs for astral code points) using built-ins only. A string of
    characters that stand for themselves costs one search.
    """
    c = _c(col)
    body = F.when(c.rlike(r"[^ !#-\[\]-~]"), _json_escape_body(c)).otherwise(c)
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def _json_escape_body(c: Column) -> Column:
    esc = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    esc = F.replace(esc, F.lit('"'), F.lit('\\"'))
    for ch, rep in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        esc = F.replace(esc, F.lit(ch), F.lit(rep))
    # Remaining control chars and all non-ASCII need \\uXXXX escapes; only
    # rows that contain such characters take the per-character path.
    needs = esc.rlike(r"[\x{0}-\x{1f}\x{7f}-\x{10ffff}]")
    per_char = F.transform(
        F.regexp_extract_all(esc, F.lit("(?s)."), 0),
        lambda ch: F.when(ch.rlike(r"^[\x{20}-\x{7e}]$"), ch).otherwise(_u_escape(ch)),
    )
    return F.when(needs, F.array_join(per_char, "")).otherwise(esc)


def _u_escape(ch: Column) -> Column:
    """``\\uXXXX`` (or a surrogate pair) for one character, like ``json.dumps``."""
    h = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
    pair = F.concat(F.lit("\\u"), F.substring(h, 1, 4), F.lit("\\u"), F.substring(h, 5, 4))
    return F.when(F.length(h) == 4, F.concat(F.lit("\\u"), h)).otherwise(pair)
