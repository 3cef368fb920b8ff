"""Regex dialect adaptation.

Rules are written in Python ``re`` syntax. Spark evaluates Java regexes and
the DuckDB oracle evaluates RE2; both need small adjustments to agree with
Python's Unicode-aware classes:

* Java: ``(?U)`` turns ``\\d \\s \\w \\b`` Unicode-aware; Python's ``\\s``
  additionally covers U+001C..U+001F, so ``\\s`` is widened.
* RE2: ``\\s`` and ``\\d`` are ASCII only, so they are spelled out as the
  explicit Unicode whitespace class and ``\\p{Nd}``. RE2's ``\\b`` stays
  ASCII (documented deviation for non-ASCII letters next to digits).
"""

from __future__ import annotations

import functools
import re

JAVA = "java"
RE2 = "re2"


@functools.lru_cache(maxsize=1)
def whitespace_chars() -> str:
    """Characters Python's ``str.isspace`` / ``str.strip`` / ``str.split`` treat as whitespace."""
    return "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def _class_body(chars: str) -> str:
    """Compact ``\\x{..}`` character-class body for a set of code points."""
    cps = sorted(ord(c) for c in chars)
    out, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        lo, hi = cps[i], cps[j]
        out.append(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
        i = j + 1
    return "".join(out)


def ws_class_body() -> str:
    return _class_body(whitespace_chars())


def ws_class() -> str:
    """Character class matching exactly Python's whitespace; valid in Java and RE2."""
    return f"[{ws_class_body()}]"


def not_ws_class() -> str:
    return f"[^{ws_class_body()}]"


def strip_pattern() -> str:
    """Pattern whose removal equals Python ``str.strip()``."""
    return f"^{ws_class()}+|{ws_class()}+$"


def java_strip_pattern() -> str:
    """``strip_pattern`` for Java, which tries ``ws+$`` anew from each blank of a run inside the text; here only from its first."""
    return f"^{ws_class()}++|(?<!{ws_class()}){ws_class()}++\\z"


def _ipv6() -> str:
    """An IPv6 address: eight groups, the last two perhaps as IPv4, one run of groups perhaps left out."""
    h = "[0-9A-Fa-f]{1,4}"
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    end = rf"(?:{h}:{h}|{octet}(?:\.{octet}){{3}})"
    forms = [f"(?:{h}:){{6}}{end}"]
    for n in range(5, -1, -1):                 # n groups between the gap and the last two
        before = f"(?:(?:{h}:){{0,{4 - n}}}{h})?" if n < 5 else ""
        forms.append(f"{before}::(?:{h}:){{{n}}}{end}")
    forms += [f"(?:(?:{h}:){{0,5}}{h})?::{h}", f"(?:(?:{h}:){{0,6}}{h})?::"]
    return "(?:" + "|".join(forms) + ")"


#: What may stand between the brackets of a host: an IPv6 address (with a zone, perhaps) or a future form.
BRACKETED = rf"\A(?:{_ipv6()}(?:%[^%]+)?|v[0-9A-Fa-f]+\.[^\n]+)\z"


def _rewrite_escapes(pattern: str, mapping_out: dict, mapping_in: dict) -> str:
    """Rewrite backslash escapes, using a different mapping inside ``[...]``."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            esc = pattern[i : i + 2]
            table = mapping_in if in_class else mapping_out
            out.append(table.get(esc, esc))
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
            out.append(ch)
            # a leading ']' or '^]' is literal inside a class
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                out.append("]")
                i += 1
        elif ch == "]" and in_class:
            in_class = False
            out.append(ch)
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def _flat_word_runs(pattern: str) -> str:
    """Write ``[w]+(?:\\s+[w]+)*\\s+`` as ``[w][w\\s]*\\s``: the same strings, one loop.

    Java matches a repeated group by recursion, one level for each word, and
    runs out of stack on long plain text; a repeated class is a plain loop.
    """
    return re.sub(r"\[([^\]\\]+)\]\+\(\?:\\s\+\[\1\]\+\)\*\\s\+",
                  lambda m: f"[{m[1]}][{m[1].removesuffix('-')}\\s{'-' * m[1].endswith('-')}]*\\s", pattern)


@functools.lru_cache(maxsize=None)
def adapt(pattern: str, case_insensitive: bool = False, dialect: str = JAVA) -> str:
    """Translate a Python-syntax pattern so it matches like Python's ``re``."""
    if dialect == JAVA:
        body = _rewrite_escapes(
            _flat_word_runs(pattern),
            {r"\s": r"[\s\x{1c}-\x{1f}]"},
            {r"\s": r"\s\x{1c}-\x{1f}"},
        )
        return ("(?iU)" if case_insensitive else "(?U)") + body
    if dialect == RE2:
        ws = ws_class_body()
        body = _rewrite_escapes(
            pattern,
            {r"\s": f"[{ws}]", r"\d": r"\p{Nd}"},
            {r"\s": ws, r"\d": r"\p{Nd}"},
        )
        return ("(?i)" if case_insensitive else "") + body
    raise ValueError(f"unknown regex dialect {dialect!r}")


def sql_literal(text: str) -> str:
    """Single-quoted SQL string literal (standard quote doubling only)."""
    return "'" + text.replace("'", "''") + "'"
