"""Forms of two shapes of rule that Java matches in time linear in the text.

Java's matcher tries a pattern from every character. A rule that begins with
an open run of characters, or that looks for its end in an open run, then
reads the same run over and over: a token of a million letters, or twenty
thousand numbers in a line, take hours. The forms here read a run once and
give the same matches.

``run rule``: ``[C]+`` followed by a literal outside C. From every start
inside a run of C the rest is the same, so only the run's first character
needs trying, or the character after the match before (``\\G``).

``span rule``: a number, then plain words, up to the last of some closing
words in the same run of plain characters. If the first number of a run
finds no closing word, no later one does; so the text is cut into pieces, a
piece being a match (the pattern's first group), a number with the whole run
after it, or anything else.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from . import regex


@dataclass(frozen=True)
class Form:
    """``pattern`` finds the matches; if ``pieces``, it cuts the whole text up, and its first group is set in matches."""

    pattern: str
    pieces: bool = False


_RUN_RULE = re.compile(r"^(\[[^\]^][^\]]*\])\+([^\[\\(.*+?{|])(\[[^\]^][^\]]*\])\+(\\.)(\[[^\]^][^\]]*\]\+)$")
_SPAN_RULE = re.compile(r"^(\\b\\d\{\d+,\d+\}\\s\+)(\[[^\]\\^]+\])\+\(\?:\\s\+\2\+\)\*\\s\+\(\?:[A-Za-z|]+\)\\b$")


def _inside(cls: str, ch: str) -> bool:
    return re.fullmatch(cls, ch) is not None


@functools.lru_cache(maxsize=None)
def form_of(pattern: str, case_insensitive: bool) -> Form | None:
    """The linear form of a rule of one of the two shapes, else None."""
    run = _RUN_RULE.match(pattern)
    if run and not case_insensitive:
        local, sign, label, dot, rest = run.groups()
        if not _inside(local, sign) and not _inside(label, dot[1]):
            return Form(rf"(?:\G|(?<!{local})){local}++{sign}{label}++{dot}{rest}")
    span = _SPAN_RULE.match(pattern)
    if span:
        number, plain = span.groups()
        flags = "(?iU)" if case_insensitive else "(?U)"
        java = regex.adapt(pattern, case_insensitive).removeprefix(flags)
        start = regex.adapt(number, case_insensitive).removeprefix(flags)
        blanks = regex.adapt(r"[\s]", case_insensitive).removeprefix(flags)[1:-1]
        run_of = f"[{plain[1:-1].removesuffix('-')}{blanks}{'-' * plain[1:-1].endswith('-')}]"
        return Form(rf"{flags}({java})|{start}{plain}{run_of}*+|\d+|\D+", pieces=True)
    return None
