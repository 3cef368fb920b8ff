"""Pre-tokens of byte-level BPE, found for whole batches with numpy.

The split is the one of the public pattern ``'s|'t|'re|'ve|'m|'ll|'d|
?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Instead of matching it
text by text, every code point gets a class, runs of a class are found by
comparing neighbours, and three local rules move the borders:

* the last white space before something else starts a pre-token of its own
  (``\\s+(?!\\S)`` leaves it); if it is a blank, what follows belongs to it;
* a contraction after an apostrophe that starts a pre-token ends after its
  letters.

``PretokenCache`` encodes each distinct pre-token of a batch once and keeps
the results for later batches, up to a bound of entries and of bytes; then it
starts anew.
"""

from __future__ import annotations

import unicodedata

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3

#: Code points with the White_Space property (fixed values).
WHITE_SPACE = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008,
    0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]


def class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    t = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)),
                    np.uint8, 0x110000)
    t[WHITE_SPACE] = SPACE
    return t


class Batch:
    """Pre-token spans of some texts: byte ranges ``start:end`` of ``raw``, and per text
    the number of its first pre-token (``first``, one more entry than texts)."""

    def __init__(self, texts: list[str], classes: np.ndarray):
        joined = "".join(texts)
        self.data = joined.encode("utf-8")
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        cps = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        n = len(cps)
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(len(texts) + 1, np.int64)
        else:
            begins = _begins(cps, classes, offsets)
            if len(self.data) == n:
                at = begins
            else:
                width = np.ones(n, np.uint8)
                for limit in (0x7F, 0x7FF, 0xFFFF):
                    width += cps > limit
                at = (np.cumsum(width, dtype=np.int64) - width)[begins]
            self.start = at
            self.end = np.append(at[1:], len(self.data))
            self.first = np.searchsorted(begins, offsets)
        # words of 8 bytes at any offset; the padding keeps the last ones readable
        padded = np.frombuffer(self.data + b"\0" * 24, np.uint8)
        self._words = np.ndarray((len(self.data) + 16,), "<u8", padded.data, strides=(1,))

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first 16 bytes of each pre-token as two words, and its length: exact up to 16 bytes."""
        length = self.end - self.start
        low = self._words[self.start] & _MASK[np.minimum(length, 8)]
        high = self._words[self.start + 8 * (length > 8)] & _MASK[np.clip(length - 8, 0, 8)]
        return low, high, length


_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], "<u8")


def _begins(cps: np.ndarray, classes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(cps)
    kind = classes[cps]
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    run = np.empty(n + 1, bool)
    run[0] = run[n] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:n])
    run |= text_start
    tok = run.copy()
    at = np.flatnonzero(run[:n] & ~text_start[:n] & (kind != SPACE))
    at = at[kind[at - 1] == SPACE]
    tok[at - 1] = True
    tok[at[cps[at - 1] == 0x20]] = False

    mark = np.flatnonzero(cps == 0x27)
    mark = mark[tok[mark]]
    mark = mark[~text_start[mark + 1]]
    mark = mark[kind[mark + 1] == LETTER]
    if len(mark):
        one, padded = cps[mark + 1], np.append(cps, np.uint32(0))
        two = np.where(text_start[mark + 2], 0, padded[np.minimum(mark + 2, n)])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) \
            | ((one == ord("l")) & (two == ord("l")))
        mark, stop = mark[short | long], (mark + np.where(short, 2, 3))[short | long]
        tok[mark + 1] = False
        stop = stop[stop < n]
        tok[stop[kind[stop] == LETTER]] = True
    return np.flatnonzero(tok[:n])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``start, start+1, ...`` of all ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class PretokenCache:
    """Token ids of pre-tokens; ``encode_new(list of bytes) -> list of id lists``.

    ``known(low, high, length) -> ids or -1`` may resolve pre-tokens of up to
    16 bytes that are single tokens before the cache is asked. ``max_bytes``
    bounds what is kept from batch to batch (pre-tokens, ids and the table's
    own ENTRY bytes each), however long the pre-tokens are.
    """

    ENTRY = 160

    def __init__(self, encode_new, known=None, max_entries: int = 1_000_000, max_bytes: int = 1 << 27):
        self.encode_new, self.known, self.max_entries, self.max_bytes = encode_new, known, max_entries, max_bytes
        self.classes = class_table()
        self._reset()

    def _reset(self):
        self.index: dict[bytes, int] = {}
        self.at = np.zeros(1024, np.int64)
        self.len = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.used = self.bytes = 0

    def _add(self, words: list[bytes]) -> None:
        got = self.encode_new(words)
        lens = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter((i for x in got for i in x), np.uint32, int(lens.sum()))
        k = len(self.index)
        while k + len(words) > len(self.at):
            self.at, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.len))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.at[k:k + len(words)] = self.used + np.cumsum(lens) - lens
        self.len[k:k + len(words)] = lens
        self.flat[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.bytes += self.ENTRY * len(words) + sum(map(len, words)) + 4 * len(ids)
        for i, w in enumerate(words, k):
            self.index[w] = i

    def _lookup(self, words: list[bytes]) -> np.ndarray:
        get = self.index.get
        got = [get(w, -1) for w in words]
        if -1 in got:
            self._add(list(dict.fromkeys(w for w, i in zip(words, got) if i < 0)))
            got = [get(w) for w in words]
        return np.array(got, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offset of each text (one more than texts)."""
        if len(self.index) > self.max_entries or self.bytes > self.max_bytes:
            self._reset()
        b = Batch(texts, self.classes)
        low, high, length = b.keys()
        n = len(length)
        single = np.full(n, -1, np.int64)   # a token id, where known() resolved it
        entry = np.zeros(n, np.int64)       # else a cache entry
        small = np.flatnonzero(length <= 16)
        mix = (low[small] * np.uint64(0x9E3779B97F4A7C15)) ^ (
            (high[small] + length[small].astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F))
        mix ^= mix >> np.uint64(29)
        _, pick, inverse = np.unique(mix, return_index=True, return_inverse=True)
        rep = small[pick]
        same = rep[inverse]
        odd = small[(low[same] != low[small]) | (high[same] != high[small]) | (length[same] != length[small])]
        ids = self.known(low[rep], high[rep], length[rep]) if self.known else np.full(len(rep), -1, np.int64)
        rest = np.flatnonzero(ids < 0)
        found = np.zeros(len(rep), np.int64)
        others = np.concatenate([np.flatnonzero(length > 16), odd])
        data = b.data
        ask = np.concatenate([rep[rest], others])
        words = [data[s:e] for s, e in zip(b.start[ask].tolist(), b.end[ask].tolist())]
        got = self._lookup(words)
        found[rest] = got[:len(rest)]
        single[small], entry[small] = ids[inverse], found[inverse]
        single[others], entry[others] = -1, got[len(rest):]

        hit = single >= 0
        lens = np.where(hit, 1, self.len[entry])
        ends = np.cumsum(lens)
        out = self.flat[ragged(np.where(hit, 0, self.at[entry]), lens)] if n else np.zeros(0, np.uint32)
        out[(ends - lens)[hit]] = single[hit]
        offsets = np.concatenate([[0], ends])[b.first]
        return out, offsets


def chunks(texts, max_chars: int):
    """Cut an iterable of texts into lists of about ``max_chars`` characters (one text at least)."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > max_chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part
