"""Burrows-Wheeler transform and common prefixes of many strings, built column by column.

Round j inserts the suffixes of length j of all strings at once: one symbol
a string, from the right. A suffix's place follows from the place of its
tail (the suffix one shorter) and the number of equal symbols before that;
its common prefix with its neighbour is one more than the least common
prefix between their tails. Both come from one sequential reading of the
transform so far; a second one writes it with the new entries put in.
Symbols and prefixes lie in files that are only read and written from front
to back, in blocks. Which suffix an entry is of is not carried along: at the
end each string is followed through the transform, from its last symbol to
its first, all strings at a time.

The files belong to the process alone (they have no name once opened), are
read by nobody else, and go when it ends; a lost task starts over.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: The symbol before a whole string; no byte of UTF-8 text has this value. A string that another one goes on from sorts first.
END = 255
#: Entries read and written at a time.
BLOCK = 1 << 17
#: Common prefixes are counted up to less than this.
_NONE = 255


class _Column:
    """An array of 16-bit entries (symbol x 256 + prefix) in two files: a round reads one and writes the other."""

    dtype = np.dtype(np.uint16)

    def __init__(self, first: np.ndarray):
        self.now, self.next = tempfile.TemporaryFile(), tempfile.TemporaryFile()
        first.astype(self.dtype).tofile(self.now)
        self.now.flush()

    def start(self):
        self.now.seek(0)

    def read(self, n: int) -> np.ndarray:
        return np.frombuffer(self.now.read(n * self.dtype.itemsize), self.dtype)

    def write(self, values: np.ndarray):
        self.next.write(values.data)

    def turn(self):
        self.next.flush()
        self.now, self.next = self.next, self.now
        self.next.seek(0)

    def close(self):
        self.now.close()
        self.next.close()


def shared_suffixes(text: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes that share ``least`` or more symbols with a neighbour, in sorted order.

    ``text``: the strings' bytes in a row, ``ends``: where each one ends.
    Returns (string number, suffix length, whether it shares them with the
    suffix before). Common prefixes are counted up to ``least``.
    """
    if least >= _NONE:
        raise ValueError(f"common prefixes are counted up to less than {_NONE}")
    count = len(ends)
    lengths = np.diff(np.concatenate([[0], ends]))
    if not count or lengths.max() < least:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    size = count
    first = np.where(lengths > 0, text[np.maximum(ends - 1, 0)], END).astype(np.uint16)
    column = _Column(first << 8)
    place, who = np.arange(count), np.arange(count)
    try:
        for j in range(1, int(lengths.max()) + 1):
            mine = lengths[who] >= j           # the others ended in the round before
            place, who, prefix, changed = _places(column, size, count, place[mine], who[mine], least)
            more = lengths[who] > j
            symbol = np.where(more, text[np.where(more, ends[who] - j - 1, 0)], END).astype(np.uint16)
            _insert(column, size, place, symbol << 8 | prefix, changed)
            size += len(place)
        return _sharing(column, size, count, lengths, least)
    finally:
        column.close()


def _places(column: _Column, size: int, count: int, tails: np.ndarray, who: np.ndarray, least: int):
    """Where the suffixes go whose tails were put at the places ``tails``, and what that changes.

    Returns their places (rising), their strings, their common prefixes, and
    (places, prefixes) of older entries whose neighbour before is new.
    """
    column.start()
    seen = np.zeros(256, np.int64)             # of each symbol, in the blocks before
    since = np.full(256, _NONE, np.uint8)      # least common prefix since its last one
    was_new = np.zeros(256, bool)              # whether that one is among the tails
    parts = []
    for at in range(0, size, BLOCK):
        n = min(BLOCK, size - at)
        entries = column.read(n)
        b, p = (entries >> 8).astype(np.uint8), entries.astype(np.uint8)
        lo, hi = np.searchsorted(tails, (at, at + n))
        order = np.argsort(b, kind="stable")
        sizes = np.bincount(b, minlength=256)
        sizes[END] = 0
        first = np.concatenate([[0], np.cumsum(sizes)])[:256]
        heads = np.flatnonzero(sizes)
        spots = tails[lo:hi] - at              # of the tails in this block
        mine = b[spots]
        inverse = np.empty(n, np.int32)
        inverse[order] = np.arange(n, dtype=np.int32)
        turn = inverse[spots]                  # and in ``order``
        next_ = turn[turn + 1 < first[mine] + sizes[mine]] + 1
        wanted, is_tail, number = np.zeros(n, bool), np.zeros(n, bool), np.empty(n, np.int32)
        wanted[turn] = is_tail[turn] = True
        number[turn] = np.arange(lo, hi)
        wanted[next_] = wanted[first[heads[was_new[heads]]]] = True
        e = np.flatnonzero(wanted)
        tail = np.where(is_tail[e], number[e], -1)
        v = order[e]
        s = b[v]
        rank = seen[s] + e - first[s]
        head = e == first[s]
        value = np.empty(len(e), np.uint8)
        inner = np.flatnonzero(~head)
        heading = np.flatnonzero(head)
        if len(heading):
            before = np.minimum.accumulate(p)
            value[heading] = np.minimum(since[s[heading]], before[v[heading]])
        if len(inner):
            start, stop = order[e[inner] - 1] + 1, v[inner] + 1
            by = np.argsort(start, kind="stable")
            cuts = np.stack([start[by], stop[by]], 1).ravel()
            value[inner[by]] = np.minimum.reduceat(np.append(p, np.uint8(_NONE)), cuts)[::2]
        prefix = np.where(rank == 0, 0, np.minimum(value.astype(np.int16) + 1, least)).astype(np.uint8)
        parts.append((s, rank, prefix, tail))
        last = order[first[heads] + sizes[heads] - 1]
        since = np.minimum(since, p.min())
        since[heads] = _least_after(p, last)
        was_new[heads] = is_tail[first[heads] + sizes[heads] - 1]
        seen += sizes
    s, rank, prefix, tail = (np.concatenate(x) for x in zip(*parts))
    place = count + np.concatenate([[0], np.cumsum(seen)])[s] + rank
    by = np.argsort(place, kind="stable")
    place, prefix, tail = place[by], prefix[by], tail[by]
    new = tail >= 0
    return place[new], who[tail[new]], prefix[new], (place[~new], prefix[~new])


def _least_after(p: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each place in ``last`` the least prefix beyond it, _NONE at the end."""
    by = np.argsort(last)
    edges = last[by] + 1
    out = np.full(len(last), _NONE, np.uint8)
    inside = np.flatnonzero(edges < len(p))
    if len(inside):
        parts = np.minimum.reduceat(p, edges[inside])
        out[by[inside]] = np.minimum.accumulate(parts[::-1])[::-1]
    return out


def _insert(column: _Column, size: int, place: np.ndarray, values: np.ndarray, changed) -> None:
    """Write the column again with ``values`` at the new places; ``changed`` are places and prefixes of older entries."""
    column.start()
    total = size + len(place)
    for at in range(0, total, BLOCK):
        n = min(BLOCK, total - at)
        lo, hi = np.searchsorted(place, (at, at + n))
        old = np.ones(n, bool)
        old[place[lo:hi] - at] = False
        out = np.empty(n, column.dtype)
        out[old] = column.read(n - (hi - lo))
        out[place[lo:hi] - at] = values[lo:hi]
        a, z = np.searchsorted(changed[0], (at, at + n))
        k = changed[0][a:z] - at
        out[k] = out[k] & 0xFF00 | changed[1][a:z]
        column.write(out)
    column.turn()


def _sharing(column: _Column, size: int, count: int, lengths: np.ndarray, least: int):
    """Follow each string through the whole transform, and keep the entries that share ``least`` symbols with a neighbour."""
    column.start()
    entries = column.read(size)
    b, joined = (entries >> 8).astype(np.uint8), (entries & 0xFF) >= least
    order = np.argsort(b, kind="stable")
    follows = np.empty(size, np.int64)         # the place of the suffix one longer
    follows[order] = np.arange(count, count + size)
    keep = joined.copy()
    keep[:-1] |= joined[1:]
    owner, left = np.empty(size, np.int32), np.empty(size, np.int32)
    place, who = np.arange(count), np.arange(count)
    for j in range(1, int(lengths.max()) + 1):
        mine = lengths[who] >= j
        place, who = follows[place[mine]], who[mine]
        owner[place], left[place] = who, j
    return owner[keep].astype(np.int64), left[keep].astype(np.int64), joined[keep]
