"""Substring dedup: repeated passages across documents by collinear chaining.

1. Seeds: minimizers of word k-mers (the least hash of each ``WINDOW``
   k-mers in a row), so two texts that share ``K + WINDOW - 1`` words in a
   row share a seed.
2. Matches: each seed is joined with its first document only (the least
   doc_id that has it), so a passage in n documents makes n - 1 matches.
   Where a document's seeds come from several documents, windows of
   ``min_words`` words are joined in the same way, as a passage's first
   document need not be that of its seeds.
3. Chains: per pair of documents the matches, merged along diagonals, are
   chained in order; a gap costs a share of its length, and a Fenwick tree
   of prefix maxima finds the best predecessor. Every chain goes on.
4. Alignment: along each chain the words of both texts are compared, also
   beyond its ends and across its gaps. A passage is a run of aligned words
   with gaps of ``MAX_GAP`` words at most, ``min_words`` long or longer, of
   which at least ``similarity`` are equal.

The first document keeps its passage; later documents are the ones found.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, discard, give_back_memory, keep_freed_memory, release_shuffles, small_batches, sorted_groups, written

#: WINDOW is at most K: seeds at most WINDOW apart then leave no word between them uncompared.
K, WINDOW = 5, 5
#: Words compared beyond a chain's ends; unequal words that a passage may bridge.
REACH, MAX_GAP = 96, 4
#: A text can be cut before every so many words.
MARK = 16
#: Cost of a gap for each word skipped on either side; longest gap merged along one diagonal.
GAP_COST, SAME_DIAGONAL = 0.1, 64
#: Bytes of other texts that a worker splits into words at once.
PART_BYTES = 1 << 18
#: A passage's first and last equal run has this many words at least.
EDGE = 3

WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8").lower().split()


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def starts_of(data: bytes) -> np.ndarray:
    """Byte offsets at which words begin."""
    blank = _BLANK[np.frombuffer(data, np.uint8)]
    begins = ~blank
    begins[1:] &= blank[:-1]
    return np.flatnonzero(begins)


_IS_BLANK = _BLANK.astype(np.uint8).tobytes()
#: The first 0 to 8 bytes of a little-endian number; odd factors of a word's length and its 8-byte pieces.
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _numbers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a piece of text begin, and a hash of each."""
    blank = np.frombuffer(data.translate(_IS_BLANK), bool)
    change = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        change = np.append(0, change)
    if len(change) % 2:
        change = np.append(change, len(data))
    starts, sizes = change[::2], change[1::2] - change[::2]
    eight = np.ndarray((len(data),), "<u8", data + bytes(8), strides=(1,))
    out = (eight[starts] & _MASKS[np.minimum(sizes, 8)]) * _FACTORS[1] + sizes.astype(np.uint64) * _FACTORS[0]
    i, at, left = np.flatnonzero(sizes > 8), 0, sizes
    while len(i):                                                          # the words that go on
        at += 8
        left = sizes[i] - at
        piece = eight[starts[i] + at] & _MASKS[np.minimum(left, 8)]
        turn = at // 8 % 62 + 2
        if turn == 2:                                                      # the factors come again
            out[i] = (out[i] ^ (out[i] >> np.uint64(31))) * _FACTORS[1]
        out[i] += piece * _FACTORS[turn]
        i = i[left > 8]
    return starts, out ^ (out >> np.uint64(32))


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, A-Z as a-z, and each text's number of words.

    A hash is the sum of a word's length and 8-byte pieces, each times an odd
    random factor of its place: different words of up to 8 bytes and one
    length never get the same one, others with a chance of some 2^-56.
    ``PART_BYTES`` are taken at once, and the rest of a word.
    """
    data = b" ".join(texts).lower()
    out, starts, x = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while x < len(data):
        y = x + PART_BYTES
        while y < len(data) and not _BLANK[data[y]]:
            y += 1
        at, h = _numbers(data[x:y])
        starts.append(at + x)
        out.append(h)
        x = y
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    return np.concatenate(out).view(np.int64), np.diff(np.searchsorted(np.concatenate(starts), ends), prepend=0)


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def hashes_of(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    return rolled(word_hashes(words), size)


def rolled(w: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, from the words' hashes."""
    n = len(w) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + w[i:i + n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def window_hashes(w: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, from the words' hashes, at a cost that does not grow with ``size``."""
    n = len(w) - size + 1
    if n < 1:
        return np.zeros(0, np.int64)
    powers = lambda base, many: np.cumprod(np.append(np.uint64(1), np.full(many - 1, base, np.uint64)))
    base = 0x9E3779B97F4A7C15
    total = np.append(np.uint64(0), np.cumsum(w.view(np.uint64) * powers(base, len(w))))
    out = (total[size:] - total[:n]) * powers(pow(base, -1, 1 << 64), n)
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def seeds_of_texts(w: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizers of texts that lie one after the other: hash, number of the text, position; by text and position.

    ``w``: the words' hashes; ``many``: each text's number of words.
    """
    n = len(w) - K + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.cumsum(many)
    kmer = rolled(w, K)
    pick = np.zeros(len(w), bool)
    m = n - WINDOW + 1
    if m > 0:
        least, off = kmer[:m].copy(), np.zeros(m, np.int64)
        for j in range(1, WINDOW):
            less = kmer[j:m + j] < least
            np.copyto(least, kmer[j:m + j], where=less)
            off[less] = j
        at = np.flatnonzero(np.repeat(end, many)[:m] - np.arange(m) >= K + WINDOW - 1)  # within one text
        pick[at + off[at]] = True
    for i in np.flatnonzero((many >= K) & (many < K + WINDOW - 1)):
        x = int(end[i] - many[i])
        pick[x + kmer[x:end[i] - K + 1].argmin()] = True
    at = np.flatnonzero(pick)
    text = np.searchsorted(end, at, side="right")
    return kmer[at].view(np.int64), text, at - (end - many)[text]


def seeds_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a text's minimizers, by position."""
    h, _, at = seeds_of_texts(word_hashes(words), np.array([len(words)]))
    return h, at


class PrefixMax:
    """Fenwick tree: set values at places, ask for the greatest at places below another."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: float, who: int) -> None:
        i += 1
        while i < len(self.best):
            if self.best[i][0] < value:
                self.best[i] = (value, who)
            i += i & -i

    def below(self, i: int) -> tuple[float, int]:
        """Greatest value at places 0..i-1, and whose it is."""
        out = (-1e18, -1)
        while i > 0:
            if self.best[i][0] > out[0]:
                out = self.best[i]
            i -= i & -i
        return out


def open_windows(pos: np.ndarray, rep: np.ndarray, diag: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Windows of ``min_words`` words (first, number) that may be repeats, and are no part of one exact match.

    ``pos``: a document's seeds that several documents have, ascending, with
    the first document of each and the diagonal there. Any ``K + WINDOW - 1``
    words of a repeat have such a seed, so the windows lie in runs of seeds
    at most WINDOW apart. A window within words that all match one document
    along one diagonal is left out: an equal window of any other document
    has the same seeds, so its chain leads to that document too.
    """
    out = []
    runs = np.flatnonzero(np.diff(pos, prepend=-2 * WINDOW) > WINDOW)
    for x, y in zip(runs, np.append(runs[1:], len(pos))):
        lo, hi = max(0, int(pos[x]) - WINDOW + 1), int(pos[y - 1]) + K + WINDOW - 1
        if hi - lo < min_words:
            continue
        p, r, d = pos[x:y], rep[x:y], diag[x:y]
        cut = np.flatnonzero((r[1:] != r[:-1]) | (d[1:] != d[:-1]) | (p[1:] - p[:-1] > K) | (p[1:] == p[:-1])) + 1
        for i, j in zip(np.append(0, cut), np.append(cut, y - x)):
            begin, stop = int(p[i]), int(p[j - 1]) + K - min_words + 1  # windows within the words that match
            if stop > begin:
                if begin > lo:
                    out.append((lo, begin - lo))
                lo = max(lo, stop)
        if hi - min_words + 1 > lo:
            out.append((lo, hi - min_words + 1 - lo))
    return out


def segments_of_pairs(doc: np.ndarray, rep: np.ndarray, pos: np.ndarray, rpos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matches of pairs of documents merged along diagonals: doc, rep, start, start in the other text, length; in this order."""
    diag = pos - rpos
    order = np.lexsort((pos, diag, rep, doc))
    doc, rep, p, d = doc[order], rep[order], pos[order], diag[order]
    new = np.ones(len(p), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (rep[1:] != rep[:-1]) | (d[1:] != d[:-1]) | (p[1:] - p[:-1] > SAME_DIAGONAL)
    s = np.flatnonzero(new)
    last = np.append(s[1:], len(p)) - 1
    out = doc[s], rep[s], p[s], p[s] - d[s], p[last] - p[s] + K
    order = np.lexsort((out[3], out[2], out[1], out[0]))
    return tuple(c[order] for c in out)


def segments(pos: np.ndarray, rpos: np.ndarray) -> np.ndarray:
    """Matches merged along diagonals: rows (start, start in the other text, length)."""
    one = np.zeros(len(pos), np.int64)
    return np.stack(segments_of_pairs(one, one, pos, rpos)[2:], axis=1)


def chains(seg: np.ndarray) -> list[list[int]]:
    """Collinear chains of segments (each segment in one), best first; ends before starts, in both texts."""
    n = len(seg)
    if n == 1:
        return [[0]]
    start, other, length = (seg[:, i].tolist() for i in range(3))
    ends = sorted({o + m for o, m in zip(other, length)})
    place = {e: i for i, e in enumerate(ends)}
    upto = np.searchsorted(ends, seg[:, 1], side="right").tolist()
    tree = PrefixMax(len(ends))
    by_end = sorted(range(n), key=lambda i: start[i] + length[i])
    score, prev, done = [0.0] * n, [-1] * n, 0
    for i in range(n):  # by start
        while done < n and start[by_end[done]] + length[by_end[done]] <= start[i]:
            j = by_end[done]
            tree.put(place[other[j] + length[j]], score[j] + GAP_COST * (start[j] + length[j] + other[j] + length[j]), j)
            done += 1
        value, j = tree.below(upto[i])
        gain = value - GAP_COST * (start[i] + other[i])
        score[i] = length[i] + max(gain, 0.0)
        prev[i] = j if gain > 0 else -1
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = prev[i]
        if chain:
            out.append(chain[::-1])
    return out


#: Words skipped on either side, few first; equal numbers first, as a changed word is likelier than words put in.
SKIPS = sorted(((x, y) for x in range(MAX_GAP + 1) for y in range(MAX_GAP + 1) if x + y),
               key=lambda p: (p[0] + p[1], abs(p[0] - p[1]), p))


def _next_agreement(a: np.ndarray, b: np.ndarray) -> tuple[int, int] | None:
    """The nearest places in two short word sequences from which EDGE words are equal."""
    n, m = len(a) - EDGE + 1, len(b) - EDGE + 1
    if n < 1 or m < 1:
        return None
    one = a[:, None] == b[None, :]
    agree = one[:n, :m].copy()
    for k in range(1, EDGE):
        agree &= one[k:n + k, k:m + k]
    if not agree.any():
        return None
    return next((p for p in SKIPS if p[0] < n and p[1] < m and agree[p]), None)


def extend(a: np.ndarray, b: np.ndarray, room_a: int, room_b: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Follow two word sequences from their starts as long as they agree; equal positions in both.

    Where they differ, the alignment goes on at the nearest place, up to
    MAX_GAP words further on either side, from which EDGE words are equal.
    """
    left, right, i, j = [], [], 0, 0
    room_a, room_b = min(room_a, len(a)), min(room_b, len(b))
    while i < room_a and j < room_b:
        m = min(room_a - i, room_b - j)
        same = a[i:i + m] == b[j:j + m]
        n = m if same.all() else int(np.argmin(same))
        if n:
            left.append(np.arange(i, i + n))
            right.append(np.arange(j, j + n))
            i, j = i + n, j + n
            continue
        skip = _next_agreement(a[i:min(i + MAX_GAP + EDGE, room_a)], b[j:min(j + MAX_GAP + EDGE, room_b)])
        if skip is None:
            break
        i, j = i + skip[0], j + skip[1]
    return left, right


def align(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Align two word sequences along a chain; returns the equal positions in both, ascending.

    Within a segment words are compared along its diagonal. Beyond the
    chain's ends, up to REACH words, and in the gap between two segments
    (forwards from the left one, then backwards from the right one) the
    alignment is extended as long as the texts agree.
    """
    left, right = [], []

    def forwards(s, o, room_a, room_b):
        x, y = extend(a[s:s + room_a], b[o:o + room_b], room_a, room_b)
        left.extend(s + v for v in x)
        right.extend(o + v for v in y)
        return (int(left[-1][-1]) + 1, int(right[-1][-1]) + 1) if x else (s, o)

    def backwards(s, o, room_a, room_b):
        room_a, room_b = min(room_a, s), min(room_b, o)
        x, y = extend(a[s - room_a:s][::-1], b[o - room_b:o][::-1], room_a, room_b)
        left.extend(s - 1 - v for v in x)
        right.extend(o - 1 - v for v in y)

    backwards(chain[0][0], chain[0][1], REACH, REACH)
    for i, (s, o, n) in enumerate(chain):
        n = min(n, len(a) - s, len(b) - o)
        eq = np.flatnonzero(a[s:s + n] == b[o:o + n])
        left.append(s + eq)
        right.append(o + eq)
        if i + 1 < len(chain):
            s2, o2, _ = chain[i + 1]
            if s2 > s + n and o2 > o + n:
                s1, o1 = forwards(s + n, o + n, s2 - s - n, o2 - o - n)
                backwards(s2, o2, s2 - s1, o2 - o1)
        else:
            forwards(s + n, o + n, REACH, REACH)
    left, right = np.concatenate(left), np.concatenate(right)
    order = np.argsort(left, kind="stable")
    return left[order], right[order]


def passages(left: np.ndarray, right: np.ndarray, min_words: int, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """Passages of an alignment: (start, words, start there, words there, equal words)."""
    out = []
    if not len(left):
        return out
    step, there = np.diff(left), np.diff(right)
    runs = np.split(np.arange(len(left)), np.flatnonzero((step != 1) | (there != 1)) + 1)
    group: list[np.ndarray] = []

    def close():
        while group and len(group[0]) < EDGE:
            group.pop(0)
        while group and len(group[-1]) < EDGE:
            group.pop()
        if group:
            i, j, equal = group[0][0], group[-1][-1], sum(map(len, group))
            words, others = left[j] - left[i] + 1, right[j] - right[i] + 1
            if words >= min_words and equal >= similarity * max(words, others):
                out.append((int(left[i]), int(words), int(right[i]), int(others), int(equal)))
        group.clear()

    for run in runs:
        if group and (left[run[0]] - left[group[-1][-1]] - 1 > MAX_GAP or not 0 <= right[run[0]] - right[group[-1][-1]] - 1 <= MAX_GAP):
            close()
        group.append(run)
    close()
    return out


def along_diagonals(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]], min_words: int,
                    similarity: float) -> list[tuple[int, int, int, int, int]]:
    """Passages that an alignment along the whole chain may cut short.

    Along each segment's diagonal, up to REACH words around it: runs of equal
    words, and passages of changed words only. Where words were put in or
    left out, an alignment from the segment's first seed and from its last.
    """
    out = []
    for s, o, n in chain:
        back = min(REACH, s, o)
        m = min(n + back + REACH, len(a) - s + back, len(b) - o + back)
        same = a[s - back:s - back + m] == b[o - back:o - back + m]
        eq = np.flatnonzero(same)
        if len(eq) >= similarity * min_words:
            out += passages(s - back + eq, o - back + eq, min_words, similarity)
            ends = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
            for i in np.flatnonzero(np.diff(ends) > min_words):
                e, words = int(ends[i]) - back, int(ends[i + 1] - ends[i]) - 1
                out.append((s + e, words, o + e, words, words))
        if len(chain) > 1 or not same[back:back + n].all():
            for x in {0, max(0, min(n, len(a) - s, len(b) - o) - K)}:
                out += passages(*align(a, b, [(s + x, o + x, K)]), min_words, similarity)
    return out


FOUND = "start long, words long, source_id long, source_start long, source_words long, equal_words long"


def _shared(s: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``h, rep, rpos``: the first document of each hash that a later one has too."""
    shared = s.groupBy("h").agg(F.min("doc").alias("rep"), F.min_by("pos", "doc").alias("rpos"), F.max("doc").alias("last")) \
        .where("last > rep").drop("last")
    # written, so that both sides of the join are dealt out for it alone and a seed that a third
    # of all documents share can be split among tasks
    return written(shared, name)


CHAIN = "doc long, rep long, chain array<struct<s:long,o:long,n:long>>, first long, last long"


def _chain_rows(doc, rep, at, s, o, n, first, last):
    """A batch of chains from flat columns: chain i has the segments ``at[i]`` to ``at[i + 1]``."""
    import pyarrow as pa

    segs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (s, o, n)], names=list("son"))
    cols = [pa.array(doc, pa.int64()), pa.array(rep, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), segs), pa.array(first, pa.int64()), pa.array(last, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=["doc", "rep", "chain", "first", "last"])


def _parts(batch, column: str, size: int) -> Iterator:
    """A batch in slices of some ``size`` bytes of a text column."""
    lengths = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(lengths, lengths[i] + size, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def _exact_chains(texts: DataFrame, open_: DataFrame, min_words: int) -> DataFrame:
    """Chains of one segment: repeats of ``min_words`` words or more, each window with its first document."""
    import pyarrow as pa

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        for batch in batches:
            for part in _parts(batch, "t", PART_BYTES):
                w, many = word_numbers([t.encode("utf-8") for t in part.column("t").to_pylist()])
                ranges = part.column("chain")
                text = np.repeat(np.arange(len(many)), pc.list_value_length(ranges).to_numpy())
                s, n = (ranges.flatten().field(c).to_numpy() for c in "sn")
                n = np.minimum(n, many[text] - min_words + 1 - s)         # another row of the same id
                s, n, text = (c[n > 0] for c in (s, n, text))
                pos = np.arange(n.sum()) + np.repeat(s - np.cumsum(n) + n, n)
                h = window_hashes(w, min_words)[pos + np.repeat((np.cumsum(many) - many)[text], n)] if len(pos) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(part.column("doc").to_numpy()[text], n)), pa.array(pos)], names=["h", "doc", "pos"])
        give_back_memory()

    spark = texts.sparkSession
    w, windows_at = written(texts.join(open_.select("doc", "chain"), "doc").mapInArrow(hashed, "h long, doc long, pos long"), "windows")
    first, first_at = _shared(w, "shared-windows")
    release_shuffles(spark)
    matches = w.join(first, "h").where("doc > rep").select("doc", "rep", "pos", "rpos")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (doc, rep, pos, rpos), _ in sorted_groups(batches, 1):
            diag = pos - rpos
            order = np.lexsort((pos, diag, rep, doc))
            doc, rep, pos, rpos, diag = (c[order] for c in (doc, rep, pos, rpos, diag))
            new = np.ones(len(pos), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (rep[1:] != rep[:-1]) | (diag[1:] != diag[:-1]) | (pos[1:] - pos[:-1] > 1)
            first = np.flatnonzero(new)
            n = pos[np.append(first[1:], len(pos)) - 1] - pos[first] + min_words
            doc, rep, pos, rpos = (c[first] for c in (doc, rep, pos, rpos))
            yield _chain_rows(doc, rep, np.arange(len(n) + 1), pos, rpos, n, rpos, rpos + n)
        give_back_memory()

    out, _ = written(matches.repartition("doc").sortWithinPartitions("doc").mapInArrow(merged, CHAIN), "exact-chains")
    discard(spark, windows_at)
    discard(spark, first_at)
    del matches, w, first
    release_shuffles(spark)
    return out


def _chains(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """``doc, rep, chain`` (array of start, start in rep, length) and the words of rep's text that
    it spans (``first`` to ``last``)."""
    import pyarrow as pa

    names = ["h", "doc", "pos", "first"]

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        for batch in batches:
            for part in _parts(batch, "t", PART_BYTES):
                words = [words_of(t) for t in part.column("t").to_pylist()]
                many = np.array(list(map(len, words)))
                long = many >= min_words
                h, text, pos = seeds_of_texts(word_hashes([x for t in words if len(t) >= min_words for x in t]), many[long])
                order = np.argsort(h, kind="stable")
                new = np.ones(len(h), bool)
                new[1:] = (h[order[1:]] != h[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
                first = np.zeros(len(h), bool)
                first[order] = new
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h, part.column("doc").to_numpy()[long][text], pos, first)], names=names)
        give_back_memory()

    texts = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("t")) \
        .where(F.col("doc").isNotNull() & (F.length("t") >= 2 * min_words - 1))
    spark = docs.sparkSession
    s, seeds_at = written(texts.mapInArrow(seeds, "h long, doc long, pos long, first boolean"), "seeds")
    # a shared seed's first document too: its windows may be the first of a repeat
    first, first_at = _shared(s.where("first"), "shared-seeds")
    release_shuffles(spark)
    matches = s.join(first, "h").select("doc", "rep", "pos", "rpos")
    work = matches.repartition("doc").sortWithinPartitions("doc")

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        for (doc, rep, pos, rpos), starts in sorted_groups(batches, 1):
            order = np.lexsort((rep, pos, doc))
            by_pos = pos[order], rep[order], (pos - rpos)[order]
            open_, mine = [], []
            for x, y in zip(starts[:-1].tolist(), starts[1:].tolist()):
                ranges = open_windows(*(c[x:y] for c in by_pos), min_words)
                if ranges:  # as a row of the document itself
                    open_.append(ranges)
                    mine.append(int(doc[x]))
            at = np.append(0, np.cumsum(list(map(len, open_)), dtype=np.int64))
            s, n = np.array([r for x in open_ for r in x], np.int64).reshape(-1, 2).T
            none = np.zeros(len(mine), np.int64)
            yield _chain_rows(mine, mine, at, s, np.zeros(len(s), np.int64), n, none, none)
            other = doc != rep
            if not other.any():
                continue
            d, r, s, o, n = segments_of_pairs(*(c[other] for c in (doc, rep, pos, rpos)))
            pairs = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1]), [True]]))
            path, many = [], []
            for x, y in zip(pairs[:-1].tolist(), pairs[1:].tolist()):
                if y == x + 1:
                    path.append(x)
                    many.append(1)
                    continue
                for c in chains(np.stack([s[x:y], o[x:y], n[x:y]], axis=1)):
                    path += [x + i for i in c]
                    many.append(len(c))
            d, r, s, o, n = (c[path] for c in (d, r, s, o, n))
            at = np.append(0, np.cumsum(many))
            yield _chain_rows(d[at[:-1]], r[at[:-1]], at, s, o, n, np.minimum.reduceat(o, at[:-1]), np.maximum.reduceat(o + n, at[:-1]))
        give_back_memory()

    made, _ = written(work.mapInArrow(chained, CHAIN), "chains")
    discard(spark, seeds_at)
    discard(spark, first_at)
    del work, matches, s, first
    release_shuffles(spark)
    return made.where("doc != rep").unionByName(_exact_chains(texts, made.where("doc = rep"), min_words))


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``_key, _text, marks``: the byte offsets of words 0, MARK, 2 MARK and so on, and the text's end."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for t in batch.column(1):
                data = t.as_py().encode("utf-8")
                marks.append(np.append(starts_of(data)[::MARK], len(data)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.list_(pa.int32()))], names=["_key", "_text", "marks"])
        give_back_memory()

    kept = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")) \
        .where(F.col("_key").isNotNull() & F.col("_text").isNotNull())
    return kept.mapInArrow(run, "_key long, _text string, marks array<int>")


def _candidates(docs: DataFrame, marked: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """``doc, c``: the chains, each with the words of the other text (in ``marked``) that it may touch (from mark ``lo`` on)."""
    chain = _chains(docs, key, text, min_words)
    spans = chain.withColumn("lo", F.expr(f"cast(greatest(first - {REACH}, 0) div {MARK} as int)")) \
        .withColumn("hi", F.expr(f"cast((last + {REACH}) div {MARK} + 1 as int)"))
    # a mark beyond the text: its end, as is a mark that only another row of the same id has
    at = lambda c: f"coalesce(get(marks, {c}), element_at(marks, -1))"
    part = F.expr(f"substring(cast(_text as binary), {at('lo')} + 1, {at('hi')} - {at('lo')})")
    return spans.join(marked, F.col("rep") == F.col("_key")).select(
        "doc", F.struct("rep", "chain", "lo", part.alias("there")).alias("c"))


def _dealt_out(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """``rows`` (``_key, _text`` and others) with a column ``_chain``, and a row for each chain: first a document's chains, then its texts.

    One shuffle and one sort of plain rows: neither a join nor an aggregate
    has all the chains of a document in a row of the JVM.
    """
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "_key"]
    both = rows.withColumn("_chain", F.lit(None).cast(chains.schema["c"].dataType)) \
        .unionByName(chains.select(F.col("doc").alias("_key"), *none, F.col("c").alias("_chain")))
    return both.repartition(F.coalesce("_key", F.xxhash64("_text"))).sortWithinPartitions("_key", F.isnull("_chain"))


def _texts_with_chains(batches: Iterator, size: int = BATCH_BYTES) -> Iterator[tuple]:
    """The texts among the rows of ``_dealt_out``: a batch, the numbers of its rows that have chains, a list of chains for each of those.

    Chains of some ``size`` bytes at once, or those of one text; rows of one
    id have the same chains.
    """
    import pyarrow as pa

    chains, docs = [], []                                                  # of the last document so far
    for batch in batches:
        text = batch.column("_chain").is_null()
        key = pc.fill_null(batch.column("_key"), -1 << 63).to_numpy()      # rows without a key come first
        is_text = text.to_numpy(zero_copy_only=False)
        chains.append(batch.column("_chain").filter(pc.invert(text)))
        docs.append(key[~is_text])
        if not is_text.any():
            continue
        rows, at = batch.filter(text), key[is_text]
        chain, doc = pa.concat_arrays(chains), np.concatenate(docs)
        first, last = np.searchsorted(doc, at), np.searchsorted(doc, at, side="right")
        last[rows.column("_key").is_null().to_numpy(zero_copy_only=False)] = 0
        many = np.maximum(last - first, 0)
        upto = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(chain.field("there")), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
        ends = np.append(0, np.cumsum(np.where(many, upto[last] - upto[first], 0)))
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + size, side="right")) - 1)
            which = np.flatnonzero(many[i:j])
            n = many[i:j][which]
            stop = np.cumsum(n)
            pick = np.arange(n.sum()) + np.repeat(first[i:j][which] - stop + n, n)
            yield rows.slice(i, j - i), which, pa.ListArray.from_arrays(pa.array(np.append(0, stop), pa.int32()), chain.take(pa.array(pick)))
            i = j
        x = int(np.searchsorted(doc, key[-1]))
        chains, docs = [chain[x:]], [doc[x:]]


class Chains(NamedTuple):
    """Chains of some texts in flat columns: text i has chains ``of[i]`` to ``of[i + 1]``, chain c the segments ``at[c]`` to ``at[c + 1]``."""

    of: np.ndarray
    rep: np.ndarray
    lo: np.ndarray
    there: list[bytes]
    at: np.ndarray
    s: np.ndarray
    o: np.ndarray
    n: np.ndarray

    @classmethod
    def from_arrow(cls, lists) -> Chains:
        of, c = lists.offsets.to_numpy(), lists.values
        at, seg = c.field("chain").offsets.to_numpy(), c.field("chain").values
        plain = lambda x, first, last: x[first:last].to_numpy(zero_copy_only=False).astype(np.int64)
        first, last = of[0], of[-1]
        at = at[first:last + 1].astype(np.int64)
        return cls(of.astype(np.int64) - first, plain(c.field("rep"), first, last), plain(c.field("lo"), first, last), c.field("there")[first:last].to_pylist(),
                   at - at[0], *(plain(seg.field(x), at[0], at[-1]) for x in "son"))

    @classmethod
    def from_rows(cls, rows: list[list[dict]]) -> Chains:
        cs = [c for r in rows for c in r]
        seg = np.array([[x[k] for k in "son"] for c in cs for x in c["chain"]], np.int64).reshape(-1, 3)
        ends = lambda x: np.append(0, np.cumsum(list(map(len, x)), dtype=np.int64)).astype(np.int64)
        return cls(ends(rows), np.array([c["rep"] for c in cs], np.int64), np.array([c["lo"] for c in cs], np.int64), [c["there"] for c in cs],
                   ends([c["chain"] for c in cs]), *seg.T)

    def part(self, i: int, j: int) -> Chains:
        """The chains of texts i to j."""
        first, last = self.of[i], self.of[j]
        x, y = self.at[first], self.at[last]
        return Chains(self.of[i:j + 1] - first, self.rep[first:last], self.lo[first:last], self.there[first:last],
                      self.at[first:last + 1] - x, self.s[x:y], self.o[x:y], self.n[x:y])


def _goes_on(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, room_a: np.ndarray, room_b: np.ndarray, step: int) -> np.ndarray:
    """For pairs of places at which words differ: does ``extend`` find a place from which EDGE words are equal?"""
    k = np.arange(MAX_GAP + EDGE)
    words = lambda x, at: x[np.clip(at[:, None] + step * k, 0, len(x) - 1)]
    one = words(a, i)[:, :, None] == words(b, j)[:, None, :]
    one &= (k < room_a[:, None])[:, :, None] & (k < room_b[:, None])[:, None, :]
    agree = one[:, :MAX_GAP + 1, :MAX_GAP + 1].copy()
    for x in range(1, EDGE):
        agree &= one[:, x:MAX_GAP + 1 + x, x:MAX_GAP + 1 + x]
    return agree.any(axis=(1, 2))


def one_run(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, a_len: np.ndarray, b_at: np.ndarray, b_len: np.ndarray,
            s: np.ndarray, o: np.ndarray, n: np.ndarray, min_words: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For chains of one segment: whether all there is to find is one run of equal words, with its words before ``s`` and its length.

    That is so if the segment's words are equal, no alignment goes on past
    the words that differ on either side, and what else is equal along the
    diagonal neither joins the run nor makes a passage. The text of chain i
    is ``a_len[i]`` words of ``a`` from ``a_at[i]`` on, the other's in ``b``.
    """
    sure = (s >= 0) & (o >= 0) & (n >= EDGE) & (s + n <= a_len) & (o + n <= b_len) & (similarity <= 1)
    before, length = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
    c = np.flatnonzero(sure)
    if not len(c):
        return sure, before, length
    s, o, n, at, bt = s[c], o[c], n[c], a_at[c], b_at[c]
    left_a, left_b = np.minimum(REACH, s), np.minimum(REACH, o)
    right_a, right_b = np.minimum(REACH, a_len[c] - s - n), np.minimum(REACH, b_len[c] - o - n)
    back = np.minimum(left_a, left_b)
    many = back + n + np.minimum(right_a, right_b)
    end = np.cumsum(many)
    begin = end - many
    x = np.arange(end[-1])
    same = a[x + np.repeat(at + s - back - begin, many)] == b[x + np.repeat(bt + o - back - begin, many)]
    unequal = np.flatnonzero(~same)
    place = begin + back                                                   # of the segment's first word
    near = np.searchsorted(unequal, place)
    edge = np.concatenate([[-1], unequal, [end[-1]]])
    first, last = np.maximum(edge[near] + 1, begin), np.minimum(edge[near + 1], end)
    total = np.concatenate([[0], np.cumsum(same)])
    rest = total[end] - total[begin] - (last - first)
    joins = (total[first] - total[np.maximum(first - MAX_GAP - 1, begin)] > 0) | (total[np.minimum(last + MAX_GAP + 1, end)] - total[last] > 0)
    least = similarity * min_words
    good = (last - place >= n) & ((rest + last - first < least) | (~joins & (rest < least)))
    for stop, i, j, room_a, room_b, step in ((first > begin, place - first, place - first, left_a, left_b, -1),
                                             (last < end, last - place - n, last - place - n, right_a, right_b, 1)):
        y = np.flatnonzero(good & stop)
        from_a, from_b = (at + s - 1 - i, bt + o - 1 - j) if step < 0 else (at + s + n + i, bt + o + n + j)
        good[y[_goes_on(a, b, from_a[y], from_b[y], (room_a - i)[y], (room_b - j)[y], step)]] = False
    sure[c], before[c], length[c] = good, place - first, last - first
    return sure, before, length


def _aligned_texts(texts: list[str], cs: Chains, min_words: int, similarity: float) -> list[list[tuple]]:
    """Passages of each text; one that lies within another is left out, as are chains within a passage."""
    a, a_len = word_numbers([t.encode("utf-8") for t in texts])
    b, b_len = word_numbers(cs.there)
    a_at, b_at = np.cumsum(a_len) - a_len, np.cumsum(b_len) - b_len
    text = np.repeat(np.arange(len(texts)), np.diff(cs.of))
    one = np.diff(cs.at) == 1
    start, stop = cs.s[cs.at[:-1]], (cs.s + cs.n)[cs.at[1:] - 1]
    c = np.flatnonzero(one)
    sure, before, length = (np.zeros(len(one), k) for k in (bool, np.int64, np.int64))
    x = cs.at[c]
    sure[c], before[c], length[c] = one_run(a, b, a_at[text[c]], a_len[text[c]], b_at[c], b_len[c], cs.s[x], cs.o[x] - cs.lo[c] * MARK, cs.n[x], min_words, similarity)
    order = np.lexsort((start, cs.rep, start - stop, text))
    order = order[~sure[order] | (length[order] >= min_words)]             # the others have no passage
    found: list[list[tuple]] = [[] for _ in texts]
    inside = [bytearray(n + 1) for n in a_len.tolist()]                    # of a passage found before
    for c, i, rep, lo, s, e, run, before_, m in zip(*(v[order].tolist() for v in (np.arange(len(one)), text, cs.rep, cs.lo * MARK, start, stop, sure, before, length))):
        size = len(inside[i]) - 1
        # a repeat may go on for WINDOW - 1 words beyond its seeds
        if e <= size and inside[i].find(0, max(0, s - WINDOW + 1), min(size, e + WINDOW - 1)) < 0:
            continue
        if run:
            got = [(s - before_, m, int(cs.o[cs.at[c]]) - lo - before_, m, m)]
        else:
            mine, other = a[a_at[i]:a_at[i] + size], b[b_at[c]:b_at[c] + b_len[c]]
            segs = slice(cs.at[c], cs.at[c + 1])
            path = list(zip(cs.s[segs].tolist(), (cs.o[segs] - lo).tolist(), cs.n[segs].tolist()))
            if any(x >= size or not 0 <= o < len(other) for x, o, _ in path):  # another row of the same id
                continue
            got = passages(*align(mine, other, path), min_words, similarity)
            got += along_diagonals(mine, other, path, min_words, similarity)
        for s, n, o, m, eq in got:
            found[i].append((s, n, rep, o + lo, m, eq))
            inside[i][s:s + n] = b"\1" * n
    return [_outermost(x) for x in found]


def _outermost(found: list[tuple]) -> list[tuple]:
    out, upto = [], -1
    for x in sorted(set(found), key=lambda x: (x[0], -x[1], x[2:])):
        if x[0] + x[1] > upto:
            out.append(x)
            upto = x[0] + x[1]
    return out


def _aligned(text: str, cs: list[dict], min_words: int, similarity: float) -> list[tuple]:
    """Passages of one text."""
    return _aligned_texts([text], Chains.from_rows([cs]), min_words, similarity)[0]


def _aligned_batch(texts, lists, min_words: int, similarity: float) -> Iterator[tuple[str | None, list[tuple]]]:
    """Texts of a batch with their passages; ``PART_BYTES`` of other texts are split into words at once."""
    cs = Chains.from_arrow(lists)
    ends = np.append(0, np.cumsum(list(map(len, cs.there)), dtype=np.int64))[cs.of]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + PART_BYTES, side="right")) - 1)
        part = texts[i:j].to_pylist()
        yield from zip(part, _aligned_texts([t or "" for t in part], cs.part(i, j), min_words, similarity))
        i = j


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50,
                 similarity: float = 0.8) -> DataFrame:
    """One row per repeated passage of a later document: ``doc_id`` and where it is here and in its source.

    ``start, words``: the passage in words of this document; ``source_id,
    source_start, source_words``: in the earlier document; ``equal_words``:
    words that are equal. Rows with a null id or text, and texts under
    ``min_words`` words, take no part. Rows that repeat an id are one
    document to the search (their passages are found in other ids). An
    empty table gives an empty result. Other columns are not read.
    """
    import pyarrow as pa

    kept = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        for batch in batches:
            ids, rows = [], []
            for i, (_, got) in zip(batch.column("_key").to_pylist(), _aligned_batch(batch.column("_text"), batch.column("_chains"), min_words, similarity)):
                ids += [i] * len(got)
                rows += got
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in cols)],
                                             names=["doc_id", "start", "words", "source_id", "source_start", "source_words", "equal_words"])
        give_back_memory()

    small_batches(docs.sparkSession)
    marked = _marked(kept, "_key", "_text")
    per_doc = _candidates(kept, marked, "_key", "_text", min_words).groupBy("doc").agg(F.collect_list("c").alias("_chains"))
    # with the marks, which nothing reads here, these are the rows that the chains' join deals out: one shuffle serves both
    return marked.join(per_doc, F.col("_key") == per_doc["doc"]).drop("doc").mapInArrow(emit, "doc_id long, " + FOUND)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without some spans of words (start, number) and the white space after each."""
    import re

    at = [m.span() for m in re.finditer(WORD, text)]
    out, pos = [], 0
    for s, n in sorted(spans):
        begin = at[s][0]
        end = at[s + n][0] if s + n < len(at) else len(text)
        if end > pos:
            out.append(text[pos:max(pos, begin)])
            pos = end
    return "".join(out) + text[pos:]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50,
                   similarity: float = 0.8) -> DataFrame:
    """``docs`` with the repeated passages cut out of later documents' texts.

    All rows and columns stay; texts without a repeat stay as they are, as
    do rows with a null id or text.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    # the text goes along once, as _text
    other = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text}
    names = list(other.values())
    kept = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in other.items()],
                       F.col(f"`{key}`").cast("long").alias("_key"), F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([kept.schema[n] for n in names] + [T.StructField("_clean", T.StringType())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        for rows, which, lists in _texts_with_chains(batches):
            clean = rows.column("_text")
            if len(which):
                new = clean.to_pylist()
                for i, (t, got) in zip(which.tolist(), _aligned_batch(clean.take(pa.array(which)), lists, min_words, similarity)):
                    if got:
                        new[i] = without(t, [x[:2] for x in got])
                clean = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), clean], names=names + ["_clean"])
        give_back_memory()

    small_batches(docs.sparkSession)
    chains = _candidates(kept, _marked(kept, "_key", "_text"), "_key", "_text", min_words)
    out = _dealt_out(kept, chains).mapInArrow(emit, schema)
    return out.select(*[F.col(other.get(c, "_clean")).alias(c) for c in docs.columns])
