"""Operator 12: every byte in a string of 100 bytes that also starts earlier is removed.

All occurrences of a string of ``length`` bytes have the same anchor: the
least hash among its substrings of ANCHOR bytes (leftmost of equals). So a
text is cut into pieces, each a run of such strings with one anchor, and only
pieces with equal anchors need comparing:

1. Pieces are sorted by (anchor, hash of the piece, place) over all tasks. Of
   pieces equal as a whole all but the first are removed then and there;
   anchors with a single distinct piece are done.
2. The distinct pieces of the other anchors are read from the text, and a
   collection of them gets its suffixes sorted, with common prefixes, by the
   column-wise construction of ``collection_bwt``. Suffixes that share
   ``length`` bytes are the same string; all but its first place are removed.

Scale: pieces (one for some 27 bytes of text, six numbers each) are dealt by
ranges of their whole sort key, so a frequent passage spreads over tasks; at
the borders of ranges a piece is kept for step 2, which decides. A collection
holds whole anchors, up to STRINGS strings at a time. An anchor with more
than HOT distinct pieces (a common line in ever different surroundings) is
cut again with longer anchors, the last of them as long as the strings, where
equal anchors are equal strings; so no group is gathered in one task. Hashes
are 128 bits a piece (anchor and contents). A text longer than CHUNK bytes is
read in overlapping chunks.

Earlier means: smaller doc_id (null before all), then, where rows repeat an
id, smaller text hash, then earlier start. Rows that repeat id and text are
one document: they get the same result. Null and empty texts, and texts
shorter than ``length``, stay as they are. Strings never span documents. An
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .collection_bwt import shared_suffixes
from .common import keep_freed_memory, materialise, release_shuffles

LENGTH = 100
#: Bytes of an anchor, then of those that frequent anchors are cut by again; ``length`` comes last.
ANCHORS = (48, 72)
#: More distinct pieces of one anchor than this are cut again.
HOT = 1024
#: Strings of one collection; windows hashed at a time (at most 2^21).
STRINGS, CHUNK = 16384, 1 << 17

_PLACE_BITS = 21
_NULL_ID = -(2**63)
PIECE = "anchor long, piece long, id long, mark long, run long, start long"
SPAN = "id long, mark long, start long, stop long"


def _keys(text: Column) -> list[Column]:
    """A row's place in the order of documents: its id, and the hash of its text for repeated ids."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), F.xxhash64(text).alias("mark")]


def _mixed(buffer, places: int, size: int):
    """A 64-bit hash of the ``size`` bytes at each of the first ``places`` places (the buffer goes on for 8 more)."""
    import numpy as np

    words = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    out = np.full(places, 0x9E3779B97F4A7C15, np.uint64)
    for at in sorted({*range(0, size - 7, 8), size - 8}):
        out ^= words[at:at + places]
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(29))


def cut_pieces(buffer, ends, size: int, length: int):
    """The pieces of texts that lie one after the other in ``buffer`` (with 8 bytes to spare).

    Returns arrays: text number, start in the buffer, number of strings in
    the run, hash of the anchor, hash of the piece.
    """
    import numpy as np

    n = int(ends[-1])
    windows = n - length + 1
    if windows <= 0:
        return [np.empty(0, np.int64)] * 5
    width = length - size + 1
    places = windows + width - 1
    h = _mixed(buffer, places, size)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = (h & ~low) | np.arange(places, dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:windows], least[width - span:width - span + windows])
    anchor = (least & low).astype(np.int64)
    crossing = np.zeros(n + 1, np.int32)       # windows that would leave their text
    starts = np.concatenate([[0], ends[:-1]])
    np.add.at(crossing, np.maximum(starts, ends - length + 1), 1)
    np.add.at(crossing, ends, -1)
    inside = np.cumsum(crossing[:windows]) == 0
    edge = np.ones(windows, bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(edge)
    run = np.diff(np.append(first, windows))
    mine = inside[first]
    first, run = first[mine], run[mine]
    text = np.searchsorted(ends, first, side="right")
    base = 0x9E3779B97F4A7C15 | 1
    power, inverse = np.full(places, base, np.uint64), np.full(windows, pow(base, -1, 2**64), np.uint64)
    power[0] = inverse[0] = 1
    power, inverse = np.cumprod(power), np.cumprod(inverse)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power, dtype=np.uint64)])
    whole = (total[first + run + width - 1] - total[first]) * inverse[first]
    whole = (whole ^ run.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return text, first, run, h[anchor[first]].view(np.int64), (whole ^ (whole >> np.uint64(31))).view(np.int64)


def _chunks(lengths, length: int):
    """Parts of texts, in groups of up to CHUNK bytes: lists of (text, from, to); neighbouring parts overlap by length - 1."""
    group, size = [], 0
    for i, n in enumerate(lengths.tolist()):
        at = 0
        while n - at >= length:
            stop = min(n, at + CHUNK)
            if group and size + stop - at > CHUNK:
                yield group
                group, size = [], 0
            group.append((i, at, stop))
            size += stop - at
            at = stop - length + 1
    if group:
        yield group


def pieces(texts: DataFrame, size: int, length: int = LENGTH) -> DataFrame:
    """The pieces of (id, mark, start, text) rows, ``start`` being the text's place in its document.

    ``run`` is a piece's own place in the document x 256 plus the number of strings.
    """
    def cut(batches):
        import numpy as np
        import pyarrow as pa

        keep_freed_memory()
        for batch in batches:
            id_, mark, start = (batch.column(k).to_numpy() for k in range(3))
            text = batch.column(3).cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            for group in _chunks(np.diff(offsets), length):
                parts = [data[offsets[i] + a:offsets[i] + z] for i, a, z in group]
                ends = np.cumsum([len(p) for p in parts])
                buffer = np.concatenate([*parts, np.zeros(8, np.uint8)])
                part, first, run, anchor, piece = cut_pieces(buffer, ends, size, length)
                row = np.array([i for i, _, _ in group])[part]
                at = first - (ends - [len(p) for p in parts])[part] + np.array([a for _, a, _ in group])[part] + start[row]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, piece, id_[row], mark[row], at << 8 | run, start[row])],
                                                 names=["anchor", "piece", "id", "mark", "run", "start"])

    return texts.select("id", "mark", "start", "text").mapInArrow(cut, PIECE)


def compare_pieces(rows: DataFrame) -> DataFrame:
    """Repeats of whole pieces (``again``), and the first ones of all others that share an anchor with a different piece."""
    def compare(batches):
        import numpy as np
        import pyarrow as pa

        last = held = border = None            # the last row; the last distinct piece with whether it is to be kept; the first anchor
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            n = len(cols[0])
            if not n:
                continue
            if last is None:
                border = cols[0][0]
                last = [~c[:1] for c in cols]
            row = [np.concatenate([x, c]) for x, c in zip(last, cols)]
            last = [c[-1:].copy() for c in cols]
            new = [c[1:] != c[:-1] for c in row]
            other = new[0] | new[1]
            again = ~other & (new[2] | new[3] | new[4])
            mine = [c[other] for c in cols]
            keep = mine[0] == border
            if held is not None:
                mine, keep = [np.concatenate([x, c]) for x, c in zip(held[0], mine)], np.concatenate([held[1], keep])
            same = mine[0][1:] == mine[0][:-1]
            keep[1:] |= same
            keep[:-1] |= same
            held = [c[-1:] for c in mine], keep[-1:]
            keep[-1:] = False
            for rows, flag in (([c[again] for c in cols], True), ([c[keep] for c in mine], False)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[0], *rows[2:], np.full(len(rows[0]), flag))],
                                                 names=["anchor", "id", "mark", "run", "start", "again"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (held[0][0], *held[0][2:], np.zeros(1, bool))],
                                             names=["anchor", "id", "mark", "run", "start", "again"])

    order = ["anchor", "piece", "id", "mark", "run"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order) \
        .mapInArrow(compare, "anchor long, id long, mark long, run long, start long, again boolean")


def read_pieces(texts: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """The bytes of pieces (anchor, id, mark, run, start, hot), taken from the texts (id, mark, start, text) they were cut from."""
    def read(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = [[] for _ in range(6)]
            for id_, mark, origin, text, found in zip(*(batch.column(k) for k in range(5))):
                data = memoryview(text.as_buffer())
                lists = found.values
                anchor, run, hot = (lists.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                start = run >> 8
                first = start - origin.as_py()
                stop = first + (run & 255) + length - 1
                for x, values in zip(out, (anchor.tolist(), [id_.as_py()] * len(run), [mark.as_py()] * len(run), start.tolist(),
                                           [bytes(data[a:z]) for a, z in zip(first.tolist(), stop.tolist())], hot.tolist())):
                    x.extend(values)
                if len(out[0]) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=names)
                    out = [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=names)

    import pyarrow as pa

    names = ["anchor", "id", "mark", "start", "text", "hot"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
    wanted = places.groupBy("id", "mark", "start").agg(F.collect_list(F.struct("anchor", "run", "hot")).alias("found"))
    return texts.join(wanted, ["id", "mark", "start"]).select("id", "mark", "start", F.col("text").cast("binary").alias("text"), "found") \
        .mapInArrow(read, "anchor long, id long, mark long, start long, text binary, hot boolean")


def compare_strings(rows: DataFrame, length: int) -> DataFrame:
    """Spans of strings in the pieces (anchor, id, mark, start, text) that start earlier in another piece of the collection."""
    def collections(batches):
        """Whole anchors, up to STRINGS pieces at a time where an anchor has no more."""
        import numpy as np
        import pyarrow as pa

        held = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            anchor = table["anchor"].to_numpy()
            ends = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor))
            at = 0
            while len(anchor) - at > STRINGS:
                fit = ends[(ends > at) & (ends <= at + STRINGS)]
                stop = fit[-1] if len(fit) else ends[ends > at][0]
                if stop == len(anchor):        # may go on in the next batch
                    break
                yield table.slice(at, stop - at)
                at = stop
            held = table.slice(at).combine_chunks().to_batches()
        if held:
            yield pa.Table.from_batches(held)

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        keep_freed_memory()
        for table in collections(batches):
            id_, mark, start = (table[c].to_numpy() for c in ("id", "mark", "start"))
            text = table["text"].combine_chunks().cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
            ends = offsets[1:] - offsets[0]
            owner, left, joined = shared_suffixes(data, ends, length)
            if not len(owner):
                continue
            by = np.lexsort((mark, id_))
            step = np.zeros(len(by), np.int64)
            step[1:] = (id_[by][1:] != id_[by][:-1]) | (mark[by][1:] != mark[by][:-1])
            document = np.empty(len(by), np.int64)
            document[by] = np.cumsum(step)
            at = start[owner] + np.diff(np.concatenate([[0], ends]))[owner] - left
            place = document[owner] << 40 | at
            groups = np.flatnonzero(~joined)
            earliest = np.repeat(np.minimum.reduceat(place, groups), np.diff(np.append(groups, len(place))))
            later = np.unique(place[place > earliest])
            who = np.searchsorted(document[by], later >> 40)
            cut = np.flatnonzero(np.diff(later) != 1) + 1
            first, last = np.append(0, cut), np.append(cut, len(later)) - 1
            if not len(later):
                continue
            low = (1 << 40) - 1
            rows = (id_[by][who[first]], mark[by][who[first]], later[first] & low, (later[last] & low) + length)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["id", "mark", "start", "stop"])

    return rows.select("anchor", "id", "mark", "start", "text").repartition("anchor").sortWithinPartitions("anchor") \
        .mapInArrow(compare, SPAN)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, mark, start, stop): bytes covered by strings of ``length`` that start earlier; spans may touch and overlap."""
    spark = docs.sparkSession
    keyed = docs.select(*_keys(F.col("text")), F.lit(0).cast("long").alias("start"), "text").where(F.octet_length("text") >= length)
    sizes = [s for s in ANCHORS if s < length] + [length]
    texts, spans = keyed, []
    for size in sizes:
        found = materialise(compare_pieces(pieces(texts, size, length)), "llm-pieces")
        release_shuffles(spark)
        at = F.shiftright("run", 8)
        spans.append(found.where("again").select("id", "mark", at.alias("start"), (at + F.col("run").bitwiseAND(255) + (length - 1)).alias("stop")))
        first = found.where("not again")
        hot = first.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.lit(True).alias("is_hot"))
        marked = first.join(hot, "anchor", "left").select(*first.columns, F.coalesce("is_hot", F.lit(False)).alias("hot")) \
            if size < length else first.withColumn("hot", F.lit(False))
        strings = materialise(read_pieces(texts, marked, length), "llm-piece-texts")
        release_shuffles(spark)
        spans.append(compare_strings(strings.where("not hot"), length))
        texts = strings.where("hot")
        if size == length or texts.isEmpty():
            break
    return materialise(reduce(DataFrame.unionByName, spans), "llm-spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Each document's remaining bytes (``kept``) and the maximal removed runs (``removed``: start, stop)."""
    spans = repeated_spans(docs, length)
    lists = spans.groupBy("id", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *_keys(F.col("text")))
    joined = rows.join(lists, ["id", "mark"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "spans")

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        removed_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            kept, sizes, starts, stops = [], [0], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                data = memoryview(text.as_buffer())
                if not spans.is_valid:
                    kept.append(data)
                    sizes.append(sizes[-1])
                    continue
                a, z = (spans.values.field(k).to_numpy() for k in range(2))
                by = np.argsort(a, kind="stable")
                a, z = a[by], np.maximum.accumulate(z[by])
                new = np.append(True, a[1:] > z[:-1])
                a, z = a[new], z[np.append(np.flatnonzero(new)[1:], len(a)) - 1]
                starts.append(a)
                stops.append(z)
                sizes.append(sizes[-1] + len(a))
                kept.append(b"".join(data[i:j] for i, j in zip([0, *z.tolist()], [*a.tolist(), len(data)])))
            runs = pa.StructArray.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (starts, stops)], fields=list(removed_type.value_type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.as_buffer()) for t in batch.column(1)], pa.int64()), pa.array(kept, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), runs)], names=["doc_id", "n_bytes", "kept", "removed"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, kept binary, removed array<struct<start: long, stop: long>>")


def digest(removed: DataFrame) -> DataFrame:
    """Counts of bytes and runs, and the digest of what is left."""
    return removed.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The whole result in DuckDB SQL: every string of 100 bytes, as hexadecimal digits.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT doc_id, i, substring(h, 2 * i + 1, 598) AS h
          FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99, 200)) AS i FROM d WHERE length(h) >= 200)),
strings AS (SELECT doc_id, i + k AS i, substring(h, 2 * k + 1, 200) AS h
            FROM (SELECT doc_id, i, h, unnest(range(least(200, length(h) // 2 - 99))) AS k FROM parts)),
placed AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM strings),
later AS (SELECT doc_id, i, lag(i) OVER w AS before FROM placed WHERE k > 1 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, i, sum(CASE WHEN i - before <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM later),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(z) OVER w, 0) AS a, a AS z FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
         UNION ALL SELECT doc_id, max(z) AS a, NULL AS z FROM spans GROUP BY doc_id),
left_over AS (SELECT g.doc_id, string_agg(CASE WHEN g.z IS NULL THEN substring(d.h, 2 * g.a + 1) ELSE substring(d.h, 2 * g.a + 1, 2 * (g.z - g.a)) END, '' ORDER BY g.a) AS h
              FROM gaps g JOIN d ON g.doc_id = d.doc_id GROUP BY g.doc_id),
counted AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST((length(d.h) - length(coalesce(l.h, d.h))) // 2 AS BIGINT) AS n_removed,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(l.h, d.h))) AS kept_sha256
FROM d LEFT JOIN left_over l ON l.doc_id = d.doc_id LEFT JOIN counted c ON c.doc_id = d.doc_id
"""
