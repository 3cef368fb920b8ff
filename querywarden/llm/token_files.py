"""Token-id files: independent zstandard frames with a trailing seek table.

A file is a run of zstandard frames, each the little-endian 32-bit ids of
whole documents (about ``frame_tokens`` ids; a longer document has a frame
to itself), then two skippable frames:

* the document index (magic 0x184D2A50): a zstandard frame of five 64-bit
  columns: has-id flag, doc_id, first id within the file, number of ids,
  frame number;
* the seek table of the public seekable format (magic 0x184D2A5E): for each
  frame its compressed size, decompressed size and the low 32 bits of the
  XXH64 of its content; then frame count, descriptor 0x80 and the footer
  magic 0x8F92EAB1.

Any zstandard tool reads a whole file (skippable frames hold no content); a
reader that wants some documents reads the tail, then only their frames.

Each task writes one file under a name of its own and reports it; the table
of reports (``manifest``) is written through Spark's commit protocol, so a
file of a lost or repeated attempt is never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, qualified, shuffle_partitions
from .pretokens import PretokenCache, chunks

INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

MANIFEST = "file string, part long, n_docs long, n_tokens long, n_frames long, bytes long"


def open_folder(path: str):
    """(file system, path) for a path with a scheme (see ``qualified``): local, HDFS, S3 or GCS."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


class LibraryEncoder:
    """Ids of texts by the tokenizers library, each distinct pre-token encoded once.

    Merges never cross the borders of pre-tokens, so encoding these one by
    one gives the ids of the whole text. A text that holds an added token's
    string (which the library cuts out before it splits) goes to the library
    whole.
    """

    def __init__(self, path: str):
        import tokenizers

        self.tok = tokenizers.Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.cache = PretokenCache(self._new, max_entries=600_000)

    def _new(self, words: list[bytes]) -> list[list[int]]:
        out = []
        for i in range(0, len(words), 4096):  # the library's results are large; keep few at once
            part = [w.decode("utf-8") for w in words[i:i + 4096]]
            out += [e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [any(a in t for a in self.added) for t in texts]
        ids, at = self.cache.encode(["" if w else t for t, w in zip(texts, whole)])
        return [np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32) if w
                else ids[at[i]:at[i + 1]] for i, (t, w) in enumerate(zip(texts, whole))]


class Writer:
    def __init__(self, out, frame_tokens: int, level: int):
        import xxhash
        import zstandard

        self.out, self.frame_tokens, self.xxh = out, frame_tokens, xxhash.xxh64_intdigest
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int, int]] = []
        self.pending: list[np.ndarray] = []
        self.waiting = self.total = self.bytes = 0

    def _put(self, data: bytes):
        self.out.write(data)
        self.bytes += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray):
        if self.waiting and self.waiting + len(ids) > self.frame_tokens:
            self._flush()
        self.docs.append((doc_id is not None, doc_id or 0, self.total, len(ids), len(self.frames)))
        self.pending.append(ids.astype("<u4"))
        self.waiting += len(ids)
        self.total += len(ids)

    def _flush(self):
        if self.pending:
            raw = np.concatenate(self.pending).tobytes()
            packed = self.zstd.compress(raw)
            self.frames.append((len(packed), len(raw), self.xxh(raw) & 0xFFFFFFFF))
            self._put(packed)
            self.pending, self.waiting = [], 0

    def close(self):
        self._flush()
        index = self.zstd.compress(np.array(self.docs, "<i8").reshape(-1, 5).T.tobytes())
        self._put(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = np.array(self.frames, "<u4").reshape(-1, 3).tobytes()
        self._put(struct.pack("<II", SEEK_MAGIC, len(table) + 9) + table
                  + struct.pack("<IBI", len(self.frames), CHECKSUMS, FOOTER_MAGIC))


class Reader:
    """Reads a file's index, and frames as they are asked for; each frame's checksum is compared."""

    def __init__(self, f):
        import xxhash
        import zstandard

        self.f, self.zstd, self.xxh = f, zstandard.ZstdDecompressor(), xxhash.xxh64_intdigest
        size = f.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        table = size - 9 - 12 * n
        self.frames = np.frombuffer(self._at(table, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.first = np.concatenate([[0], np.cumsum(self.frames[:, 1] // 4)])
        where = int(self.start[-1])
        magic, length = struct.unpack("<II", self._at(where, 8))
        if magic != INDEX_MAGIC or where + 8 + length + 8 != table:
            raise ValueError("no document index before the seek table")
        raw = self.zstd.decompress(self._at(where + 8, length))
        self.has_id, self.doc_id, self.doc_first, self.doc_len, self.doc_frame = \
            np.frombuffer(raw, "<i8").reshape(5, -1)

    def _at(self, start: int, length: int) -> bytes:
        self.f.seek(int(start))
        return self.f.read(int(length))

    def frame(self, k: int) -> np.ndarray:
        raw = self.zstd.decompress(self._at(self.start[k], self.frames[k, 0]))
        if len(raw) != self.frames[k, 1] or self.xxh(raw) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u4")

    def documents(self, rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(index row, ids) of the asked rows, each frame read once."""
        have, ids = -1, None
        for i in (range(len(self.doc_id)) if rows is None else np.sort(rows).tolist()):
            if self.doc_frame[i] != have:
                have = int(self.doc_frame[i])
                ids = self.frame(have)
            s = self.doc_first[i] - self.first[have]
            yield i, ids[s:s + self.doc_len[i]]


def write_tokens(df: DataFrame, folder: str, tokenizer_path: str, key: str = "doc_id", text: str = "text",
                 end_id: int = 2, frame_tokens: int = 1 << 18, level: int = 3,
                 n_files: int | None = None, batch_chars: int = 3_000_000) -> DataFrame:
    """Encode all texts and write them in ascending ``key`` order; returns the manifest.

    Null text: empty (its file entry is the end id alone). Null keys come
    first; rows with equal keys are ordered by a hash of the text, and equal
    rows are all kept. An empty table gives an empty manifest and no files.
    Other columns are not read.
    """
    import pyarrow as pa

    spark = df.sparkSession
    folder = qualified(spark, folder)
    rows = df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    n = n_files or shuffle_partitions(spark)
    ranged = rows.repartitionByRange(n, F.col("k").asc_nulls_first(), "h").sortWithinPartitions(
        F.col("k").asc_nulls_first(), "h").select(F.spark_partition_id().cast("long").alias("p"), "k", "t")

    sent = spark.sparkContext.broadcast({})  # keeps the encoder and its cache for a worker's next task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            keys, done = batch.column(1).to_pylist(), 0
            for texts in chunks(batch.column(2).to_pylist(), batch_chars):
                if writer is None:
                    part = batch.column(0)[0].as_py()
                    files, base = open_folder(folder)
                    files.create_dir(base, recursive=True)
                    name = f"tokens-{part:06d}-{uuid.uuid4().hex}.zst"
                    encoder = sent.value.setdefault("encoder", None) or LibraryEncoder(tokenizer_path)
                    sent.value["encoder"] = encoder
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                    writer = Writer(out, frame_tokens, level)
                for k, ids in zip(keys[done:], encoder.encode(texts)):
                    writer.add(k, np.append(ids, np.uint32(end_id)))
                done += len(texts)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({
                "file": [name], "part": [part], "n_docs": [len(writer.docs)], "n_tokens": [writer.total],
                "n_frames": [len(writer.frames)], "bytes": [writer.bytes]})

    made = ranged.mapInArrow(run, MANIFEST)
    made.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file with ``base``, the number of ids in all files before it."""
    m = spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return m.withColumn("base", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))


DOC = "doc_id long, start long, n_tokens long, ids_crc32 long, file string, frame long"


def read_documents(spark: SparkSession, folder: str, wanted: DataFrame | None = None, ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, file, frame[, ids]`` from the files.

    ``wanted`` (a column ``doc_id``): only these documents, and only their
    frames are decompressed. Their ids are joined with the file indexes, so
    any number may be asked for.
    """
    import pyarrow as pa

    folder = qualified(spark, folder)
    manifest = read_manifest(spark, folder)
    files_n = manifest.select("file", "base").repartition(shuffle_partitions(spark), "file")
    schema = DOC + (", ids array<int>" if ids else "")

    def emit(reader, file, base, rows, batch_docs=4096):
        cols = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32", "file", "frame", "ids")}

        def flush():
            arrays = {k: pa.array(v, pa.list_(pa.int32()) if k == "ids" else pa.string() if k == "file" else pa.int64())
                      for k, v in cols.items() if k != "ids" or ids}
            for v in cols.values():
                v.clear()
            return pa.RecordBatch.from_pydict(arrays)

        held = 0
        for i, doc in reader.documents(rows):
            cols["doc_id"].append(int(reader.doc_id[i]) if reader.has_id[i] else None)
            cols["start"].append(int(base + reader.doc_first[i]))
            cols["n_tokens"].append(len(doc))
            cols["ids_crc32"].append(zlib.crc32(doc.tobytes()))
            cols["file"].append(file)
            cols["frame"].append(int(reader.doc_frame[i]))
            if ids:
                cols["ids"].append(doc.astype(np.int32))
                held += len(doc)
            if len(cols["doc_id"]) >= batch_docs or held > 1 << 22:
                held = 0
                yield flush()
        if cols["doc_id"]:
            yield flush()

    def each(file):
        files, base = open_folder(folder)
        return files.open_input_file(f"{base}/{file}")

    if wanted is None:
        def run(batches):
            for batch in batches:
                for file, base in zip(*(c.to_pylist() for c in batch.columns)):
                    with each(file) as f:
                        yield from emit(Reader(f), file, base, None)

        return files_n.mapInArrow(run, schema)

    def index(batches):
        for batch in batches:
            for file, base in zip(*(c.to_pylist() for c in batch.columns)):
                with each(file) as f:
                    r = Reader(f)
                    keep = np.flatnonzero(r.has_id)
                    yield pa.RecordBatch.from_pydict({
                        "file": pa.array([file] * len(keep), pa.string()), "base": pa.array([base] * len(keep), pa.int64()),
                        "row": pa.array(keep, pa.int64()), "doc_id": pa.array(r.doc_id[keep], pa.int64())})

    asked = files_n.mapInArrow(index, "file string, base long, row long, doc_id long").join(
        wanted.select(F.col("doc_id").cast("long")).distinct(), "doc_id").select("file", "base", "row")
    # a file's documents are few enough for its task: one task wrote them
    asked = asked.repartition(shuffle_partitions(spark), "file").sortWithinPartitions("file", "row")

    def pick(batches):
        now, rows = None, []

        def done():
            with each(now[0]) as f:
                yield from emit(Reader(f), *now, np.array(rows))

        for batch in batches:
            for file, base, row in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (file, base):
                    if now:
                        yield from done()
                    now, rows = (file, base), []
                rows.append(row)
        if now:
            yield from done()

    return asked.mapInArrow(pick, schema)


def token_files(df: DataFrame, tokenizer_path: str, folder: str | None = None, **options) -> DataFrame:
    """Write ``df`` as token files (in a new shared folder by default) and read every document back."""
    folder = folder or fresh_path(df.sparkSession, "tokens")
    write_tokens(df, folder, tokenizer_path, **options)
    return read_documents(df.sparkSession, folder)
