"""Log segments as files on disk, written and read by the tasks themselves.

A rotated log has a small file and a folder for each segment, so its cost is
the number of files. Hadoop's local file system starts a ``chmod`` process
for each new file, checksum file and folder, and Spark's driver moves all
files one by one when it commits, lists them all before it reads and makes a
task of every 32 of them. Here tasks make and read the files; the driver
renames one folder and holds no list of files. Only for folders that driver and
executors share as a file system; folder names, hidden files and line ends
are those of Spark's partitioned text files.
"""

from __future__ import annotations

import contextlib
import itertools
import os
import re
import shutil
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The name of a folder whose value is null or "".
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: Characters written as ``%XX`` in folder names, and those that a file's URI cannot hold.
ESCAPED = r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]"""
NOT_IN_URI = r"""[\x00-\x20"#%<>?\[\\\]^`{|}\x7f]"""
#: Files that Spark's text reader would unpack.
PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst")
#: Bytes read, and lines handed on, at a time; what a line takes in memory besides its bytes.
READ_BYTES, LINE_BYTES = 4 << 20, 48
NAMES_A_BATCH = 10_000


def on_disk(spark: SparkSession, path: str) -> str | None:
    """The absolute path in the machines' file system, or None if it lies in another store."""
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(hp).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def _percent(text: str, chars: str) -> str:
    return re.sub(chars, lambda m: f"%{ord(m[0]):02X}", text)


def folder_name(column: str, value: str | None) -> str:
    return f"{_percent(column, ESCAPED)}={_percent(value, ESCAPED) if value else NO_VALUE}"


def folder_value(name: str) -> str | None:
    value = name.partition("=")[2]
    return None if value == NO_VALUE else re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), value)


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


# ---------------------------------------------------------------------------
# writing
# ---------------------------------------------------------------------------

def _runs(b: pa.RecordBatch) -> Iterator[tuple[tuple, memoryview]]:
    """The values and the bytes of each run of rows of one folder; the last column is the line (null: a blank one).

    Lines are handed on as bytes, whether or not they are UTF-8.
    """
    end, none = (pa.scalar(x, pa.large_binary()) for x in (b"\n", b""))
    text = pc.binary_join_element_wise(b.columns[-1].cast(pa.large_binary()), none, end, null_handling="replace", null_replacement="")
    upto, data = np.frombuffer(text.buffers()[1], np.int64), memoryview(text.buffers()[2])
    new = np.arange(b.num_rows) == 0
    for c in b.columns[:-1]:
        new[1:] |= np.asarray(pc.not_equal(c[1:], c[:-1]))
    at = np.flatnonzero(new)
    keys = zip(*(c.take(pa.array(at)).to_pylist() for c in b.columns[:-1]))
    for key, i, j in zip(keys, upto[at].tolist(), upto[[*at[1:], b.num_rows]].tolist()):
        yield key, data[i:j]


def _write(root: str, columns: Sequence[str], job: str):
    """Fold over lines sorted by folder: a file each. It gets its name when it is
    whole, so attempts at the same task do not meet in it."""
    def run(batches):
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{job}.txt"
        at, out, files = None, None, 0

        def done():
            out.close()
            os.replace(out.name, os.path.join(os.path.dirname(out.name), name))

        try:
            for key, text in itertools.chain.from_iterable(_runs(b) for b in batches if b.num_rows):
                if key != at:
                    if out is not None:
                        done()
                    folder = root
                    for i, (c, v) in enumerate(zip(columns, key), 1):
                        folder = os.path.join(folder, folder_name(c, v))
                        if at is None or key[:i] != at[:i]:
                            with contextlib.suppress(FileExistsError):
                                os.mkdir(folder)
                    at, files = key, files + 1
                    out = open(os.path.join(folder, f".{name}.{task.taskAttemptId()}"), "wb")
                out.write(text)
            if out is not None:
                done()
        finally:
            if out is not None and not out.closed:
                out.close()
                os.remove(out.name)
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])
    return run


def write_segments(rows: DataFrame, root: str, columns: Sequence[str]) -> None:
    """``rows`` are the values of ``columns`` as text and the line, sorted by ``columns`` within partitions.

    All files are made in a hidden folder beside ``root``, which then takes its
    place, so a failed job leaves ``root`` as it was.
    """
    job = uuid.uuid4().hex[:16]
    draft = os.path.join(os.path.dirname(root), f".{os.path.basename(root)}-{job}")
    os.makedirs(draft)
    try:
        rows.mapInArrow(_write(draft, columns, job), "files bigint").agg(F.sum("files")).first()
        open(os.path.join(draft, "_SUCCESS"), "w").close()
        if os.path.isdir(root) and not os.path.islink(root):
            shutil.rmtree(root)
        elif os.path.lexists(root):
            os.remove(root)
        os.rename(draft, root)
    except BaseException:
        shutil.rmtree(draft, ignore_errors=True)
        raise


# ---------------------------------------------------------------------------
# reading
# ---------------------------------------------------------------------------

def _subfolders(column: str):
    """The folders ``column=...`` in each folder."""
    def names(batches) -> Iterator[str]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                with os.scandir(folder) as found:
                    for e in found:
                        if not _hidden(e.name):
                            if not e.name.startswith(f"{_percent(column, ESCAPED)}="):
                                raise ValueError(f"{e.path} is no folder of {column}")
                            yield e.path

    def run(batches):
        found = names(batches)
        while some := list(itertools.islice(found, NAMES_A_BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["folder"])
    return run


def line_runs(f) -> Iterator[list[bytes]]:
    """The lines of a binary file, some MB at a time. A line ends with ``\\n``, ``\\r\\n`` or ``\\r``."""
    rest = f.read(3)
    if rest == b"\xef\xbb\xbf":
        rest = b""
    while block := f.read(READ_BYTES):
        got = (rest + block).splitlines(keepends=True)
        # the last line may go on in the next block, or its \r be followed by \n
        rest = b"" if got[-1].endswith(b"\n") else got.pop()
        yield [x.rstrip(b"\r\n") for x in got]
    if rest:
        yield rest.splitlines()


def _read(columns: Sequence[str]):
    """The lines of each folder's files, with the folder's values, the file and the line's number in it."""
    def batch(runs: list[tuple]) -> pa.RecordBatch:
        values, files, first, lines = zip(*runs)
        sizes = [len(x) for x in lines]
        at = np.repeat(np.arange(len(runs)), sizes)
        no = np.concatenate([np.arange(n, n + k) for n, k in zip(first, sizes)])
        text = pa.array(list(itertools.chain.from_iterable(lines)), pa.binary())
        text = pa.Array.from_buffers(pa.string(), len(text), text.buffers())
        made = [*(pa.array(v, pa.string()).take(pa.array(at)) for v in (*zip(*values), files)), pa.array(no, pa.int64()), text]
        return pa.RecordBatch.from_arrays(made, names=[*columns, "file", "line_no", "line"])

    def run(batches):
        runs, held = [], 0
        for b in batches:
            for folder in b.column(0).to_pylist():
                values = [folder_value(x) for x in folder.split("/")[-len(columns):]]
                for name in sorted(n for n in os.listdir(folder) if not _hidden(n)):
                    path, no = os.path.join(folder, name), 1
                    if name.endswith(PACKED):
                        raise ValueError(f"{path} is packed")
                    with open(path, "rb") as f:
                        for lines in line_runs(f):
                            runs.append((values, f"file:{_percent(path, NOT_IN_URI)}", no, lines))
                            no, held = no + len(lines), held + sum(map(len, lines)) + LINE_BYTES * len(lines)
                            if held >= READ_BYTES:
                                yield batch(runs)
                                runs, held = [], 0
        if runs:
            yield batch(runs)
    return run


def read_segments(spark: SparkSession, root: str, columns: Sequence[str]) -> DataFrame:
    """``columns`` as text, ``file, line_no, line``: every line under ``root``.

    Each level of folders is dealt out to the tasks before the next is listed,
    so a chain of many segments is read by many of them.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders = spark.range(1, numPartitions=1).select(F.lit(root).alias("folder"))
    for c in columns:
        folders = folders.mapInArrow(_subfolders(c), "folder string").repartition(n, "folder")
    keys = "".join(f"`{c}` string, " for c in columns)
    return folders.mapInArrow(_read(columns), f"{keys}file string, line_no bigint, line string")
