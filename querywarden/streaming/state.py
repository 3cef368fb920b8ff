"""Values by key that micro-batches carry on, as files in hash buckets.

A batch writes the keys it changed and nothing else: one small version for
each bucket that these keys fall into. A manifest per batch lists, for each
bucket, the versions that make it up; of a key's values the newest counts. A
bucket whose later versions hold as many rows as its first, or that are more
than ``max_versions``, is written anew as one version, so the bytes written
grow with the batches (each row is rewritten a logarithmic number of times),
not with the number of keys. Reading for a batch opens only the buckets that
its keys fall into.

Batch N reads the newest manifest before N and writes its own, last, so a
retried batch starts from the same state and gives the same one. Manifests
but the newest ``keep``, and versions that none of those lists, are deleted.
The folder must be shared storage on a cluster. The driver handles one row a
bucket and version.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "bucket int, version long, rows long"


@dataclass(frozen=True)
class KeyedState:
    """State ``name`` under ``base``: ``schema`` has the ``keys`` first, then the values."""

    base: str
    name: str
    keys: tuple[str, ...]
    schema: str
    buckets: int = 64
    max_versions: int = 8
    keep: int = 2

    @property
    def root(self) -> str:
        return f"{self.base.rstrip('/')}/{self.name}"

    def bucket(self) -> Column:
        """The bucket of a row's key (null is a key like any other)."""
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def touched(self, batch: DataFrame) -> list[int]:
        return sorted(r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect())

    def read(self, spark: SparkSession, batch_id: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The state before batch ``batch_id`` (None: after the last one), or of some buckets of it."""
        listed = self._manifest(spark, batch_id)
        if buckets is not None:
            listed = [e for e in listed if e[0] in set(buckets)]
        return self._newest(spark, listed)

    def write(self, changed: DataFrame, batch_id: int) -> None:
        """Make ``changed`` (one row a key) the new values of its keys."""
        spark = changed.sparkSession
        listed = self._manifest(spark, batch_id)
        version = 2 * batch_id
        self._put(changed, version)
        written = self._read(spark, [(None, version, 0)])
        counts = [] if written is None else [(r["bucket"], version, r["count"]) for r in written.groupBy("bucket").count().collect()]
        entries = listed + counts
        crowded = self._crowded(entries)
        if crowded:
            old = [e for e in entries if e[0] in crowded]
            self._put(self._newest(spark, old), version + 1)
            merged = self._read(spark, [(None, version + 1, 0)])
            counts = [(r["bucket"], version + 1, r["count"]) for r in merged.groupBy("bucket").count().collect()]
            entries = [e for e in entries if e[0] not in crowded] + counts
        spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(self._at("manifest", batch_id))
        self._expire(spark, batch_id)

    def _crowded(self, entries) -> set[int]:
        by_bucket: dict[int, list] = {}
        for bucket, version, rows in sorted(entries):
            by_bucket.setdefault(bucket, []).append(rows)
        return {b for b, rows in by_bucket.items()
                if len(rows) > 1 and (len(rows) > self.max_versions or sum(rows[1:]) >= rows[0])}

    def _put(self, rows: DataFrame, version: int) -> None:
        rows.select(*self._columns(), self.bucket().alias("bucket")).repartition("bucket") \
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/version={version}")

    def _columns(self) -> list[str]:
        return [f.split()[0] for f in _fields(self.schema)]

    def _read(self, spark: SparkSession, entries) -> DataFrame | None:
        paths = [f"{self.root}/data/version={v}" + ("" if b is None else f"/bucket={b}") for b, v, _ in entries]
        paths = [p for p in paths if any(True for _ in _list(spark, p))]
        if not paths:
            return None
        return spark.read.schema(f"{self.schema}, version long, bucket int").option("basePath", f"{self.root}/data").parquet(*paths)

    def _newest(self, spark: SparkSession, entries) -> DataFrame:
        rows = self._read(spark, entries)
        if rows is None:
            return spark.createDataFrame([], self.schema)
        values = [c for c in self._columns() if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "version").alias("_v"))
        return newest.select(*self.keys, "_v.*").select(*self._columns())

    def _at(self, what: str, batch_id: int) -> str:
        return f"{self.root}/{what}/batch_id={batch_id}"

    def _committed(self, spark: SparkSession) -> list[int]:
        """Batches with a whole manifest, ascending."""
        found = [n for n in _list(spark, f"{self.root}/manifest") if n.startswith("batch_id=")]
        return sorted(int(n.split("=")[1]) for n in found if "_SUCCESS" in _list(spark, f"{self.root}/manifest/{n}"))

    def _manifest(self, spark: SparkSession, batch_id: int | None) -> list[tuple[int, int, int]]:
        earlier = [b for b in self._committed(spark) if batch_id is None or b < batch_id]
        if not earlier:
            return []
        rows = spark.read.schema(_MANIFEST).parquet(self._at("manifest", earlier[-1])).collect()
        return sorted((r["bucket"], r["version"], r["rows"]) for r in rows)

    def _expire(self, spark: SparkSession, batch_id: int) -> None:
        committed = [b for b in self._committed(spark) if b <= batch_id]
        for b in committed[:-self.keep]:
            _delete(spark, self._at("manifest", b))
        listed = set()
        for b in committed[-self.keep:]:
            listed |= {(e[0], e[1]) for e in self._manifest(spark, b + 1)}
        for folder in _list(spark, f"{self.root}/data"):
            version = int(folder.split("=")[1])
            if version > 2 * batch_id + 1:
                continue
            mine = {b for b, v in listed if v == version}
            if not mine:
                _delete(spark, f"{self.root}/data/{folder}")
                continue
            for part in _list(spark, f"{self.root}/data/{folder}"):
                if part.startswith("bucket=") and int(part.split("=")[1]) not in mine:
                    _delete(spark, f"{self.root}/data/{folder}/{part}")


def _fields(schema: str) -> list[str]:
    """The fields of a DDL schema; commas inside <> or () do not part fields."""
    out, depth = [""], 0
    for ch in schema:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [f.strip() for f in out]


def _path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _list(spark: SparkSession, path: str) -> list[str]:
    at, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _delete(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)
