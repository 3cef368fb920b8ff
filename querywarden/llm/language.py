"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: hashed character n-grams (2 to 4, lower-cased, runs of
non-letters as one blank), term frequency times inverse document frequency.
Document frequencies are counted over all training rows. Weights are learnt
by follow-the-regularised-leader (FTRL-proximal) with an elastic-net
penalty, on a bounded sample of labelled rows: ``rows_per_label`` rows of
each label in the mean, chosen by a hash of the text. Every fifth row of the
sample is kept for temperature calibration, which scales the logits so that
the stated probability fits the held-back labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16
DIMS = 1 << BITS
NGRAMS = (2, 3, 4)
#: Labelled rows of each label that the weights are fitted on (in the mean; all, where there are fewer).
ROWS_PER_LABEL = 1500
#: Labels that can be learnt (a fit holds two tables of DIMS x labels numbers); more are an error.
MAX_LABELS = 256


def fold_table() -> np.ndarray:
    """Per code point: its lower-case letter (first code point), or 0 if it is no letter."""
    t = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            t[c] = ord(x.lower()[0])
    return t


class Grams:
    """N-grams of some texts: for each size the feature numbers in text order and their count per text."""

    def __init__(self, texts: list[str], letters: np.ndarray):
        raw = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), "<u4")
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)) + 2)
        c = letters[raw]
        keep = np.ones(len(c), bool)  # of a run of non-letters the first stays, as a blank (0)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0) | (owner[1:] != owner[:-1])
        c, owner = c[keep].astype(np.uint64), owner[keep]
        self.has_letter = np.bincount(owner, weights=c != 0, minlength=len(texts)) > 0
        self.by_size, h = [], c
        for size in range(2, max(NGRAMS) + 1):
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[size - 1:] + np.uint64(size)
            h ^= h >> np.uint64(29)
            if size in NGRAMS:
                inside = owner[size - 1:] == owner[:len(h)]
                mixed = h[inside] * np.uint64(0xD6E8FEB86659FD93)
                self.by_size.append(((mixed >> np.uint64(64 - BITS)).astype(np.int64),
                                     np.bincount(owner[:len(h)][inside], minlength=len(texts))))
        self.total = sum(n for _, n in self.by_size)

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Per text the sum of its features' rows of ``table``, divided by their number."""
        out = np.zeros((len(self.total), table.shape[1]))
        for what, n in self.by_size:
            have = np.flatnonzero(n)
            if len(have):
                starts = (np.cumsum(n) - n)[have]
                out[have] += np.add.reduceat(table[what], starts, axis=0)
        return out / np.maximum(self.total, 1)[:, None]

    def present(self) -> np.ndarray:
        """How many texts have each feature."""
        mark = np.zeros((len(self.total), DIMS), bool)
        for what, n in self.by_size:
            mark[np.repeat(np.arange(len(n)), n), what] = True
        return mark.sum(axis=0)

    def sparse(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Text ``k``: its distinct features and their term frequencies."""
        parts = []
        for what, n in self.by_size:
            s = int(n[:k].sum())
            parts.append(what[s:s + int(n[k])])
        f, n = np.unique(np.concatenate(parts), return_counts=True)
        return f, n / max(1, int(self.total[k]))


def _batches(texts: list[str], chars: int = 400_000, rows: int = 128) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and (size + len(t) > chars or len(part) == rows):
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


class Ftrl:
    """FTRL-proximal for a softmax over ``labels`` classes; the last feature is the intercept."""

    def __init__(self, dims: int, labels: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.02):
        self.z = np.zeros((dims + 1, labels))
        self.n = np.zeros((dims + 1, labels))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, f=slice(None)) -> np.ndarray:
        z, n = self.z[f], self.n[f]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, f: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(f)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[f]
        self.z[f] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[f] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature in 1/16..16 that gives the labels their greatest likelihood (golden section)."""
    if not len(labels):
        return 1.0

    def loss(t):
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).mean()

    a, b, r = -np.log(16), np.log(16), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


#: Mean frequencies are small; this brings features near 1.
SCALE = 64.0


def fit(texts: list[str], labels: np.ndarray, n_labels: int, idf: np.ndarray, epochs: int = 3):
    """Weights (DIMS + 1 rows), temperature. Every fifth text is for calibration alone."""
    letters, model, held = fold_table(), Ftrl(DIMS, n_labels), ([], [])
    rows, at = [], 0
    for part in _batches(texts):
        g = Grams(part, letters)
        for k in range(len(part)):
            f, tf = g.sparse(k)
            rows.append((np.append(f, DIMS), np.append(tf * idf[f] * SCALE, 1.0).astype(np.float32), int(labels[at])))
            at += 1
    held = rows[4::5] if len(rows) >= 50 else []
    learnt = [r for i, r in enumerate(rows) if i % 5 != 4 or not held]
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(learnt)):
            model.learn(*learnt[i])
    w = model.weights()
    logits = np.array([x @ w[f] for f, x, _ in held]).reshape(-1, n_labels)
    return w, temperature(logits, np.array([y for _, _, y in held], int))


def train(rows: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id",
          rows_per_label: int = ROWS_PER_LABEL) -> dict:
    """Learn from all rows with a text and a label; returns the model as plain arrays.

    Rows with a null text or label are not learnt from. Without any labelled
    row the model knows no label. More than MAX_LABELS labels are an error.
    """
    import pyarrow as pa

    rows = rows.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"),
                       F.xxhash64(F.col(key), F.col(text)).alias("h")) \
        .where(F.col("text").isNotNull() & F.col("label").isNotNull())
    counts = rows.groupBy("label").count().limit(MAX_LABELS + 1).collect()
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    names = sorted(r["label"] for r in counts)
    if not names:
        return {"labels": []}
    many = {r["label"]: r["count"] for r in counts}
    docs = sum(many.values())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, df = fold_table(), np.zeros(DIMS, np.int64)
        for batch in batches:
            for part in _batches(batch.column(0).to_pylist()):
                df += Grams(part, letters).present()
        f = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(df[f])], names=["f", "n"])

    got = rows.select("text").mapInArrow(frequencies, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    idf = np.zeros(DIMS)
    idf[got.column("f").to_numpy()] = got.column("n").to_numpy()
    idf = np.log((1 + docs) / (1 + idf)) + 1

    share = F.lit(0.0)
    for name in names:
        share = F.when(F.col("label") == name, F.lit(rows_per_label / many[name])).otherwise(share)
    sample = rows.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).repartition(1).sortWithinPartitions("h", "label")
    sent = rows.sparkSession.sparkContext.broadcast(idf)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, texts, labels = {n: i for i, n in enumerate(names)}, [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += [number[x] for x in batch.column(1).to_pylist()]
        w, t = fit(texts, np.array(labels, int), len(names), sent.value)
        f = np.flatnonzero(w.any(axis=1))
        f, w = np.append(f, -1), np.vstack([w[f], np.full((1, len(names)), t)])
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(list(w), pa.list_(pa.float64()))], names=["f", "w"])

    got = sample.select("text", "label").mapInArrow(learn, "f long, w array<double>").toArrow()
    f = got.column("f").to_numpy()
    learnt = np.array(got.column("w").to_pylist())
    w = np.zeros((DIMS + 1, len(names)))
    w[f[f >= 0]] = learnt[f >= 0]
    return {"labels": names, "idf": idf, "weights": w, "temperature": float(learnt[f < 0][0, 0])}


def predict(df: DataFrame, model: dict, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the most likely label and its probability; columns of these names are replaced.

    ``und`` with score 0 for a null text, a text without a letter, and for
    every text if the model knows no label. The whole text is read.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    keep = [c for c in df.columns if c not in (label, score)]
    names = [f"c{i}" for i in range(len(keep))]
    source = df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"),
                       *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)])
    schema = T.StructType([T.StructField(n, source.schema[n].dataType) for n in names]
                          + [T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
    known = model["labels"]
    if known:
        table = (model["weights"][:DIMS] * model["idf"][:, None] * SCALE).astype(np.float32)
        sent = df.sparkSession.sparkContext.broadcast((table, model["weights"][DIMS], model["temperature"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = fold_table()
        for batch in batches:
            said, scores = [], []
            for part in _batches(batch.column(0).to_pylist()):
                g = Grams(part, letters)
                if known:
                    table, bias, t = sent.value
                    p = softmax((g.sums(table) + bias) / t)
                    best = p.argmax(axis=1)
                    said += [known[b] if has else "und" for b, has in zip(best.tolist(), g.has_letter.tolist())]
                    scores += np.where(g.has_letter, p.max(axis=1), 0.0).tolist()
                else:
                    said += ["und"] * len(part)
                    scores += [0.0] * len(part)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(said, pa.string()), pa.array(scores, pa.float64())],
                names=names + ["label", "score"])

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], F.col("label").alias(label), F.col("score").alias(score))
