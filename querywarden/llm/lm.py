"""Scoring documents with a gated recurrent language model and a unigram baseline.

Counts of all tokens come from all training rows. The most frequent
``DIRECT`` words (and the end token) have a place of their own in the
model, in classes of like frequency; all other words belong to the class of
their last two letters (the ``SUFFIXES`` most frequent endings, and one for
the rest), within which their probability is ``(c + 1) / (N + V + 1)`` of
the class. The network's weights are learnt by truncated backpropagation
from all training rows, inside every partition from common weights, which
are then averaged by the number of tokens. This takes ROUNDS rounds, each on
a share of the rows by hash, every row in one of them; the first shares are
small, so that partitions part ways only once the weights point somewhere.

Counts of the ``HEAD`` most frequent words are broadcast; the counts of
others are joined, so no worker holds the whole vocabulary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import keep_freed_memory, materialise

HEAD, DIRECT, SUFFIXES = 200_000, 1023, 23
#: Sixteenths of the training rows in each round.
ROUNDS = (1, 3, 4, 8)
#: Fewest tasks that a round is gathered into; tokens that a task learns from at once at most.
LEAST_TASKS, MOST_TOKENS = 8, 2_000_000
#: Tasks that add up weights, and the numbers the driver receives: this many copies of the network.
ADDERS = 8


def slices(batch, column: int, size: int = 1 << 23) -> Iterator:
    """A batch in runs of rows whose texts have about ``size`` bytes."""
    import pyarrow.compute as pc

    block = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    for x, y in zip(cuts[:-1], cuts[1:]):
        if y > x:
            yield batch.slice(x, y - x)


def words_of(texts) -> tuple:
    """The words of an array of texts, one after another (A-Z in lower case), and each text's number of them."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    there = pc.greater(pc.binary_length(words), 0)            # white space at a text's ends leaves an empty string
    upto = np.append(0, np.cumsum(there.to_numpy(zero_copy_only=False)))[ends]
    return words.filter(there), np.diff(upto, prepend=0)


def count_tokens(texts: DataFrame) -> DataFrame:
    """``word, c`` over all rows of ``t``; the end token is not a row."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        for batch in batches:
            for part in slices(batch, 0):
                found = words_of(part.column(0))[0].value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "c"])

    return texts.select("t").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What each token is to the model; plain data, sent to tasks."""

    def __init__(self, head: list[tuple[str, int]], docs: int, suffixes: list[tuple[str, int, int]],
                 rest: tuple[int, int], n_tokens: int, n_types: int):
        # head: by count, descending; suffixes: (ending, tokens, types) and rest, of all words that are not direct
        self.n_tokens, self.n_types, self.end_count = n_tokens, n_types, docs
        direct = sorted([(b"", docs)] + [(w.encode(), c) for w, c in head[:DIRECT]], key=lambda x: (-x[1], x[0]))
        self.words = [w.encode() for w, _ in head]
        self.counts = np.array([c for _, c in head], np.int64)
        self.n_direct = len(direct)
        number = {w: i for i, (w, _) in enumerate(direct)}
        self.end = number.pop(b"")
        self.classes = -(-len(direct) // gru.WORDS)
        self.endings = [s for s, _, _ in suffixes]
        tail = [(n, v) for _, n, v in suffixes] + [rest]
        self.tail_log10 = np.array([np.log10(n + v + 1) for n, v in tail])
        # per head word: its number in the model's input, its class and its place in it
        self.input_of = np.array([number[w] if i < DIRECT else self.n_direct + self.tail_class(w)
                                  for i, w in enumerate(self.words)], np.int64)
        mass = np.zeros(self.classes + len(tail))
        prior = np.zeros((self.classes, gru.WORDS))
        for i, (_, c) in enumerate(direct):
            prior[i // gru.WORDS, i % gru.WORDS] = c + 1
        mass[:self.classes] = prior.sum(axis=1)
        mass[self.classes:] = [n + 1 for n, _ in tail]
        self.class_prior = mass / mass.sum()
        self.word_prior = prior / prior.sum(axis=1, keepdims=True)

    def tail_class(self, word: bytes) -> int:
        s = word.decode("utf-8")[-2:]
        return self.endings.index(s) if s in self.endings else len(self.endings)

    def state(self) -> dict:
        return dict(self.__dict__)

    @staticmethod
    def of(state: dict) -> Vocabulary:
        import pyarrow as pa

        v = Vocabulary.__new__(Vocabulary)
        v.__dict__.update(state)
        v.table, v.endings_table = pa.array(v.words, pa.binary()).cast(pa.string()), pa.array(v.endings, pa.string())
        return v

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, object]:
        """Model numbers of all texts' words and ends, one after another, and their number by text; the
        words' head numbers or -1 (also for ends); numbers of words beyond the head by text, and these words."""
        import pyarrow as pa
        import pyarrow.compute as pc

        def index(words, table, other):
            return pc.fill_null(pc.index_in(words, value_set=table), other).to_numpy(zero_copy_only=False)

        words, lengths = words_of(texts)
        known = index(words, self.table, -1)
        rare = np.flatnonzero(known < 0)
        beyond = words.take(pa.array(rare))
        own = self.input_of[known] if len(self.words) else np.empty(len(known), np.int64)
        own[rare] = self.n_direct + index(pc.utf8_slice_codeunits(beyond, -2), self.endings_table, len(self.endings))
        ends = np.cumsum(lengths + 1) - 1
        inside = np.ones(len(words) + len(lengths), bool)
        inside[ends] = False
        numbers, head = np.full(len(inside), self.end, np.int64), np.full(len(inside), -1, np.int64)
        numbers[inside], head[inside] = own, known
        n_rare = np.diff(np.searchsorted(rare, np.cumsum(lengths)), prepend=0)
        return numbers, lengths + 1, head, n_rare, beyond

    def each(self, texts) -> list[np.ndarray]:
        """Model numbers of each text."""
        numbers, lengths, *_ = self.encode(texts)
        return np.split(numbers, np.cumsum(lengths)[:-1])

    def targets(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        direct = numbers < self.n_direct
        cls = np.where(direct, numbers // gru.WORDS, self.classes + numbers - self.n_direct)
        return cls, np.where(direct, numbers % gru.WORDS, -1)

    def before(self, numbers: np.ndarray, lengths: list[int]) -> np.ndarray:
        """What the model reads before each token: the token before it, the end token at a document's start."""
        out = np.empty_like(numbers)
        out[1:] = numbers[:-1]
        starts = np.cumsum(lengths) - lengths
        out[starts[np.asarray(lengths) > 0]] = self.end
        return out


def vocabulary(counts: DataFrame, docs: int, head_size: int = HEAD) -> Vocabulary:
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    # the least count with which no more than head_size words remain
    bar, many = None, 0
    for r in counts.groupBy("c").count().orderBy(F.desc("c")).toLocalIterator():
        if many + r["count"] > head_size:
            break
        bar, many = r["c"], many + r["count"]
    head = [] if bar is None else [(w, c) for w, c in zip(*(
        x.to_pylist() for x in counts.where(F.col("c") >= bar).select("word", "c").toArrow().columns))]
    head.sort(key=lambda x: (-x[1], x[0]))
    direct = head[:DIRECT]
    by_end = counts.groupBy(F.expr("right(word, 2)").alias("s")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    top = [(r["s"], r["n"], r["v"]) for r in by_end.orderBy(F.desc("n"), "s").limit(SUFFIXES).collect()]
    inside = Counter(), Counter()
    for w, c in direct:
        inside[0][w[-2:]] += c
        inside[1][w[-2:]] += 1
    top = [(s, n - inside[0][s], v - inside[1][s]) for s, n, v in top]
    n_all, v_all = (total["n"] or 0), total["v"]
    rest = (n_all - sum(c for _, c in direct) - sum(n for _, n, _ in top), v_all - len(direct) - sum(v for _, _, v in top))
    return Vocabulary(head, docs, top, rest, n_all + docs, v_all + (docs > 0))


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float64)


def shaped(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def parts_of(documents: Iterator[np.ndarray], part_tokens: int, n_lanes: int) -> Iterator[list[np.ndarray]]:
    """Documents that are learnt from together: of ``part_tokens`` tokens or more.

    Lanes that end long before that of the longest document leave it to run
    alone, at a window's full cost, so a part goes on, up to MOST_TOKENS,
    until the longest document is no longer than a lane.
    """
    part, waiting, longest = [], 0, 0
    for x in documents:
        part.append(x)
        waiting, longest = waiting + len(x), max(longest, len(x))
        if waiting > part_tokens and waiting > min(n_lanes * longest, MOST_TOKENS):
            yield part
            part, waiting, longest = [], 0, 0
    if part:
        yield part


def one_round(texts: DataFrame, vocab_sent, params: dict[str, np.ndarray], part_tokens: int) -> dict[str, np.ndarray]:
    """The weights that each partition of ``t`` comes to from ``params``, averaged by its number of tokens.

    Sums are added up task by task in constant memory before the driver gets
    ADDERS of them at most.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    sent = texts.sparkSession.sparkContext.broadcast(params)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = vocab_sent.value
        if "ready" not in here:
            here["ready"] = Vocabulary.of(here["vocabulary"])
        v, total = here["ready"], 0
        keep_freed_memory()
        trainer = gru.Trainer({k: x.copy() for k, x in sent.value.items()})
        documents = (x for batch in batches for some in slices(batch, 0) for x in v.each(some.column(0)))
        for part in parts_of(documents, part_tokens, trainer.n_lanes):
            numbers, lengths = np.concatenate(part), [len(x) for x in part]
            trainer.part(v.before(numbers, lengths), *v.targets(numbers), lengths)
            total += len(numbers)
        if total:
            yield pa.RecordBatch.from_arrays([
                pa.array([TaskContext.get().partitionId() % ADDERS], pa.int32()), pa.array([float(total)]),
                pa.array([(flat(trainer.p) * total).tobytes()], pa.binary())], names=["slot", "n", "w"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, w = 0.0, 0.0
        for batch in batches:
            for many, values in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n, w = n + many, w + np.frombuffer(values)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n]), pa.array([w.tobytes()], pa.binary())],
                                             names=["slot", "n", "w"])

    schema = "slot int, n double, w binary"
    sums = texts.select("t").mapInArrow(learn, schema).repartition(ADDERS, "slot").mapInArrow(add, schema).collect()
    sent.unpersist()
    if not sums:
        return params
    return shaped(sum(np.frombuffer(r["w"]) for r in sums) / sum(r["n"] for r in sums), params)


def fit(texts: DataFrame, vocab: Vocabulary, part_tokens: int = 400_000) -> dict[str, np.ndarray]:
    """Weights learnt from every row of ``t``; ``h``, a hash, says in which round a row is read."""
    params = gru.new_params(vocab.n_direct + len(vocab.tail_log10), vocab.class_prior, vocab.word_prior)
    sent = texts.sparkSession.sparkContext.broadcast({"vocabulary": vocab.state()})
    share, before = F.pmod("h", F.lit(sum(ROUNDS))), 0
    tasks = texts.rdd.getNumPartitions()
    for part in ROUNDS:
        rows = texts.where((share >= before) & (share < before + part))
        # a task of a small round gets about as many rows as one of the largest
        fewer = max(LEAST_TASKS, -(-tasks * part // max(ROUNDS)))
        params = one_round(rows.coalesce(fewer) if fewer < tasks else rows, sent, params, part_tokens)
        before += part
    sent.unpersist()
    return params


def score_documents(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    Learns from the rows where ``held_out`` is false, scores all. Null text:
    empty, which is one token (the end). Repeated rows and null ids each get
    their row; with no training row all counts are zero and the network
    keeps its first weights. Other columns are not read.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       F.coalesce(F.col(text), F.lit("")).alias("t"))
    training = rows.where(~F.col("held_out")).withColumn("h", F.xxhash64("doc_id", "t"))
    counts = materialise(count_tokens(training), "token-counts")
    n_docs = training.count()
    vocab = vocabulary(counts, n_docs)
    params = fit(training, vocab)
    sent = docs.sparkSession.sparkContext.broadcast({"vocabulary": vocab.state(), "params": params})
    below = float(np.log10(vocab.n_tokens + vocab.n_types + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = sent.value
        if "ready" not in here:
            here["ready"] = Vocabulary.of(here["vocabulary"])
        v, p = here["ready"], here["params"]
        keep_freed_memory()
        log_count = np.log10(np.append(v.counts, 0) + 1.0)  # the last one stands for words beyond the head
        row = TaskContext.get().partitionId() << 33

        for batch in batches:
            for part in slices(batch, 2):
                numbers, lengths, head, n_rare, beyond = v.encode(part.column(2))
                cls, word = v.targets(numbers)
                logs = gru.score(p, v.before(numbers, lengths), cls, word, lengths.tolist()) / np.log(10)
                counted = log_count[head]
                tail = np.flatnonzero(numbers >= v.n_direct)
                logs[tail] += counted[tail] - v.tail_log10[numbers[tail] - v.n_direct]
                by_text = lambda x: np.add.reduceat(x, np.cumsum(lengths) - lengths)
                rare = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_rare)), pa.int32()), beyond)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(x) for x in (
                        np.arange(row, row + len(lengths)), lengths, by_text((head >= 0).astype(np.int64)) + (v.end_count > 0),
                        by_text(counted) + np.log10(v.end_count + 1) - lengths * below, by_text(logs))), rare],
                    names=["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "score", "rare"])
                row += len(lengths)

    scored = materialise(rows.mapInArrow(run, "doc_id long, held_out boolean, row long, n_tokens long, n_known long, "
                                              "base double, score double, rare array<string>"), "scores")
    rare = scored.select("row", F.explode("rare").alias("word")).join(counts, "word", "inner").groupBy("row").agg(
        F.count("*").alias("known"), F.sum(F.log10(F.col("c") + 1)).alias("more"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.drop("rare").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("known")).alias("n_known"),
        F.lit(vocab.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more")).alias("base_score"), (F.col("score") + zero("more")).alias("score"))
