"""Scores of texts by a log-bilinear language model trained with noise contrast.

Tokens are counted over all training documents.  The most frequent have a class of their
own, the others share classes by their endings; a token's probability is that of its class
in context times its share of the class (one added to every count, one place kept for
unseen tokens).  The class model is log-bilinear: the vectors of the classes before are
weighted by place and added up, and the product with each class's vector, plus its bias,
is its logit; scores use the exact normaliser over all classes, from batched matrix
products.  Training is noise-contrastive: tell each class from classes drawn by frequency,
with the normaliser taken as 1.  A small fixed number of documents gives the start; then
every task trains on its share of all training documents and the parameters are averaged,
weighted by tokens, in two levels, so neither a task nor the driver sees more than a
bounded number of parameter sets.

Counts of frequent tokens are broadcast (at most ``head``); the others are joined.
Null and empty texts have the end token alone.  Repeated rows give repeated results; a
null doc_id is training data.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import LOWER, id_remainder, materialize, slices, text_rows, tidy

HEAD, SINGLES, CLASSES, WIDTH, CONTEXT, NOISE, BATCH = 50_000, 256, 384, 16, 3, 24, 2048
START_ROWS, RATE = 600, 0.15
END = b""


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").translate(LOWER).split(), END]


def shared_class(word: bytes) -> int:
    """The class of a word without one of its own, by its ending."""
    return SINGLES + zlib.crc32(word[-3:]) % (CLASSES - SINGLES)


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    held = Counter()
    for b in slices(batches):
        for text in b.column("text").to_pylist():
            held.update(tokens(text))
            if len(held) > 250_000:
                yield out(held)
                held = Counter()
    yield out(held)


class Vocabulary:
    """The most frequent tokens, their counts and classes, and how often each class occurs."""

    def __init__(self, words: list[bytes], counts: list[int], classes: np.ndarray, kinds: np.ndarray):
        self.index = dict(zip(words, count()))
        self.counts = np.array(counts, np.int64)
        self.of = np.array([i if i < SINGLES else shared_class(w) for i, w in enumerate(words)], np.int64)
        self.classes, self.kinds = classes, kinds

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Indices of all tokens, the number of each text's tokens, and the words that indices beyond the head stand for."""
        index, flat, lengths = Growing(self.index), [], []
        for t in texts:
            words = tokens(t)
            lengths.append(len(words))
            flat.extend(map(index.__getitem__, words))
        return np.array(flat, np.int64), np.array(lengths, np.int64), list(islice(index, len(self.index), None))

    def class_rows(self, flat: np.ndarray, lengths: np.ndarray, rest: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Classes of all texts one after another, each after a pad of ends; where the tokens stand."""
        of = np.concatenate([self.of, np.array([shared_class(w) for w in rest], np.int64)])
        end = self.of[self.index[END]] if END in self.index else 0
        row = np.full(len(flat) + CONTEXT * len(lengths), end)
        at = np.arange(len(flat)) + CONTEXT * (np.repeat(np.arange(len(lengths)), lengths) + 1)
        row[at] = of[flat]
        return row, at


class Growing(dict):
    """Gives a word that it doesn't hold the next number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add each row to the one of ``total`` that ``at`` names."""
    order = at.astype(np.uint16).argsort(kind="stable")
    own = at[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    total[own[first]] += np.add.reduceat(rows[order], first)


class Model:
    """Parameters: context vectors R, place weights C, class vectors T and biases b."""

    def __init__(self, classes: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.noise = ((classes + 1) / (classes + 1).sum()).astype(np.float32)
        self.R = rng.normal(0, 0.3, (CLASSES, WIDTH)).astype(np.float32)
        self.T = rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32)
        self.C = np.full((CONTEXT, WIDTH), 1 / CONTEXT, np.float32)
        self.b = np.log(self.noise)
        self.G = [np.full(p.shape, 1.0, np.float32) for p in (self.R, self.T, self.C, self.b)]

    def pack(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.R, self.T, self.C, self.b, *self.G)]).astype(np.float64)

    def unpack(self, flat: np.ndarray) -> Model:
        at = 0
        for x in (self.R, self.T, self.C, self.b, *self.G):
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        return self

    def query(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        return sum(self.C[k] * self.R[row[at - k - 1]] for k in range(CONTEXT))

    def step(self, row: np.ndarray, at: np.ndarray, rng: np.random.Generator) -> None:
        q, y = self.query(row, at), row[at]
        z = np.searchsorted(self.cumulative, rng.random(NOISE)).clip(0, CLASSES - 1)
        base = np.log(NOISE * self.noise)
        gy = 1 / (1 + np.exp(-((q * self.T[y]).sum(1) + self.b[y] - base[y]))) - 1
        gz = 1 / (1 + np.exp(-(q @ self.T[z].T + self.b[z] - base[z])))
        dq = gy[:, None] * self.T[y] + gz @ self.T[z]
        dT, db, dR = np.zeros_like(self.T), np.zeros_like(self.b), np.zeros_like(self.R)
        add_rows(dT, y, gy[:, None] * q)
        add_rows(dT, z, gz.T @ q)
        db += np.bincount(y, gy, CLASSES) + np.bincount(z, gz.sum(0), CLASSES)
        dC = np.zeros_like(self.C)
        for k in range(CONTEXT):
            c = row[at - k - 1]
            add_rows(dR, c, dq * self.C[k])
            dC[k] = (dq * self.R[c]).sum(0)
        for p, g, s in zip((self.R, self.T, self.C, self.b), (dR, dT, dC, db), self.G, strict=True):
            s += g * g
            p -= RATE * g / np.sqrt(s)

    def train(self, row: np.ndarray, at: np.ndarray, rng: np.random.Generator) -> None:
        self.cumulative = np.cumsum(self.noise)
        order = rng.permutation(len(at))
        for i in range(0, len(at), BATCH):
            self.step(row, at[order[i : i + BATCH]], rng)

    def log_probabilities(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural logarithms of the normalised probabilities of the classes that stand at ``at``."""
        out = np.zeros(len(at), np.float64)
        for i in range(0, len(at), 1024):
            own = at[i : i + 1024]
            logits = self.query(row, own) @ self.T.T
            logits += self.b
            logits -= logits.max(1)[:, None]
            chosen = logits[np.arange(len(own)), row[own]]
            np.exp(logits, out=logits)
            out[i : i + 1024] = chosen - np.log(logits.sum(1))
        return out


def train_share(batches: Iterator[pa.RecordBatch], shared: object, flat: np.ndarray | None, passes: int = 1) -> Iterator[pa.RecordBatch]:
    vocabulary = shared.value
    model, seen = Model(vocabulary.classes), 0
    if flat is not None:
        model.unpack(flat)
    rng = np.random.default_rng(7)
    for p in slices(batches, rows=256):
        row, at = vocabulary.class_rows(*vocabulary.encode(p.column("text").to_pylist()))
        for _ in range(passes):
            model.train(row, at, rng)
        seen += len(at)
    if seen:
        salt = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays([pa.array([salt], pa.int32()), pa.array([seen], pa.int64()), pa.array([(model.pack() * seen).tobytes()], pa.binary())], ["salt", "n", "total"])


def add_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for b in batches:
        for k, x in zip(b.column("n").to_pylist(), b.column("total").to_pylist(), strict=True):
            n, total = n + k, np.frombuffer(x) if total is None else total + np.frombuffer(x)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["salt", "n", "total"])


SHARE = "salt int, n long, total binary"


def average(shares: DataFrame) -> np.ndarray | None:
    rows = shares.repartition(16, "salt").mapInArrow(tidy(add_shares), SHARE).collect()
    return sum(np.frombuffer(r["total"]) for r in rows) / sum(r["n"] for r in rows) if rows else None


def score_rows(batches: Iterator[pa.RecordBatch], shared: object, kept: list[str]) -> Iterator[pa.RecordBatch]:
    """What is known of each document without the counts of its rare words, and those words."""
    vocabulary, flat = shared.value
    model, block, at_row = Model(vocabulary.classes).unpack(flat), TaskContext.get().partitionId(), 0
    in_class = np.log10(vocabulary.classes + vocabulary.kinds + 1)
    logs, size = np.log10(vocabulary.counts + 1), len(vocabulary.counts)
    for p in slices(batches, rows=256):
        flat_ids, lengths, rest = vocabulary.encode(p.column("text").to_pylist())
        row, at = vocabulary.class_rows(flat_ids, lengths, rest)
        first, head = np.cumsum(lengths) - lengths, flat_ids < size
        count_logs = np.where(head, logs[np.minimum(flat_ids, size - 1)] if size else 0.0, 0.0)
        own = flat_ids >= min(SINGLES, size)  # tokens that share their class
        score = model.log_probabilities(row, at) / np.log(10) + np.where(own, count_logs - in_class[row[at]], 0)
        place, times = np.unique((np.repeat(np.arange(len(lengths)), lengths) << 40 | flat_ids)[~head], return_counts=True)
        word = pa.array(rest, pa.binary()).take(pa.array((place & (1 << 40) - 1) - size))
        offsets = np.cumsum([0, *np.bincount(place >> 40, minlength=len(lengths))])
        rows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([word, pa.array(times, pa.int64())], ["word", "times"]))
        sums = [np.add.reduceat(x, first) for x in (head.astype(np.int64), count_logs, score)]
        key = pa.array(np.arange(at_row, at_row + p.num_rows) + (block << 40))
        at_row += p.num_rows
        yield pa.RecordBatch.from_arrays([key, *map(p.column, kept), pa.array(lengths), *map(pa.array, sums), rows], ["row", *kept, "n_tokens", "known", "count_logs", "class_score", "rest"])


def most_frequent(counts: DataFrame, head: int) -> list[tuple[bytes, int]]:
    """At most ``head`` tokens with their counts, most frequent first.

    Counts are told apart in steps of an eighth of a power of two, and whole steps are
    taken, so the driver gets a few hundred rows and then the tokens that it keeps."""
    step = F.floor(8 * F.log2("n"))
    least, total = None, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        total += r["n"]
        if total > head:
            break
        least = r["step"]
    rows = [] if least is None else counts.where(step >= least).collect()
    return sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


def fit(training: DataFrame, head: int = HEAD, start_rows: int = START_ROWS) -> tuple[DataFrame, Vocabulary, np.ndarray, int, int]:
    """Token counts (a table), the vocabulary, the parameters, N and V of ``training(doc_id, text)``."""
    spark = training.sparkSession
    training = text_rows(training)
    counts = materialize(training.mapInArrow(tidy(count_tokens), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "tokens")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = most_frequent(counts, head)
    singles = spark.sparkContext.broadcast({w: i for i, (w, _) in enumerate(top[:SINGLES])})

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for b in batches:
            of = np.array([singles.value.get(w, -1) for w in b.column("word").to_pylist()], np.int64)
            own = np.flatnonzero(of < 0)
            words = b.column("word")
            of[own] = [shared_class(words[int(i)].as_py()) for i in own]
            np.add.at(total, of, b.column("n").to_numpy())
            np.add.at(kinds, of, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(total), pa.array(kinds)], ["k", "n", "kinds"])

    rows = counts.mapInArrow(tidy(by_class), "k long, n long, kinds long").groupBy("k").agg(F.sum("n"), F.sum("kinds")).orderBy("k").collect()
    classes, kinds = (np.array([r[i] for r in rows] or [0] * CLASSES, np.int64) for i in (1, 2))
    vocabulary = Vocabulary([w for w, _ in top], [k for _, k in top], classes, kinds)
    shared = spark.sparkContext.broadcast(vocabulary)
    documents = training.count()
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("start")), F.lit(1 << 30)) < F.lit(int(min(1.0, start_rows / max(documents, 1)) * (1 << 30)))
    start = average(training.where(drawn).repartition(1).mapInArrow(tidy(train_share, shared, None, 3), SHARE))
    flat = average(training.mapInArrow(tidy(train_share, shared, start), SHARE))
    return counts, vocabulary, Model(classes).pack() if flat is None else flat, n, v


def score(documents: DataFrame, fitted: tuple, *keep: str) -> DataFrame:
    """doc_id, the columns to keep, n_tokens, n_known, train_tokens, base_score and score."""
    counts, vocabulary, flat, n, v = fitted
    shared = documents.sparkSession.sparkContext.broadcast((vocabulary, flat))
    source = text_rows(documents, *keep)
    kept = ["doc_id", *keep]
    types = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = "row long, " + ", ".join(f"`{c}` {types[c]}" for c in kept) + ", n_tokens long, known long, count_logs double, class_score double, rest array<struct<word:binary,times:long>>"
    rows = materialize(source.mapInArrow(tidy(score_rows, shared, kept), schema), "scored")
    rare = rows.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.times").join(counts, "word")
    more = rare.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    known, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    out = rows.drop("rest").join(more, "row", "left")
    each = float(np.log10(n + v + 1))
    return out.select(*kept, "n_tokens", (F.col("known") + known).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("count_logs") + logs - F.col("n_tokens") * F.lit(each)).alias("base_score"), (F.col("class_score") + logs).alias("score"))


def cross_fit(documents: DataFrame) -> DataFrame:
    """Scores of all documents by what those with crc32(doc_id) mod 7 other than 2 teach."""
    held = F.coalesce(id_remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    marked = documents.select("doc_id", "text", held.alias("held_out"))
    return score(marked, fit(marked.where("not held_out")), "held_out")
