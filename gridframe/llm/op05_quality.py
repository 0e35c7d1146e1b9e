"""Quality classifier from weak labels.

Heuristic labellers look at a text and vote good, bad or not at all.  Their votes overlap,
and none is trusted: expectation maximisation estimates how each one votes on good and on
bad texts, and the share of good texts, from how often each pattern of votes occurs, counted over all documents (a
table bounded by the number of patterns).  The posterior of its pattern is a document's
weak label.  A linear scorer over hashed words and the measures behind the votes is then
fitted to the weak labels of a bounded number of documents (``sample_rows``, drawn by a
hash of the id) and scores every document, so it also ranks texts no labeller spoke on.

Null texts are empty.  Repeated rows give repeated results; an empty table an empty one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import slices, text_rows, tidy

SAMPLE_ROWS, HASHED, EPOCHS, ITERATIONS = 3000, 1 << 14, 8, 60
#: (measure, bad from here, good up to here): a labeller votes by one measure and is silent between.
LABELLERS = (("capitals", 0.3, 0.08), ("symbols", 0.04, 0.004), ("stutter", 0.08, 0.01), ("dividers", 0.02, 0.0), ("copied_lines", 0.3, 0.0), ("looped", 0.5, 0.1), ("brevity", 0.2, 0.02))
PLAIN = frozenset(".,;:!?'\"()-\n\t\r ")


def measures(text: str) -> list[float]:
    words, n = text.split(), max(len(text), 1)
    chars, m = Counter(text), max(len(text.split()), 1)
    letters = max(sum(k for c, k in chars.items() if c.isalpha()), 1)
    lines = [x for x in text.split("\n") if len(x) > 20]
    pairs = list(zip(words, words[1:], words[2:], strict=False))
    return [
        sum(k for c, k in chars.items() if c.isupper()) / letters,
        sum(k for c, k in chars.items() if not c.isalnum() and c not in PLAIN) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
        chars["|"] / m,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        1 - len(set(pairs)) / len(pairs) if pairs else 0.0,
        1 / m,
    ]


def votes(values: list[float]) -> str:
    return "".join("b" if v >= bad else "g" if v <= good else "-" for v, (_, bad, good) in zip(values, LABELLERS, strict=True))


def estimate(patterns: dict[str, int], iterations: int = ITERATIONS) -> dict[str, float]:
    """The posterior of good for each pattern of votes.

    Each labeller has its own table of how often it votes good, bad or not at all on good
    and on bad texts; the first guess takes a text as bad if any labeller says so."""
    n = np.array(list(patterns.values()), float)
    outcomes = np.stack([np.array([list(p) for p in patterns]) == v for v in "gb-"], 2).astype(float)
    p = np.array([0.1 if "b" in x else 0.9 for x in patterns])
    for _ in range(iterations):
        share = np.clip((n * p).sum() / n.sum(), 0.01, 0.99)
        good, bad = ((np.tensordot(n * w, outcomes, 1) + 0.5) / ((n * w).sum() + 1.5) for w in (p, 1 - p))
        odds = np.log(share / (1 - share)) + (outcomes * np.log(good / bad)).sum((1, 2))
        p = 1 / (1 + np.exp(-odds))
    return dict(zip(patterns, p.tolist(), strict=True))


def features(text: str, values: list[float]) -> tuple[list[int], list[float]]:
    words = Counter(zlib.crc32(w.encode("utf-8", "replace")) % HASHED for w in text.lower().split())
    norm = sum(words.values()) ** 0.5 if words else 1.0
    scaled = [min(v / bad, 4.0) for v, (_, bad, _) in zip(values, LABELLERS, strict=True)]
    return [*words, *range(HASHED, HASHED + len(values) + 1)], [*(k / norm for k in words.values()), *scaled, 1.0]


def label_rows(batches: Iterator[pa.RecordBatch], with_features: bool) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts = [(t or b"").decode("utf-8", "replace") for t in b.column("text").to_pylist()]
        found = [measures(t) for t in texts]
        out = [pa.array([votes(v) for v in found], pa.string())]
        if with_features:
            at, value = zip(*map(features, texts, found), strict=True) if texts else ((), ())
            out += [pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(out, ["votes", "at", "value"][: len(out)])


def fit(rows: list, labels: dict[str, float], epochs: int = EPOCHS) -> np.ndarray:
    """Weights of a logistic scorer, by adaptive gradient steps over the sampled rows."""
    weights = np.zeros(HASHED + len(LABELLERS) + 1)
    squares, rng = np.full(len(weights), 1e-6), np.random.default_rng(3)
    data = [(np.array(r["at"]), np.array(r["value"]), labels[r["votes"]]) for r in rows]
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            at, value, y = data[i]
            g = (1 / (1 + np.exp(-np.clip(weights[at] @ value, -30, 30))) - y) * value + 1e-4 * weights[at]
            squares[at] += g * g
            weights[at] -= 0.1 * g / np.sqrt(squares[at])
    return weights


def score_rows(batches: Iterator[pa.RecordBatch], shared: object) -> Iterator[pa.RecordBatch]:
    weights, labels = shared.value
    for b in slices(batches):
        own, weak, scores = [], [], []
        for text in b.column("text").to_pylist():
            text = (text or b"").decode("utf-8", "replace")
            found = measures(text)
            at, value = features(text, found)
            own.append(votes(found))
            weak.append(labels[own[-1]])
            scores.append(float(1 / (1 + np.exp(-np.clip(weights[at] @ np.array(value), -30, 30)))))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(own, pa.string()), pa.array(weak, pa.float64()), pa.array(scores, pa.float64())], ["doc_id", "votes", "weak_label", "score"])


def classify(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, votes, weak_label (posterior of good), score and good (score of a half or more)."""
    source = text_rows(documents)
    spark = documents.sparkSession
    voted = source.mapInArrow(tidy(label_rows, False), "votes string")
    patterns = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = estimate(patterns) if patterns else {}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) < int(min(1.0, sample_rows / max(sum(patterns.values()), 1)) * (1 << 30))
    sampled = source.where(drawn).mapInArrow(tidy(label_rows, True), "votes string, at array<int>, value array<double>").collect()
    shared = spark.sparkContext.broadcast((fit(sampled, labels), labels))
    scored = source.mapInArrow(tidy(score_rows, shared), "doc_id long, votes string, weak_label double, score double")
    return scored.withColumn("good", F.col("score") >= 0.5)
