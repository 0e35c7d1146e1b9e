"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts (orders 0 to ``order``).  The
code length of a byte after a context is that of the longest context seen in training in
which the byte followed; every longer one that had been seen costs its escape
probability q / (n + q) (n symbols seen, q of them different), and below order 0 every
byte is equally likely.  Statistics are frozen after training, so a byte's code length
depends on the byte and the bytes before it alone.  Contexts start anew at white space
(a word is coded with blanks before it and one after it), so the length of a text is the
sum over its words, and a worker codes each distinct word once.

Training takes a bounded number of rows per language (``sample_rows``, by a hash of the
id, so that the share does not depend on order or on partitions); their context counts
are summed by Spark and only then sent to the driver.

A null text, or one without a letter, is ``und`` with score 0.  Rows with a null lang
don't train.  Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import id_remainder, slices, text_rows, tidy

ORDER, SAMPLE_ROWS = 3, 1000
UNKNOWN = "und"
CACHE_WORDS, CACHE_BYTES = 250_000, 48
LETTER = re.compile(r"[a-z]")


def grams_of(word: bytes, order: int = ORDER) -> np.ndarray:
    """Each byte of a word, and the blank after it, with the ``order`` bytes before it, as one number."""
    a = np.frombuffer(b" " * order + word + b" ", np.uint8).astype(np.uint32)
    out = np.zeros(len(word) + 1, np.uint32)
    for k in range(order + 1):
        out = (out << np.uint32(8)) | a[k : k + len(out)]
    return out


def lowered(text: bytes | None) -> str:
    return (text or b"").decode("utf-8", "replace").lower()


def has_letter(text: str) -> bool:
    """Whether a character is a letter (Unicode category L)."""
    return bool(LETTER.search(text)) or any(map(str.isalpha, text))


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        by: dict[str, Counter] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            by.setdefault(lang, Counter()).update(lowered(text).encode().split())
        for lang, words in by.items():
            grams = [grams_of(w) for w in words]
            if grams:
                own, at = np.unique(np.concatenate(grams), return_inverse=True)
                n = np.bincount(at, np.repeat(np.fromiter(words.values(), float), [len(g) for g in grams])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


class ContextTree:
    """Frozen statistics of one language; ``bits`` gives code lengths of bytes in context."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.levels = []
        for k in range(order, -1, -1):
            own, at = np.unique(grams & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(at, counts)
            contexts, of = np.unique(own >> np.uint32(8), return_inverse=True)
            total, kinds = np.bincount(of, n), np.bincount(of)
            self.levels.append((np.uint32((1 << 8 * (k + 1)) - 1), own, np.log2((total + kinds)[of] / n), contexts, np.log2((total + kinds) / kinds)))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for mask, own, cost, contexts, escape in self.levels:
            if not len(open_):
                return out
            g = grams[open_] & mask
            at = np.minimum(np.searchsorted(own, g), len(own) - 1)
            seen = own[at] == g
            out[open_[seen]] += cost[at[seen]]
            open_, g = open_[~seen], g[~seen] >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, g), len(contexts) - 1)
            known = contexts[at] == g
            out[open_[known]] += escape[at[known]]
        out[open_] += 8
        return out


class Model:
    def __init__(self, trees: dict[str, ContextTree]):
        self.languages = sorted(trees)
        self.trees = [trees[x] for x in self.languages]
        self.forget()

    def forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.costs = np.zeros((0, len(self.languages)))

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "trees": self.trees}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def cost(self, words: list[bytes]) -> np.ndarray:
        grams = [grams_of(w) for w in words]
        starts, all_ = np.cumsum([0] + [len(g) for g in grams[:-1]]), np.concatenate(grams)
        distinct, at = np.unique(all_, return_inverse=True)
        return np.stack([np.add.reduceat(t.bits(distinct)[at], starts) for t in self.trees], 1)

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code length of each text in bits under each language."""
        if len(self.rows) > CACHE_WORDS:
            self.forget()
        split = [t.encode().split() for t in texts]
        new = set().union(*split).difference(self.rows)
        short = [w for w in new if len(w) <= CACHE_BYTES]
        if short:
            self.rows.update(zip(short, range(len(self.rows), len(self.rows) + len(short)), strict=True))
            self.costs = np.concatenate([self.costs, self.cost(short)])
        out = np.zeros((len(texts), len(self.languages)))
        for i, words in enumerate(split):
            at = [k for k in map(self.rows.get, words) if k is not None]
            out[i] = self.costs[at].sum(0) if at else 0
            if len(at) < len(words):
                out[i] += sum(self.cost([w])[0] for w in words if w not in self.rows)
        return out


def predict(batches: Iterator[pa.RecordBatch], shared: object) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for b in slices(batches):
        texts = [lowered(t) for t in b.column("text").to_pylist()]
        names, scores = [], []
        lengths = model.lengths(texts) if model.languages else np.zeros((len(texts), 0))
        for text, own in zip(texts, lengths, strict=True):
            if not len(own) or not has_letter(text):
                names.append(UNKNOWN)
                scores.append(0.0)
            else:
                best = int(own.argmin())
                names.append(model.languages[best])
                scores.append(float(1 / np.exp2(np.maximum(own[best] - own, -1000)).sum()))
        kept = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])
    model.forget()  # workers outlive their tasks


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of ``labelled(doc_id, text, lang)``: about ``sample_rows`` rows of each language,
    all where there are no more."""
    labelled = labelled.where("lang is not null and text is not null")
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not rows:
        return Model({})
    share = F.lit(0.0)
    for lang, n in sorted(rows.items()):
        share = F.when(F.col("lang") == lang, min(1.0, sample_rows / n)).otherwise(share)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < share * (1 << 30)
    counted = labelled.where(drawn).select("lang", "text").mapInArrow(tidy(count_grams), "lang string, gram long, n long")
    got = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return Model({lang: ContextTree(own["gram"].to_numpy(np.uint32), own["n"].to_numpy(float)) for lang, own in got.groupby("lang")})


def identify(documents: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, the columns to keep, lang_pred and score (the posterior of equally likely languages)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = text_rows(documents, *[F.col(c).alias(f"kept_{c}") for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    found = rows.mapInArrow(tidy(predict, shared), schema + ", lang_pred string, score double")
    return found.withColumnsRenamed({f"kept_{c}": c for c in keep})


def cross_fit(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Predictions for all documents by a model of those with crc32(doc_id) mod 3 other than 1."""
    held = F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    marked = documents.select("doc_id", "text", "lang", held.alias("held_out"))
    model = train(text_rows(marked.where("not held_out"), "lang"), sample_rows)
    return identify(marked, model, "held_out")
