"""Best-fit packing of token sequences by a configuration linear program.

Every document becomes token ids and an end id; documents longer than a sequence are
cut into full pieces and a rest.  The histogram of piece lengths, at most ``capacity``
numbers however large the corpus is, goes to the driver.  There the configuration
program (fewest sequences so that the chosen fillings cover every length) is solved by
multiplicative weights: each round prices the lengths by how little they are covered
yet, and an unbounded knapsack by dynamic programming finds the best filling at these
prices.  The fractional solution is rounded down, never past a length's count, and the
remaining histogram is filled best-fit decreasing.  Executors then look up each piece's
place by its rank among the pieces of its length.

Null texts are empty documents (the end id alone).  Repeated rows are packed once each.
An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm.common import materialize, slices, text_rows, tidy

CAPACITY, END_ID, ROUNDS = 4096, 1, 150
#: Bounds of a worker's word cache: entries, and bytes of a word that is kept.
CACHE_WORDS, CACHE_BYTES = 600_000, 64
#: ASCII signs that may end a word (fixed values); the apostrophe may begin a contraction.
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: How byte-level vocabularies write bytes: printable Latin-1 signs as they are, the others from 256 on.
BYTE_SIGNS = dict(zip([b for b in range(256) if b != 32 and not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)], [256 + k for k in range(69) if k != 32]))
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, rank long"


#: The vocabulary that this worker has read, and its cache: tasks that follow go on with them.
HELD: dict[str, WordIds] = {}


def held_words(path: str) -> WordIds:
    if path not in HELD:
        HELD.clear()
        HELD[path] = WordIds(path)
    return HELD[path]


class WordIds:
    """Little-endian ids of whole texts, put together from those of words.

    The vocabulary's pre-tokenizer never joins across white space, so a text's ids are
    those of its words one after another; each distinct word is encoded once.  Many new
    words are encoded as one text, with a bar between them, which is a token of its own.
    A word of Latin letters, maybe with signs after it, is small letters for one token and
    the signs for another: its letters go to the vocabulary's merges without its text rules.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.cache: dict[bytes, bytes] = {}
        bar = encoded(self.tokenizer, ["|"])[0]
        probe = ["a", "house", "\u00e4rger", "the\u00f1o"]
        whole = [x.tolist() for x in encoded(self.tokenizer, ["a | b", "a", "b", "Probe,;", "probe", ",;"])]
        self.bar = bar[0] if len(bar) == 1 and whole[0] == [*whole[1], *bar, *whole[2]] else None
        self.letters_alone = False
        if self.bar is not None and whole[3] == [*whole[4], *whole[5]]:
            self.letters_alone = [x.tobytes() for x in encoded(self.tokenizer, probe)] == self.of_stems([x.encode() for x in probe])

    def between_bars(self, tokenizer: object, text: str, n: int) -> list[bytes] | None:
        own = encoded(tokenizer, [text])[0]
        bars = np.flatnonzero(own == self.bar)
        if len(bars) != n - 1:
            return None
        data, ends = own.tobytes(), [*(4 * bars).tolist(), 4 * len(own)]
        return [data[i:j] for i, j in zip([0, *[x + 4 for x in ends]], ends)]

    def of_stems(self, stems: list[bytes]) -> list[bytes] | None:
        text = b" | ".join(stems)
        return self.between_bars(self.merges, text.decode("latin-1") if text.isascii() else text.decode("latin-1").translate(BYTE_SIGNS), len(stems))

    def of_words(self, words: list[bytes]) -> list[bytes]:
        joined = None if self.bar is None or any(b"|" in w for w in words) else self.between_bars(self.tokenizer, b" | ".join(words).decode("utf-8", "replace"), len(words))
        return joined or [x.tobytes() for x in encoded(self.tokenizer, [w.decode("utf-8", "replace") for w in words])]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        used = set().union(*split)
        if len(self.cache) > CACHE_WORDS:  # words of these texts stay: frequent ones are among them
            self.cache = {w: self.cache[w] for w in used.intersection(self.cache)}
        found = self.cache
        new = used.difference(found)
        plain = {w for w in new if w.isalpha() and len(w) <= CACHE_BYTES} if self.letters_alone else set()  # ASCII letters
        stems = {w for w in plain if w.islower()}  # ids of their own; all other words of letters are put together from such
        parts = {w: (w.lower(), b"") for w in plain.difference(stems)}
        if self.letters_alone:
            for w in new.difference(plain):
                stem = w.rstrip(SIGNS)
                if stem.isalpha() and len(stem) <= CACHE_BYTES:
                    parts[w] = (stem.lower(), w[len(stem) :])
                elif p := letters_and_signs(w):
                    parts[w] = p
        whole = [*new.difference(plain, parts), *{signs for _, signs in parts.values()}.difference(found, [b""])]
        whole.sort(key=lambda w: b"|" in w)
        for i in range(0, len(whole), 2000):
            found.update(zip(whole[i : i + 2000], self.of_words(whole[i : i + 2000]), strict=True))
        stems = sorted(stems.union(stem for stem, _ in parts.values()).difference(found), key=bytes.isascii)
        for i in range(0, len(stems), 2000):
            found.update(zip(stems[i : i + 2000], self.of_stems(stems[i : i + 2000]), strict=True))
        for w, (stem, signs) in parts.items():
            found[w] = found[stem] + found[signs] if signs else found[stem]
        out = [b"".join(map(found.__getitem__, words)) for words in split]
        for w in [w for w in (*whole, *parts) if len(w) > CACHE_BYTES]:
            found.pop(w, None)
        return out


def encoded(tokenizer: object, texts: list[str]) -> list[np.ndarray]:
    return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def letters_and_signs(word: bytes) -> tuple[bytes, bytes] | None:
    """The small letters of a word and the signs after them; nothing for other words."""
    stem = word.rstrip(SIGNS)
    if len(stem) > CACHE_BYTES:
        return None
    if stem.isalpha():  # ASCII letters
        return stem.lower(), word[len(stem) :]
    text = stem.decode("utf-8", "replace")
    small = text.lower()
    if not text.isalpha() or max(text) >= "\u0250" or len(small) != len(text):
        return None
    return small.encode(), word[len(stem) :]


def cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    words = held_words(path)
    end, seen, block = np.array([end_id], "<u4").tobytes(), Counter(), TaskContext.get().partitionId()
    names = [x.split()[0] for x in PIECES.split(",")] + ["ids"] * keep_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * keep_ids
    for batch in slices(batches, 2 << 20):
        rows = []
        for doc, packed in zip(batch.column("doc_id").to_pylist(), words.ids([t or b"" for t in batch.column("text").to_pylist()]), strict=True):
            packed += end
            for piece, at in enumerate(range(0, len(packed), 4 * capacity)):
                own = packed[at : at + 4 * capacity]
                n = len(own) // 4
                rows.append((doc, piece, at // 4, n, zlib.crc32(own), block, seen[n], *[own] * keep_ids))
                seen[n] += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def best_filling(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> Counter:
    """The multiset of sizes with the largest worth that fits into ``capacity``."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(int(sizes[0]), capacity + 1):
        value = best[c - sizes[: fits[c]]] + worth[: fits[c]]
        k = int(value.argmax())
        best[c], took[c] = value[k], k
    filling, c = Counter(), capacity
    while took[c] >= 0:
        filling[int(sizes[took[c]])] += 1
        c -= int(sizes[took[c]])
    return filling


def fillings(histogram: dict[int, int], capacity: int, rounds: int) -> list[tuple[int, Counter]]:
    """How often each filling is used; together they hold exactly the histogram."""
    left = {n: k for n, k in histogram.items() if k}
    chosen = [(left.pop(capacity), Counter({capacity: 1}))] if capacity in left else []
    if left and rounds:
        sizes = np.array(sorted(left))
        need = np.array([left[n] for n in sizes.tolist()], float)
        covered, found = np.zeros(len(sizes)), Counter()
        step = max(float((sizes * need).sum()) / capacity / rounds, 1e-9)  # sequences that a round adds
        at = {n: i for i, n in enumerate(sizes.tolist())}
        for done in range(1, rounds + 1):
            lack = 1 - covered / need * rounds / done
            price = np.exp(np.clip(3 * lack, -30, 30)) * sizes * np.where(covered < need, 1, 1e-3)
            own = best_filling(sizes, price, capacity)
            for n, k in own.items():
                covered[at[n]] += k * step
            found[tuple(sorted(own.items()))] += step
        for own, times in found.most_common():
            m = min([int(times), *(left.get(n, 0) // k for n, k in own)])
            if m:
                chosen.append((m, Counter(dict(own))))
                for n, k in own:
                    left[n] -= k * m
    left = {n: k for n, k in left.items() if k}
    order = sorted(left)
    while order:
        own, room = Counter(), capacity
        upper = len(order)
        while upper := bisect.bisect_right(order, room, 0, upper):
            n = order[upper - 1]
            k = min(left[n], room // n)
            own[n] += k
            room -= k * n
            upper -= 1
        m = min(left[n] // k for n, k in own.items())
        chosen.append((m, own))
        for n, k in own.items():
            left[n] -= k * m
            if not left[n]:
                del left[n]
                del order[bisect.bisect_left(order, n)]
    return chosen


def places(chosen: list[tuple[int, Counter]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks of runs, and each run's first sequence and offset in it."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    rank, base = Counter(), 0
    for m, own in chosen:
        offset = 0
        for n, k in sorted(own.items(), reverse=True):
            for _ in range(k):
                out.setdefault(n, []).append((rank[n], base, offset))
                rank[n] += m
                offset += n
        base += m
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for n, rows in out.items()}


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, rounds: int = ROUNDS, keep_ids: bool = False) -> DataFrame:
    """One row per piece of ``documents(doc_id, text)`` with its place in a sequence.

    ``rounds`` bounds the rounds of multiplicative weights; ``keep_ids`` adds the ids.
    The driver holds the length histogram and the fillings, both bounded by ``capacity``.
    """
    schema = PIECES + ", ids binary" * keep_ids
    pieces = materialize(text_rows(documents).mapInArrow(tidy(cut, tokenizer_path, capacity, end_id, keep_ids), schema), "pieces")
    counts = pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(fillings(histogram, capacity, rounds))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(zero_copy_only=False), b.column("at").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                firsts, base, start = where[n]
                run = np.searchsorted(firsts, rank[own], "right") - 1
                sequence[own], offset[own] = base[run] + rank[own] - firsts[run], start[run]
            kept = [c for c in b.schema.names if c != "at"]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    ranked = pieces.join(first, ["length", "block"]).select(*kept, (F.col("rank") + F.col("before")).alias("at"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, out)
