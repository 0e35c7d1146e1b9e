"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are its runs of ``width`` consecutive words (a shorter item is one
window).  A document holds a window only if it holds all its words, so one necessary
word is enough to find it: words are ordered by how often the documents use them, and
each window is filed under its rarest word, with that word's place in it.  Documents are
scanned once; a filed word at place ``i`` proposes the window that would start at
``i - place``, the length and position bounds drop those that would not fit into the
document, and the words of the proposed stretch are compared exactly.

The benchmark is taken in blocks of at most ``block_words`` words, measured before
anything is broadcast; each block is one pass over the documents, so a benchmark of any
size works and no document text is ever shuffled.

Null texts have no words; a document without words is never contaminated.  Repeated rows
give repeated results, a repeated item_id counts once, null item_ids are left out.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import materialize, slices, text_rows, tidy

WIDTH, SHARE, BLOCK_WORDS = 13, 20, 200_000
#: Bytes that are no part of a word become spaces; A-Z become a-z.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def frequencies(batches: Iterator[pa.RecordBatch], wanted: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    total = Counter()
    for b in slices(batches):
        for text in b.column("text").to_pylist():
            total.update(filter(wanted.__contains__, words_of(text)))
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def file_windows(items: list[tuple[str, list[bytes]]], often: dict[bytes, int], width: int) -> dict[bytes, dict[tuple[int, int], dict[tuple, set[str]]]]:
    """rarest word -> (its place, window length) -> window -> the items that have it."""
    filed: dict = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
    for item, words in items:
        for start in range(max(1, len(words) - width + 1)):
            window = tuple(words[start : start + width])
            place = min(range(len(window)), key=lambda i: (often.get(window[i], 0), window[i], i))
            filed[window[place]][place, len(window)][window].add(item)
    return {w: {k: dict(v) for k, v in by.items()} for w, by in filed.items()}


def scan(batches: Iterator[pa.RecordBatch], shared: object, first: bool, kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds this block's hit words (runs of start and end) and items to each document."""
    filed = shared.value
    for b in slices(batches):
        counts, runs, found = [], [], []
        before = zip(b.column("runs").to_pylist(), b.column("items").to_pylist(), strict=True) if not first else None
        for text in b.column("text").to_pylist():
            words = words_of(text)
            old_runs, old_items = next(before) if before else ((), ())
            hits, items = [tuple(r.values()) for r in old_runs], set(old_items)
            for i in [i for i, w in enumerate(words) if w in filed]:
                for (place, length), windows in filed[words[i]].items():
                    start = i - place
                    if start >= 0 and start + length <= len(words):
                        own = windows.get(tuple(words[start : start + length]))
                        if own:
                            hits.append((start, start + length))
                            items |= own
            merged: list[list[int]] = []
            for start, end in sorted(hits):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(end, merged[-1][1])
                else:
                    merged.append([start, end])
            counts.append(len(words))
            runs.append([{"start": s, "end": e} for s, e in merged])
            found.append(sorted(items))
        spans = pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        added = [pa.array(counts, pa.int64()), spans, pa.array(found, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*map(b.column, kept), *added], [*kept, "n_words", "runs", "items"])


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = SHARE, block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, the columns to keep, n_words, runs of hit words, items found, n_hit, contaminated.

    A document is contaminated if ``share`` times its hit words are at least its words.
    """
    spark = documents.sparkSession
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    # an upper bound of an item's words: half its bytes and one more
    sized = items.withColumn("size", F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / 2) + 1)
    blocks = int(sized.agg(F.ceil(F.sum("size") / block_words)).first()[0] or 1)
    sized = sized.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    source = text_rows(documents, *[F.col(c).alias(f"kept_{c}") for c in keep])
    kept_types = {f.name: f.dataType.simpleString() for f in source.schema}
    out = source
    for block in range(blocks):
        held = [(r["item_id"], w) for r in sized.where(F.col("block") == block).collect() if (w := words_of(r["text"]))]
        wanted = frozenset(w for _, words in held for w in words)
        counted = text_rows(documents).mapInArrow(tidy(frequencies, wanted), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        often = {bytes(r["word"]): r["n"] for r in counted.collect()}
        shared = spark.sparkContext.broadcast(file_windows(held, often, width))
        if block:
            out = materialize(out, "decontamination")
        kept = [c for c in kept_types if c != "text" or block < blocks - 1]
        schema = ", ".join(f"`{c}` {kept_types[c]}" for c in kept) + ", n_words long, runs array<struct<start:int,end:int>>, items array<string>"
        out = out.mapInArrow(tidy(scan, shared, not block, kept), schema)
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    out = out.withColumnsRenamed({f"kept_{c}": c for c in keep})
    return out.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: counts and one digest for the items instead of spans and texts."""
    joined = F.concat_ws(",", "items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), "contaminated")
