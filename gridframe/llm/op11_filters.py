"""Filter interaction audit: what five text filters remove alone, in every order, and at whose cost.

The filters: A under 200 words, B fewer than half of the words distinct, C more than 2 % capital
letters, D one of ``#$%&*|``, E identical to the text of a smaller doc_id.  Words are runs of bytes
that are no white space; case counts.

One scan reads the Arrow buffers of whole texts: a table of byte classes, whose prefix sums give
words, capitals, symbols and code points of each text, and hashes of words, sorted within each text;
neighbours of equal hash are compared byte by byte, so distinct words are exact.  The scan leaves
a mask of four failures and a SHA-256 of the text for each row.  E joins each text's smallest
doc_id back by (digest, doc_id), a key that no group of copies makes hot.  Documents are then
counted by part, mask and labels, at most 128 rows a part, and all orders are worked out
from these counts.

A null text is empty, a null part the empty string.  Rows that share doc_id and text are copies
of one document: none has a smaller doc_id, so E fails none of them.  A row without a doc_id
is not identical to a smaller one and none is smaller than it; it has no labels.  A document is
good (toxic) if any of its label rows says so.  No documents give no parts and no rows.
Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm import spans
from gridframe.llm.common import discard, materialize, slices, tidy

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 2, b"#$%&*|"
#: Bits of the byte classes.
WORD, CAPITAL, SYMBOL, INNER = 1, 2, 4, 8
CLASSES = (~spans.SPACE * WORD + spans.byte_table(range(65, 91)) * CAPITAL + spans.byte_table(SYMBOLS) * SYMBOL + spans.byte_table(range(128, 192)) * INNER).astype(np.uint8)
#: Rows of a slice: the text's number in it takes so many bits of a sort key.
ROW_BITS = 12


def within(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text, by prefix sums."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def distinct_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """The number of distinct words of each text: sorted hashes, neighbours verified."""
    lanes = spans.lanes_of(data)
    key = owner.astype(np.uint64) << np.uint64(64 - ROW_BITS) | spans.hashes(data, lanes, begin, end) >> np.uint64(ROW_BITS)
    order = np.argsort(key)
    key = key[order]
    again = np.flatnonzero(key[1:] == key[:-1]) + 1
    alike = spans.equal(data, lanes, begin, end, order[again - 1], order[again])
    found = np.bincount(owner, minlength=texts) - np.bincount(owner[order[again]], minlength=texts)
    for text in np.unique(owner[order[again[~alike]]]):  # words of one hash that differ
        own = np.flatnonzero(owner == text)
        found[text] = len({data[i:j].tobytes() for i, j in zip(begin[own], end[own], strict=True)})
    return found


def failures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A mask for each text: bits 0 to 3 for the filters A to D."""
    kinds = CLASSES[data]
    begin, end, owner = spans.words(data, offsets, ~spans.SPACE)
    texts = len(offsets) - 1
    n = np.bincount(owner, minlength=texts)
    distinct = distinct_words(data, begin, end, owner, texts)
    capitals, symbols, inner = (within(kinds & bit != 0, offsets) for bit in (CAPITAL, SYMBOL, INNER))
    points = np.diff(offsets) - inner
    return (n < LEAST_WORDS) + 2 * (100 * distinct < DISTINCT_PERCENT * n) + 4 * (100 * capitals > CAPITAL_PERCENT * points) + 8 * (symbols > 0)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, rows=1 << ROW_BITS):
        data, offsets = spans.texts_of(b.column("text"))
        digests = [hashlib.sha256(data[i:j]).digest() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(digests, pa.binary()), pa.array(failures(data, offsets).astype(np.int32))], ["doc_id", "part", "digest", "fails"])


def text_failures(documents: DataFrame, part: str) -> DataFrame:
    """doc_id, part, digest of the text, and the mask of A to D, of every row."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text)
    return source.mapInArrow(tidy(scan), "doc_id long, part string, digest binary, fails int")


def counted(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, fails, good, toxic, n): how many documents have each mask of failures."""
    scanned = materialize(text_failures(documents, part), "filters")
    rows = scanned.groupBy("doc_id", "part", "digest", "fails").agg(F.count(F.lit(1)).alias("n"))
    first = scanned.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    known = rows.join(first, ["doc_id", "digest"], "left").withColumn("fails", F.col("fails") + F.when(copy, 16).otherwise(0))
    known = known.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    out = materialize(known.groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n")), "masks")
    discard(scanned)
    return out


def orders() -> list[tuple[str, int, int, int]]:
    """Every order and step: the filter's number and the mask of the filters before it."""
    return [("".join(FILTERS[f] for f in p), i + 1, p[i], sum(1 << f for f in p[:i])) for p in permutations(range(len(FILTERS))) for i in range(len(FILTERS))]


def audit(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    n, fails, before, f = F.col("n"), F.col("fails"), F.col("before"), F.col("f")
    masks = len(FILTERS)
    bit = F.expr("shiftleft(1, f)")

    def total(which: Column) -> Column:
        return F.sum(F.when(which, n).otherwise(0))

    looks = counted(documents, labels, part).withColumn("f", F.explode(F.array(*map(F.lit, range(masks))))).withColumn("before", F.explode(F.array(*map(F.lit, range(1 << masks))))).where(before.bitwiseAND(bit) == 0)
    own, reached = fails.bitwiseAND(bit) != 0, fails.bitwiseAND(before) == 0
    steps = looks.groupBy("part", "f", "before").agg(
        total(fails.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total(own & reached).alias("removed"),
        total(own & ~reached).alias("redundant"),
        total(fails == bit).alias("unique_fails"),
        total(own & reached & F.col("good")).alias("good_lost"),
        total(own & reached & F.col("toxic")).alias("toxic_lost"),
    )
    ways = F.element_at(F.array(*[F.lit(factorial(k) * factorial(masks - 1 - k)) for k in range(masks)]), F.bit_count(before) + 1)
    steps = steps.withColumn("shapley", F.sum(F.col("removed") * ways).over(Window.partitionBy("part", "f")))
    places = documents.sparkSession.createDataFrame(orders(), "filter_order string, step int, f int, before int")
    return steps.join(F.broadcast(places), ["f", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def oracle_sql() -> str:
    word = r"[^\x20\x09-\x0D]+"
    return f"""WITH marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) good, bool_or(coalesce(toxic = 1, false)) toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
      texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
      firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
      split AS (SELECT doc_id, part, t, first, regexp_extract_all(t, '{word}') AS ws FROM texts JOIN firsts USING (t)),
      failed AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CASE WHEN len(ws) < {LEAST_WORDS} THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(ws)) < {DISTINCT_PERCENT} * len(ws) THEN 2 ELSE 0 END
        + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {CAPITAL_PERCENT} * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS fails FROM split LEFT JOIN marks USING (doc_id)),
      masks AS (SELECT part, fails, good, toxic, count(*) AS n FROM failed GROUP BY ALL),
      letters(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
      orders AS (SELECT v.l || w.l || x.l || y.l || z.l AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits FROM letters v, letters w, letters x, letters y, letters z WHERE v.b + w.b + x.b + y.b + z.b = 31 AND v.b | w.b | x.b | y.b | z.b = 31),
      places AS (SELECT filter_order, s::INTEGER AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INTEGER AS before FROM orders, range(1, 6) r(s)),
      steps AS (SELECT part, filter_order, step, bit, sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails & bit > 0 AND fails & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN fails & bit > 0 AND fails & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN fails & bit > 0 AND fails & before = 0 AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails & bit > 0 AND fails & before = 0 AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM masks, places GROUP BY ALL)
      SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM steps"""
