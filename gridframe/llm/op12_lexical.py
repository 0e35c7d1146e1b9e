"""Ranked lexical search: score-at-a-time over postings in order of impact.

A term's impact in a document is an integer: its weight times a quotient of its occurrences and
the document's length.  Documents are read once for the items' terms; each task then holds one
shard of documents at a time.  A shard's postings are grouped by term and exact quotient, largest
first.  An item reads the groups of its terms in descending impact, a twelfth of its postings at a
time, into one accumulator a document.  What is unread of a term adds no more than its next
group, so a document's score lies between its accumulator and that plus the sum of the next
impacts.  The documents ahead are completed at each depth; the k-th best of them is a bar.  Reading
stops only when the bounds prove that no document outside a pool of those read can reach the bar
(of this shard, or of those the task had before) and the pool's documents hold fewer postings than
are left to read; the pool's scores are then completed from its documents.

Items are a stated query set, taken in blocks of ``block_terms`` terms, a size that doesn't grow
with the documents; terms, document frequencies and weights of one block are sent to all tasks.
All rows of ``documents`` are read for each block, and each task sends k rows an item on.

A null text has no terms.  Repeated rows are documents of their own.  Rows without a doc_id count
and are ranked, after those of equal score that have one.  Items with the same item_id are one
item with the terms of all (those without an id too); an item without terms, or whose terms are
in no document, gives no rows, as do empty tables.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm import spans
from gridframe.llm.common import discard, materialize, slices, tidy

K, SHARE = 10, 90
TERM = spans.byte_table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Terms of the items of a block, counted by item; postings of a shard.
BLOCK_TERMS, SHARD_POSTINGS = 1 << 20, 1 << 20
#: An item reads its postings in so many parts at most, and looks at the bounds after each.
LOOKS = 12
#: Above every quotient (1000 occurrences without end give less than 10 ** 6 by a tenth).
QUOTIENT_BITS = 20
NO_ID = np.iinfo(np.int64).max


class Vocabulary:
    """The terms of a block of items, found by hash and then compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        size = np.array([len(t) for t in terms], np.int64)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        h = spans.hashes(self.data, spans.lanes_of(self.data), self.begin, self.end)
        self.order = np.argsort(h)
        self.hashes = h[self.order]

    def numbers(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each span's term, -1 for others."""
        found = np.full(len(begin), -1)
        if not len(self.hashes):
            return found
        h = spans.hashes(data, spans.lanes_of(data), begin, end)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        while len(hit):  # the next term of the same hash, where the bytes differ
            term = self.order[at[hit]]
            both = np.concatenate([data, self.data])
            b, e = np.concatenate([begin[hit], self.begin[term] + len(data)]), np.concatenate([end[hit], self.end[term] + len(data)])
            n = np.arange(len(hit))
            same = spans.equal(both, spans.lanes_of(both), b, e, n, n + len(hit))
            found[hit[same]] = term[same]
            hit = hit[~same]
            at[hit] += 1
            hit = hit[at[hit] < len(self.hashes)]
            hit = hit[self.hashes[at[hit]] == h[hit]]
        return found


def occurrences(batches: Iterator[pa.RecordBatch], shared: object) -> Iterator[pa.RecordBatch]:
    """doc_id, the number of terms, and the terms of the vocabulary with how often each stands in the text."""
    for b in slices(batches):
        data, offsets = spans.texts_of(b.column("text"))
        data = LOWER[data]
        begin, end, owner = spans.words(data, offsets, TERM)
        term = shared.value.numbers(data, begin, end)
        kept = term >= 0
        pairs, tf = np.unique(owner[kept] << 32 | term[kept], return_counts=True)
        starts = pa.array(np.searchsorted(pairs, np.arange(b.num_rows + 1) << 32), pa.int32())
        lists = [pa.ListArray.from_arrays(starts, pa.array(x, pa.int32())) for x in (pairs & 0xFFFFFFFF, tf)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.bincount(owner, minlength=b.num_rows), pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])


class Shard:
    """Documents and their postings: by document, and by term in groups of one quotient, largest first."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, terms: np.ndarray, quotients: np.ndarray, vocabulary: int):
        self.ids, self.starts, self.terms, self.quotients = ids, starts, terms, quotients
        key = terms.astype(np.int64) << QUOTIENT_BITS | (1 << QUOTIENT_BITS) - 1 - quotients
        order = np.argsort(key)
        key = key[order]
        self.docs = np.repeat(np.arange(len(ids)), np.diff(starts))[order]
        self.first = np.flatnonzero(np.diff(key, prepend=-1))
        self.size = np.diff(np.append(self.first, len(key)))
        self.quotient = (1 << QUOTIENT_BITS) - 1 - (key[self.first] & (1 << QUOTIENT_BITS) - 1)
        self.groups = np.searchsorted(key[self.first] >> QUOTIENT_BITS, np.arange(vocabulary + 1))

    def complete(self, pool: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The whole scores of these documents."""
        size = self.starts[pool + 1] - self.starts[pool]
        at = spans.ranges(self.starts[pool], size)
        score = np.zeros(len(pool), np.int64)
        np.add.at(score, np.repeat(np.arange(len(pool)), size), weights[self.terms[at]] * self.quotients[at])
        return score

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that hold the k best (and perhaps others), their scores, and the postings read.

        ``floor``: documents below this score are not wanted."""
        own = weights[terms]
        only = np.zeros_like(weights)
        only[terms] = own
        begin, many = self.groups[terms], self.groups[terms + 1] - self.groups[terms]
        group, term = spans.ranges(begin, many), np.repeat(np.arange(len(terms)), many)
        impact = own[term] * self.quotient[group]
        order = np.argsort(-impact, kind="stable")
        group, term, impact = group[order], term[order], impact[order]
        postings = np.cumsum(self.size[group])
        total, at, read = np.zeros(len(self.ids), np.int64), 0, 0
        seen, bar = np.zeros(len(terms), np.int64), max(floor, 1)
        while at < len(group):
            to = int(np.searchsorted(postings, read + max(4 * k, int(postings[-1]) // LOOKS))) + 1
            to = int(np.searchsorted(-impact, -impact[min(to, len(impact)) - 1], "right"))  # groups of equal impact together
            new = group[at:to]
            np.add.at(total, self.docs[spans.ranges(self.first[new], self.size[new])], np.repeat(impact[at:to], self.size[new]))
            seen += np.bincount(term[at:to], minlength=len(terms))
            at, read = to, int(postings[to - 1])
            left = seen < many
            rest = int((own[left] * self.quotient[(begin + seen)[left]]).sum())
            ahead = np.argpartition(total, -2 * k)[-2 * k :] if len(total) > 2 * k else np.arange(len(total))
            sure = np.sort(self.complete(ahead, only))
            bar = max(bar, int(sure[-k]) if len(sure) >= k else 0)
            if rest < bar:  # documents not seen yet can't qualify
                pool = np.flatnonzero(total + rest >= bar)
                held = int((self.starts[pool + 1] - self.starts[pool]).sum())
                if held <= postings[-1] - read:
                    return pool, self.complete(pool, only), read + held
        pool = np.flatnonzero(total >= bar)
        return pool, total[pool], read


def shards(batches: Iterator[pa.RecordBatch], counts: tuple[int, int], vocabulary: int, most: int) -> Iterator[Shard]:
    documents, terms = counts
    for batch in batches:
        starts = batch.column("terms").offsets.to_numpy().astype(np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + most, "right")) - 1)
            b = batch.slice(at, end - at)
            own = starts[at : end + 1] - starts[at]
            size = np.diff(own)
            length = 100 - SHARE + (SHARE * b.column("n").to_numpy() * documents) // terms
            tf = b.column("tf").flatten().to_numpy().astype(np.int64)
            quotient = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(length, size))
            yield Shard(b.column("doc_id").fill_null(NO_ID).to_numpy(), own, b.column("terms").flatten().to_numpy(), quotient, vocabulary)
            at = end


def cut_to_k(item: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores, item))
    item = item[order]
    kept = np.arange(len(item)) - np.searchsorted(item, item, "left") < k
    return item[kept], ids[order[kept]], scores[order[kept]]


def search(batches: Iterator[pa.RecordBatch], shared: object, counts: tuple[int, int], k: int, most: int) -> Iterator[pa.RecordBatch]:
    """The k best documents of the task for each item: (item, doc_id, score)."""
    items, weights = shared.value
    tops = tuple(np.zeros(0, np.int64) for _ in range(3))
    floors = np.zeros(len(items), np.int64)
    for shard in shards(batches, counts, len(weights), most):
        found = [tops]
        for i, terms in enumerate(items):
            rows, scores, _ = shard.best(terms, weights, k, int(floors[i]))
            found.append(cut_to_k(np.full(len(rows), i), shard.ids[rows], scores, k))
        tops = cut_to_k(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
        full = np.flatnonzero(np.bincount(tops[0], minlength=len(items)) >= k)
        floors[full] = tops[2][np.searchsorted(tops[0], full, "right") - 1]
    yield pa.RecordBatch.from_arrays([pa.array(tops[0], pa.int32()), pa.array(tops[1], pa.int64(), mask=tops[1] == NO_ID), pa.array(tops[2])], ["item", "doc_id", "score"])


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        data, offsets = spans.texts_of(b.column("text"))
        data = LOWER[data]
        begin, end, owner = spans.words(data, offsets, TERM)
        terms = [data[i:j].tobytes() for i, j in zip(begin, end, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(owner)), pa.array(terms, pa.binary())], ["item_id", "term"])


def binary_text() -> object:
    return F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")


def rank_documents(documents: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents of each item, scores above 0."""
    kind = items.schema["item_id"].dataType.simpleString()
    wanted = items.select("item_id", binary_text()).mapInArrow(tidy(item_terms), f"item_id {kind}, term binary").distinct()
    wanted = materialize(wanted, "item_terms")
    blocks = max(1, -(-wanted.count() // block_terms))
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text())
    found = []
    for block in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        found.append(materialize(search_block(source, own, k, shard_postings), "ranked"))
    discard(wanted)
    return reduce(DataFrame.unionByName, found)


def search_block(source: DataFrame, wanted: DataFrame, k: int, shard_postings: int) -> DataFrame:
    spark = source.sparkSession
    held = wanted.toArrow()  # one block: its size is bounded
    terms = held.column("term").to_pylist()
    distinct = sorted(set(terms))
    number = {t: i for i, t in enumerate(distinct)}
    ids: dict[object, int] = {}
    item = np.array([ids.setdefault(x, len(ids)) for x in held.column("item_id").to_pylist()], np.int64)
    each = np.array([number[t] for t in terms], np.int64)
    lists = np.split(each[np.argsort(item)], np.cumsum(np.bincount(item, minlength=1))[:-1])[: len(ids)]

    vocabulary = spark.sparkContext.broadcast(Vocabulary(distinct))
    postings = materialize(source.mapInArrow(tidy(occurrences, vocabulary), "doc_id long, n long, terms array<int>, tf array<int>"), "postings")
    vocabulary.unpersist()
    documents, total = postings.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(distinct), np.int64)
    for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # terms of the block at most
        df[r["term"]] = r["df"]
    weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    shared = spark.sparkContext.broadcast((lists, weights))
    tops = postings.where("size(terms) > 0").mapInArrow(tidy(search, shared, (documents, total), k, shard_postings), "item int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = tops.withColumn("rank", rank).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, x) for x, i in ids.items()], f"item int, item_id {wanted.schema['item_id'].dataType.simpleString()}")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def oracle_sql() -> str:
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all({lower}, '{term}')) AS term FROM documents),
      p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
      lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
      whole AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
      w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, whole GROUP BY term, big_n),
      items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({lower}, '{term}')) AS term FROM benchmark),
      scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score FROM items JOIN w USING (term) JOIN p USING (term) JOIN lengths USING (doc_id), whole GROUP BY item_id, doc_id)
      SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= {K}"""
