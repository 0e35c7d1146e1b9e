"""Exact top-k inner-product search by no-random-access aggregation.

Each component is a list of the candidates, sorted by its value and read from the end
that the sign of the query's component favours.  After reading to some depth, a
candidate's score lies between two bounds: a value not read yet is no better than the
last one read and no worse than the list's far end.  Every query reads a block of
candidates on its own: depths grow (three quarters, then half of what is left each time),
at each depth the outsiders go whose upper bound is below the k-th lower bound or below
the k-th score of the blocks before, and reading stops when no outsider is left.  Only
the scores of those that stayed are resolved.  The first look of many queries is two
matrix products; later ones touch the pairs that are still open.

Queries are a stated set, taken in blocks of ``query_block`` rows, a size that doesn't
grow with the data.  One block at a time is sent to all tasks and given back after its
result is written; candidates are read where they are, and each task keeps k rows a
query, so nothing but tops is shuffled.

Vectors that are null or hold null, NaN or infinite components take no part, nor do rows
without a vec_id.  Rows that share a vec_id count as one vector, the smallest of them;
shorter vectors end in zeros.  vec_id is an integer column.  An empty table or no query
gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm.common import discard, materialize

K, QUERY_BLOCK, SCALE = 20, 8192, 64
#: Rows of the two blocks that are held against each other at once.
QUERIES_AT_ONCE, CANDIDATES_AT_ONCE = 256, 8192
#: Rows of a task's first block; as blocks double, later ones meet the scores of earlier ones.
FIRST_CANDIDATES = 512


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integer lists, at most ``width`` long, as a matrix."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def exact_type(queries: np.ndarray, rows: np.ndarray) -> type:
    """The narrowest type in which every partial sum of a score is exact."""
    most = float(np.abs(queries).astype(float).sum(1).max(initial=0)) * float(np.abs(rows).max(initial=0))
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


NONE = np.iinfo(np.int64).min


class Lists:
    """The sorted lists of a block of candidates."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.sorted = rows, np.sort(rows, axis=0)

    def read(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Best and worst values that each candidate can have in the descending lists, then in the ascending ones."""
        down, up = self.sorted[-depth], self.sorted[depth - 1]
        best = np.hstack([np.maximum(self.rows, down), np.minimum(self.rows, up)])
        worst = np.hstack([np.where(self.rows >= down, self.rows, self.sorted[0]), np.where(self.rows <= up, self.rows, self.sorted[-1])])
        # of values equal to the last one read, all count as read: what is known of them is the same
        return best, worst

    def at(self, query: np.ndarray, depth: int) -> np.ndarray:
        """What the value at ``depth`` of each list adds to the query's score (most at depth 1)."""
        return query * np.where(query > 0, self.sorted[-depth], self.sorted[depth - 1])


def first_look(queries: np.ndarray, query_ids: np.ndarray, lists: Lists, ids: np.ndarray, k: int, floor: np.ndarray, depth: int) -> np.ndarray:
    """Which candidates (columns) may still be among the k best of each query (rows) after reading to ``depth``."""
    kind = exact_type(queries, lists.rows)
    signed = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]).astype(kind)
    best, worst = lists.read(depth)
    own = query_ids[:, None] == ids[None, :]
    bar = floor
    if len(ids) >= k:
        lower = signed @ worst.T.astype(kind)
        lower[own] = NONE
        bar = np.maximum(floor, np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k].astype(np.int64))
    return (signed @ best.T.astype(kind) >= bar[:, None]) & ~own


def read_on(query: np.ndarray, lists: Lists, open_rows: np.ndarray, k: int, floor: int, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The candidates left when no outsider can qualify, their scores, and the depth reached."""
    n, far = len(lists.rows), lists.at(query, len(lists.rows))
    terms = query * lists.rows[open_rows]
    while len(open_rows) > k and depth < n:
        depth = n - (n - depth) // 2
        last = lists.at(query, depth)
        lower = np.where(terms >= last, terms, far).sum(1)
        bar = max(floor, np.partition(lower, len(lower) - k)[len(lower) - k])
        stay = np.maximum(terms, last).sum(1) >= bar
        open_rows, terms = open_rows[stay], terms[stay]
    return open_rows, terms.sum(1), depth


def search_block(queries: np.ndarray, query_ids: np.ndarray, lists: Lists, ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of all candidates of the block that may be among the k best."""
    depth = len(ids) - len(ids) // 4
    may = first_look(queries, query_ids, lists, ids, k, floor, depth)
    q, c, s = [], [], []
    for i in np.flatnonzero(may.any(1)):
        rows, scores, _ = read_on(queries[i], lists, np.flatnonzero(may[i]), k, floor[i], depth)
        q.append(np.full(len(rows), i))
        c.append(rows)
        s.append(scores)
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (q, c, s))


def cut_to_k(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores, q))
    q = q[order]
    first = np.searchsorted(q, q, "left")
    kept = order[np.arange(len(q)) - first < k]
    return q[np.arange(len(q)) - first < k], ids[kept], scores[kept]


def search(batches: Iterator[pa.RecordBatch], query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    width = queries.shape[1]
    tops = tuple(np.zeros(0, np.int64) for _ in range(3))
    floor = np.full(len(query_ids), NONE)
    seen = 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, min(CANDIDATES_AT_ONCE, max(FIRST_CANDIDATES, seen)))
            at, seen = at + part.num_rows, seen + part.num_rows
            ids = part.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, lists = ids[order], Lists(matrix(part.column("v"), width)[order])
            found = [tops]
            for first in range(0, len(query_ids), QUERIES_AT_ONCE):
                own = slice(first, first + QUERIES_AT_ONCE)
                q, c, s = search_block(queries[own], query_ids[own], lists, ids, k, floor[own])
                found.append(cut_to_k(q + first, ids[c], s, k))
            tops = cut_to_k(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
            full = np.bincount(tops[0], minlength=len(query_ids)) >= k
            last = np.full(len(query_ids), np.iinfo(np.int64).max)
            np.minimum.at(last, tops[0], tops[2])
            floor = np.where(full, last, NONE)
    yield pa.RecordBatch.from_arrays([pa.array(query_ids[tops[0]]), pa.array(tops[1]), pa.array(tops[2])], ["query_id", "vec_id", "score"])


def quantized(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    valid = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(double(x)) < double('infinity'))"
    rows = embeddings.where(valid).select("vec_id", F.transform("embedding", lambda x: F.floor(scale * x.cast("double"))).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors(vec_id, v)`` for each row of ``queries``."""
    n, width = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(width, vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0])
    blocks = max(1, -(-n // query_block))
    if blocks == 1:
        return search_all(vectors, queries, width, k)[0]
    vectors, queries = materialize(vectors, "vectors"), materialize(queries, "queries")
    found = []
    for block in range(blocks):
        top, shared = search_all(vectors, queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block), width, k)
        found.append(materialize(top, "tops"))
        shared.destroy()
    discard(vectors, queries)
    return reduce(DataFrame.unionByName, found)


def search_all(vectors: DataFrame, queries: DataFrame, width: int, k: int) -> tuple[DataFrame, Broadcast]:
    """The result for one block of queries, and the block as it was sent."""
    held = queries.select("vec_id", "v").toArrow()
    shared = vectors.sparkSession.sparkContext.broadcast((held.column("vec_id").to_numpy(), matrix(held.column("v").combine_chunks(), width)))
    found = vectors.mapInArrow(lambda it: search(it, *shared.value, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), shared
