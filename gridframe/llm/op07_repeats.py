"""Removal of repeated byte strings by a difference cover.

A byte goes if a string of ``width`` bytes over it also starts earlier.  Order is needed
to that depth only, so the cover is taken for it: positions whose remainder lies in a
difference cover are the sample.  For any two positions there is a shift below the modulus
that takes both into the sample, so equal strings hold equal sample prefixes of
width - modulus + 1 bytes at the same place.  Sample prefixes are named (by 48 bits of a hash
beside the block), the names sorted in blocks, and neighbours compared; a prefix met once rules out the
positions that it serves.  The suffixes left are merged: each is sent, with those beside it,
to the block of its least 32-byte prefix, ordered there by a hash of its ``width`` bytes
and by place, and compared with its neighbours byte by byte; whoever isn't the first of
its equals is covered.

Depth 100 needs one level of names; a recursion would only deepen them.  Texts are not
shuffled unless they hold a repeated prefix.  Equal prefixes and equal strings within a
batch meet before the shuffle, so what a third of all documents hold reaches its block once
a batch.  Runs of positions with equal least prefixes stay one string, so periodic texts
(a long line of dashes) take no more room than others.

Null texts are empty.  Rows that share a doc_id should share the text: neither is earlier
than the other.  Rows without a doc_id are kept whole and match nothing.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import among, discard, give_back, materialize, slices, text_rows, tidy
from gridframe.llm.spans import ranges, texts_of

WIDTH, ANCHOR = 100, 32
#: A perfect difference cover: every remainder is a difference of two of these (fixed values).
MODULUS, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
BLOCK_BYTES = 6 << 20
#: More bytes than this of one block are not looked at in one task.
HEAVY_BYTES = 4 * BLOCK_BYTES
#: Positions that are looked at together, so that what is worked out for them stays in a core's cache.
CHUNK = 1 << 15
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two strings side by side, or one over the other, from theirs."""
    h = a * FACTORS[0]
    h += b
    h ^= h >> np.uint64(32)
    return h


def finished(h: np.ndarray) -> np.ndarray:
    h = h * FACTORS[1]
    h ^= h >> np.uint64(29)
    return h


def first_lane(width: int) -> int:
    return 8 if width >= 8 else 1


def lanes_at(data: np.ndarray, span: int) -> np.ndarray:
    """The ``span`` (8 or 1) bytes from every position on, as one number."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,)) if span == 8 else data


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every string of ``width`` bytes, by doubling."""
    out = np.empty(max(len(data) - width + 1, 0), np.uint64)
    for i in range(0, len(out), CHUNK):
        span = first_lane(width)
        h = lanes_at(data[i : i + CHUNK + width - 1], span).astype(np.uint64)
        while 2 * span <= width:
            h, span = joined(h[:-span], h[span:]), 2 * span
        if rest := width - span:
            h = joined(h[:-rest], h[rest:])
        out[i : i + CHUNK] = finished(h)
    return out


def hashes_at(data: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """What ``rolling`` gives for the strings that begin at ``place`` (in ascending order), worked out for these alone."""
    out, least = np.empty(len(place), np.uint64), first_lane(width)
    whole = 1 << (width.bit_length() - 1)

    def of(at: np.ndarray, span: int) -> np.ndarray:
        return lanes[at].astype(np.uint64) if span == least else joined(of(at, span // 2), of(at + span // 2, span // 2))

    for i in range(0, len(place), CHUNK):
        at = place[i : i + CHUNK]
        lanes, at = lanes_at(data[at[0] : at[-1] + width], least), at - at[0]
        h = of(at, whole)
        out[i : i + CHUNK] = finished(joined(h, of(at + (width - whole), whole)) if width > whole else h)
    return out


def in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys, ordered by as many of their high bits as leave room for the place, then by place;
    and whether those bits equal the ones before.  One sort of plain numbers."""
    bits = np.uint64(max(len(keys) - 1, 1).bit_length())
    packed = keys >> bits
    packed <<= bits
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    same = np.zeros(len(keys), bool)
    same[1:] = (packed[1:] ^ packed[:-1]) >> bits == 0
    packed &= (np.uint64(1) << bits) - np.uint64(1)
    return packed.astype(np.int32 if len(keys) < 1 << 31 else np.int64), same


def cut_at(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of an array as values that end at ``edges``, given in elements of the array."""
    data = np.ascontiguousarray(data)
    ends = np.asarray(edges) * (data.nbytes // max(len(data), 1))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def sample(batches: Iterator[pa.RecordBatch], blocks: int, width: int) -> Iterator[pa.RecordBatch]:
    """Names of sample prefixes as (block, names, doc_ids, their numbers, starts), one row a block;
    blocks below 0 hold places whose prefix is met again within the rows at hand, without names."""
    prefix = width - MODULUS + 1
    for turn, b in enumerate(slices(batches)):
        docs = b.column("doc_id").to_numpy()
        data, ends = texts_of(b.column("text").fill_null(b""))
        strings = np.maximum(np.diff(ends) - prefix + 1, 0)
        own = (np.arange(0, int(strings.max()) + MODULUS, MODULUS)[:, None] + np.array(COVER)).ravel()
        counts = np.searchsorted(own, strings)
        of = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        if not len(of):
            continue
        start = own[ranges(np.zeros(len(counts), np.int64), counts)]
        h = hashes_at(data, start + ends[of], prefix)
        order, new = in_order(h)
        new[1:] &= h[order[1:]] == h[order[:-1]]
        new = ~new
        again = ~new
        again[:-1] |= ~new[1:]
        apart, met = np.zeros(len(h), bool), np.zeros(len(h), bool)
        apart[order], met[order] = new, again
        apart, met = np.flatnonzero(apart), np.flatnonzero(met)
        block = (h[apart] % np.uint64(blocks)).astype(np.int64)
        key = np.sort(block << 32 | np.arange(len(apart)))
        apart, block = apart[key & 0xFFFFFFFF], key >> 32
        names = (h[apart] // np.uint64(blocks)).view(np.uint8).reshape(-1, 8)[:, :6]
        at = np.concatenate([met, apart])
        block = np.concatenate([np.full(len(met), -1 - turn % blocks), block])
        of, start = of[at], start[at]
        begins = np.ones(len(at), bool)
        begins[1:] = block[1:] != block[:-1]
        edges = np.append(np.flatnonzero(begins), len(at))
        used = begins.copy()
        used[1:] |= of[1:] != of[:-1]
        number = np.cumsum(used)  # of a document among those of all rows, from 1
        held = np.append(number[edges[:-1]] - 1, number[-1])
        local = number - 1 - np.repeat(held[:-1], np.diff(edges))
        columns = [pa.array(block[edges[:-1]], pa.int32()), cut_at(names, np.maximum(edges - len(met), 0)), cut_at(docs[of[used]], held), cut_at(local.astype("<u2"), edges), cut_at(start.astype("<u4"), edges)]
        yield pa.RecordBatch.from_arrays(columns, ["block", "names", "docs", "of", "start"])


def repeated(rows: pa.Table) -> pa.Table:
    """The sample positions of a block whose prefix is met more than once: names are sorted, neighbours compared
    (by what ``in_order`` keeps of them; the few places too many that this lets through are ruled out later)."""
    columns = [rows.column(c).to_pylist() for c in ("docs", "of", "start")]
    docs = np.concatenate([np.frombuffer(d, np.int64)[np.frombuffer(o, "<u2")] for d, o in zip(*columns[:2], strict=True)])
    start = np.concatenate([np.frombuffer(x, "<u4") for x in columns[2]])
    if rows.column("block")[0].as_py() >= 0:
        names = np.frombuffer(b"".join(rows.column("names").to_pylist()), np.uint8).reshape(-1, 6)
        h = np.zeros((len(names), 8), np.uint8)
        h[:, 2:] = names
        order, same = in_order(h.view("<u8")[:, 0])
        same[:-1] |= same[1:]
        keep = np.sort(order[same])
        docs, start = docs[keep], start[keep]
    give_back(cycles=False)
    return pa.table({"doc_id": docs, "start": start.astype(np.int64)})


def minima(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width``, by minima of doubling runs."""
    out = np.empty(len(h) - width + 1, h.dtype)
    for i in range(0, len(out), CHUNK):
        best, span = h[i : i + CHUNK + width - 1], 1
        while 2 * span <= width:
            best, span = np.minimum(best[:-span], best[span:]), 2 * span
        rest = width - span
        out[i : i + CHUNK] = np.minimum(best[:-rest], best[rest:]) if rest else best
    return out


def contexts(batches: Iterator[pa.RecordBatch], blocks: int, width: int) -> Iterator[pa.RecordBatch]:
    """Runs of candidate strings that share their least prefix, as (block, doc_id, start, bytes);
    block -1: a run that also starts earlier within the rows at hand."""
    for b in slices(batches, 2 << 20):
        data, ends = texts_of(b.column("text"))
        strings = np.maximum(np.diff(ends) - width + 1, 0)
        of = np.repeat(np.arange(b.num_rows), b.column("starts").value_lengths().to_numpy())
        at, most, begin = b.column("starts").flatten().to_numpy(), strings[of], ends[of]
        edges = np.bincount(begin + np.minimum(np.maximum(at - MODULUS + 1, 0), most), minlength=len(data) + 1)
        edges -= np.bincount(begin + np.minimum(at + 1, most), minlength=len(data) + 1)
        own = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
        if not len(own):
            continue
        least = minima(rolling(data, ANCHOR), width - ANCHOR + 1)[own]
        cuts = np.flatnonzero((np.diff(own) != 1) | (least[1:] != least[:-1]))  # texts are cut too: their last bytes begin no string
        first_of, last_of = np.append(0, cuts + 1), np.append(cuts, len(own) - 1)
        begin = own[first_of]
        of = np.searchsorted(ends, begin, "right") - 1
        docs, starts = b.column("doc_id").to_numpy()[of].tolist(), (begin - ends[of]).tolist()
        homes, held = (least[first_of] % np.uint64(blocks)).tolist(), data.tobytes()
        first: dict[bytes, tuple[int, int, int]] = {}
        rows: list[tuple[int, int, int, bytes]] = []
        for doc, s, block, i, j in zip(docs, starts, homes, begin.tolist(), (own[last_of] + width).tolist(), strict=True):
            part = held[i:j]
            met = first.get(part)
            if met is None:
                first[part] = (doc, s, block)
            elif (doc, s) <= met[:2]:
                if (doc, s) < met[:2]:
                    rows.append((-1, met[0], met[1], part))
                    first[part] = (doc, s, block)
            else:
                rows.append((-1, doc, s, part))
        rows += [(block, doc, s, part) for part, (doc, s, block) in first.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), pa.int64(), pa.binary()], strict=True)], ["block", "doc_id", "start", "part"])


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether the strings of ``width`` bytes at a and at b are equal, eight bytes at a time."""
    out, span = np.ones(len(a), bool), first_lane(width)
    lanes = lanes_at(data, span)
    for i in range(0, len(a), CHUNK):
        x, y, equal = a[i : i + CHUNK], b[i : i + CHUNK], out[i : i + CHUNK]
        for k in [*range(0, width - span, span), width - span]:
            equal &= lanes[x + k] == lanes[y + k]
    return out


def covered(rows: pa.Table, width: int) -> pa.Table:
    """Runs of bytes under strings of this block that also start earlier."""
    rows = rows.select(["doc_id", "start", "part"]).combine_chunks()
    rows = rows.take(np.lexsort((rows.column("start").to_numpy(), rows.column("doc_id").to_numpy()))).combine_chunks()
    doc, first = rows.column("doc_id").to_numpy(), rows.column("start").to_numpy()
    data, ends = texts_of(rows.column("part").chunk(0))
    strings = np.diff(ends) - width + 1
    of = np.repeat(np.arange(len(doc), dtype=np.int32), strings)
    place = ranges(ends[:-1], strings).astype(np.int32)
    shared = bool(np.any((doc[1:] == doc[:-1]) & (first[1:] < first[:-1] + strings[:-1])))

    def where(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return doc[of[i]], first[of[i]] + place[i] - ends[of[i]]

    if shared:  # rows of one id: only then is the order of runs not that of their strings
        by_doc, by_start = where(np.arange(len(of)))
        order = np.lexsort((by_start, by_doc))
        of, place = of[order], place[order]
    order, same = in_order(rolling(data, width)[place])  # from here on strings are numbered from the earliest
    at = np.flatnonzero(same)
    before = np.full(len(order), -1, np.int32)
    before[order[at]] = order[at - 1]
    pairs = np.flatnonzero(before >= 0)
    unlike = pairs[~same_bytes(data, place[pairs], place[before[pairs]], width)]
    head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    if len(unlike):  # different strings whose hashes share the bits looked at: told apart by their bytes
        group, mixed = np.cumsum(~same), np.zeros(len(order), bool)
        mixed[unlike] = True
        for g in np.unique(group[mixed[order]]).tolist():
            met: dict[bytes, int] = {}
            for k in range(*np.searchsorted(group, [g, g + 1]).tolist()):
                i = int(order[k])
                head[k] = met.setdefault(data[place[i] : place[i] + width].tobytes(), i)
    later = head != order
    if shared:
        own, least = where(order), where(head)
        later &= (own[0] != least[0]) | (own[1] != least[1])
    gone = np.zeros(len(order), bool)
    gone[order[later]] = True
    docs, starts = where(np.flatnonzero(gone))
    cut = np.flatnonzero((docs[1:] != docs[:-1]) | (starts[1:] - starts[:-1] > 1))
    a, z = (np.append(0, cut + 1), np.append(cut, len(docs) - 1)) if len(docs) else (cut, cut)
    found = pa.table({"doc_id": docs[a], "start": starts[a], "end": starts[z] + width})
    del rows, data, of, place, order, same, at, before, pairs, head, later, gone, docs, starts
    give_back(cycles=False)
    return found


def strings_of_runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The strings of runs as (digest, doc_id, start, end), 128 bits of SHA-256 each; those that also start
    earlier within the rows at hand come as runs of bytes without a digest."""
    for b in slices(batches, 1 << 18, "part"):
        first: dict[bytes, tuple[int, int]] = {}
        rows: list[tuple[bytes | None, int, int, int]] = []
        for doc, start, part in sorted(zip(b.column("doc_id").to_pylist(), b.column("start").to_pylist(), b.column("part").to_pylist(), strict=True), key=lambda x: x[:2]):
            open_run = None
            for k in range(len(part) - width + 1):
                own = hashlib.sha256(part[k : k + width]).digest()[:16]
                at = start + k
                if first.setdefault(own, (doc, at)) == (doc, at):
                    open_run = None
                elif open_run is None:
                    open_run = len(rows)
                    rows.append((None, doc, at, at + width))
                else:
                    rows[open_run] = (None, doc, rows[open_run][2], at + width)
        rows += [(own, doc, at, at + width) for own, (doc, at) in first.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.binary(), pa.int64(), pa.int64(), pa.int64()], strict=True)], ["digest", "doc_id", "start", "end"])


def covered_by_digest(found: DataFrame) -> DataFrame:
    """What ``covered`` finds, from the strings of any number of runs: equal ones meet by digest.

    Strings come once for each batch that holds them, so a hot one is as many rows as there are batches;
    a part of the join that is still skewed is split by Spark."""
    place = F.struct("doc_id", "start")
    least = found.where("digest is not null").groupBy("digest").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "least")
    later = found.where("digest is not null").join(least, "digest").where(place != F.col("least"))
    return found.where("digest is null").select("doc_id", "start", "end").unionByName(later.select("doc_id", "start", "end"))


def cut_out(batches: Iterator[pa.RecordBatch], kept_columns: list[str]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 2 << 20):
        spans, kept = [], []
        for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
            text, merged = text or b"", []
            for r in sorted((r["start"], r["end"]) for r in runs or ()):
                if merged and r[0] <= merged[-1][1]:
                    merged[-1][1] = max(r[1], merged[-1][1])
                else:
                    merged.append(list(r))
            edges = [0, *[x for r in merged for x in r], len(text)]
            kept.append(b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
            spans.append([{"start": s, "end": e} for s, e in merged])
        runs = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([*map(b.column, kept_columns), runs, pa.array(kept, pa.binary())], [*kept_columns, "spans", "kept"])


def remove_repeats(documents: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = (), heavy_bytes: int = HEAVY_BYTES) -> DataFrame:
    """doc_id, text (bytes), the columns to keep, spans removed, kept (the remaining bytes) of every row.

    Blocks of more than ``heavy_bytes`` are looked at by digest; the rows are the same."""
    source = text_rows(documents)
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + int(size * len(COVER) / MODULUS * 16 / BLOCK_BYTES)
    prefixes = source.where("doc_id is not null").mapInArrow(tidy(sample, blocks, width), "block int, names binary, docs binary, of binary, start binary")
    marks = materialize(prefixes.groupBy("block").applyInArrow(repeated, "doc_id long, start long"), "repeated")
    marked = among(documents.select("doc_id", F.col("text").cast("binary").alias("text"), *keep), marks)
    texts = materialize(marked.where("hit and doc_id is not null and text is not null").drop("hit"), "texts")
    starts = marks.groupBy("doc_id").agg(F.collect_list("start").alias("starts"))
    runs = texts.join(starts, "doc_id").mapInArrow(tidy(contexts, blocks, width), "block int, doc_id long, start long, part binary")
    runs = materialize(runs, "runs")
    discard(marks)
    inside = runs.where("block = -1").select("doc_id", "start", (F.col("start") + F.octet_length("part")).alias("end"))
    across = runs.where("block >= 0")
    heavy = materialize(across.groupBy("block").agg(F.sum(F.octet_length("part")).alias("bytes")).where(F.col("bytes") > heavy_bytes).select("block"), "heavy")
    used = [runs, heavy]
    if heavy.isEmpty():
        later = across.groupBy("block").applyInArrow(lambda rows: covered(rows, width), "doc_id long, start long, end long")
    else:
        strings = across.join(heavy, "block", "left_semi").select("doc_id", "start", "part").mapInArrow(tidy(strings_of_runs, width), "digest binary, doc_id long, start long, end long")
        used.append(materialize(strings, "strings"))
        later = across.join(heavy, "block", "left_anti").groupBy("block").applyInArrow(lambda rows: covered(rows, width), "doc_id long, start long, end long")
        later = later.unionByName(covered_by_digest(used[-1]))
    gone = materialize(inside.unionByName(later).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("runs")), "gone")
    discard(*used)
    empty = F.lit(None).cast("array<struct<start:bigint,end:bigint>>")
    rows = texts.join(gone, "doc_id", "left").select("doc_id", "text", *keep, "runs")
    rest = marked.where("not hit or doc_id is null or text is null").select("doc_id", "text", *keep, empty.alias("runs"))
    kept = ["doc_id", "text", *keep]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "runs")
    return rows.unionByName(rest).mapInArrow(tidy(cut_out, kept), types + ", spans array<struct<start:bigint,end:bigint>>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    """Counts and the digest of what is left, as the query returns them."""
    n, kept = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), F.octet_length("kept").cast("long")
    return found.select("doc_id", n.alias("n_bytes"), (n - kept).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
