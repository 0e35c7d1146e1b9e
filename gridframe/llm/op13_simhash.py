"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments of 22, 21 and 21 bits, each taken as a word of the
perfect binary Golay code (23, 12).  A word has one codeword within three bits and, if it lies
three bits from that, five more within four bits.  Two words that differ in two bits or fewer
share one of these codewords; of two that differ in one bit, the one of even parity needs its
nearest codeword only.  Pigeonhole on four errors in three segments: either one segment is equal
and another differs in two bits at most, or two segments differ in one bit each.  Keys:

* equal segment + codewords of another one (6 ordered pairs);
* codewords of two segments of opposite parities (3 pairs).

Together about 62 keys a fingerprint.  Equal fingerprints are one class from the start.  Keys are
dealt to partitions and sorted by Spark; rows of one key are verified by their differing bits, so
every link between classes is found in one pass, and each key sends only links that keep its
rows connected.  Keys of more rows than ``RUN`` are not compared there: their rows are held
against a few of them, and what isn't connected afterwards is dealt in blocks of rows, every two
blocks in a group of their own, so no task holds a key and no link is lost.

Words are runs of bytes that are no white space, A-Z in lower case.  A text of fewer words than
a shingle is one shingle, one without words (or null) has fingerprint zero and is linked like any
other.  Repeated rows are copies; rows that share a doc_id but not a fingerprint are one node of
the graph.  Rows without a doc_id join their class, but give it no id: alone they get null.
An empty table gives no rows.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm import spans
from gridframe.llm.common import LOWER, components, discard, materialize, slices, text_rows, tidy

WIDTH, SEED, RADIUS = 4, 42, 4
#: Low bit and bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The generator polynomial of the Golay code (fixed value) and the length of a word.
GENERATOR, LENGTH, CHECK = 0b110001110101, 23, 11
#: Rows of a key that are compared in one go; rows that the rows of a larger key are held against.
RUN, CENTRES = 1024, 8


def syndromes(words: np.ndarray) -> np.ndarray:
    """The remainder by the generator polynomial: 0 for codewords."""
    rest = words.astype(np.int64)
    for k in range(LENGTH - 1, CHECK - 1, -1):
        rest = np.where(rest >> k & 1, rest ^ GENERATOR << k - CHECK, rest)
    return rest


def near_patterns() -> np.ndarray:
    """For each syndrome the error patterns of up to four bits that have it, the lightest first; -1 where there are no more."""
    table = np.full((1 << CHECK, 6), -1, np.int64)
    used = np.zeros(1 << CHECK, np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)], np.int64)
        for s, p in zip(syndromes(patterns), patterns, strict=True):
            table[s, used[s]] = p
            used[s] += 1
    return table


PATTERNS = near_patterns()


def codewords(words: np.ndarray) -> np.ndarray:
    """The numbers (12 bits) of the codewords within four bits of each word, the nearest first; -1 where there are no more."""
    patterns = PATTERNS[syndromes(words)]
    return np.where(patterns < 0, -1, (words[:, None].astype(np.int64) ^ patterns) >> CHECK)


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of each fingerprint."""
    unsigned = prints.astype(np.uint64)
    parts = [(unsigned >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    near = [codewords(p) for p in parts]
    odd = [np.bitwise_count(p) & 1 for p in parts]
    of_parity = [np.where((o == 0)[:, None] & (np.arange(6) > 0), -1, n) for o, n in zip(odd, near, strict=True)]
    n = np.arange(len(prints))
    rows, keys = [], []
    for tag, (x, y) in enumerate((x, y) for x in range(3) for y in range(3) if x != y):
        row, at = np.nonzero(near[y] >= 0)
        rows.append(row)
        keys.append(tag << 40 | parts[x][row] << 12 | near[y][row, at])
    for tag, (x, y) in enumerate(combinations(range(3), 2)):
        both = (of_parity[x][:, :, None] >= 0) & (of_parity[y][:, None, :] >= 0)
        row, i, j = np.nonzero(both)
        rows.append(n[row])
        keys.append(6 + tag << 40 | (odd[x] ^ odd[y])[row].astype(np.int64) << 24 | of_parity[x][row, i] << 12 | of_parity[y][row, j])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(texts: list[bytes | None]) -> np.ndarray:
    """64 bits for each text: 1 where over half of its shingles' hashes have a 1."""
    h, size = [], []
    for text in texts:
        words = (text or b"").translate(LOWER).split()  # of bytes: at ASCII white space, the six of the contract
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends[: max(len(words) - WIDTH, 0)]] if words else []
        size.append(len(starts))
        h.append(np.fromiter((xxhash.xxh64_intdigest(joined[i : j - 1], SEED) for i, j in zip(starts, ends[WIDTH - 1 :] or ends[-1:], strict=True)), np.uint64, len(starts)))
    size = np.array(size, np.int64)
    out = np.zeros(len(texts), np.uint64)
    known = np.flatnonzero(size)
    if len(known):
        bits = np.unpackbits(np.concatenate(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(size) - size)[known], axis=0, dtype=np.int32)
        out[known] = np.packbits(2 * ones > size[known][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprints(b.column("text").to_pylist()).view(np.int64))], ["doc_id", "print"])


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = b.column("print").to_numpy()
        for at in range(0, len(prints), 4096):
            own = prints[at : at + 4096]
            row, key = keys_of(own)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[row])], ["key", "print"])


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of differing bits (numpy counts the bits of a negative number's amount)."""
    return np.bitwise_count((x ^ y).view(np.uint64))


def connected(prints: np.ndarray, radius: int) -> np.ndarray:
    """For each of these fingerprints the first one that it is connected with by links among them."""
    near = apart(prints[:, None], prints[None, :]) <= radius
    label = np.arange(len(prints))
    while True:
        least = np.where(near, label[None, :], len(prints)).min(1)
        least = least[least]
        if np.array_equal(least, label):
            return label
        label = least


def run_links(key: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within each run of equal keys (sorted)."""
    first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    size = np.diff(np.append(first, len(key)))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    few = spans.ranges(first[size <= 8], size[size <= 8])
    for step in range(1, 8):  # all pairs of short runs, at once
        few = few[few + step < len(key)]
        few = few[key[few] == key[few + step]]
        near = few[apart(prints[few], prints[few + step]) <= radius]
        a.append(prints[near])
        b.append(prints[near + step])
    for i, n in zip(first[size > 8], size[size > 8], strict=True):
        own = prints[i : i + n]
        label = connected(own, radius)
        a.append(own[label != np.arange(n)])
        b.append(own[label[label != np.arange(n)]])
    return np.concatenate(a), np.concatenate(b)


def star_links(prints: np.ndarray, centres: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    near = apart(prints[:, None], centres[None, :]) <= radius
    row, c = np.nonzero(near & (prints[:, None] != centres[None, :]))
    return prints[row], centres[c]


def sorted_links(batches: Iterator[pa.RecordBatch], radius: int, run: int) -> Iterator[pa.RecordBatch]:
    """(a, b) for links, (key, null) for keys of more than ``run`` rows; keys come together and in order."""

    def rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    key, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)
    large: tuple[int, np.ndarray] | None = None  # a key that is known to have many rows, and its centres
    for b in batches:
        key, prints = np.concatenate([key, b.column("key").to_numpy()]), np.concatenate([prints, b.column("print").to_numpy()])
        while large is not None and len(key):
            own = int(np.searchsorted(key, large[0], "right")) if key[0] == large[0] else 0
            if own:
                yield rows(*star_links(prints[:own], large[1], radius))
                key, prints = key[own:], prints[own:]
            if len(key):
                large = None
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))  # the last key may go on
        cut, n = np.flatnonzero(np.diff(key[:last], prepend=key[:1] - 1)), last
        size = np.diff(np.append(cut, last))
        small = np.repeat(size <= run, size)
        yield rows(*run_links(key[:last][small], prints[:last][small], radius))
        many = [(int(i), int(i + s)) for i, s in zip(cut[size > run], size[size > run], strict=True)]
        if len(key) - n > run:
            many.append((n, len(key)))
            large = (int(key[-1]), prints[n : n + CENTRES])
        for i, j in many:
            yield rows(*star_links(prints[i:j], prints[i : i + CENTRES], radius))
            yield pa.RecordBatch.from_arrays([pa.array([key[i]]), pa.array([None], pa.int64())], ["a", "b"])
        key, prints = (key[:0], prints[:0]) if large is not None else (key[n:], prints[n:])
    if len(key):
        yield rows(*run_links(key, prints, radius))


def block_links(batches: Iterator[pa.RecordBatch], radius: int, run: int) -> Iterator[pa.RecordBatch]:
    """Links between rows of two blocks of a key that aren't connected yet; blocks come together and in order."""
    held: list[pa.RecordBatch] = []

    def links() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        prints, part = table.column("print").to_numpy(), table.column("component").to_numpy()
        for i in range(0, len(prints), run):
            for j in range(i, len(prints), run):
                x, y = slice(i, i + run), slice(j, j + run)
                near = (apart(prints[x][:, None], prints[y][None, :]) <= radius) & (part[x][:, None] != part[y][None, :])
                row, c = np.nonzero(near)
                _, once = np.unique(np.stack([part[x][row], part[y][c]], 1), axis=0, return_index=True)  # one link for two components
                yield pa.RecordBatch.from_arrays([pa.array(prints[x][row[once]]), pa.array(prints[y][c[once]])], ["a", "b"])

    for b in batches:
        of = [b.column(c).to_numpy() for c in ("key", "i", "j")]
        cuts = [0, *(np.flatnonzero(np.any([np.diff(c) != 0 for c in of], axis=0)) + 1).tolist(), b.num_rows]
        for at, end in zip(cuts, cuts[1:]):
            own = b.slice(at, end - at)
            if held and own.num_rows and any(held[-1].column(c)[0] != own.column(c)[0] for c in ("key", "i", "j")):
                yield from links()
                held = []
            if own.num_rows:
                held.append(own)
    if held:
        yield from links()


def print_links(classes: DataFrame, radius: int, run: int) -> DataFrame:
    """Links (a, b) between fingerprints that connect all that differ in ``radius`` bits at most."""
    keys = classes.select("print").mapInArrow(tidy(key_rows), "key long, print long")
    dealt = keys.repartition("key").sortWithinPartitions("key", "print")
    found = materialize(dealt.mapInArrow(tidy(sorted_links, radius, run), "a long, b long"), "links")
    links = found.where("b is not null")
    large = found.where("b is null").select(F.col("a").alias("key")).distinct()
    if large.isEmpty():
        return links
    known = components(links, "parts")
    rows = materialize(keys.join(large, "key").join(known.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print")), "large")
    # a key whose rows are all connected has nothing left; of the others, each two blocks meet once
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    blocks = F.greatest(F.ceil(F.col("n") / run), F.lit(1)).cast("int")
    open_rows = rows.join(sizes.select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    met = open_rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "print", "component")
    rest = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(tidy(block_links, radius, run), "a long, b long")
    more = materialize(rest, "links")
    discard(rows)
    return links.unionByName(more)


def near_groups(documents: DataFrame, radius: int = RADIUS, run: int = RUN) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id of every row."""
    prints = materialize(text_rows(documents).mapInArrow(tidy(fingerprint_rows), "doc_id long, print long"), "prints")
    classes = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "classes")
    links = print_links(classes, radius, run)
    both = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("z")).where("a <> z").select("doc_id", "a")
    shared = prints.join(both, "doc_id").where("a <> print").select("a", F.col("print").alias("b"))
    found = components(links.unionByName(shared), "components")
    whole = classes.join(found.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialize(whole.select("print", "component").join(least, "component").select("print", "component_id"), "named")
    return prints.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
