"""N-gram Jaccard join by rare-first prefix filtering.

A document's set holds its distinct runs of ``width`` words, as 64-bit hashes.  All sets
are ordered by one order, rarest first: the order's key is the number of documents' shingles
in the hash bucket of a shingle, counted over all documents in buckets whose number grows
with the input up to ``most_bits``.  Two sets can reach the threshold only if they share a
shingle of their prefixes, their sizes are near enough (length filter), what follows the
shared shingle is long enough (positional filter), and their parity bitmaps differ in few
enough bits (the suffix filter: each differing bit needs an element outside the
intersection).  What is left is verified on the whole sets, each pair once.  Shingles that
stand alone in their bucket are in one document only and are joined with nothing; sets of
so few shingles that no other set is near enough are linked with equal ones only.

Documents with equal sets are one class from the start.  Classes that share prefix
shingles are joined in rounds: the first ones hold each row of a bucket against the
heaviest row of the bucket, later of its part of the bucket (heavy: the prefix lies in the
fullest buckets, as that of the centre of a group of near copies does), and verify the two
nearest by bitmap, which connects groups of near copies by few pairs.  Centres are maxima,
so they are combined before the shuffle and no task holds a bucket.  The last round takes
every remaining pair of a bucket whose members are not connected yet, within neighbouring
bands of sizes, so no link between components is lost.

A null text or one without words has an empty set, linked with nothing.  Repeated rows
are copies; rows that share a doc_id are one node of the graph.  Rows without a doc_id get
the class of an equal set that has one, or null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm.common import LOWER, among, components, discard, materialize, slices, text_rows, tidy

WIDTH, PERCENT, ROUNDS = 4, 85, 3
#: Buckets of the order: about one for each shingle, within these powers of two; half a byte each.
LEAST_BITS, MOST_BITS, CHUNK_BITS = 16, 26, 16
BITMAP_BITS = 512
BITMAP = [f"bits{k}" for k in range(BITMAP_BITS // 64)]
SET = ["n", "key1", "key2"]
MULTIPLIER = 0x9E3779B97F4A7C15
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts, and the text that it stands in."""
    lengths = np.array([len(t or b"") + 1 for t in texts], np.int64)
    data = np.frombuffer(b" ".join([t or b"" for t in texts]).translate(LOWER), np.uint8)
    edges = np.flatnonzero(np.diff(~SPACE[data], prepend=False, append=False))
    begin, end = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(MULTIPLIER, len(data)), out=sums[1:])
    h = (sums[end] - sums[begin]) * powers(pow(MULTIPLIER, -1, 1 << 64), len(data))[begin]
    return mixed(h + (end - begin).astype(np.uint64)), np.searchsorted(np.cumsum(lengths), begin, "right")


def folded(words: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words that starts at one of ``first``."""
    h = np.zeros(len(first), np.uint64)
    for k in range(width):
        h = mixed(h * np.uint64(MULTIPLIER) + words[first + k])
    return h


def shingles(texts: list[bytes | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of all texts, each text's set in order of value; whose they are; and the size of each set."""
    words, of = hashed_words(texts)
    first = np.arange(max(len(words) - width + 1, 0))
    first = first[of[first] == of[first + width - 1]]
    h, owner = [folded(words, first, width)], [of[first]]
    many = np.bincount(of, minlength=len(texts))
    start = np.cumsum(many) - many
    for n in range(1, width):  # texts of fewer words: the whole sequence
        short = np.flatnonzero(many == n)
        h.append(mixed(folded(words, start[short], n) + np.uint64(n)))
        owner.append(short)
    h, owner = np.concatenate(h), np.concatenate(owner)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new], np.bincount(owner[new], minlength=len(texts))


def sketch(batches: Iterator[pa.RecordBatch], width: int, bits: int) -> Iterator[pa.RecordBatch]:
    """How many shingles fall into each bucket, as (chunk of buckets, places in it, counts)."""

    def rows() -> pa.RecordBatch:
        place, n = np.unique(np.concatenate(waiting), return_counts=True)
        cuts = np.flatnonzero(np.diff(place >> CHUNK_BITS)) + 1
        edges = [0, *cuts.tolist(), len(place)]
        parts = [(int(place[i]) >> CHUNK_BITS, place[i:j].astype(np.uint16).tobytes(), np.minimum(n[i:j], 0xFFFF).astype(np.uint16).tobytes()) for i, j in zip(edges, edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), [pa.int32(), pa.binary(), pa.binary()], strict=True)], ["chunk", "places", "counts"])

    waiting, size = [], 0
    for b in slices(batches):
        waiting.append((shingles(b.column("text").to_pylist(), width)[0] >> np.uint64(64 - bits)).astype(np.uint32))
        size += len(waiting[-1])
        if size > 1 << 21:
            yield rows()
            waiting, size = [], 0
    if size:
        yield rows()


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts as half bytes, two in a byte: up to 8 exactly, then by powers of two."""
    own = (np.minimum(counts, 8) + np.minimum(np.floor(np.log2(np.maximum(counts, 8) / 8)), 7)).astype(np.uint8)
    return own[::2] | own[1::2] << 4


def rarities(packed: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return packed[buckets >> 1] >> (4 * (buckets & 1)).astype(np.uint8) & 15


def add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for chunk, places, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own = total.setdefault(chunk, np.zeros(1 << CHUNK_BITS, np.int64))
            own[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.uint16)
    for chunk, own in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([scaled(own).tobytes()], pa.binary())], ["chunk", "counts"])


def rarity(source: DataFrame, width: int, most_bits: int) -> tuple[np.ndarray, int]:
    """The counts of buckets, half a byte each, and the bits of a hash that choose a bucket."""
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(max(math.ceil(math.log2(size / 8 + 1)), LEAST_BITS), most_bits)
    chunks = source.select("text").mapInArrow(tidy(sketch, width, bits), "chunk int, places binary, counts binary")
    counts = np.zeros(1 << bits - 1, np.uint8)
    for r in chunks.repartition("chunk").mapInArrow(tidy(add_chunks), "chunk int, counts binary").toLocalIterator():
        counts[r["chunk"] << CHUNK_BITS - 1 :][: 1 << CHUNK_BITS - 1] = np.frombuffer(r["counts"], np.uint8)
    return counts, bits


def linkable(n: Column | np.ndarray, percent: int) -> Column | np.ndarray:
    """Whether a set of n elements can be near a different one, of one element more at least."""
    return 100 * n >= percent * (n + 1)


def profile(batches: Iterator[pa.RecordBatch], shared: object, bits: int, width: int, percent: int) -> Iterator[pa.RecordBatch]:
    counts = shared.value
    for b in slices(batches):
        h, owner, n = shingles(b.column("text").to_pylist(), width)
        first = np.cumsum(n) - n
        keys = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h ^ np.uint64(x)))]) for x in (0, MULTIPLIER)]
        often = rarities(counts, (h >> np.uint64(64 - bits)).astype(np.int64))
        order = np.lexsort((h, often, owner))
        at = np.arange(len(h)) - first[owner]
        keep = (at < (n - -(-percent * n // 100) + 1)[owner]) & linkable(n, percent)[owner] & (often[order] > 1)
        offsets = pa.array(np.cumsum([0, *np.bincount(owner[keep], minlength=len(n))]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (at[keep].astype(np.int32), h[order][keep].view(np.int64))]
        odd = np.bincount(owner * BITMAP_BITS + (h & np.uint64(BITMAP_BITS - 1)).astype(np.int64), minlength=len(n) * BITMAP_BITS) & 1
        words = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, len(BITMAP)).T
        sums = [pa.array((k[first + n] - k[first]).view(np.int64)) for k in keys]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *sums, *lists, *(pa.array(np.ascontiguousarray(x)) for x in words)], ["doc_id", *SET, "at", "h", *BITMAP])


def sets_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        h, _, n = shingles(b.column("text").to_pylist(), width)
        data, ends = h.tobytes(), (8 * np.cumsum(n)).tolist()
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([data[i:j] for i, j in zip([0, *ends], ends)], pa.binary())], ["doc_id", "own"])


def verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, column="x"):
        keep = []
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def links_among(pairs: DataFrame, source: DataFrame, width: int, percent: int) -> DataFrame:
    """The links among ``pairs(a, b)``, a table, by whole sets.

    Only documents in a pair get their sets made; a bitmap of fixed size tells which, so no text is shuffled."""
    wanted = among(source, pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))).where("hit").select("doc_id", "text")
    sets = materialize(wanted.mapInArrow(tidy(sets_of, width), "doc_id long, own binary"), "sets")
    rows = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    links = materialize(rows.mapInArrow(tidy(verified, percent), "a long, b long").distinct(), "links")
    discard(sets)
    return links


def needed(na: Column, nb: Column, percent: int) -> Column:
    """The smallest intersection of two sets of these sizes that reaches the threshold."""
    return F.ceil(percent * (na + nb) / (100 + percent))


def fits(na: Column, nb: Column, i: Column, j: Column, percent: int) -> Column:
    """Length and positional filters, for the first shingle that two prefixes share."""
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.least(na - i, nb - j) >= needed(na, nb, percent))


def paired(x: str, y: str, nx: str, ny: str) -> list[Column]:
    """The rows x and y as a pair, the smaller id first, and which of the two y is."""
    a, b = F.col(x), F.col(y)
    return [b.alias("row"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(a < b, F.col(nx)).otherwise(F.col(ny)).alias("na"), F.when(a < b, F.col(ny)).otherwise(F.col(nx)).alias("nb")]


def suffix_filtered(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """(a, b, row, apart) of the pairs whose bitmaps differ in few enough bits."""
    a, b = (bitmaps.select(F.col("d").alias(x), *[F.col(c).alias(c + x) for c in BITMAP]) for x in "ab")
    apart = sum((F.bit_count(F.col(c + "a").bitwiseXOR(F.col(c + "b"))) for c in BITMAP), F.lit(0))
    near = pairs.distinct().join(a, "a").join(b, "b").withColumn("apart", apart)
    return near.where(F.col("na") + F.col("nb") - F.col("apart") >= 2 * needed(F.col("na"), F.col("nb"), percent)).groupBy("a", "b", "row").agg(F.min("apart").alias("apart"))


def with_components(live: DataFrame, found: DataFrame | None) -> DataFrame:
    known = live.withColumn("component", F.lit(None).cast("long")) if found is None else live.join(found.withColumnRenamed("node", "d"), "d", "left")
    return known.withColumn("component", F.coalesce("component", "d"))


def around_centres(known: DataFrame, parts: int, seed: int, percent: int) -> DataFrame:
    """Each row of a bucket (or of one of ``parts`` of it) beside the heaviest one, if they aren't connected yet."""
    dealt = known.withColumn("part", F.pmod(F.xxhash64("d", F.lit(seed)), F.lit(parts)))
    row = F.struct("weight", "d", "n", "i", "component")
    ends = dealt.groupBy("h", "part").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(row).alias("c")).where("low < high")
    beside = dealt.join(ends.select("h", "part", "c"), ["h", "part"]).where(F.col("c.component") != F.col("component"))
    return beside.where(fits(F.col("c.n"), F.col("n"), F.col("c.i"), F.col("i"), percent)).withColumns({"dx": F.col("c.d"), "nx": F.col("c.n")}).select(*paired("dx", "d", "nx", "n"))


def all_pairs_left(known: DataFrame, percent: int) -> DataFrame:
    """Every pair of a bucket's rows that aren't connected, the larger set in the same band of sizes or the next one."""
    ends = known.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    several = materialize(known.join(ends.select("h"), "h").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent))), "several")
    x = several.select(F.col("h"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), *[F.col(c).alias(c + "x") for c in ("d", "n", "i", "component")])
    y = several.select("h", "band", *[F.col(c).alias(c + "y") for c in ("d", "n", "i", "component")])
    once = (F.col("nx") < F.col("ny")) | (F.col("nx") == F.col("ny")) & (F.col("dx") < F.col("dy"))
    rest = x.join(y, ["h", "band"]).where(once & (F.col("componentx") != F.col("componenty")) & fits(F.col("nx"), F.col("ny"), F.col("ix"), F.col("iy"), percent))
    return rest.select(*paired("dx", "dy", "nx", "ny"))


def near_groups(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT, rounds: int = ROUNDS, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row.

    ``rounds`` bounds the rounds that link centres; the last round takes whatever is left.
    ``most_bits`` bounds the buckets of the order (half a byte each, sent to all tasks).
    """
    source = text_rows(documents)
    counts, bits = rarity(source, width, most_bits)
    shared = documents.sparkSession.sparkContext.broadcast(counts)
    schema = "doc_id long, n long, key1 long, key2 long, at array<int>, h array<long>, " + ", ".join(f"{c} long" for c in BITMAP)
    profiles = materialize(source.mapInArrow(tidy(profile, shared, bits, width, percent), schema), "profiles")
    shared.unpersist()
    members = profiles.where("n > 0").groupBy(*SET).agg(F.min("doc_id").alias("rep")).where("rep is not null")
    heads = profiles.where(linkable(F.col("n"), percent) & (F.size("h") > 0)).join(members.withColumnRenamed("rep", "doc_id"), [*SET, "doc_id"], "left_semi")
    heads = materialize(heads.dropDuplicates([*SET, "doc_id"]).withColumnRenamed("doc_id", "d"), "heads")
    rows = heads.select("d", "n", F.explode(F.arrays_zip("at", "h")).alias("e")).select("d", "n", F.col("e.at").alias("i"), F.col("e.h").alias("h"))
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    shared_rows = materialize(rows.join(often, "h"), "shared")
    weights = shared_rows.groupBy("d").agg(F.sum("k").alias("weight"))
    live = materialize(shared_rows.drop("k").join(weights, "d"), "live")
    discard(shared_rows)

    found = tested = None
    for k in range(rounds + 1):
        known = with_components(live, found)
        new = around_centres(known, 4**k, k, percent) if k < rounds else all_pairs_left(known, percent)
        if tested is not None:
            new = new.join(tested, ["a", "b"], "left_anti")
        near = suffix_filtered(new, heads, percent)
        if k < rounds:
            nearest = Window.partitionBy("row").orderBy("apart", "a", "b")
            near = near.withColumn("place", F.row_number().over(nearest)).where("place <= 2")
        pairs = materialize(near.select("a", "b").distinct(), "candidates")
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = links_among(pairs, source, width, percent)
        if not links.isEmpty():
            found = components(links if found is None else links.unionByName(found.toDF("a", "b")), "components")
    discard(live)
    if found is None:
        found = members.where("false").select(F.col("rep").alias("node"), F.col("rep").alias("component"))

    both = profiles.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*SET)).alias("least"), F.max(F.struct(*SET)).alias("most")).where("least <> most").select("doc_id")
    shared_ids = materialize(profiles.join(both, "doc_id", "left_semi").where("n > 0").join(members, SET).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "ids")
    if not shared_ids.isEmpty():
        found = components(found.toDF("a", "b").unionByName(shared_ids), "components")
    classes = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(*SET, F.coalesce("component", "rep").alias("class"))
    out = profiles.select("doc_id", *SET).join(classes, SET, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class")).otherwise(F.col("doc_id")).alias("component_id"))
