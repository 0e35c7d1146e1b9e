"""Filters, ranked search and SimHash groups against brute force."""

import hashlib
from itertools import permutations

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from gridframe.llm import op11_filters as filters
from gridframe.llm import op12_lexical as lexical
from gridframe.llm import op13_simhash as simhash
from gridframe.llm import spans

rng = np.random.default_rng(11)
WORDS = [f"w{i}" for i in range(400)]
LONG = "x" * 100
TEXTS = [None, "", " \n\t", "One", "one", "ONE two", *[" ".join(rng.choice(WORDS, n)) for n in (3, 4, 199, 200, 201, 500, 9000)], f"{LONG} {LONG}y {LONG}", "ß Ä é " * 90, "a|b " * 150, "the the and the\x0b and " * 80, "NUL\x00 byte AB"]
TEXTS += [TEXTS[9], TEXTS[9], TEXTS[10] + " Extra", "It costs $5 " + TEXTS[10], TEXTS[12] + " w1"]
IDS = [*range(0, 3 * len(TEXTS) - 6, 3), None, 12]  # a row without an id, and an id that two rows have
SCHEMA = "doc_id long, text string, source string, n long, term string, print string, part string"


@pytest.fixture(scope="module")
def rows():
    return [(i, t, [None, "a", "b", ""][k % 4], 7, "t", "p", "q") for k, (i, t) in enumerate(zip(IDS, TEXTS, strict=True))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (3, 0, 1), (6, 1, None), (12, None, 1), (27, 1, 0), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def oracle(sql: str, **tables) -> pd.DataFrame:
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.sql(sql).df()


def test_spans():
    data, offsets = np.frombuffer(b"ab cab" + LONG.encode() + b" ab", np.uint8), np.array([0, 0, 4, 6, 106, 109])
    begin, end, owner = spans.words(data, offsets, ~spans.SPACE)
    assert [data[i:j].tobytes() for i, j in zip(begin, end, strict=True)] == [b"ab", b"c", b"ab", LONG.encode(), b"ab"] and owner.tolist() == [1, 1, 2, 3, 4]
    lanes = spans.lanes_of(data)
    h = spans.hashes(data, lanes, begin, end)
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3
    assert spans.equal(data, lanes, begin, end, np.array([0, 0, 3, 1]), np.array([2, 1, 3, 4])).tolist() == [True, False, True, False]


def test_filters(docs, labels, rows):
    got = filters.audit(docs, labels).collect()
    good, toxic = {3, 6, 27, 999}, {3, 12, 999}
    masks = []
    for i, t, part, *_ in rows:
        ws, t = split(t), t or ""
        own = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in t for c in "#$%&*|")}
        own["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows)
        masks.append((i, part or "", {f for f in own if own[f]}))
    expected, removed_by = {}, {}
    for part in {m[1] for m in masks}:
        for order in permutations("ABCDE"):
            for step in range(5):
                f, before = order[step], set(order[:step])
                mine = [(i, fails) for i, p, fails in masks if p == part]
                here = [i for i, fails in mine if f in fails and not fails & before]
                expected[part, "".join(order), step + 1] = [sum(not fails & {*before, f} for _, fails in mine), len(here), sum(f in fails and bool(fails & before) for _, fails in mine), sum(fails == {f} for _, fails in mine), sum(i in good for i in here), sum(i in toxic for i in here)]
                removed_by[part, f] = removed_by.get((part, f), 0) + len(here)
    assert len(got) == len(expected) == 600 * 3
    for r in got:
        assert list(r)[3:9] == expected[r["part"], r["filter_order"], r["step"]]
        assert r["shapley"] == removed_by[r["part"], r["filter_order"][r["step"] - 1]]


def test_filters_equal_their_sql(docs, labels):
    got = filters.audit(docs, labels).toPandas()
    want = oracle(filters.oracle_sql(), documents=docs.select("doc_id", "text", "source"), labels=labels)
    key = ["part", "filter_order", "step"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want[list(got.columns)].sort_values(key).reset_index(drop=True), check_dtype=False)


def test_filters_tell_words_of_one_hash(monkeypatch):
    monkeypatch.setattr(spans, "hashes", lambda data, lanes, begin, end: np.zeros(len(begin), np.uint64))
    data, offsets = np.frombuffer(b"a b a cd cd", np.uint8), np.array([0, 5, 11])
    begin, end, owner = spans.words(data, offsets, ~spans.SPACE)
    assert filters.distinct_words(data, begin, end, owner, 2).tolist() == [2, 1]


def test_empty_tables(docs, labels):
    none = docs.where("doc_id < 0")
    items = docs.selectExpr("doc_id as item_id", "text")
    assert filters.audit(none, labels).count() == 0 and filters.audit(docs, labels.where("false")).count() == 1800
    assert lexical.rank_documents(none, items).count() == 0 and lexical.rank_documents(docs, items.where("item_id < 0")).count() == 0
    assert simhash.near_groups(none).count() == 0


def scores(rows, items):
    terms = lambda t: [] if t is None else lexical.LOWER[np.frombuffer(t.encode(), np.uint8)].tobytes().translate(bytes(b if lexical.TERM[b] else 32 for b in range(256))).split()
    held = [(i, terms(t)) for i, t, *_ in rows]
    big_n, big_l = sum(bool(ts) for _, ts in held), sum(len(ts) for _, ts in held)
    df = {t: sum(t in set(ts) for _, ts in held) for t in {t for _, ts in held for t in ts}}
    out = {}
    united: dict = {}
    for item, text in items:
        united.setdefault(item, set()).update(terms(text))
    for item, own in united.items():
        ranked = []
        for i, ts in held:
            m = 10 + 90 * len(ts) * big_n // big_l
            s = sum(int(np.floor(1000 * np.log((2 * big_n + 2) / (2 * df[t] + 1)))) * (10**9 * ts.count(t) // (1000 * ts.count(t) + 8 * m)) for t in own & set(ts))
            if s > 0:
                ranked.append((-s, i is None, i or 0))
        out[item] = [(None if null else i, -s) for s, null, i in sorted(ranked)[: lexical.K]]
    return out


@pytest.mark.parametrize(("shard", "block"), [(lexical.SHARD_POSTINGS, lexical.BLOCK_TERMS), (300, lexical.BLOCK_TERMS), (60, 40)])
def test_ranked_search(spark, docs, rows, shard, block):
    items = [(1, "w1 W2 w3, w400 w1"), (2, " ".join(WORDS)), (3, None), (4, "???"), (5, "one"), (1, "w7"), (None, "the and é"), (6, "nowhere"), (7, TEXTS[9]), (7, TEXTS[9])]
    table = spark.createDataFrame(items, "item_id long, text string")
    got: dict = {}
    for r in lexical.rank_documents(docs, table, block_terms=block, shard_postings=shard).orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(got[r["item_id"]])
    want = {k: v for k, v in scores(rows, items).items() if v}
    assert got == want
    known = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    mine, sql = lexical.rank_documents(known, table).toPandas(), oracle(lexical.oracle_sql(), documents=known.select("doc_id", "text"), benchmark=table)
    key = ["item_id", "rank"]
    pd.testing.assert_frame_equal(mine.sort_values(key).reset_index(drop=True), sql[list(mine.columns)].sort_values(key).reset_index(drop=True), check_dtype=False)


@pytest.mark.parametrize("floor", [0, 4_000_000_000, 10**12])
def test_reading_by_impact_stops_early_and_is_exact(floor):
    own = np.random.default_rng(3)
    docs, vocabulary = 4000, 60
    held = own.random((docs, vocabulary)) < 1 / np.arange(1, vocabulary + 1)
    starts = np.append(0, np.cumsum(held.sum(1)))
    terms = np.nonzero(held)[1]
    tf, length = own.geometric(0.6, len(terms)), np.repeat(own.integers(10, 300, docs), held.sum(1))
    weights = np.floor(1000 * np.log((2 * docs + 2) / (2 * held.sum(0) + 1))).astype(np.int64)
    shard = lexical.Shard(np.arange(docs), starts, terms, 10**9 * tf // (1000 * tf + 8 * length), vocabulary)
    read = 0
    for _ in range(30):
        item = np.unique(own.integers(0, vocabulary, 12))
        only = np.where(np.isin(np.arange(vocabulary), item), weights, 0)
        whole = shard.complete(np.arange(docs), only)
        rows, found, n = shard.best(item, only, 10, floor)
        want = [d for d in np.lexsort((np.arange(docs), -whole))[:10] if whole[d] >= max(floor, 1)]
        order = np.lexsort((rows, -found))[:10]
        assert [d for d, s in zip(rows[order], found[order], strict=True) if s >= max(floor, 1)] == want
        assert np.array_equal(found, whole[rows])
        read += n / held[:, item].sum()
    assert read / 30 < 0.9


def near_classes(prints: dict, radius: int) -> dict:
    label = {i: i for i in prints}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                label[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


def test_golay_keys_cover_four_bits():
    own = np.random.default_rng(2)
    for bits in (0, 1, 2, 3, 4):
        for _ in range(300):
            x = int(own.integers(0, 1 << 63))
            y = x
            for b in own.choice(64, bits, replace=False):
                y ^= 1 << int(b)
            a, b = (set(simhash.keys_of(np.array([v], np.uint64).view(np.int64))[1].tolist()) for v in (x, y))
            assert a & b
    found = (simhash.PATTERNS >= 0).sum(1)
    assert sorted(set(found.tolist())) == [1, 6] and (found == 6).sum() == 1771


def test_simhash_of_texts(spark, docs, rows):
    def brute(text):
        ws = [w.translate(simhash.LOWER) for w in split(text)]
        runs = [b" ".join(ws[i : i + 4]) for i in range(max(len(ws) - 3, 1))] if ws else []
        h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash.near_groups(docs).collect()
    assert len(got) == len(rows)
    prints = {(i, t): brute(t) for i, t, *_ in rows}
    wanted = sorted((i is None, i or 0, f"{prints[i, t]:016x}") for i, t, *_ in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"]) for r in got) == wanted
    nodes = {k: p for k, p in enumerate(prints.values())}
    classes = near_classes(nodes, 4)
    ids = [i for i, _ in prints]
    twice = [k for k, i in enumerate(ids) if i == 12]
    joined = {classes[k] for k in twice}
    group = lambda k: min(joined) if classes[k] in joined else classes[k]
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[group(k)] = min(least.get(group(k), i), i)
    by = {(i, f"{p:016x}"): least.get(group(k)) for k, ((i, _), p) in enumerate(prints.items())}
    assert all(r["component_id"] == by[r["doc_id"], r["fingerprint"]] for r in got)


@pytest.mark.parametrize("run", [1024, 5])
def test_simhash_groups(spark, run):
    own = np.random.default_rng(9)
    prints = own.integers(-(1 << 63), 1 << 63, 60, dtype=np.int64, endpoint=False).view(np.uint64).tolist()
    for centre in range(4):  # clusters, whose members are far from each other but joined by chains
        at = prints[centre]
        for _ in range(60):
            at ^= sum(1 << int(b) for b in own.choice(64, own.integers(1, 6), replace=False))
            prints.append(at)
            prints.append(prints[centre] ^ sum(1 << int(b) for b in own.choice(12, own.integers(1, 5), replace=False)))
    prints = list(dict.fromkeys(prints))
    nodes = dict(enumerate(prints))
    rows = [(np.uint64(p).view(np.int64).item(),) for p in prints]
    links = simhash.print_links(spark.createDataFrame(rows, "print long"), 4, run).distinct().collect()
    at = {r[0]: i for i, r in enumerate(rows)}
    assert all((prints[at[r["a"]]] ^ prints[at[r["b"]]]).bit_count() <= 4 for r in links) or run == 1024
    label = list(range(len(prints)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in links:
        a, b = top(at[r["a"]]), top(at[r["b"]])
        label[max(a, b)] = min(a, b)
    assert {i: top(i) for i in nodes} == near_classes(nodes, 4)


def test_digests_are_of_whole_texts(docs):
    got = {bytes(r["digest"]) for r in filters.text_failures(docs, "source").collect()}
    assert got == {hashlib.sha256((t or "").encode()).digest() for t in TEXTS}
