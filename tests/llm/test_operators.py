"""Small fixtures against brute force: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridframe.llm import op01_lm as lm
from gridframe.llm import op02_decontamination as decontamination
from gridframe.llm import op03_packing as packing
from gridframe.llm import op04_language as language
from gridframe.llm import op05_quality as quality
from gridframe.llm import op06_license as license_scan
from gridframe.llm import op07_repeats as repeats
from gridframe.llm import op08_html as pages_html
from gridframe.llm import op09_jaccard as jaccard
from gridframe.llm import op10_topk as topk

rng = np.random.default_rng(5)
WORDS = [f"w{i}" for i in range(300)]
BASE = [" ".join(rng.choice(WORDS, 60)) for _ in range(6)]
TEXTS = [None, "", "  \n", "One", "one", "Zwei drei", *BASE, BASE[0], BASE[0].upper(), BASE[1] + " extra end", "x " + BASE[2] + "\nnew", BASE[3][:200] + BASE[4], " ".join(rng.choice(WORDS, 9000)), BASE[0], "ß" * 300, "12 34 !!"]
SCHEMA = "doc_id long, text string, lang string, score string, n string, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(3 * i, t, ["en", "de", None][i % 3], "s", "n", "k") for i, t in enumerate(TEXTS)], SCHEMA).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def test_lm(spark, docs, empty):
    rows = {r["doc_id"]: r for r in lm.cross_fit(docs).collect()}
    split = {3 * i: [*(t or "").encode().translate(lm.LOWER).split(), b"\n"] for i, t in enumerate(TEXTS)}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in split}
    counts = Counter(w for d, ws in split.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in split.items():
        assert (rows[d]["held_out"], rows[d]["n_tokens"], rows[d]["train_tokens"]) == (held[d], len(ws), n)
        assert rows[d]["n_known"] == sum(counts[w] > 0 for w in ws)
        assert math.isclose(rows[d]["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isfinite(rows[d]["score"]) and rows[d]["score"] < 0
    assert lm.cross_fit(empty).count() == 0


def test_lm_head_takes_whole_steps(spark, docs):
    counts = spark.createDataFrame([(bytes([97 + i]), n) for i, n in enumerate([9, 5, 5, 3, 1, 1])], "word binary, n long")
    assert lm.most_frequent(counts, 10) == [(b"a", 9), (b"b", 5), (b"c", 5), (b"d", 3), (b"e", 1), (b"f", 1)]
    assert lm.most_frequent(counts, 5) == [(b"a", 9), (b"b", 5), (b"c", 5), (b"d", 3)]
    assert lm.most_frequent(counts, 2) == [(b"a", 9)] and lm.most_frequent(counts, 0) == []
    whole, few = ({r["doc_id"]: r for r in lm.score(docs, lm.fit(docs, head)).collect()} for head in (lm.HEAD, 0))
    assert all(r["n_known"] == few[d]["n_known"] and math.isclose(r["base_score"], few[d]["base_score"], rel_tol=1e-9) for d, r in whole.items())


def test_lm_is_normalised():
    model = lm.Model(np.arange(lm.CLASSES))
    row = np.concatenate([np.zeros(lm.CONTEXT, int), [7]])
    total = 0.0
    for k in range(lm.CLASSES):
        row[-1] = k
        total += math.exp(model.log_probabilities(row, np.array([lm.CONTEXT]))[0])
    assert abs(total - 1) < 1e-4


@pytest.mark.parametrize("block_words", [decontamination.BLOCK_WORDS, 40])
def test_decontamination(spark, docs, empty, block_words):
    items = [("a", " ".join(BASE[0].split()[5:40])), ("b", "ONE"), ("c", None), ("d", ""), ("e", "nothing of this is there at all in any of them, not one word"), ("a", " ".join(BASE[0].split()[5:40]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: r for r in decontamination.digest(decontamination.contamination(docs, bench, block_words=block_words)).collect()}
    for i, t in enumerate(TEXTS):
        ws = decontamination.words_of((t or "").encode())
        hit, found = set(), set()
        for item, text in items:
            own = decontamination.words_of((text or "").encode())
            for s in range(max(1, len(own) - 12)) if own else ():
                w = own[s : s + 13]
                for k in range(len(ws) - len(w) + 1):
                    if ws[k : k + len(w)] == w:
                        hit |= set(range(k, k + len(w)))
                        found.add(item)
        r = got[3 * i]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(ws), len(hit), len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(ws))
    assert decontamination.contamination(empty, bench).count() == 0
    assert not decontamination.contamination(docs, bench.where("false")).where("contaminated").count()


def test_packing(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = {}
    for i, text in enumerate(TEXTS):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            own = np.array(ids[p : p + 4096], "<u4")
            want[3 * i, p // 4096] = (p, len(own), zlib.crc32(own.tobytes()))
    rows = packing.pack_documents(docs, path).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(empty, path).count() == 0


def test_fillings_hold_the_histogram():
    histogram = {int(n): int(k) for n, k in zip(rng.integers(1, 500, 80), rng.integers(1, 60, 80), strict=True)}
    chosen = packing.fillings(histogram, 512, 40)
    total = Counter()
    for m, own in chosen:
        assert sum(n * k for n, k in own.items()) <= 512
        for n, k in own.items():
            total[n] += m * k
    assert total == Counter(histogram)
    least = max(sum(n * k for n, k in histogram.items()) / 512, sum(k for n, k in histogram.items() if n > 256))
    assert sum(m for m, _ in chosen) <= 1.1 * least + 2


def test_language(spark, docs, empty):
    rows = [(i, text, lang, "x") for i in range(60) for text, lang in [(("the house of the king and this thing ", "en"), ("der Hund und die Katze nicht ein Haus ", "de"))[i % 2]]]
    some = spark.createDataFrame([*rows, (1000, None, "en", "x"), (1001, "12 !", "en", "x"), (1003, "² ½ ①", "en", "x"), (1002, "the thing and the king", None, "x")], "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["held_out"]) for r in language.cross_fit(some).collect()}
    assert all(got[i][0] == ("en", "de")[i % 2] and 0 <= got[i][1] <= 1 for i in range(60))
    assert got[1000][:2] == got[1001][:2] == got[1003][:2] == ("und", 0.0) and got[1002][0] == "en"
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, (_, _, h) in got.items())
    assert language.cross_fit(empty).count() == 0 and language.cross_fit(docs).count() == len(TEXTS)


def test_language_code_lengths_sum_to_one_or_less():
    grams = np.concatenate([language.grams_of(w) for w in (b"abc", b"abd", b"bcd")])
    own, n = np.unique(grams, return_counts=True)
    tree = language.ContextTree(own, n.astype(float))
    after = np.array([int.from_bytes(b" ab" + bytes([k]), "big") for k in range(256)], np.uint32)
    assert np.exp2(-tree.bits(after)).sum() <= 1 + 1e-9


def test_quality(spark, docs, empty):
    good = [" ".join(rng.choice(WORDS, 50)) + "." for _ in range(80)]
    bad = ["ALL THIS IS SHOUTED!! " * 10, "a | b | c | d | e | f", "no no no no no no no no no no"] * 7
    some = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*good, *bad, None, ""])], "doc_id long, text string, score string")
    got = {r["doc_id"]: r["good"] for r in quality.classify(some).collect()}
    assert sum(got[i] for i in range(80)) > 70 and sum(got[i] for i in range(80, 101)) < 7
    assert quality.classify(empty).count() == 0 and quality.classify(docs).count() == len(TEXTS)


def test_license(spark, docs, empty):
    known = spark.createDataFrame([("MIT", "Released under the MIT Licence."), ("x", None)], "license_id string, text string")
    some = spark.createDataFrame([(1, "Copyright (c) 2020 Someone\nreleased  under\nthe MIT license", "a"), (2, None, "a"), (3, "", "a"), (4, "Released under the MIT License. And more", "a")], "doc_id long, text string, digest string")
    assert {r["doc_id"]: r["license_id"] for r in license_scan.scan(some, known).collect()} == {1: "MIT", 2: None, 3: None, 4: None}
    assert license_scan.scan(empty, known).count() == 0 and license_scan.scan(docs, known.where("false")).count() == len(TEXTS)


def test_repeats(spark, docs, empty):
    got = {r["doc_id"]: r for r in repeats.digest(repeats.remove_repeats(docs)).collect()}
    seen = set()
    for i, t in enumerate(TEXTS):
        x = (t or "").encode()
        gone = bytearray(len(x))
        for k in range(len(x) - 99):
            if x[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(x[k : k + 100])
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        r = got[3 * i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(x), len(x) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    assert repeats.remove_repeats(empty).count() == 0
    double = docs.where("doc_id = 18").unionByName(docs.where("doc_id = 18"))
    assert [r["n_removed"] for r in repeats.digest(repeats.remove_repeats(double)).collect()] == [0, 0]


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav><a>Menu</a></nav><div>Site name</div><div class='ad'>Buy</div>{}<footer>&copy; x</footer></body></html>"
    rows = [(1, "http://a.b/1", page.format("<article><h1>A &amp; B</h1><p>One<br>two  <b>three</b><p>Next</article><div class=comments>no</div>"), "x")]
    rows += [(i, f"http://a.b/{i}", page.format(f"<div><p>Text {i} is here</p></div><script>var t='</p>';</script><!-- c -->"), "x") for i in range(2, 8)]
    rows += [(8, "http://a.b/8", None, "x"), (9, None, "", "x")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in pages_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1][0] == "A & B\n\nOne two three\n\nNext" and got[8] == got[9] == ("", 0)
    assert all(got[i] == (f"Text {i} is here", len(f"Text {i} is here")) for i in range(2, 8))


def test_jaccard(spark, docs, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(docs).collect()}
    sets = {}
    for i, t in enumerate(TEXTS):
        w = (t or "").encode().lower().split()
        sets[3 * i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    group = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    assert got == {d: (len(s), group[d]) for d, s in sets.items()}
    assert jaccard.near_groups(empty).count() == 0


def test_jaccard_where_rows_share_an_id(spark):
    rows = [(3, BASE[0]), (5, BASE[0]), (5, BASE[1]), (9, BASE[1] + " and"), (None, BASE[2]), (None, None), (11, "a b"), (11, "")]
    got = sorted(jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(3, 3), (5, 3), (9, 3), (None, None), (11, 11)} and len(got) == len(rows)


def test_repeats_in_periodic_text(spark):
    texts = ["-" * 3000, "x" + "-=" * 700, "-" * 150 + "end", "ab" * 20]
    got = {r["doc_id"]: r for r in repeats.digest(repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    seen = set()
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(t[k : k + 100])
        assert (got[i]["n_bytes"], got[i]["n_removed"]) == (len(t), sum(gone))


def test_top_k(spark):
    x = rng.normal(0, 0.3, (400, 6))
    x[100:160] = x[3]
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)] + [(1000, None, "x"), (1001, [1.0, None], "x"), (1020, [float("nan")] * 6, "x")]
    vectors = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"))
    got = sorted(tuple(r) for r in topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), query_block=7).collect())
    q = np.floor(64 * x).astype(int)
    want = []
    for i in range(0, 400, 20):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(400), -s)) if j != i][:20]
        want += [(i, k + 1, int(j), int(s[j])) for k, j in enumerate(order)]
    assert got == sorted(want)
    assert topk.top_k(vectors.where("false"), vectors.where("false")).count() == 0


def test_top_k_of_repeated_rows_ties_and_short_vectors(spark):
    """Copies tie to the smaller id; of rows that share an id the smallest vector counts; short ones end in zeros."""
    x = [(i, [float(i % 7), 1.0], None) for i in range(300)] + [(40, [-9.0, 0.0], "extra"), (60, [2.0], "extra"), (None, [1.0, 1.0], None), (80, [], None)]
    vectors = topk.quantized(spark.createDataFrame(x, "vec_id long, embedding array<double>, rank string"))
    got = sorted(tuple(r) for r in topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), query_block=6).collect())
    known = {}
    for i, v, _ in x:
        if i is not None:
            known[i] = min(known.get(i, [64 * w for w in v]), [64 * w for w in v])
    known = {i: np.array([*v, 0, 0][:2], int) for i, v in known.items()}
    want = []
    for i in range(0, 300, 20):
        best = sorted((-int(known[i] @ v), j) for j, v in known.items() if j != i)[:20]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_stops_before_the_end_of_the_lists():
    x = rng.integers(-60, 60, (4000, 12))
    x[7] = 60 * np.sign(x[5])
    lists, ids = topk.Lists(x), np.arange(4000)
    floor = np.array([int(x[5] @ x[7])])
    may = topk.first_look(x[5:6], ids[5:6], lists, ids, 1, floor, 3000)
    rows, scores, depth = topk.read_on(x[5], lists, np.flatnonzero(may[0]), 1, int(floor[0]), 3000)
    assert may.sum() < 400 and depth < 4000
    assert list(rows) == [7] and list(scores) == [floor[0]]


def test_top_k_keeps_exact_scores_of_large_values():
    x = rng.integers(-(2**30), 2**30, (64, 3))
    lists, ids = topk.Lists(x), np.arange(64)
    q, c, s = topk.search_block(x[:2], ids[:2], lists, ids, 5, np.full(2, topk.NONE))
    for i in range(2):
        score = {j: sum(int(a) * int(b) for a, b in zip(x[i], x[j], strict=True)) for j in ids if j != i}
        found = dict(zip(c[q == i], s[q == i], strict=True))
        assert sorted(score, key=lambda j: -score[j])[:5] == sorted(found, key=lambda j: -found[j])[:5]
        assert all(score[j] == v for j, v in found.items())


def test_license_texts_however_wrapped_and_by_sql(spark):
    """Whole licences match in other wraps, cases, spellings and with copyright lines; with anything more they don't."""
    texts, wanted = [], []
    for name, text in license_scan.LICENSES:
        words = text.split()
        texts += [text, text.upper(), "Copyright (c) 2021 Some One\nAll rights reserved.\n\n" + "\n".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7))]
        texts += ["\n".join(words).replace("copyright", "Copyright"), text + "\nAnd one thing more."]
        wanted += [name] * 4 + [None]
    texts += [None, "", "Copyright 2020", "licence licence licence sublicence", "(c) you must keep this", "(c) 2020 me"]
    wanted += [None] * 6
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: tuple(r) for r in license_scan.scan(docs, license_scan.known_licenses(docs)).collect()}
    assert [rows[i][3] for i in range(len(texts))] == wanted
    assert rows[len(texts) - 3][2] == len("license license license sublicense") and rows[len(texts) - 2][2] > 0 and rows[len(texts) - 1][2] == 0
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    assert {r[0]: r for r in con.execute(license_scan.oracle_sql()).fetchall()} == rows


def test_counts_of_buckets_beyond_32_bits():
    """A bucket of over 2**31 shingles is not taken for one that stands alone."""
    full = pa.array([np.array([7], np.uint16).tobytes()] * 40_000, pa.binary())
    counts = pa.array([np.array([0xFFFF], np.uint16).tobytes()] * 40_000, pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 40_000, pa.int32()), full, counts], ["chunk", "places", "counts"])
    (out,) = jaccard.add_chunks(iter([batch]))
    packed = np.frombuffer(out.column("counts")[0].as_py(), np.uint8)
    assert jaccard.rarities(packed, np.array([7, 8])).tolist() == [15, 0]
