"""The pipeline's stages and run() against plain Python, with null and repeated ids and repeated texts."""

import random

import corpus_pipeline as pipeline

rnd = random.Random(3)
PASSAGE = [" ".join(rnd.choice("abcdefghij") * rnd.randint(2, 6) + str(rnd.randint(0, 999)) for _ in range(60)) for _ in range(5)]
TEXTS = [
    (5, PASSAGE[0]), (2, PASSAGE[0] + " one"), (None, PASSAGE[1]), (None, PASSAGE[1]), (None, PASSAGE[2]), (7, PASSAGE[3]), (7, PASSAGE[3]),
    (5, "own words of a row that shares its id"), (9, "start " * 3 + PASSAGE[3][:150] + " then other words to the end of it " + PASSAGE[4]), (None, PASSAGE[4] + " x"), (2, "ab cd"), (1, ""), (None, None), (None, "1 2 3"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, lang=None):
    return spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t in texts], SCHEMA)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def got(df):
    return in_order([(r["doc_id"], r["text"]) for r in df.collect()])


def one_of_each(texts):
    sets = [{tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if (w := (t or "").lower().split()) else set() for _, t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    return [min((texts[i] for i in range(len(texts)) if group[i] == g), key=lambda r: (r[0] is None, r[0] or 0)) for g in sorted(set(group))]


def cut(texts, width=100):
    """Texts in order of their rows: ids first, then the rest as it comes."""
    seen, out = set(), []
    for doc, text in texts:
        data, gone = (text or "").encode(), set()
        for i in range(len(data) - width + 1):
            if data[i : i + width] in seen:
                gone.update(range(i, i + width))
            seen.add(data[i : i + width])
        kept = bytes(b for i, b in enumerate(data) if i not in gone).decode()
        out += [(doc, kept)] if kept else []
    return out


def test_no_language_keeps_all(spark):
    assert got(pipeline.known_language(spark, frame(spark, TEXTS), "")) == in_order(TEXTS)
    assert got(pipeline.known_language(spark, frame(spark, TEXTS, "en"), "")) == in_order([r for r in TEXTS if any(c.isalpha() for c in r[1] or "")])


def test_one_row_of_each_group(spark):
    assert got(pipeline.one_of_each_group(spark, frame(spark, TEXTS), "")) == in_order(one_of_each(TEXTS))


def test_repeats_of_rows_that_share_an_id_or_have_none(spark):
    order = [(2, "ab cd"), (5, PASSAGE[0]), (5, "own " + PASSAGE[0][:120] + " end"), (None, "x " + PASSAGE[0][:130] + " y")]
    assert got(pipeline.without_repeats(spark, frame(spark, order).coalesce(1), "")) == in_order(cut(order))


def test_run(spark, tmp_path):
    frame(spark, TEXTS, "en").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = one_of_each([r for r in TEXTS if any(c.isalpha() for c in r[1] or "")])
    kept = cut([r for r in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))])
    columns = ["doc_id", "piece", "length", "ids_crc32"]  # which sequence holds a piece depends on the partitions
    got, want = (sorted(map(repr, df.select(columns).collect())) for df in (pipeline.run(spark, str(tmp_path)), pipeline.packed(spark, frame(spark, kept), "")))
    assert got == want
