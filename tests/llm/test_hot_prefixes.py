"""Removal of repeats where many different texts share a line."""

import hashlib
import random

import pytest

from gridframe.llm import op07_repeats as repeats


def brute(rows):
    seen, out = {}, {}
    for i, t in rows:
        for k in range(len(t) - 99):
            seen.setdefault(t[k : k + 100], (i, k))
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - 99):
            if seen[t[k : k + 100]] < (i, k):
                gone[k : k + 100] = b"\1" * 100
        kept = bytes(c for c, g in zip(t.encode(), gone, strict=True) if not g)
        out[i] = (len(t) - len(kept), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)

    def noise(n):
        return "".join(draw.choices("abcdefghij klmnopqrstuvwxyz", k=n))

    line, other = noise(140), noise(230)
    texts = [noise(draw.randint(0, 150)) + line + noise(draw.randint(0, 150)) + (other if i % 7 == 0 else "") for i in range(400)]
    texts += [texts[5], "-" * 900, "x" + "-" * 400 + line, "", line * 3, line[:99]]
    return sorted(zip(draw.sample(range(10_000), len(texts)), texts, strict=True))


@pytest.mark.parametrize("heavy_bytes", [0, 20_000, repeats.HEAVY_BYTES])
def test_a_line_of_many_texts(spark, rows, heavy_bytes):
    """Blocks above the bound are looked at by digest: all of them, some, or none give the same rows."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = repeats.digest(repeats.remove_repeats(df, heavy_bytes=heavy_bytes)).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == brute(rows)


def test_repeated_rows_of_hot_blocks(spark, rows):
    """Rows that share an id and a text: neither is earlier than the other."""
    twice = spark.createDataFrame(rows[:1] * 2, "doc_id long, text string")
    assert [r["n_removed"] for r in repeats.digest(repeats.remove_repeats(twice, heavy_bytes=0)).collect()] == [0, 0]
