"""The packing's word cache: what it holds, and that ids stay those of whole texts."""

from gridframe.llm import entries
from gridframe.llm import op03_packing as packing


def test_small_words_are_held_once():
    words = packing.WordIds(entries.tokenizer_path())
    assert words.letters_alone
    words.ids([b"one two three", b"three four"])
    assert len(words.cache) + len(getattr(words, "stems", ())) == 4


def test_ids_with_long_words_and_signs():
    words = packing.WordIds(entries.tokenizer_path())
    texts = ["Straße ÄRGER, ABC-def it's", "x" * 70 + " a" + "-" * 80 + " A, a| |b", "ABC abc. Abc," + " y" * 3, ""]
    for _ in range(2):
        got = words.ids([t.encode() for t in texts])
        assert got == [b"".join(x.tobytes() for x in packing.encoded(words.tokenizer, t.split())) for t in texts]
        assert all(len(w) <= packing.CACHE_BYTES for w in words.cache)


def test_words_in_use_stay_when_the_cache_is_full(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    words = packing.WordIds(entries.tokenizer_path())
    words.ids([b"the of and to in rare seldom once"])
    asked = []
    monkeypatch.setattr(words, "of_stems", lambda stems, real=words.of_stems: (asked.extend(stems), real(stems))[1])
    assert words.ids([b"the of and new"]) == [b"".join(x.tobytes() for x in packing.encoded(words.tokenizer, ["the", "of", "and", "new"]))]
    assert asked == [b"new"] and set(words.cache) == {b"the", b"of", b"and", b"new"}
