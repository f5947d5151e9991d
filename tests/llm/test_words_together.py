"""Words segmented together, and ids decoded by spellings, against one word and one id at a time."""

import random

import numpy as np

from panelspark.llm import unigram
from panelspark.llm.queries import tokenizer_file

PIECES = ["a", "the", "ing", "don't", " ", "  ", "\n", "é", "ß", "日本", "🙂", "\U0010ffff", "\x00", "▁", "▁▁", "12,5", "|", "q" * 63, "w" * 200, "ω" * 40]


def texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(n)] + ["", " ", "  ", "▁", "x" * 100_000]


def alone(model: unigram.Unigram, text: str) -> list[int]:
    marked = unigram.MARK + text.replace(" ", unigram.MARK) if text else ""
    return [i for w in model.cut.findall(marked) for i in model.viterbi(w)]


def test_words_together_equal_each_word_alone(monkeypatch):
    model = unigram.Unigram(tokenizer_file("piece_bpe_32k.model"))
    some = texts(41, 1500)
    want = [alone(model, t) for t in some]
    for limit, together, words in ((10**6, 1 << 19, 1024), (50, 200, 3), (10**6, 1, 1)):    # a full memory, groups of one
        monkeypatch.setattr(unigram, "WORD_LIMIT", limit)
        monkeypatch.setattr(unigram, "TOGETHER", together)
        monkeypatch.setattr(unigram, "WORDS_TOGETHER", words)
        model.words.clear()
        assert [i.tolist() for i in model.encode_all(some)] == want
    assert [model.encode(t).tolist() for t in some] == want
    assert all(len(w) <= unigram.LONGEST for w in model.words)


def test_new_short_words_take_no_search_of_their_own(monkeypatch):
    model = unigram.Unigram(tokenizer_file("piece_bpe_32k.model"))
    searched = []
    one = model.viterbi
    monkeypatch.setattr(model, "viterbi", lambda w: searched.append(w) or one(w))
    rng = random.Random(42)
    words = ["".join(rng.choices("abcdeé日", k=rng.randint(1, 30))) for _ in range(5000)]
    ids = model.encode(" ".join([*words, "w" * 200]))
    assert searched == ["▁" + "w" * 200]
    assert model.decode(ids) == " ".join([*words, "w" * 200])


def test_spellings_equal_one_id_at_a_time():
    model = unigram.Unigram(tokenizer_file("piece_bpe_32k.model"))
    rng = np.random.default_rng(43)
    for _ in range(200):    # any ids, also broken byte runs and silent ones
        ids = rng.integers(0, rng.choice([300, len(model.pieces)]), rng.integers(0, 40))
        raw = b"".join(bytes([model.byte_of[i]]) if i in model.byte_of else b"" if i in model.silent else model.pieces[i].encode()
                       for i in ids.tolist())
        text = raw.decode("utf-8", "replace").replace("▁", " ")
        assert model.decode(ids) == model.decode(ids.tolist()) == (text[1:] if text.startswith(" ") else text)
