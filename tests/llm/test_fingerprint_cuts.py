"""Fingerprints of texts with few line breaks and sentence ends."""

import random

import pytest

from panelspark.llm import iblt


def _long_texts():
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    yield "stone " * 500
    yield " ".join("".join(rng.choices(letters, k=rng.randrange(2, 9))) + "!!" for _ in range(600))
    yield "".join(rng.choices(letters, k=4000))
    yield "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(1500))
    yield "x" * 3000


def test_an_unchanged_half_of_one_paragraph_is_seen():
    texts = list(_long_texts())
    for text, other in zip(texts, texts[1:] + texts[:1]):
        n = len(text)
        edited = text[:n - n // 2] + other[:n // 2]
        assert iblt.likeness(iblt.Document(text), iblt.Document(edited)) > 0.2


@pytest.mark.parametrize("n", [32, 33, 64, 200, 257, 1000])
def test_any_unchanged_beginning_of_sixteen_bytes_leaves_a_digest(n):
    rng = random.Random(n)
    for _ in range(100):
        start = "".join(rng.choices("abcdefgh ,", k=n // 2))
        a, b = (start + "".join(rng.choices("abcdefgh ,.\n", k=rng.randrange(n))) for _ in range(2))
        assert set(iblt.digests(a)) & set(iblt.digests(b))


def test_pieces_make_up_the_paragraph_and_meet_again_after_an_insertion():
    rng = random.Random(3)
    unit = "".join(rng.choices("abcdefgh ", k=20_000)).encode()
    pieces = iblt._pieces(unit, iblt._LONG)
    assert b"".join(pieces) == unit and all(128 <= len(p) <= 256 for p in pieces[:-1])
    moved = iblt._pieces(b"inserted words " + unit, iblt._LONG)
    assert len(set(pieces) & set(moved)) > 0.8 * len(pieces)
    assert iblt._pieces(b"y" * 128, iblt._LONG) == [b"y" * 128]


def test_short_sentences_stay_whole():
    assert len(iblt.digests("A title\n" + "One sentence of words. " * 3)) == 4
