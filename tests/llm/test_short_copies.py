"""Near copies of short texts, where the bits of a fingerprint are coarse: every pair must be found."""

import random

import numpy as np
import pytest

from panelspark.llm import simhash


def brute_force(texts, least):
    """Smallest id reachable over pairs of similar shingle sets, all pairs compared."""
    sets = {i: simhash.shingle_set((t or "").encode(), 5) for i, t in texts}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for at, i in enumerate(ids):
        for j in ids[at + 1:]:
            (da, a), (db, b) = sets[i], sets[j]
            shared = len(np.intersect1d(a, b))
            if da == db or shared and shared >= least * (len(a) + len(b) - shared):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: top(i) for i in ids}


def short_pairs(rng, n, longest):
    """Texts of 1 to ``longest`` words, many with one word more at either end, some with the same common opening."""
    texts = []
    for _ in range(n):
        words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(rng.randint(1, longest))]
        if rng.random() < .3:
            words = "the same five words open this".split() + words
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 2)):
            extra = "".join(rng.choices("klmnop", k=4))
            texts.append(" ".join(rng.choice([words + [extra], [extra] + words, words[:-1] + [extra], words + words[:1]])))
    return texts


@pytest.mark.parametrize("tile", [8, 1024])
def test_short_copies_equal_all_pairs(spark, tile):
    rng = random.Random(11)
    texts = list(enumerate([*short_pairs(rng, 250, 24), None, "", "  ", "one", "One", "a a a a a a", "a a a a a a a"]))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df, tile=tile).collect()}
    assert got == brute_force(texts, .8)


def test_eight_words_and_a_ninth_are_always_linked(spark):
    rng = random.Random(12)
    texts = []
    for k in range(400):
        words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(8)]
        texts += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "ninth"]))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == list(range(0, 800, 2))


def test_without_any_short_text_nothing_changes(spark):
    rng = random.Random(13)
    base = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60)) for _ in range(3)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*base, base[0] + " more"])], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()} == {0: 0, 1: 1, 2: 2, 3: 0}
    assert simhash.similar_groups(df.limit(0)).collect() == []
