"""Short passages from inside long benchmark items."""

import random

from panelspark.llm import decontaminate


def _words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n))


def test_a_short_quote_from_anywhere_in_an_item_is_found():
    rng = random.Random(6)
    item = _words(rng, 120)
    index = decontaminate.Benchmark([(7, item.encode())])
    size = decontaminate.SHORT + decontaminate.STEP - 1
    for at in range(len(item) - size + 1):
        text = decontaminate.fold(f"{_words(rng, 15)} {item[at:at + size]} {_words(rng, 15)}".encode())
        assert any(i == 7 and edits <= 5 for i, _, _, _, edits in index.find(text)), at


def test_gathered_edits_are_still_found_by_the_long_windows():
    rng = random.Random(8)
    item = _words(rng, 60)[:192]
    copied = list(item)
    for p in range(84, 105, 3):    # seven edits, more than a short window allows
        copied[p] = "z"
    text = decontaminate.fold(f"{_words(rng, 15)} {''.join(copied)[48:144]} {_words(rng, 15)}".encode())
    index = decontaminate.Benchmark([(7, item.encode())])
    assert {(len(w), at) for i, at, w in index.windows} >= {(96, 48), (64, 48)}
    assert (7, 48, 7) in {(i, at, edits) for i, at, _, _, edits in index.find(text)}


def test_unrelated_texts_match_nothing():
    rng = random.Random(9)
    index = decontaminate.Benchmark([(k, _words(rng, 60).encode()) for k in range(5)])
    assert not any(index.find(decontaminate.fold(_words(rng, 300).encode())) for _ in range(20))


def _best_in_band(pattern, stretch, allowed):
    """Fewest edits over all stretches that begin and end on the band's diagonals, by a plain table."""
    width = decontaminate.band_width(allowed)
    cost = {d: 0 for d in range(width)}
    for i, c in enumerate(pattern):
        new = {}
        for d in range(width):
            new[d] = min(cost[d] + (stretch[i + d] != c), cost.get(d + 1, 999) + 1, new.get(d - 1, 999) + 1)
        cost = new
    return min(cost.values())


def test_bands_verified_together_equal_a_plain_table():
    rng = random.Random(10)
    for size in (20, 64, 96):
        k = decontaminate.edits_allowed(size)
        patterns, stretches = [], []
        for trial in range(60):
            pattern = bytes(rng.choices(b"ab c", k=size))
            copied = list(pattern)
            for p in sorted(rng.sample(range(size), trial % (k + 3)), reverse=True):
                copied[p:p + 1] = [[], [122], [copied[p], 121]][rng.randrange(3)]
            lead = rng.randrange(2 * k + 3)
            room = size + decontaminate.band_width(k)
            patterns.append(pattern)
            stretches.append((bytes(lead) + bytes(copied) + bytes(rng.choices(b"ab c", k=room)))[:room])
        edits, begin, end = decontaminate.banded(patterns, stretches, k)
        want = [_best_in_band(p, s, k) for p, s in zip(patterns, stretches)]
        assert [min(e, k + 1) for e in edits] == [min(w, k + 1) for w in want]
        assert any(w > k for w in want) and any(0 < w <= k for w in want)


def test_a_short_item_leaves_the_bounds_of_the_others():
    rng = random.Random(11)
    long_item = _words(rng, 60).encode()
    alone, both = decontaminate.Benchmark([(1, long_item)]), decontaminate.Benchmark([(1, long_item), (2, b"abcd efgh ij abc")])
    assert [i.classes for i in both.indexes][1:] == [alone.indexes[0].classes] and len(both.indexes) == 2
    text = decontaminate.fold(f"{_words(rng, 9)} {long_item.decode()[30:120]} {_words(rng, 9)} abcd efgh ij abc".encode())
    assert set(both.find(text)) >= set(alone.find(text)) and {r[0] for r in both.find(text)} == {1, 2}


def test_small_pieces_and_small_batches_change_nothing(monkeypatch):
    rng = random.Random(13)
    items = [(k, _words(rng, 40).encode()) for k in range(8)]
    texts = [decontaminate.fold((_words(rng, 20) + " " + items[k % 8][1].decode()[k:k + 90] + "q" + _words(rng, 20)).encode()) for k in range(24)]
    whole = decontaminate.Benchmark(items).find_all([*texts, b"", b"a"])
    assert whole[-2:] == [[], []] and sum(map(bool, whole)) > 12
    monkeypatch.setattr(decontaminate, "PAIRS", 3)
    monkeypatch.setattr(decontaminate, "VERIFY", 2)
    small = decontaminate.Benchmark(items)
    assert [small.find(t) for t in [*texts, b"", b"a"]] == whole


def test_an_item_without_an_id_and_equal_texts():
    index = decontaminate.Benchmark([(None, b"one two three four five six seven"), (3, b"one two three four five six seven")])
    assert [r[0] for r in index.find(b"x one two three four five six seven y")] == [None, 3]
