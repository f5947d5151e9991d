"""The automaton of a block: states, arcs, failure arcs and the traversal."""

import numpy as np
import pytest

from panelspark.llm import backoff_lm


def _block(texts, held=99):
    return backoff_lm.Block(list(range(len(texts))), [t.encode() for t in texts], 5, held)


def _model(block, count, pairs, starts):
    unigram = (count + .5) / (count.sum() + .5 * (len(count) + 1))
    continues = np.linspace(.3, .9, backoff_lm.CLASSES)
    return backoff_lm.Automaton(block, count, pairs, starts, unigram, continues)


def _one_by_one(model, words):
    """The weights along one text, an arc at a time."""
    arcs = dict(zip(model.arc.tolist(), model.arc_weight.tolist()))
    state, total = model.start, 0.0
    for w in words:
        while state != model.empty and state * model.words + w not in arcs:
            total += model.fail_weight[state]
            state = int(model.fail_to[state])
        total += model.base[w] if state == model.empty else arcs[state * model.words + w]
        state = int(model.next[w])
    return total


def test_traversal_equals_one_step_at_a_time():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 40))) for _ in range(50)] + ["", "a", "x y z " * 300]
    b = _block(texts)
    pairs = b.counts(np.unique(b.pair_hash, return_inverse=True)[1], len(np.unique(b.pair_hash))).astype(np.int64)
    pairs[rng.random(len(pairs)) < .4] = 0            # bigrams that only held-out texts have
    count = b.counts(b.word_at, len(b.words)).astype(np.int64)
    for word in rng.choice(len(count), 3, replace=False):    # words that are no context
        count[word] = 0
    first = np.unique(b.pair_hash, return_index=True)[1]
    context = np.append(count, len(texts))[np.where(b.first[first], len(count), b.word_at[first - 1])]
    pairs[(context == 0) | (count[b.word_at[first]] == 0)] = 0
    model = _model(b, count, pairs, len(texts))
    assert len(model.arc) == (pairs > 0).sum() + 1 and (np.diff(model.arc) > 0).all()
    got, begin = model.run(b.word_at, b.tokens), b.ends - b.tokens
    want = [_one_by_one(model, b.word_at[s:e].tolist()) for s, e in zip(begin, b.ends)]
    assert got == pytest.approx(want) and len(set(np.round(got, 9))) > 40


def test_equal_texts_score_alike_wherever_they_stand():
    texts = ["a b c", "c c", "a b c", "", "", "b " * 50, "a b c"]
    b = _block(texts)
    pairs = b.counts(np.unique(b.pair_hash, return_inverse=True)[1], len(np.unique(b.pair_hash))).astype(np.int64)
    got = _model(b, b.counts(b.word_at, len(b.words)).astype(np.int64), pairs, 7).run(b.word_at, b.tokens)
    assert got[0] == got[2] == got[6] and got[3] == got[4]


def test_arcs_and_failure_share_the_whole_probability():
    texts = ["a b a c", "b a", "c c a"]
    b = _block(texts)
    keys, at = np.unique(b.pair_hash, return_inverse=True)
    count = b.counts(b.word_at, len(b.words)).astype(np.int64)
    model = _model(b, count, b.counts(at, len(keys)).astype(np.int64), len(texts))
    unknown = .5 / (count.sum() + .5 * (len(count) + 1))    # one class for every word not seen
    end = int(np.searchsorted(b.words, backoff_lm.END))
    arcs = dict(zip(model.arc.tolist(), model.arc_weight.tolist()))
    for state in {*range(len(count)), model.start} - {end}:
        fail = 10 ** model.fail_weight[state]
        total = fail * unknown + sum(10 ** arcs.get(state * model.words + w, np.log10(fail) + model.base[w]) for w in range(len(count)))
        assert total == pytest.approx(1)


def test_without_training_every_step_is_the_empty_state():
    b = _block(["a b", "b"])
    zero = np.zeros(len(b.words), np.int64)
    model = backoff_lm.Automaton(b, zero, np.zeros(len(np.unique(b.pair_hash)), np.int64), 0, np.ones(len(zero)), np.full(backoff_lm.CLASSES, .5))
    assert model.run(b.word_at, b.tokens).tolist() == [0, 0] and model.run(b.word_at[:0], b.tokens[:0]).tolist() == []
