"""Scores of whole texts under a smoothed bigram model run as a weighted backoff automaton.

Model.  p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), one class for all unknown words.
p(w|h) = l(h) c(h w) / c(h) + (1 - l(h)) p1(w).  l(h) is the Good-Turing estimate of
how often a word after h continues a known bigram, one minus the bigrams seen once
over all bigrams, taken over all contexts whose count falls into the same
``STEPS`` to a power of two.  Probabilities sum to one after every context.

Automaton.  States are the contexts and the empty context.  A state has an arc for
every bigram seen after it, weighted log10 p(w|h), and a failure arc weighted
log10(1 - l(h)) to the empty state, which has an arc for every word.  An arc leads
to the state of its word, or to the empty state if that word is no context.  One
traversal from left to right carries the state and adds the weights; all texts of
a block take their steps together.

Scale.  No model is ever held whole.  A block is a stretch of a scan partition of
bounded text.  In three passes over the documents a block (1) sends the
distinct words with their training counts to the hash partition of the word, which
adds them up over all blocks and answers; (2) sends its distinct bigrams likewise;
(3) builds the part of the automaton that its own texts reach and runs them.  Texts
never move.  Blocks send sorted arrays of 64-bit hashes, so an answer is the array
of totals alone, and a word in every text is one entry per block, not one per use.
Answers are Parquet tables in the shared folder, one directory per block.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bytes_of, id_and_text, open_folder, py_crc_mod
from panelspark.session import scratch_path

BLOCK_BYTES = 8 << 20     # text after which a new block begins
STEPS = 2                 # classes of context counts per power of two
CLASSES = 64 * STEPS
PART_BYTES = 16 << 20     # text per hash partition
_ASK = "part int, block long, check long, keys binary, counts binary, classes binary"
_ANSWER = "block long, part int, check long, totals binary, stats binary"

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNSTEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
START, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)    # contexts and words no text contains


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the hash."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = _SPACE[raw]
    inside = np.concatenate([[False], ~gap])                # inside[k + 1]: byte k belongs to a word
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & gap)
    # polynomial over random odd byte values, so every word is a difference of prefix sums
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[raw]] * _powers(_STEP, len(raw)))])
    h = _mix((sums[ends] - sums[starts]) * _powers(_UNSTEP, len(raw))[starts])
    words = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))    # words before the end of each text
    return np.insert(h, words, END), np.diff(np.concatenate([[0], words])) + 1


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, END after each text, and the number of tokens per text."""
    found, group, size = [], [], 0
    for t in texts:
        group.append(t)
        size += len(t) + 1
        if size > 1 << 19:
            found.append(_word_hashes(group))
            group, size = [], 0
    if group:
        found.append(_word_hashes(group))
    return tuple(np.concatenate(x) for x in zip(*found))


class Block:
    """Tokens of some documents as indices into their sorted distinct words and bigrams."""

    def __init__(self, ids: list, texts: list[bytes], modulus: int, held: int):
        h, tokens = word_hashes(texts)
        self.ids, self.tokens = ids, tokens
        self.held = np.array([py_crc_mod(i, modulus) == held for i in ids], bool)
        self.train = np.repeat(~self.held, tokens)
        self.words, at = np.unique(h, return_inverse=True)
        self.word_at = at.astype(np.int32)
        del at
        self.ends = np.cumsum(tokens)
        before = np.concatenate([[START], h[:-1]])
        before[np.concatenate([[0], self.ends[:-1]])] = START
        self.first = np.zeros(len(h), bool)
        self.first[np.concatenate([[0], self.ends[:-1]])] = True
        self.pair_hash = _mix(before * np.uint64(0xD6E8FEB86659FD93) + h)
        self.check = zlib.crc32(self.words.tobytes(), len(ids))

    def counts(self, at: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(at[self.train], minlength=n).astype(np.uint32)

    def contexts(self, totals: np.ndarray, starts: int) -> np.ndarray:
        """Training count of the context of every token."""
        back = np.concatenate([[0], totals[self.word_at[:-1]]])
        back[self.first] = starts
        return back


class Automaton:
    """The part of the model that a block's texts can reach, as states with arcs and failure arcs.

    States are the words of the block, ``start`` and ``empty``.  Arcs are sorted by (state, word); ``fail_to`` and
    ``fail_weight`` belong to states, and ``empty`` takes every word w with ``base[w]``, so a traversal always ends there.
    """

    def __init__(self, block: Block, count: np.ndarray, pairs: np.ndarray, starts: int, unigram: np.ndarray, continues: np.ndarray):
        """``count`` and ``pairs``: training counts of the block's sorted distinct words and bigrams."""
        n = len(block.words)
        self.start, self.empty, self.words = n, n + 1, n
        context = np.append(count, [starts, 0])
        share = continues[_class_of(context)]
        self.base = np.log10(unigram)
        self.fail_to = np.full(n + 2, self.empty, np.int32)
        self.fail_weight = np.where(context > 0, np.log10(1 - share), 0.0)
        self.next = np.where(count > 0, np.arange(n), self.empty).astype(np.int32)    # the state after a word
        at = np.unique(block.pair_hash, return_index=True)[1][pairs > 0]
        pairs = pairs[pairs > 0]
        state = np.where(block.first[at], self.start, block.word_at[at - 1])
        word = block.word_at[at]
        weight = np.log10(share[state] * pairs / context[state] + (1 - share[state]) * unigram[word])
        key = state.astype(np.int64) * n + word
        order = np.argsort(key)
        # a last arc that no state has, so that every search ends on an arc
        self.arc, self.arc_weight = np.append(key[order], np.int64(1) << 62), np.append(weight[order], 0.0)

    def run(self, word_at: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Summed weights of texts given as words of the block, ``tokens`` of them each, one after the other."""
        order = np.argsort(-tokens, kind="stable")
        at, left = (np.cumsum(tokens) - tokens)[order], np.sort(tokens)    # longest first; texts that end leave the front part
        state, total = np.full(len(tokens), self.start, np.int64), np.zeros(len(tokens))
        for step in range(int(tokens.max(initial=0))):
            n = len(left) - int(np.searchsorted(left, step, "right"))
            word = word_at[at[:n] + step]
            self._step(state[:n], word, total[:n])
            state[:n] = self.next[word]
        out = np.empty(len(tokens))
        out[order] = total
        return out

    def _step(self, state: np.ndarray, word: np.ndarray, total: np.ndarray) -> None:
        """Adds the weight of one word per text: along failure arcs until a state has an arc for it."""
        key = state * self.words + word
        arc = np.searchsorted(self.arc, key)
        found = self.arc[arc] == key
        total += np.where(found, self.arc_weight[arc], 0.0)
        missed = np.flatnonzero(~found)
        if len(missed):
            state, word = state[missed], word[missed]
            total[missed] += np.where(state == self.empty, self.base[word], self.fail_weight[state])
            on = np.flatnonzero(state != self.empty)
            if len(on):
                rest = np.zeros(len(on))
                self._step(self.fail_to[state[on]].astype(np.int64), word[on], rest)
                total[missed[on]] += rest


def _class_of(count: np.ndarray) -> np.ndarray:
    return np.minimum(CLASSES - 1, np.log2(np.maximum(count, 1)) * STEPS).astype(np.uint8)


def _blocks(batches, modulus: int, held: int):
    """(block number, Block) of one scan partition; the same cuts in every pass."""
    part = TaskContext.get().partitionId()
    ids, texts, size, k = [], [], 0, 0
    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), bytes_of(b.column("text"))):
            ids.append(i)
            texts.append(t)
            size += len(t) + 1
            if size >= BLOCK_BYTES:
                yield part << 24 | k, Block(ids, texts, modulus, held)
                ids, texts, size, k = [], [], 0, k + 1
    if ids:
        yield part << 24 | k, Block(ids, texts, modulus, held)


def _asked(block: int, check: int, keys: np.ndarray, counts: np.ndarray, classes, parts: int) -> pa.RecordBatch:
    """One row per hash partition: the slices of sorted ``keys`` between equal cuts of the hash range."""
    cuts = np.searchsorted(keys, (np.arange(1, parts, dtype=np.float64) / parts * 2.0 ** 64).astype(np.uint64))
    at = np.concatenate([[0], cuts, [len(keys)]])
    cols = [[pack(x[a:b]) for a, b in zip(at, at[1:])] for x, pack in
            ((keys, np.ndarray.tobytes), (counts, _pack), (classes, np.ndarray.tobytes))]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(parts), pa.int32()), pa.array([block] * parts, pa.int64()), pa.array([check] * parts, pa.int64()),
         *[pa.array(c, pa.binary()) for c in cols]], names=["part", "block", "check", "keys", "counts", "classes"])


def _totals(with_classes: bool):
    """Adds the counts of equal keys over all blocks of a hash partition; answers every block in its own order."""
    def run(key, table):
        keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        sizes = [len(k) for k in keys]
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([_unpack(x) for x in table.column("counts").to_pylist()])
        total = np.bincount(at, counts, minlength=len(known)).astype(np.int64)
        stats = b""
        if with_classes:    # per class of context counts: bigrams, and bigrams seen once
            of = np.zeros(len(known), np.uint8)
            of[at] = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("classes").to_pylist()])
            stats = np.stack([np.bincount(of, total, CLASSES), np.bincount(of[total == 1], minlength=CLASSES)]).tobytes()
        else:               # tokens and distinct words in training
            stats = np.array([total.sum(), (total > 0).sum()], np.float64).tobytes()
        cut = np.cumsum(sizes)[:-1]
        answers = [_pack(t) for t in np.split(total[at], cut)]
        n = len(answers)
        return pa.table({"block": table.column("block"), "part": table.column("part"), "check": table.column("check"),
                         "totals": pa.array(answers, pa.binary()), "stats": pa.array([stats] + [b""] * (n - 1), pa.binary())})
    return run


def _pack(x: np.ndarray) -> bytes:
    """Counts in the narrowest of 1, 2, 4 or 8 bytes, with the width in front."""
    top = int(x.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def _answers(folder: str, block: int, check: int) -> np.ndarray:
    """Totals of a block's sorted keys, from its directory."""
    fs, path = open_folder(f"{folder}/block={block}")
    found = fs.get_file_info(FileSelector(path, allow_not_found=True))
    tables = [pq.read_table(f.path, filesystem=fs, columns=["part", "check", "totals"], partitioning=None)
              for f in found if f.path.endswith(".parquet")]
    table = pa.concat_tables(tables).sort_by("part") if tables else None
    if table is None or set(table.column("check").to_pylist()) != {check}:
        raise RuntimeError("the input's partitions changed between two passes; write the documents to a table first")
    return np.concatenate([_unpack(x) for x in table.column("totals").to_pylist()])


def score_texts(docs: DataFrame, modulus: int = 5, held: int = 1, id_col: str = "doc_id", text_col: str = "text",
                parts: int | None = None) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    Learns from all texts whose crc32(doc_id as text) mod ``modulus`` is not
    ``held``.  Tokens are lower-cased words and one end per text; null counts as
    empty text, a single end.  ``docs`` must scan the same partitions in every pass
    (a table, not a shuffle); a change is noticed and refused.  Without training rows
    every token is unknown and base_score is 0 per token.  Repeated rows repeat.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    trained = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus != held
    size = rows.agg(F.count_if(trained).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    starts = size["n"]
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    n = parts or max(least, size["b"] // PART_BYTES + 1)
    folder = scratch_path(spark, "lm")

    def ask_words(batches):
        for block, b in _blocks(batches, modulus, held):
            yield _asked(block, b.check, b.words, b.counts(b.word_at, len(b.words)), np.zeros(0, np.uint8), n)

    def answered(asked: DataFrame, name: str, with_classes: bool, width: int) -> np.ndarray:
        """Writes the answers, one directory per block; returns the summed statistics of the partitions."""
        (asked.groupBy("part").applyInArrow(_totals(with_classes), _ANSWER).repartition(n, "block")
         .write.partitionBy("block").parquet(f"{folder}/{name}"))
        stats = spark.read.schema(f"{_ANSWER}").parquet(f"{folder}/{name}").select("stats")
        return _summed(stats.filter(F.octet_length("stats") > 0), width)

    total, distinct = answered(rows.mapInArrow(ask_words, _ASK), "words", False, 2)

    def ask_pairs(batches):
        for block, b in _blocks(batches, modulus, held):
            context = b.contexts(_answers(f"{folder}/words", block, b.check), starts)
            keys, first, at = np.unique(b.pair_hash, return_index=True, return_inverse=True)
            yield _asked(block, b.check, keys, b.counts(at, len(keys)), _class_of(context[first]), n)

    sums = answered(rows.mapInArrow(ask_pairs, _ASK), "pairs", True, 2 * CLASSES)
    seen, once = sums[:CLASSES], sums[CLASSES:]
    # every context keeps some mass for either side, also where all or none of its class repeats
    continues = np.clip(1 - (once + 0.5) / (seen + 1), 1e-4, 1 - 1e-4)

    def run(batches):
        for block, b in _blocks(batches, modulus, held):
            count = _answers(f"{folder}/words", block, b.check)
            unigram = (count + 0.5) / (total + 0.5 * (distinct + 1))
            model = Automaton(b, count, _answers(f"{folder}/pairs", block, b.check), starts, unigram, continues)
            known, base = count[b.word_at], model.base[b.word_at]
            begin = b.ends - b.tokens
            add = lambda x: np.add.reduceat(x, begin)
            cols = [pa.array(b.ids, pa.int64()), pa.array(b.held), pa.array(b.tokens, pa.int64()), pa.array(add((known > 0).astype(np.int64))),
                    pa.array(np.full(len(b.ids), int(total))), pa.array(add(base)), pa.array(model.run(b.word_at, b.tokens))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                "base_score double, score double")


def _summed(stats: DataFrame, width: int) -> np.ndarray:
    """Sum of small statistic arrays, one per hash partition."""
    def run(batches):
        out = np.zeros(width)
        for b in batches:
            for x in b.column("stats").to_pylist():
                out += np.frombuffer(x, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(out)], names=["k", "v"])
    found = stats.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width)
    for r in found:
        out[r["k"]] = r["v"]
    return out
