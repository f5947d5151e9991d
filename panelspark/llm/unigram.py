"""SentencePiece-style unigram encoding and decoding.

The pieces come from a sentencepiece model file with byte fallback; the file is
only read for its pieces.  A file made for byte-pair merging stores ranks instead of
log probabilities, so the log score of a piece follows Zipf's law over its rank,
``-ln(rank + 1)`` minus the log of the normaliser.  A double-array trie over UTF-8
bytes finds all pieces that start at a position, and Viterbi keeps the best-scored
segmentation.  A character no piece covers becomes its UTF-8 bytes.

Spaces become the marker U+2581 and one marker is put in front of the text.  No piece
has a marker after another character, so a text may be cut in front of every marker
that follows a visible character and its words segmented, and remembered, apart.  The
new words of a few texts go through trie and Viterbi together, one array step per byte
of the longest; long stretches without a space, which hardly repeat, go one by one.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import id_and_text, texts_of, worker_cache

MARK = "▁"
UNKNOWN_PENALTY = 10.0    # below the lowest piece score, as in the published algorithm
WORD_LIMIT = 1_000_000      # words remembered per worker
LONGEST = 64                # longer words hardly repeat and are not remembered
TOGETHER = 1 << 17          # characters of texts whose words are looked up together
WORDS_TOGETHER = 1024       # words segmented together: few enough for the arrays to stay in the processor's cache


class DoubleArray:
    """Trie over bytes in two integer arrays: child of state s on byte c is base[s] + c + 1 where check says s."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for value, key in enumerate(keys):
            s = 0
            for c in key:
                t = children[s].get(c)
                if t is None:
                    t = children[s][c] = len(children)
                    children.append({})
                s = t
            ends[s] = value
        size = 2 * len(children) + 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0], place, begin = -2, {0: 0}, 1
        for s, kids in enumerate(children):
            at = place[s]
            value[at] = ends.get(s, -1)
            if not kids:
                continue
            codes = [c + 1 for c in kids]
            b, tried, begun = max(1, begin - min(codes)), 0, begin
            while True:
                if b + 257 >= len(check):
                    grow = len(check)
                    base += [0] * grow
                    check += [-1] * grow
                    value += [-1] * grow
                for c in codes:
                    if check[b + c] != -1:
                        break
                else:
                    break
                b += 1
                tried += 1
            if tried > 50:    # the stretch behind is nearly full: later searches start further on
                begin = begun + tried // 2
            base[at] = b
            for c, t in kids.items():
                check[b + c + 1] = at
                place[t] = b + c + 1
        self.base, self.check, self.value = array("i", base), array("i", check), array("i", value)


class Unigram:
    """Encoder and decoder over the pieces of one model file."""

    def __init__(self, file: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=file)
        size = sp.vocab_size()
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        if len(self.byte_ids) != 256:
            raise ValueError(f"{file} has no byte fallback")
        self.byte_of = {i: v for v, i in self.byte_ids.items()}
        self.silent = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.spelled = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.silent else p.encode()
                        for i, p in enumerate(self.pieces)]
        total = math.log(sum(1 / (r + 1) for r in range(len(normal))))
        self.score = {i: -math.log(r + 1) - total for r, i in enumerate(normal)}
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY
        self.trie = DoubleArray([self.pieces[i].encode() for i in normal])
        self.normal = normal
        self.arrays = [np.frombuffer(a, np.int32) for a in (self.trie.base, self.trie.check, self.trie.value)]
        # by place in the trie; the last place stands for a character no piece covers
        self.piece_of = np.array([*normal, -1], np.int32)
        self.score_of = np.array([*(self.score[i] for i in normal), self.unknown])
        self.byte_id = np.array([self.byte_ids[c] for c in range(256)], np.int32)
        cut = all(MARK not in p.lstrip(MARK) for p in (self.pieces[i] for i in normal))
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+") if cut else None
        self.words: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """Best-scored ids of one stretch of text; of equal scores the one whose last piece starts first."""
        raw = text.encode()
        n = len(raw)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        low = -math.inf
        best, start, piece = [low] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0], i = 0.0, 0
        while i < n:
            here, lead = best[i], raw[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            single, s, j = False, 0, i
            while j < n:
                t = base[s] + raw[j] + 1
                if base[s] == 0 or check[t] != s:
                    break
                s = t
                j += 1
                v = value[s]
                if v >= 0:
                    k = self.normal[v]
                    score = here + self.score[k]
                    if score > best[j]:
                        best[j], start[j], piece[j] = score, i, k
                    single |= j - i == width
            if not single and here + self.unknown > best[i + width]:
                best[i + width], start[i + width], piece[i + width] = here + self.unknown, i, -1
            i += width
        out, j = [], n
        while j:
            i = start[j]
            if piece[j] >= 0:
                out.append(piece[j])
            else:
                out += [self.byte_ids[c] for c in reversed(raw[i:j])]
            j = i
        return out[::-1]

    def viterbi_all(self, words: list[str]) -> list[bytes]:
        """``viterbi`` of many short words at once, as little-endian unsigned 32-bit ids of each.

        A word of n bytes has n + 1 nodes in a row.  Paths to a node are tried in the same
        order and with the same sums as one by one, so equal scores fall the same way.
        """
        base, check, value = self.arrays
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw])
        text = np.frombuffer(b"".join(raw), np.uint8)
        first = np.cumsum(size) - size
        of, node0 = np.repeat(np.arange(len(raw)), size), first + np.arange(len(raw))
        end = (first + size)[of]
        begin = np.flatnonzero((text & 0xC0) != 0x80)
        lead = text[begin]
        width = 1 + (lead >= 0xC0) + (lead >= 0xE0).astype(int) + (lead >= 0xF0)
        # all pieces from every character on: places that leave the trie drop out of the walk
        starts, ends, places, single = [], [], [], np.zeros(len(begin), bool)
        at, state, length = np.arange(len(begin)), np.zeros(len(begin), np.int32), 0
        while True:
            inside = (begin[at] + length < end[begin[at]]) & (base[state] != 0)
            at, state = at[inside], state[inside]
            if not len(at):
                break
            to = base[state] + text[begin[at] + length] + 1
            there = check[to] == state
            at, state, length = at[there], to[there], length + 1
            found = value[state] >= 0
            starts.append(begin[at[found]])
            ends.append(starts[-1] + length)
            places.append(value[state[found]])
            single[at[found]] |= width[at[found]] == length
        starts.append(begin[~single])
        ends.append(starts[-1] + width[~single])
        places.append(np.full(len(starts[-1]), len(self.normal), np.int32))
        starts, ends, places = np.concatenate(starts), np.concatenate(ends), np.concatenate(places)
        # arcs in the order of their place in the word; no two arcs of one step reach the same node
        step = (starts - first[of[starts]]).astype(np.int16)
        order = np.argsort(step, kind="stable")
        bounds = np.cumsum(np.bincount(step))
        word = of[starts[order]]
        source, target, place = starts[order] + word, ends[order] + word, places[order]
        score = self.score_of[place]
        nodes = len(text) + len(raw)
        best, back, arc = np.full(nodes, -np.inf), np.zeros(nodes, np.int64), np.zeros(nodes, np.int32)
        best[node0] = 0.0
        for lo, hi in zip([0, *bounds[:-1]], bounds):
            total = best[source[lo:hi]] + score[lo:hi]
            better = lo + np.flatnonzero(total > best[target[lo:hi]])
            best[target[better]] = total[better - lo]
            back[target[better]] = source[better]
            arc[target[better]] = place[better]
        on, node, origin = np.zeros(nodes, bool), node0 + size, node0
        while len(node):
            left = node != origin
            node, origin = node[left], origin[left]
            on[node] = True
            node = back[node]
        node = np.flatnonzero(on)
        owner = np.searchsorted(node0, node, side="right") - 1
        ids = self.piece_of[arc[node]]
        count = np.where(ids < 0, node - back[node], 1)
        if (ids < 0).any():    # unknown characters become the ids of their bytes
            flat = np.repeat(ids, count)
            nth = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
            byte = np.repeat(back[node] - owner, count) + nth
            ids = np.where(flat < 0, self.byte_id[text[byte]], flat)
        data, stop = ids.astype("<u4").tobytes(), (4 * np.cumsum(count)[np.cumsum(np.bincount(owner)) - 1]).tolist()
        return [data[lo:hi] for lo, hi in zip([0, *stop[:-1]], stop)]

    def learn(self, texts: list[list[str]]) -> None:
        """Remembers the short words of some texts that are not known yet."""
        every = set().union(*texts)
        new = every.difference(self.words)
        if len(self.words) + len(new) > WORD_LIMIT:
            self.words.clear()
            new = every
        short = [w for w in new if len(w) <= LONGEST]
        for lo in range(0, len(short), WORDS_TOGETHER):
            part = short[lo:lo + WORDS_TOGETHER]
            self.words.update(zip(part, self.viterbi_all(part)))

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of whole texts, in their order; empty text has none."""
        lo = 0
        while lo < len(texts):
            hi, held = lo, 0
            while hi < len(texts) and held < TOGETHER:
                held += len(texts[hi])
                hi += 1
            marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts[lo:hi]]
            words = [self.cut.findall(m) if self.cut else [m] if m else [] for m in marked]
            self.learn(words)
            known = self.words.get
            for ws in words:
                yield np.frombuffer(b"".join([known(w) or np.array(self.viterbi(w), "<u4").tobytes() for w in ws]), "<u4")
            lo = hi

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; empty text has none."""
        return next(self.encode_all([text]))

    def decode(self, ids) -> str:
        """Text of ids: pieces joined, byte runs read as UTF-8, markers back to spaces, the leading marker dropped.

        Exact for every text without U+2581, which reads back as a space.
        """
        out = b"".join(map(self.spelled.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        text = out.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def _model(file: str) -> Unigram:
    return worker_cache(("unigram", file), lambda: Unigram(file))


def encode_texts(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens and exact (decoding gives the text back) of every whole text.

    Null and empty texts have no ids and read back as empty.  ``exact`` is false only
    for texts with U+2581.  Rows are independent, so repeated rows repeat.
    """
    def run(batches):
        model = _model(file)
        for b in batches:
            for at in range(0, b.num_rows, 512):    # ids of few texts at a time
                part = b.slice(at, 512)
                texts = texts_of(part.column("text"))
                ids = list(model.encode_all(texts))
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array([len(i) for i in ids], pa.int64()),
                     pa.array([model.decode(i) == t for i, t in zip(ids, texts)], pa.bool_())],
                    names=["doc_id", "ids", "n_tokens", "exact"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, exact boolean")


def decode_texts(rows: DataFrame, file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows with ``array<int>`` ids; null counts as no ids."""
    def run(batches):
        model = _model(file)
        for b in batches:
            texts = [model.decode(i or []) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id long, text string")


def encode_and_check(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_tokens, n_byte_tokens, ids_crc32 of its ids, and whether decoding them gives the text back.

    ids_crc32 is over little-endian unsigned 32-bit ids.  Null and empty texts have
    no ids and read back as empty.  ``exact`` is false only for texts with U+2581.
    Rows are independent, so repeated rows repeat.
    """
    def run(batches):
        model = _model(file)
        is_byte = np.zeros(len(model.pieces), bool)
        is_byte[list(model.byte_of)] = True
        for b in batches:
            for at in range(0, b.num_rows, 512):    # texts and ids of few rows at a time
                part = b.slice(at, 512)
                rows, texts = [], texts_of(part.column("text"))
                for t, ids in zip(texts, model.encode_all(texts)):
                    rows.append((len(ids), int(is_byte[ids].sum()), zlib.crc32(ids.tobytes()), model.decode(ids) == t))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array([r[k] for r in rows], pa.bool_() if k == 3 else pa.int64()) for k in range(4)]],
                    names=["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "exact"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, exact boolean")
