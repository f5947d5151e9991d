"""Benchmark passages in documents, found by the q-gram lemma.

Texts are compared as folded bytes: a-z and other scripts kept, everything else one
space.  Every benchmark item is cut into windows of ``WINDOW`` bytes, half overlapping,
and of ``SHORT`` bytes, one every ``STEP`` (a shorter item is one window).  The short ones
find a passage from anywhere inside an item: ``SHORT + STEP - 1`` bytes in common always
hold a whole one; the long ones allow more edits in one place.  A window of m bytes that occurs with at most k
edits shares at least m + 1 - q - kq of its q-grams with the stretch it occurs in, on
diagonals at most k apart.  So:

1. positions of a document whose q-gram occurs in any item are marked by one table
   look-up each; hits too few for every window size in any stretch of that size are left out;
2. in what is left, shared q-grams are counted per item and band of ``2k + 1``
   diagonals, every band overlapping the next by half; where an item's band meets the
   bound of some window, they are counted again per window, and bands that meet the
   window's own bound are kept;
3. kept bands are verified by edit distance inside the band, many bands at a time.

Items are indexed apart by length, so a short item with a low bound does not weaken the
bounds of the others.

The benchmark is a stated query set.  It is read in blocks of bounded size, each held
against all documents, so a large benchmark takes more passes and no more memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bytes_of, id_and_text

Q = 8
WINDOW = 96
SHORT, STEP = 64, 8
ERRORS = 0.08                # edits per byte of a window
BLOCK_BYTES = 1 << 20        # benchmark text held by a task at once
PAIRS = 1 << 18              # shared q-grams (place in the text, place in an item) held at once
VERIFY = 1 << 13             # bands verified at once
_BITS = 22
_ORIGINS = 64                # diagonals of a band fit below this
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def fold(text: bytes) -> bytes:
    return b" ".join(text.translate(_FOLD).split())


def grams(text: bytes) -> np.ndarray:
    """The Q bytes at every position as one integer."""
    n = len(text) - Q + 1
    return np.ndarray((n,), "<u8", text, 0, (1,)) if n > 0 else np.zeros(0, np.uint64)


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)


def edits_allowed(size: int) -> int:
    return int(ERRORS * size)


def least_shared(size: int) -> int:
    """The q-gram lemma's bound for a window of ``size`` bytes."""
    return size + 1 - Q - edits_allowed(size) * Q


def _windows(folded: bytes) -> list[tuple[int, bytes]]:
    """Places and bytes of the windows of an item, its end included."""
    out = set()
    for size, step in ((WINDOW, WINDOW // 2), (SHORT, STEP)):
        last = max(0, len(folded) - size)
        out |= {(at, folded[at:at + size]) for at in (*range(0, last, step), last)}
    return sorted(out)


def _repeat(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indices low to low + n - 1 of every entry, one after the other."""
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def _in_bands(key: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the key of every row, and whether a key and its next one meet the bound, from the left and from the right.

    A key is a strip of diagonals; a strip and the next one make a band.
    """
    keys, at, count = np.unique(key, return_inverse=True, return_counts=True)
    follows = np.append(keys[1:] == keys[:-1] + 1, False)
    meets = count + np.where(follows, np.append(count[1:], 0), 0) >= bound[keys]
    return keys, at, meets, np.append(False, meets[:-1] & follows[:-1])


class _Bounds:
    """``bound[key]`` for keys of the form owner * many + strip."""

    def __init__(self, bounds: np.ndarray, many: int):
        self.bounds, self.many = bounds, many

    def __getitem__(self, key: np.ndarray) -> np.ndarray:
        return self.bounds[key // self.many]


class _Index:
    """q-grams of some items, and which windows each belongs to."""

    def __init__(self, items: list[tuple[bytes, list[tuple[int, int, int]]]]):
        """Per item its folded text and (number, place, size) of its windows."""
        code = [grams(text) for text, _ in items]
        item = np.repeat(np.arange(len(items)), [len(c) for c in code])
        place = np.concatenate([np.arange(len(c)) for c in code])
        code = np.concatenate(code)
        first = np.concatenate([[0], np.cumsum([len(t) + 1 - Q for t, _ in items])])
        self.number, self.size = (np.array([w[k] for _, ws in items for w in ws], np.int64) for k in (0, 2))
        # windows of every q-gram of an item, in order of the q-grams
        many = self.size + 1 - Q
        gram = _repeat(np.array([first[i] + w[1] for i, (_, ws) in enumerate(items) for w in ws], np.int64), many)
        owner = np.repeat(np.arange(len(self.size), dtype=np.int32), many)
        self.owner = owner[np.argsort(gram, kind="stable")]
        owners = np.bincount(gram, minlength=len(code))
        low = np.cumsum(owners) - owners
        order = np.argsort(code, kind="stable")
        self.code, self.item, self.place = code[order], item[order], place[order]
        self.low, self.owners = low[order], owners[order]
        self.marks = np.zeros(1 << _BITS, bool)
        self.marks[_slot(self.code)] = True
        self.allowed = np.array([edits_allowed(s) for s in self.size], np.int64)
        self.bounds = np.array([least_shared(s) for s in self.size], np.int64)
        of = np.repeat(np.arange(len(items)), [len(ws) for _, ws in items])
        self.item_bounds = np.full(len(items), 1 << 30, np.int64)
        np.minimum.at(self.item_bounds, of, self.bounds)
        self.item_allowed = np.zeros(len(items), np.int64)
        np.maximum.at(self.item_allowed, of, self.allowed)
        self.classes = sorted({(least_shared(s), s + edits_allowed(s)) for s in self.size.tolist()})
        self.span = max(s for _, s in self.classes)

    def bands(self, g: np.ndarray) -> set[tuple[int, int]]:
        """(window, strip) of bands of a text's q-grams that meet the window's bound."""
        hit = np.flatnonzero(self.marks[_slot(g)])
        # a hit stays if, for some window size, a stretch of that size holds it and enough hits
        cover = np.zeros(len(hit) + 1, np.int32)
        for bound, span in self.classes:
            if len(hit) >= bound:
                near = np.flatnonzero(hit[bound - 1:] - hit[:len(hit) - bound + 1] < span)
                cover[near] += 1
                cover[near + bound] -= 1
        hit = hit[np.cumsum(cover[:-1]) > 0]
        if not len(hit):
            return set()
        low = np.searchsorted(self.code, g[hit])
        n = np.searchsorted(self.code, g[hit], "right") - low
        out, total, at = set(), np.cumsum(n), 0
        while at < len(hit):    # pieces overlap by more than any window, so memory follows a piece
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            stop = int(np.searchsorted(hit, hit[end - 1] + 2 * self.span))
            out |= self._piece(hit[at:stop], low[at:stop], n[at:stop])
            at = end
        return out

    def _piece(self, hit: np.ndarray, low: np.ndarray, n: np.ndarray) -> set[tuple[int, int]]:
        entry, h = _repeat(low, n), np.repeat(hit, n)
        if not len(entry):
            return set()
        diagonal, item = h - self.place[entry], self.item[entry]
        strip = diagonal // (self.item_allowed[item] + 1)
        first, many = int(strip.min()), int(strip.max() - strip.min()) + 2
        _, at, left, right = _in_bands(item * many + strip - first, _Bounds(self.item_bounds, many))
        kept = (left | right)[at]
        if not kept.any():
            return set()
        entry, diagonal = entry[kept], diagonal[kept]
        each = self.owners[entry]
        window, diagonal = self.owner[_repeat(self.low[entry], each)].astype(np.int64), np.repeat(diagonal, each)
        strip = diagonal // (self.allowed[window] + 1)
        first, many = int(strip.min()), int(strip.max() - strip.min()) + 2
        # the band that starts one strip earlier holds the same q-grams as a strip whose predecessor is empty
        keys, _, meets, _ = _in_bands(window * many + strip - first, _Bounds(self.bounds, many))
        keys = keys[meets]
        return set(zip((keys // many).tolist(), (keys % many + first).tolist()))


class Benchmark:
    """Windows of the items of one block, ``(item, place in the item, bytes)``, and indexes of their q-grams by length of the item."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.windows: list[tuple[int, int, bytes]] = []
        by_length: dict = {}
        for item, text in items:
            folded, mine = fold(text), []
            for at, w in _windows(folded):
                if len(w) >= 2 * Q and least_shared(len(w)) >= 1:    # else too short to tell from chance
                    mine.append((len(self.windows), at, len(w)))
                    self.windows.append((item, at, w))
            if mine:
                by_length.setdefault(min(len(folded), SHORT).bit_length(), []).append((folded, mine))
        self.indexes = [_Index(group) for _, group in sorted(by_length.items())]

    def find(self, text: bytes) -> list[tuple[int, int, int, int, int]]:
        """(item, place in the item, begin, end, edits) of windows that occur in a folded text."""
        return self.find_all([text])[0]

    def find_all(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int, int]]]:
        """``find`` of many folded texts, whose bands are verified together."""
        found: list[list] = [[] for _ in texts]    # (window, strip, begin, end, edits)
        waiting: dict = {}                         # by window size: (text, window, strip, begin, stretch of the text)

        def verify(size: int) -> None:
            todo = waiting.pop(size)
            patterns = [self.windows[w][2] for _, w, _, _, _ in todo]
            for (t, w, b, begin, _), edits, origin, end in zip(todo, *banded(patterns, [r[4] for r in todo], edits_allowed(size))):
                if edits <= edits_allowed(size):
                    found[t].append((w, b, max(0, begin + origin), min(begin + size + end, len(texts[t])), edits))

        for t, text in enumerate(texts):
            g = grams(text)
            for index in self.indexes:
                for own, b in index.bands(g):
                    w = int(index.number[own])
                    _, place, pattern = self.windows[w]
                    size, k = len(pattern), int(index.allowed[own])
                    begin = place + (b - 1) * (k + 1)    # diagonals are those of the item
                    exact = text.find(pattern, max(0, begin), max(0, begin) + size + 3 * (k + 1))
                    if exact >= 0:
                        found[t].append((w, b, exact, exact + size, 0))
                        continue
                    begin -= k
                    stop = begin + band_width(k) + size
                    stretch = text[max(0, begin):max(0, stop)]
                    stretch = bytes(min(max(0, -begin), stop - begin)) + stretch
                    waiting.setdefault(size, []).append((t, w, b, begin, stretch.ljust(stop - begin, b"\0")))
                    if len(waiting[size]) == VERIFY:
                        verify(size)
        for size in list(waiting):
            verify(size)
        return [self._distinct(rows) for rows in found]

    def _distinct(self, rows: list) -> list[tuple[int, int, int, int, int]]:
        out, done = set(), set()
        for w, b, begin, end, edits in sorted(rows):
            if (w, b - 1) not in done:    # else found in the band that overlaps this one
                done.add((w, b))
                out.add((*self.windows[w][:2], begin, end, edits))
        return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def band_width(allowed: int) -> int:
    """Diagonals of a band of three strips with room for the edits on either side."""
    return 3 * (allowed + 1) + 2 * allowed + 1


def banded(patterns: list[bytes], stretches: list[bytes], allowed: int) -> tuple[list, list, list]:
    """Fewest edits, and diagonals of begin and end, of patterns of one length inside their bands.

    A stretch is the text below a band: diagonal d starts at its byte d; bytes outside the text are zero and match
    nothing.  Row i of the alignment holds, per diagonal, the cost of matching the first i bytes so that they end there,
    with the diagonal they began on packed below it; a match may begin on any diagonal.  Bands are columns, so a row
    is worked out for all of them at once, and columns that can no longer succeed are left out every 16 rows.
    """
    m, width, n = len(patterns[0]), band_width(allowed), len(patterns)
    p = np.frombuffer(b"".join(patterns), np.uint8).reshape(n, m).T.copy()
    t = np.frombuffer(b"".join(stretches), np.uint8).reshape(n, m + width).T.copy()
    one = np.int32(_ORIGINS)
    ramp = (np.arange(width, dtype=np.int32) * one)[:, None]
    state = np.repeat(np.arange(width, dtype=np.int32)[:, None], n, 1)
    alive = np.arange(n)
    edits, origin, last = np.full(n, allowed + 1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(m):
        new = state + (t[i:i + width] != p[i]) * one                      # matched or replaced
        np.minimum(new[:-1], state[1:] + one, out=new[:-1])               # missing from the text
        state = np.minimum.accumulate(new - ramp, axis=0) + ramp          # extra in the text
        if i % 16 == 15:
            keep = state.min(0) < (allowed + 1) * one
            if not keep.all():
                state, t, p, alive = state[:, keep], t[:, keep], p[:, keep], alive[keep]
                if not len(alive):
                    break
    if len(alive):
        end = (state // one).argmin(0)
        best = state[end, np.arange(len(alive))]
        edits[alive], origin[alive], last[alive] = best // one, best % one, end
    return edits.tolist(), origin.tolist(), last.tolist()


def _blocks_of(benchmark: DataFrame, item_col: str, text_col: str):
    """Benchmark items in blocks of bounded size, as broadcasts."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    blocks = size // BLOCK_BYTES + 1
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield spark.sparkContext.broadcast(sorted(((r["item"], r["text"].encode()) for r in part.distinct().collect()),
                                                  key=lambda r: (r[0] is not None, r)))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that share a passage.

    doc_id, item_id, windows (windows of the item found), edits (fewest of any), begin
    and end (bytes of the folded text from the first to the last found window) and
    passage, that stretch.  Null and empty texts on either side match nothing; items
    of less than two q-grams of folded text, or too short for the bound, cannot be
    told from chance and match nothing.  Repeated documents repeat.
    """
    rows, out = id_and_text(docs, id_col, text_col), None
    for block in _blocks_of(benchmark, item_col, item_text_col):
        def run(batches, block=block):
            index = Benchmark(block.value)
            names = ["doc_id", "item_id", "windows", "edits", "begin", "end", "passage"]
            for b in batches:
                found = []
                texts = [fold(t) for t in bytes_of(b.column("text"))]
                for doc_id, folded, hits in zip(b.column("doc_id").to_pylist(), texts, index.find_all(texts)):
                    by_item: dict = {}
                    for item, at, begin, end, edits in hits:
                        by_item.setdefault(item, []).append((at, begin, end, edits))
                    for item, hits in by_item.items():
                        begin, end = min(h[1] for h in hits), max(h[2] for h in hits)
                        found.append((doc_id, item, len({h[0] for h in hits}), min(h[3] for h in hits), begin, end,
                                      folded[begin:end].decode("utf-8", "replace")))
                cols = list(zip(*found)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 6 else pa.int64()) for k, c in enumerate(cols)], names=names)
        part = rows.mapInArrow(run, "doc_id long, item_id long, windows long, edits long, begin long, end long, passage string")
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that share no passage with any benchmark item."""
    for block in _blocks_of(benchmark, item_col, item_text_col):
        def run(batches, block=block):
            index = Benchmark(block.value)
            for b in batches:
                texts = [fold(t) for t in bytes_of(b.column(b.schema.get_field_index(text_col)))]
                yield b.filter(pa.array([not found for found in index.find_all(texts)], pa.bool_()))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
