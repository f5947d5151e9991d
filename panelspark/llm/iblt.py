"""Document fingerprints as invertible Bloom lookup sketches.

A text is a multiset of paragraphs: its lines, cut further after sentence ends, and after
128 to 256 bytes where a hash of the last eight bytes is small (a text's first paragraph
sooner, from 8 to 16 bytes and then in doubled steps).  Every cut depends on the bytes
before it only, so an unchanged beginning of a text gives the same paragraphs, the last
one excepted, whatever follows.  Every paragraph's digest (with the number of its repetition, so repeats differ) is added to
one cell in each of three hash tables; a cell holds a count, the exclusive-or of its
digests and of their check values.  Subtracting two sketches cancels what the texts
share.  Peeling then recovers the digests that only one of them has: a
cell with a count of one and a fitting check value gives up its digest, which is
removed from its other cells.  If peeling gets stuck, both sketches are made again,
four times as large, until it succeeds.

The order of documents is found without moving a text more than once: cut points of
the id deal the documents to slots, and the first document of every slot is also sent
to the slot before, as the successor of that slot's last document.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import id_and_text, texts_of

CELLS = 24            # of the stored fingerprint; a multiple of three
_GROWTH = 4
_FIRST, _LONG = 8, 128    # bytes after which the first piece of a text and any other piece may end; it ends at twice as many
_MASK = (1 << 64) - 1
_SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)    # one odd multiplier per table


def _pieces(unit: bytes, least: int) -> list[bytes]:
    """A long paragraph in pieces of ``least`` to ``2 * least`` bytes; ``least`` doubles up to ``_LONG``."""
    out, at, n = [], 0, len(unit)
    # of the eight bytes from every place on
    mixed = np.ndarray(n - 7, "<u8", unit, strides=(1,)) * np.uint64(_SPREAD[0])
    while n - at > least:
        small = mixed[at + least - 8:at + 2 * least - 8] < np.uint64((1 << 65) // least)    # two in ``least``
        k = int(small.argmax())
        end = at + least + k if small[k] else at + 2 * least
        if end >= n:
            break
        out.append(unit[at:end])
        at, least = end, min(2 * least, _LONG)
    out.append(unit[at:])
    return out


def digests(text: str) -> list[int]:
    """64-bit digests of the paragraphs of a text, repeats told apart by their number."""
    import xxhash
    hashed, times, out, least = xxhash.xxh64_intdigest, {}, [], _FIRST
    for unit in text.replace(". ", ".\n").encode().split(b"\n"):
        if unit:
            for piece in _pieces(unit, least) if len(unit) > least else (unit,):
                k = times.get(piece, 0)
                times[piece] = k + 1
                out.append(hashed(piece, k))
            least = _LONG
    return out


def _check(digest: int) -> int:
    return (digest * 0xD6E8FEB86659FD93 & _MASK) >> 32


def _places(digest: int, third: int) -> tuple[int, int, int]:
    """The digest's cell in each of the three tables."""
    a, b, c = _SPREAD
    return (((digest * a & _MASK) >> 32) * third >> 32, third + (((digest * b & _MASK) >> 32) * third >> 32),
            2 * third + (((digest * c & _MASK) >> 32) * third >> 32))


class Sketch:
    """Counts, digest sums and check sums of ``cells`` cells."""

    def __init__(self, items: list[int], cells: int = CELLS):
        third = cells // 3
        self.counts, self.keys, self.checks = [0] * cells, [0] * cells, [0] * cells
        counts, keys, checks = self.counts, self.keys, self.checks
        for d in items:
            c = _check(d)
            for p in _places(d, third):
                counts[p] += 1
                keys[p] ^= d
                checks[p] ^= c

    def text(self) -> str:
        """The sketch in base 64: 32-bit counts, 64-bit digest sums, 32-bit check sums, little-endian."""
        return base64.b64encode(np.array(self.counts, "<u4").tobytes() + np.array(self.keys, "<u8").tobytes()
                                + np.array(self.checks, "<u4").tobytes()).decode()

    def differences(self, other: Sketch) -> tuple[list[int], list[int]] | None:
        """Digests that only this sketch has and that only the other has; None where peeling gets stuck."""
        counts = [a - b for a, b in zip(self.counts, other.counts)]
        keys = [a ^ b for a, b in zip(self.keys, other.keys)]
        checks = [a ^ b for a, b in zip(self.checks, other.checks)]
        third, mine, theirs = len(counts) // 3, [], []
        pure = [p for p, n in enumerate(counts) if n in (1, -1)]
        while pure:
            p = pure.pop()
            n, d = counts[p], keys[p]
            if n not in (1, -1) or checks[p] != _check(d):
                continue
            (mine if n == 1 else theirs).append(d)
            c = checks[p]
            for q in _places(d, third):
                counts[q] -= n
                keys[q] ^= d
                checks[q] ^= c
                if counts[q] in (1, -1):
                    pure.append(q)
        return None if any(counts) or any(keys) else (mine, theirs)


class Document:
    """A text's digests and its sketches, made when a size is first asked for."""

    def __init__(self, text: str):
        self.text, self.items, self.made = text, digests(text), {}

    def sketch(self, cells: int = CELLS) -> Sketch:
        if cells not in self.made:
            self.made[cells] = Sketch(self.items, cells)
        return self.made[cells]


def recover(a: Document, b: Document, cells: int = CELLS) -> tuple[list[int], list[int]]:
    """Paragraph digests only in ``a`` and only in ``b``, retrying with larger sketches.

    The sizes end where every digest of both has a cell many times over; two digests
    that share all three cells there are told apart by comparing the digests directly.
    """
    while True:
        found = a.sketch(cells).differences(b.sketch(cells))
        if found is not None:
            return found
        if cells > 64 * (len(a.items) + len(b.items)):
            return sorted(set(a.items) - set(b.items)), sorted(set(b.items) - set(a.items))
        cells *= _GROWTH


def likeness(a: Document, b: Document) -> float:
    """Shared paragraphs over all paragraphs of both, from the recovered differences; 1 for two empty texts."""
    mine, theirs = recover(a, b)
    every = len(a.items) + len(theirs)
    return (len(a.items) - len(mine)) / every if every else 1.0


def _rows(run: list) -> list:
    """Result rows of consecutive documents; the last one only is the successor of the one before."""
    out = []
    for (doc_id, here), (_, after) in zip(run, run[1:]):
        text, n = here.text, len(here.text)
        edited = Document(text[:n - n // 2] + after.text[:n // 2])
        out.append((doc_id, n, hashlib.sha256(edited.text.encode()).hexdigest(), here.sketch().text(), edited.sketch().text(),
                    likeness(here, edited), likeness(here, after)))
    return out


_RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _pairs(batches):
    """Every document with its successor.  Rows are sorted by slot, own rows before the successor of the slot."""
    held, slot, done = None, None, False
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    names = [x.split()[0] for x in _RESULT.split(", ")]
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part, out = b.slice(at, 512), []
            columns = [part.column(c).to_pylist() for c in ("slot", "successor", "doc_id")]
            for s, after, doc_id, text in zip(*columns, texts_of(part.column("text"))):
                if s != slot:
                    held, slot, done = None, s, False
                if done:
                    continue    # equal ids may send several successors; the first one counts
                now = (doc_id, Document(text))
                if held:
                    out += _rows([held, now])
                held, done = now, after
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next text's.

    Documents follow each other by descending id (null ids last, equal ids by text
    hash), the first one after the last.  The edited text replaces the last
    half of the code points by the first as many, or all, of the next text.  Null
    counts as empty text.  A single document is its own successor.  An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    wanted = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    cuts = rows.agg(F.percentile_approx("doc_id", [k / wanted for k in range(1, wanted)], 10 * wanted).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))    # at most one per slot

    @F.pandas_udf("int")
    def slot_of(ids: pd.Series) -> pd.Series:
        """Slot 0 has the highest ids; null ids are in the last slot."""
        found = [len(cuts) if i is None or i != i else len(cuts) - bisect_left(cuts, i) for i in ids.astype(object)]
        return pd.Series(found, dtype="int32")

    # the first id of every slot that has documents, and the slot before it: at most one row per slot
    firsts = (rows.select("doc_id", slot_of("doc_id").alias("slot")).groupBy("slot")
              .agg(F.max("doc_id").alias("id")).orderBy("slot").collect())
    before = {r["slot"]: (firsts[k - 1]["slot"], r["id"]) for k, r in enumerate(firsts)}

    def deal(batches):
        """Rows with their slot; the first rows of a slot once more, as successors, for the slot before."""
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            own = [len(cuts) if i is None else len(cuts) - bisect_left(cuts, i) for i in ids]
            again = [k for k, (i, s) in enumerate(zip(ids, own)) if before[s][1] == i]
            take = pa.array([*range(len(ids)), *again], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(own + [before[own[k]][0] for k in again], pa.int32()),
                 pa.array([False] * len(ids) + [True] * len(again)), b.column("doc_id").take(take), b.column("text").take(take)],
                names=["slot", "successor", "doc_id", "text"])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = rows.mapInArrow(deal, "slot int, successor boolean, doc_id long, text string")
    return (dealt.repartition(n, "slot")
            .sortWithinPartitions("slot", "successor", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
            .mapInArrow(_pairs, _RESULT))
