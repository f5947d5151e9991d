"""Importance resampling of documents towards a target distribution of hashed word runs.

Features are single words and pairs of neighbouring words; a feature's bucket is
the CRC-32 of its bytes modulo the number of buckets.  No feature is ever written
out.  The distinct words of a block of texts, each between two delimiters, form an
Aho-Corasick automaton whose entries carry the word's CRC and length.  One scan of a
text emits the payloads of its words in order, and the CRC of a pair follows from
two neighbouring payloads: appending n bytes to a string multiplies its CRC by a
fixed 32 x 32 matrix over GF(2).

The automaton belongs to a worker and grows with the words it meets; it starts anew
beyond ``DICTIONARY_BYTES``, so no vocabulary of the whole corpus is gathered,
broadcast or cut.  Words above ``LONGEST`` bytes would make it deep; texts are cut at them and
their payload is computed from the word itself.

The texts are scanned once.  Each document's buckets, two bytes a feature, are
stored; counting and scoring read them back and shuffle one number per bucket and task.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bytes_of, id_and_text, worker_cache
from panelspark.operators.ordered import number_in_order
from panelspark.session import written

BUCKETS = 10_000
SEED = 7
MIN_WORDS = 20
SHARE_PERCENT = 25

LONGEST = 48                    # bytes of the longest word the automaton holds
DICTIONARY_BYTES = 3 << 20      # letters in an automaton, at most about 60 bytes of memory each
BLOCK_BYTES = 4 << 20           # text scanned between two looks at the dictionary
_LONG_WORD = re.compile(rb"([^ ]{%d,})" % (LONGEST + 1))
# A-Z to lower case; every other ASCII character that is no letter or digit becomes the delimiter
_FOLD = bytes(c | 0x20 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def _shift_tables() -> np.ndarray:
    """tables[k, j, v]: the CRC with only byte j set to v, after 2**k more zero bytes, without the final conditioning."""
    byte = np.arange(256, dtype=np.uint32)
    step = byte.copy()
    for _ in range(8):    # the reversed polynomial of CRC-32
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> np.uint32(1)), step >> np.uint32(1))
    crc = np.stack([byte << np.uint32(8 * j) for j in range(4)])
    tables = [step[crc & np.uint32(255)] ^ (crc >> np.uint32(8))]
    while len(tables) < 31:    # twice as many bytes: the same map once more
        tables.append(_apply(tables[-1], tables[-1]))
    return np.stack(tables)


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    low = np.uint32(255)
    return (table[0][crc & low] ^ table[1][(crc >> np.uint32(8)) & low]
            ^ table[2][(crc >> np.uint32(16)) & low] ^ table[3][crc >> np.uint32(24)])


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings put together, from the CRC of each and the length of the second."""
    tables = worker_cache("crc_shift_tables", _shift_tables)
    out, left, k = first.astype(np.uint32), length.copy(), 0
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = _apply(tables[k], out[odd])
        left, k = left >> 1, k + 1
    return out ^ second


class Scanner:
    """Payloads ``length << 32 | crc`` of the words of folded texts."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.automaton, self.known, self.size = ahocorasick.Automaton(), {b""}, 0

    def learn(self, texts: list[bytes]) -> None:
        """Adds the words of the texts that the automaton does not hold."""
        every = set().union(*(t.split(b" ") for t in texts))
        new = [w for w in every - self.known if len(w) <= LONGEST]
        if self.size + sum(map(len, new)) > DICTIONARY_BYTES:
            self.clear()
            new = [w for w in every - self.known if len(w) <= LONGEST]
        if new:
            for w in new:
                self.automaton.add_word(f" {w.decode('latin-1')} ", len(w) << 32 | zlib.crc32(w))
            self.known.update(new)
            self.size += sum(map(len, new))
            self.automaton.make_automaton()

    def payloads(self, text: bytes) -> list[int]:
        """Payloads of a folded text whose shorter words have been learned."""
        out: list[int] = []
        for i, piece in enumerate(_LONG_WORD.split(text) if len(text) > LONGEST else [text]):
            if i % 2:
                out.append(len(piece) << 32 | zlib.crc32(piece))
            elif piece and len(self.automaton):
                out += [p for _, p in self.automaton.iter(f" {piece.decode('latin-1')} ")]
        return out


def _pieces(text: bytes):
    """A folded text in pieces of at most about a block, cut at delimiters."""
    start = 0
    while len(text) - start > BLOCK_BYTES:
        cut = text.rfind(b" ", start + 1, start + BLOCK_BYTES)
        cut = text.find(b" ", start + BLOCK_BYTES) if cut < 0 else cut
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def _blocks(texts: list[bytes]):
    """Runs of (document, piece) of about a block of folded bytes."""
    held, size = [], 0
    for doc, text in enumerate(texts):
        for piece in _pieces(text.translate(_FOLD)):
            held.append((doc, piece))
            size += len(piece)
            if size >= BLOCK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def bucket_runs(texts: list[bytes], scanner: Scanner, buckets: int):
    """Yields (document, bucket) arrays: every single word, and every pair with its second word's document."""
    last_doc, last = -1, 0
    for block in _blocks(texts):
        scanner.learn([piece for _, piece in block])
        found = [scanner.payloads(piece) for _, piece in block]
        docs = np.repeat(np.array([doc for doc, _ in block], np.int32), [len(p) for p in found])
        payload = np.fromiter((p for ps in found for p in ps), np.int64, len(docs))
        if not len(payload):
            continue
        crc, length = (payload & 0xFFFFFFFF).astype(np.uint32), payload >> 32
        yield docs, crc % np.uint32(buckets)
        # the word before each word, over the block's edge
        before = np.concatenate([[last], payload[:-1]])
        same = np.concatenate([[last_doc], docs[:-1]]) == docs
        space = np.full(int(same.sum()), zlib.crc32(b" "), np.uint32)
        spaced = joined_crc((before[same] & 0xFFFFFFFF).astype(np.uint32), space, np.ones(len(space), np.int64))
        yield docs[same], joined_crc(spaced, crc[same], length[same]) % np.uint32(buckets)
        last_doc, last = int(docs[-1]), int(payload[-1])


def _width(buckets: int):
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def _slices(batch: pa.RecordBatch):
    """A batch in runs of rows of about a block of text, or one longer text."""
    start, size = 0, 0
    for end, n in enumerate(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist(), 1):
        size += n
        if size >= BLOCK_BYTES or end == batch.num_rows:
            yield batch.slice(start, end - start)
            start, size = end, 0


def _bucket_writer(buckets: int):
    def run(batches):
        scanner, width = worker_cache("importance_scanner", Scanner), _width(buckets)
        for whole in batches:
            for b in _slices(whole):
                found = list(bucket_runs(bytes_of(b.column("text")), scanner, buckets))
                doc = np.concatenate([d for d, _ in found] or [np.zeros(0, np.int32)])
                data = np.concatenate([v for _, v in found] or [np.zeros(0, np.uint32)])[np.argsort(doc, kind="stable")].astype(width)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.num_rows) * data.itemsize)])
                stored = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), stored.cast(pa.binary())], names=["doc_id", "buckets"])
    return run


def bucketed(docs: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored table (doc_id, buckets): the buckets of all features of each document as little-endian integers."""
    rows = id_and_text(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    return written(rows.mapInArrow(_bucket_writer(buckets), "doc_id long, buckets binary"), "buckets")


def _stored_buckets(column: pa.Array, width) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch and the place where each row's begin, with the end of the last."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    return data.view(width), (ends - ends[0]) // np.dtype(width).itemsize


def bucket_counts(stored: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all documents: ``buckets`` numbers, whatever the input."""
    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for b in batches:
            if b.num_rows:
                counts += np.bincount(_stored_buckets(b.column("buckets"), _width(buckets))[0], minlength=buckets)
        held = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held])], names=["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    found = stored.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in found.collect():    # at most ``buckets`` rows
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the target's smoothed share of a bucket over the corpus's, in doubles."""
    s_all, t_all, buckets = float(raw.sum()), float(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))))
                     for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def luck(doc_id: int | None, seed: int) -> int:
    """floor(1000 x) of a Gumbel variate fixed by the seed and the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scorer(gains: np.ndarray, seed: int):
    def score(batches):
        for b in batches:
            if not b.num_rows:
                continue
            found, ends = _stored_buckets(b.column("buckets"), _width(len(gains)))
            upto = np.concatenate([[0], np.cumsum(gains[found])])
            features, total = np.diff(ends), upto[ends[1:]] - upto[ends[:-1]]
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            noise = np.array([luck(i, seed) for i in b.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(features), pa.array(weight), pa.array(weight + noise)],
                names=["doc_id", "n_features", "weight", "score"])
    return score


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
             share_percent: int = SHARE_PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_features, weight, score, rank); rank counts the drawn from 1, others have none.

    ``weight`` is the mean log ratio of the target's and the documents' bucket shares over a document's
    features, ``score`` adds Gumbel noise fixed by the id, and the ``share_percent`` of highest
    scores among documents of at least ``min_words`` words are drawn: a sample without
    replacement in proportion to the importance weights.

    Null and empty texts have no features, weight 0 and no rank.  Ties go to the smaller id (null last), then to
    fewer features and the smaller weight.  Repeated rows are drawn one by one.  Very long texts are scanned in blocks.  An empty
    table gives no rows, an empty target weighs against frequent buckets.  Other columns are never read.
    """
    own = bucketed(docs, buckets, id_col, text_col)
    wanted = bucketed(target.select(F.lit(None).alias(id_col), text_col), buckets, id_col, text_col)
    gains = bucket_gains(bucket_counts(own, buckets), bucket_counts(wanted, buckets))
    scored = written(own.mapInArrow(_scorer(gains, seed), "doc_id long, n_features long, weight long, score long"), "scored")
    long_enough = F.col("n_features") >= 2 * min_words - 1    # w words have 2 w - 1 runs
    eligible = scored.agg(F.count(F.when(long_enough, 1)).alias("_eligible"))
    drawn = share_percent * eligible.first()["_eligible"] // 100
    # a row's own place is the last resort of the order, so that equal rows need not share a task
    placed = number_in_order(
        scored.withColumn("_at", F.monotonically_increasing_id()).withColumn("_short", ~long_enough),
        ["_short", F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight", "_at"])
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
