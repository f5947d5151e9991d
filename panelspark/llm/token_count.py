"""Token counts by heap-driven byte-pair merging, without emitting identifiers.

The count of a word is its number of initial symbols minus the merges made.  The
symbols form a doubly linked list; a heap holds every adjacent pair that has a rank,
and the lowest rank (leftmost on ties) is popped and merged until none is left.
Work per word is O(n log n), so a text without spaces is no special case.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.chunks import CACHE_LIMIT, ChunkCache, Irregular
from panelspark.llm.common import id_and_text, texts_of, worker_cache


def count_after_merges(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges, lowest rank first."""
    n = len(symbols)
    rank_of = ranks.get
    heap = [(r, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := rank_of(pair)) is not None]
    if not heap:
        return n
    heapify(heap)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    count = n
    while heap:
        rank, i = heappop(heap)
        j = right[i]
        # an entry is stale if its left symbol is gone (empty) or the pair has changed since
        if j >= n or rank_of((symbols[i], symbols[j])) != rank:
            continue
        merged = symbols[i] = symbols[i] + symbols[j]
        symbols[j] = ""
        count -= 1
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            if (r := rank_of((merged, symbols[k]))) is not None:
                heappush(heap, (r, i))
        h = left[i]
        if h >= 0 and (r := rank_of((symbols[h], merged))) is not None:
            heappush(heap, (r, h))
    return count


class Counter:
    """Counts of whole texts under one byte-level BPE file."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{file} is not a plain byte-level BPE vocabulary")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(a, b): r for r, (a, b) in enumerate(pairs)}
        self.words_of = Tokenizer.from_file(file).pre_tokenizer.pre_tokenize_str
        self.added = tuple(t["content"] for t in spec["added_tokens"])
        self.words: dict[str, int] = {}
        self.chunks = ChunkCache(self.plain, self.many, self.added)

    def word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            n = count_after_merges(list(word), self.ranks)
            if len(word) <= 64:
                if len(self.words) > CACHE_LIMIT:
                    self.words.clear()
                self.words[word] = n
        return n

    def plain(self, text: str) -> int:
        """Text without assumptions: added tokens count one each, the rest word by word."""
        total = 0
        while found := [(p, -len(t), t) for t in self.added if (p := text.find(t)) >= 0]:
            p, _, t = min(found)
            total += self.between(text[:p]) + 1
            text = text[p + len(t):]
        return total + self.between(text)

    def between(self, text: str) -> int:
        return sum(self.word(w) for w, _ in self.words_of(text)) if text else 0

    def many(self, chunks: list[str]) -> list[int]:
        """Counts of chunks with their space, split into words in one call."""
        with_added = [k for k, c in enumerate(chunks) if any(t in c for t in self.added)]
        out, k, end = [0] * len(chunks), 0, 1 + len(chunks[0]) if chunks else 0
        for w, (begin, _) in self.words_of(" " + " ".join(chunks)) if chunks else ():
            while begin >= end:
                k += 1
                end += 1 + len(chunks[k])
            out[k] += self.words.get(w) or self.word(w)
        for k in with_added:
            out[k] = self.plain(" " + chunks[k])
        return out

    def counts(self, texts: list[str]) -> list[int]:
        split = [t.split(" ") for t in texts]
        self.chunks.learn([s[1:] for s in split])
        out = []
        for text, (first, *rest) in zip(texts, split):
            try:
                out.append(self.plain(first) + sum(map(self.chunks.__getitem__, rest)))
            except Irregular:
                out.append(self.plain(text))
        return out


def count_tokens(docs: DataFrame, file: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    ``file`` is a byte-level BPE vocabulary (.json) that every executor can open.
    Null counts as empty text: no bytes, no tokens.  Rows are independent of each
    other, so repeated rows and ids repeat in the result.
    """
    def run(batches):
        counter = worker_cache(("token_count", file), lambda: Counter(file))
        for b in batches:
            texts = texts_of(b.column("text"))
            found = [n for at in range(0, len(texts), 256) for n in counter.counts(texts[at:at + 256])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), pa.array(found, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    rows = id_and_text(docs, id_col, text_col).withColumn(
        "n_bytes", F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long"))
    return (rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
