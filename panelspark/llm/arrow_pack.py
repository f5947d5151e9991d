"""Token ids as Arrow files of equal-length sequences.

File format.  A shard is two Arrow IPC files (the stream format with a footer, so
batches can be reached at random):

``<name>.seq.arrow``   record batches of ``ids: fixed_size_list<uint16|uint32>[length]``
                       and ``mask: fixed_size_list<bool>[length]``; all batches but the
                       last hold ``ROWS`` sequences, so sequence k is row k % ROWS of
                       batch k // ROWS and is read without a copy from a mapped file
``<name>.docs.arrow``  ``doc_id``, ``first`` (position of its first id in the shard's
                       id stream) and ``n_tokens``, in stream order

Documents follow each other without gaps; only the end of a shard's last
sequence is padded (id 0, mask false).  ``manifest/`` (Parquet) lists the shards in
id order.  It is written by Spark after the shards, from what the tasks that
succeeded returned, so files of lost or repeated task attempts are never listed.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.chunks import ChunkCache, Irregular
from panelspark.llm.common import id_and_text, open_folder, texts_of, worker_cache

ROWS = 64           # sequences in a record batch
SPACE = "\u0120"    # how byte-level vocabularies write the byte of a space
MANIFEST = "name string, first_doc long, docs long, tokens long, sequences long"


class Encoder:
    """Ids of whole texts by the tokenizers library, as bytes of fixed-width little-endian integers."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # tasks are parallel already
        self.library = Tokenizer.from_file(file)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.width = "<u2" if len(vocabulary) <= 1 << 16 else "<u4"
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)    # ids of tokens whose first byte is a space
        self.opens[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.chunks = ChunkCache(self.whole, self.many, tuple(t.content for t in self.library.get_added_tokens_decoder().values()))

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.width).tobytes()

    def many(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks with their space, encoded in one call: a chunk has one space, so a token that opens with it begins a chunk."""
        if not chunks:
            return []
        ids = np.array(self.library.encode_batch_fast([" " + " ".join(chunks)], add_special_tokens=False)[0].ids, self.width)
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(chunks):    # a vocabulary that does not keep spaces in front
            return [self.whole(" " + c) for c in chunks]
        raw, starts = ids.tobytes(), (starts * ids.itemsize).tolist()
        return [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every whole text.  Chunks are looked up once; only those not remembered are learned, all together."""
        split = [t.split(" ") for t in texts]
        flat = [c for s in split for c in s[1:]]
        found = list(map(self.chunks.get, flat))
        unknown = [k for k, v in enumerate(found) if v is None]
        self.chunks.learn([{flat[k] for k in unknown}])
        for k in unknown:
            found[k] = self.chunks.get(flat[k])
        out, at = [], 0
        for text, (first, *rest) in zip(texts, split):
            mine = found[at:at + len(rest)]
            at += len(rest)
            try:
                if None in mine:    # long chunks are not remembered, irregular ones do not stand alone
                    mine = [self.chunks[c] if v is None else v for c, v in zip(rest, mine)]
                out.append(self.whole(first) + b"".join(mine))
            except Irregular:
                out.append(self.whole(text))
        return out


class ShardWriter:
    """Streams documents into one shard; holds at most one record batch of ids."""

    def __init__(self, folder: str, length: int, width: str):
        self.fs, self.path = open_folder(folder)
        self.name, self.length, self.dtype = uuid.uuid4().hex, length, np.dtype(width)
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])
        self.sink = self.fs.open_output_stream(f"{self.path}/{self.name}.seq.arrow")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.docs_sink = self.fs.open_output_stream(f"{self.path}/{self.name}.docs.arrow")
        self.docs_out = pa.ipc.new_file(self.docs_sink, self.docs_schema)
        self.buffer, self.waiting = [], 0
        self.tokens = self.sequences = self.docs = 0
        self.first_doc = None

    def write(self, doc_ids: list, encoded: list[bytes]) -> None:
        sizes = np.array([len(e) for e in encoded], np.int64) // self.dtype.itemsize
        starts = self.tokens + np.cumsum(sizes) - sizes
        self.docs_out.write_batch(pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(sizes)], schema=self.docs_schema))
        if not self.docs:
            self.first_doc = doc_ids[0]
        self.docs += len(doc_ids)
        self.tokens += int(sizes.sum())
        self.buffer += encoded
        self.waiting += int(sizes.sum())
        full = ROWS * self.length
        if self.waiting >= full:
            ids = np.frombuffer(b"".join(self.buffer), self.dtype)
            for at in range(0, len(ids) - full + 1, full):
                self.batch(ids[at:at + full], full)
            rest = ids[len(ids) // full * full:]
            self.buffer, self.waiting = [rest.tobytes()], len(rest)

    def batch(self, ids: np.ndarray, valid: int) -> None:
        rows = -(-len(ids) // self.length)
        padded = np.zeros(rows * self.length, self.dtype)
        padded[:len(ids)] = ids
        mask = np.arange(rows * self.length) < valid
        self.out.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)], schema=self.schema))
        self.sequences += rows

    def close(self) -> pa.RecordBatch:
        if self.waiting:
            ids = np.frombuffer(b"".join(self.buffer), self.dtype)
            self.batch(ids, len(ids))
        for x in (self.out, self.sink, self.docs_out, self.docs_sink):
            x.close()
        row = (self.name, self.first_doc, self.docs, self.tokens, self.sequences)
        return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if k == 0 else pa.int64()) for k, v in enumerate(row)],
                                          names=["name", "first_doc", "docs", "tokens", "sequences"])


def write_packed(docs: DataFrame, folder: str, file: str, end_id: int = 2, length: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text with the vocabulary ``file``, appends ``end_id``, writes the shards; returns the manifest.

    ``folder`` must not exist and must be reachable by every executor.  Documents
    are in ascending id order over all shards (null ids first, equal ids by text);
    null counts as empty text, which is its end id alone.  An empty table gives an
    empty manifest.
    """
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)

    def run(batches):
        encoder = worker_cache(("arrow_pack", file), lambda: Encoder(file))
        end = np.array([end_id], encoder.width).tobytes()
        shard = None
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), texts_of(b.column("text"))
            for at in range(0, len(ids), 256):
                shard = shard or ShardWriter(folder, length, encoder.width)
                shard.write(ids[at:at + 256], [e + end for e in encoder.encode(texts[at:at + 256])])
        if shard:
            yield shard.close()

    rows = id_and_text(docs, id_col, text_col)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def documents_of(folder: str, name: str):
    """(doc_id, ids) of a shard in order, read batch by batch."""
    fs, path = open_folder(folder)
    with fs.open_input_file(f"{path}/{name}.docs.arrow") as d, fs.open_input_file(f"{path}/{name}.seq.arrow") as s:
        index, sequences = pa.ipc.open_file(d), pa.ipc.open_file(s)
        held, at = np.zeros(0, np.uint16), 0
        for k in range(index.num_record_batches):
            batch = index.get_batch(k)
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist()):
                parts, have = [held], len(held)
                while have < n:
                    b = sequences.get_batch(at)
                    ids = b.column("ids").values.to_numpy()
                    if at == sequences.num_record_batches - 1:    # only the last batch can be padded
                        ids = ids[b.column("mask").values.to_numpy(zero_copy_only=False)]
                    parts.append(ids)
                    have, at = have + len(ids), at + 1
                flat = np.concatenate(parts) if len(parts) > 1 else held
                yield doc_id, flat[:n]
                held = flat[n:]


def views(folder: str, name: str, k: int) -> tuple[pa.Array, pa.Array]:
    """Ids and mask of sequence ``k`` of a shard as Arrow arrays; where the folder is local both are views of the mapped file."""
    fs, path = open_folder(folder)
    file = f"{path}/{name}.seq.arrow"
    source = pa.memory_map(file) if fs.type_name == "local" else fs.open_input_file(file)
    b = pa.ipc.open_file(source).get_batch(k // ROWS)
    ids, mask = (b.column(c)[k % ROWS].values for c in ("ids", "mask"))
    return ids, mask


def sequence(folder: str, name: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``views`` for numpy: ids stay a view; masks are bit-packed in the file, which numpy cannot view, so they are unpacked."""
    ids, mask = views(folder, name, k)
    return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def read_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    ``ids_crc32`` is taken over the ids as little-endian unsigned 32-bit integers.
    """
    def run(batches):
        for b in batches:
            for name, base in zip(b.column("name").to_pylist(), b.column("base").to_pylist()):
                rows, start = [], base
                for doc_id, ids in documents_of(folder, name):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 4096:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                          names=["doc_id", "start", "n_tokens", "ids_crc32"])

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # one row per shard: the manifest is as small as the number of tasks that wrote it
    shards = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(
        Window.orderBy(F.col("first_doc").asc_nulls_first(), "name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return (shards.select("name", "base").repartition(n)
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))
