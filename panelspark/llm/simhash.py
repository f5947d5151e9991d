"""SimHash near-duplicates by tiled exact comparison.

Fingerprints within ``radius`` bits agree on at least one of ``radius + 1`` bands of
bits, so all links are found inside groups of equal bands.  A group is ordered by
population count and cut into tiles of at most about ``TILE`` fingerprints.  Two
fingerprints whose population counts differ beyond the radius cannot be linked, so a
row is only sent to the tile pairs that hold counts within its radius; the others are
never formed.  A tile pair is one exclusive-or and bit count over a numpy matrix.

Equal fingerprints are one class before any comparison, so exact copies add no work.
A tile pair returns edges that connect what it found linked, not every link:
components need no more, and a group of near copies stays linear in its output.

Copies with edits (``similar_groups``).  A shingle similarity of 0.8 moves about
ten of 64 bits, too many for bands.  There fingerprints have ``64 * WIDE`` bits over distinct
shingles, and groups share one of ``KEYS`` pairs of smallest shingle hashes, which
two such texts miss with a probability of 0.0003.  Tiles are compared as above within a wide
radius, larger groups return the shortest connecting edges, and every edge is
checked by the exact similarity of its two shingle sets.  Where rejected edges left
a larger group in several parts, a second pass brings the shingle sets themselves to its tiles: pairs of
different parts within the radius are checked there and then, and only edges that connect
parts leave the tile, at most one less than it has rows.

Bits of few shingles are too coarse for that radius, so pairs whose smaller text has at most ``SHORT`` distinct shingles
are found exactly: sets that similar share one of their first shingles under any common order (prefix filter),
here the rare ones first.  Groups of an equal such shingle are tiled by set size and checked like the second pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import bytes_of, id_and_text
from panelspark.session import written

TILE = 1024
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = 1 << 15    # shingles whose bits are unpacked at once
WIDE = 8            # 64-bit words of a wide fingerprint
WIDE_RADIUS = 108   # of 512 bits: similarity 0.8 differs in 78 bits, standard deviation 8
EVERY = 32          # rows of a tile pair up to which all its links are returned at once
SHORT = 20          # distinct shingles up to which the smaller text of a pair is joined exactly
KEYS = 8            # groups a text is dealt to by its smallest shingle hashes
_ODD = np.random.default_rng(20250119).integers(1, 1 << 63, WIDE + 2 * KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingles(split: list[bytes], words: int, seed: int) -> np.ndarray:
    """Hashes of the shingles of a text's words, repeats included; a shorter text is one shingle."""
    import xxhash
    joined = b" ".join(split)
    hashed = xxhash.xxh64_intdigest
    if len(split) <= words:
        return np.array([hashed(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in split])
    starts = np.concatenate([[0], ends[:-1]])
    return np.array([hashed(joined[a:b], seed) for a, b in
                     zip(starts[:len(split) - words + 1].tolist(), (ends[words - 1:] - 1).tolist())], np.uint64)


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Bits set in over half of the hashes, as one unsigned 64-bit integer."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at:at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: bytes, words: int, seed: int = 42) -> int:
    """Bits set in over half of the shingle hashes, as an unsigned 64-bit integer; 0 without words."""
    split = text.translate(_LOWER).split()
    return int(_majority(_shingles(split, words, seed))[0]) if split else 0


def shingle_set(text: bytes, words: int, seed: int = 42) -> tuple[int, np.ndarray]:
    """Digest of the sequence of words, and the sorted distinct shingle hashes; none without words."""
    import xxhash
    split = text.translate(_LOWER).split()
    found = np.unique(_shingles(split, words, seed)) if split else np.zeros(0, np.uint64)
    return xxhash.xxh64_intdigest(b" ".join(split), seed + 1), found


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    h = hashes * _ODD[k]
    return (h ^ (h >> np.uint64(29))) * _ODD[k]


def wide_fingerprint(hashes: np.ndarray) -> tuple[bytes, list[int]]:
    """``WIDE`` words of majority bits over distinct shingle hashes, and ``KEYS`` keys from pairs of smallest hashes."""
    if not len(hashes):
        return bytes(8 * WIDE), [0] * KEYS
    bits = np.concatenate([_majority(_mixed(hashes, k)) for k in range(WIDE)])
    low = np.array([_mixed(hashes, WIDE + k).min() for k in range(2 * KEYS)])
    keys = (low[0::2] * np.uint64(0x9E3779B97F4A7C15) ^ (low[1::2] >> np.uint64(7))) + np.arange(KEYS, dtype=np.uint64)
    return bits.tobytes(), keys.view(np.int64).tolist()


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a long, of every whole text; null counts as empty text."""
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in bytes_of(b.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


# -- links ------------------------------------------------------------------------
def _connect(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a symmetric matrix links: from one member of each component to the others."""
    out, seen = [], np.zeros(len(linked), bool)
    for root in np.flatnonzero(linked.any(axis=1)):
        if seen[root]:
            continue
        seen[root] = True
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & ~seen)
            seen[front] = True
            out += [(root, i) for i in front]
    return out


def _compare(fps: np.ndarray, tiles: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Connecting edges of one tile pair: inside the tile, or between its two tiles."""
    linked = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    if tiles[0] != tiles[-1]:
        linked &= tiles[:, None] != tiles[None, :]
    np.fill_diagonal(linked, False)
    edges = np.array(_connect(linked), np.int64).reshape(-1, 2)
    return fps[edges[:, 0]], fps[edges[:, 1]]


def _compare_small(fps: np.ndarray, key: np.ndarray, longest: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside many small groups at once: each row against the next ones of the same group."""
    left, right = [fps[:0]], [fps[:0]]
    for step in range(1, longest):
        hit = (key[step:] == key[:-step]) & (np.bitwise_count(fps[step:] ^ fps[:-step]) <= radius)
        left.append(fps[:-step][hit])
        right.append(fps[step:][hit])
    return np.concatenate(left), np.concatenate(right)


def _links(radius: int):
    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy() for c in ("pair", "tile", "fp")]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            cut = np.searchsorted(held[0], held[0][-1])    # rows are sorted by pair: the last may go on
            if cut:
                yield from found(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield from found(*held)

    def found(pair, tile, fp):
        fp = fp.view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        sizes = np.diff(np.append(starts, len(pair)))
        left, right = [], []
        small = sizes <= 32
        rows = np.repeat(small, sizes)
        if small.any():
            part = np.repeat(np.arange(len(sizes)), sizes)[rows]
            a, b = _compare_small(fp[rows], part, int(sizes[small].max()), radius)
            left.append(a)
            right.append(b)
        for s, n in zip(starts[~small], sizes[~small]):
            a, b = _compare(fp[s:s + n], tile[s:s + n], radius)
            left.append(a)
            right.append(b)
        a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    return run


def _deal(rows: DataFrame, group: list, node: list, radius: int, tile: int, above: int, how: str) -> DataFrame:
    """Rows with the tile pairs they take part in: (*node, tile, pair).

    Groups with more than ``above`` rows get a layout: per population count, the rows before and within the radius.
    ``how`` says whether rows of other groups stay, in one tile ("left"), or go ("inner").
    """
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("ones")
    layout = (rows.groupBy(*group, "ones").agg(F.count("*").alias("n"))
              .withColumn("total", F.sum("n").over(whole)).filter(F.col("total") > above)
              .select(*group, "ones", "n",
                      (F.sum("n").over(upto) - F.col("n")).alias("before"),
                      F.coalesce(F.sum("n").over(upto.rangeBetween(Window.unboundedPreceding, -radius - 1)), F.lit(0)).alias("low"),
                      F.sum("n").over(upto.rangeBetween(Window.unboundedPreceding, radius)).alias("high")))
    layout = written(layout, "tiles")
    mine = F.coalesce(F.floor((F.col("before") + F.pmod(F.xxhash64(node[0]), F.col("n"))) / tile), F.lit(0))
    first = F.coalesce(F.floor(F.col("low") / tile), F.lit(0))
    last = F.coalesce(F.floor((F.col("high") - 1) / tile), F.lit(0))
    return (rows.join(layout, [*group, "ones"], how)
            .select(*node, *group, mine.alias("tile"), F.explode(F.sequence(first, last)).alias("other"))
            .select(*node, "tile", F.xxhash64(*group, F.least("tile", "other"), F.greatest("tile", "other")).alias("pair")))


def linked_pairs(classes: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect exactly what links within ``radius`` connect."""
    bands = radius + 1
    widths = [64 // bands + (k < 64 % bands) for k in range(bands)]
    parts, at = [], 0
    for k, w in enumerate(widths):
        value = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << w) - 1))
        parts.append(F.struct(F.lit(k).alias("band"), value.alias("value")))
        at += w
    rows = classes.select("fp", F.bit_count("fp").alias("ones"), F.explode(F.array(*parts)).alias("g")).select(
        "fp", "ones", "g.band", "g.value")
    dealt = _deal(rows, ["band", "value"], ["fp"], radius, tile, tile, "left")
    n = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")),
            classes.sparkSession.sparkContext.defaultParallelism)
    return (dealt.repartition(n, "pair").sortWithinPartitions("pair", "tile")
            .mapInArrow(_links(radius), "a long, b long").filter("a <> b"))


# -- copies with edits --------------------------------------------------------------
def _distances(bits: np.ndarray) -> np.ndarray:
    """Differing bits between all rows of one tile pair."""
    out = np.zeros((len(bits), len(bits)), np.int16)
    for word in bits.T:
        out += np.bitwise_count(word[:, None] ^ word[None, :])
    return out


def _shortest_edges(apart: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A forest of the shortest edges within ``radius``, grown row by row (Prim)."""
    n, out = len(apart), []
    left, near, source = np.ones(n, bool), np.full(n, 1 << 14, np.int16), np.zeros(n, np.int64)
    for _ in range(n):
        at = int(np.where(left, near, 1 << 14 | 1).argmin())
        if near[at] <= radius:
            out.append((int(source[at]), at))
        left[at] = False
        closer = apart[at] < near
        near[closer] = apart[at][closer]
        source[closer] = at
    return out


def _by_pair(found, columns: list):
    """Runs ``found`` on the rows of each tile pair; rows come sorted by pair, and the last may go on in the next batch."""
    def read(b, c):
        if c == "bits":
            return np.frombuffer(b"".join(b.column(c).to_pylist()), "<u8").reshape(-1, WIDE)
        if c == "hashes":
            sets = np.empty(b.num_rows, object)
            ends, flat = b.column(c).offsets.to_numpy(), b.column(c).values.to_numpy()
            sets[:] = [flat[x:y] for x, y in zip(ends, ends[1:])]
            return sets
        return b.column(c).to_numpy()

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [read(b, c) for c in ["pair", *columns]]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            starts = np.flatnonzero(np.concatenate([[True], held[0][1:] != held[0][:-1]]))
            for at, end in zip(starts, starts[1:]):
                yield found(*[x[at:end] for x in held[1:]])
            held = [x[starts[-1]:] for x in held]
        if held is not None:
            yield found(*held[1:])
    return run


def _edges(node: np.ndarray, edges) -> pa.RecordBatch:
    edges = np.asarray(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(node[edges[:, 0]]), pa.array(node[edges[:, 1]])], names=["a", "b"])


def _apart(bits: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Differing bits of the pairs a tile pair is there for; far more than any radius elsewhere."""
    apart = _distances(bits)
    if tile[0] != tile[-1]:
        apart[tile[:, None] == tile[None, :]] = 1 << 14
    np.fill_diagonal(apart, 1 << 14)
    return apart


def _wide_links(radius: int):
    """Per tile pair: all links where it has at most ``EVERY`` rows, else the shortest that connect what is linked."""
    def found(node, tile, bits):
        apart = _apart(bits, tile)
        return _edges(node, np.argwhere(np.triu(apart <= radius)) if len(node) <= EVERY else _shortest_edges(apart, radius))
    return _by_pair(found, ["node", "tile", "bits"])


_AT_ONCE = 1 << 22    # hashes of other rows that a row is compared with at once


def _checked_links(radius: int, least: float):
    """Per tile pair: edges between rows ``least`` similar or more that connect different parts, each connection once."""
    def found(node, tile, bits, part, hashes):
        if (part == part[0]).all():
            return _edges(node, [])
        near = _apart(bits, tile) <= radius
        sizes = np.array([len(h) for h in hashes])
        distinct, ids = np.unique(np.concatenate(hashes), return_inverse=True)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        mine, group = np.zeros(len(distinct), bool), np.unique(part, return_inverse=True)[1]
        edges = []
        for i in range(len(node)):
            others = np.flatnonzero(near[i, i + 1:] & (group[i + 1:] != group[i])) + i + 1
            low, high = np.minimum(sizes[i], sizes[others]), np.maximum(sizes[i], sizes[others])
            others = others[(low >= least * high) & (low > 0)]
            if not len(others):
                continue
            mine[ids[begins[i]:begins[i + 1]]] = True
            step = max(1, _AT_ONCE // int(sizes[others].max()))
            for at in range(0, len(others), step):
                js = others[at:at + step]
                starts = np.concatenate([[0], np.cumsum(sizes[js])])
                flat = np.concatenate([ids[begins[j]:begins[j + 1]] for j in js])
                shared = np.add.reduceat(mine[flat].astype(np.int64), starts[:-1])
                for j in js[shared >= least * (sizes[i] + sizes[js] - shared)]:
                    if group[j] != group[i]:
                        edges.append((i, j))
                        group[group == group[j]] = group[i]
            mine[ids[begins[i]:begins[i + 1]]] = False
        return _edges(node, edges)
    return _by_pair(found, ["node", "tile", "bits", "part", "hashes"])


def _tile_partitions(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def similar_pairs(classes: DataFrame, radius: int = WIDE_RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between the ``node`` of classes with wide fingerprints ``bits`` within ``radius`` that share one of their ``keys``."""
    rows = classes.select("node", "bits", "ones", F.explode("keys").alias("key"))
    dealt = _deal(rows, ["key"], ["node", "bits"], radius, tile, 1, "inner")
    return _ordered(dealt.repartition(_tile_partitions(classes.sparkSession), "pair").sortWithinPartitions("pair", "tile")
                    .mapInArrow(_wide_links(radius), "a long, b long"))


def _sets_of(nodes: DataFrame, rows: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(node, hashes): the shingle sets of some classes, taken again from one text of each."""
    wanted = written(classes.join(nodes, "node").select("node", F.col("low").alias("doc_id")), "wanted")

    def sets(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                found = [shingle_set(t, words) for t in bytes_of(b.column("text").slice(at, 256))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array([d for d, _ in found], np.uint64).view(np.int64)),
                     pa.array([h.view(np.int64) for _, h in found], pa.list_(pa.int64()))], names=["node", "hashes"])

    # an id may be repeated with other words, so the digest is compared again
    again = rows.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(sets, "node long, hashes array<long>")
    return written(again.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")


def _alike(edges: DataFrame, rows: DataFrame, classes: DataFrame, words: int, least: float) -> DataFrame:
    """The edges (a, b) whose shingle sets are ``least`` similar or more."""
    sets = _sets_of(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), rows, classes, words)
    both = (edges.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b"))
    shared = F.size(F.array_intersect("ha", "hb"))
    return written(both.filter(shared >= least * (F.size("ha") + F.size("hb") - shared)).select("a", "b"), "alike")


def _across_parts(classes: DataFrame, roots: DataFrame, rows: DataFrame, words: int, least: float, radius: int, tile: int) -> DataFrame:
    """What the first pass may have left out: alike pairs of different ``roots`` in groups of more than ``EVERY`` rows."""
    named = classes.join(roots, "node", "left").select(
        "node", "bits", "ones", F.coalesce("root", "node").alias("part"), F.explode("keys").alias("key"))
    open_keys = (named.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high"))
                 .filter((F.col("n") > EVERY) & (F.col("low") < F.col("high"))).select("key"))
    open_rows = written(named.join(written(open_keys, "open"), "key", "left_semi"), "parts")
    sets = _sets_of(open_rows.select("node").distinct(), rows, classes, words)
    dealt = _deal(open_rows, ["key"], ["node", "part", "bits"], radius, tile, EVERY, "inner").join(sets, "node")
    spark = classes.sparkSession
    return written(_ordered(dealt.repartition(_tile_partitions(spark), "pair").sortWithinPartitions("pair", "tile")
                            .mapInArrow(_checked_links(radius, least), "a long, b long")), "across")


def _short_links(classes: DataFrame, roots: DataFrame, least: float, tile: int) -> DataFrame:
    """Alike pairs of different ``roots`` whose smaller text has at most ``SHORT`` shingles, as edges that connect them; none is missed."""
    longest = int(SHORT / least + 1e-9)
    short = written(classes.filter(F.size("few") > 0).join(roots, "node", "left")
                    .select("node", "bits", F.coalesce("root", "node").alias("part"), "few"), "short")
    each = short.select("node", F.size("few").alias("ones"), F.explode("few").alias("key"))
    common = written(each.groupBy("key").agg(F.count("*").alias("often")).filter(F.col("often") > EVERY), "common")
    placed = each.join(common, "key", "left").groupBy("node", "ones").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "key"))).alias("keys"))    # at most ``longest``
    first = F.slice("keys", 1, (F.col("ones") - F.ceil(F.col("ones") * least - 1e-9) + 1).cast("int"))
    rows = written(placed.select("node", "ones", F.explode(first.getField("key")).alias("key"))
                   .join(short.select("node", "bits", "part"), "node"), "prefixes")
    open_keys = (rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"))
                 .filter(F.col("low") < F.col("high")).select("key"))
    open_rows = written(rows.join(written(open_keys, "open"), "key", "left_semi"), "parts")
    dealt = _deal(open_rows, ["key"], ["node", "part", "bits"], longest, tile, 1, "inner")
    dealt = dealt.join(short.select("node", F.col("few").alias("hashes")), "node")
    return written(_ordered(dealt.repartition(_tile_partitions(classes.sparkSession), "pair").sortWithinPartitions("pair", "tile")
                            .mapInArrow(_checked_links(64 * WIDE, least), "a long, b long")), "short_links")


def similar_groups(docs: DataFrame, words: int = 5, least: float = 0.8, tile: int = TILE,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over texts whose shingle sets are ``least`` similar or more.

    Similarity is shared over all distinct shingles of both.  Texts of the same words are one
    class; null, empty and blank texts are one class too.  A text shorter than a
    shingle is one shingle.  Repeated rows repeat.  Rows without an id are left out.
    """
    return _groups(docs, words, least, tile, id_col, text_col).select("doc_id", "component_id")


def _groups(docs: DataFrame, words: int, least: float, tile: int, id_col: str, text_col: str) -> DataFrame:
    """``similar_groups`` with the class of every row (node) and its group (root), which ids alone may not tell."""
    rows = id_and_text(docs, id_col, text_col).filter("doc_id is not null")
    longest = int(SHORT / least + 1e-9)

    def measure(batches):
        for b in batches:
            ids, found = b.column("doc_id"), [shingle_set(t, words) for t in bytes_of(b.column("text"))]
            wide = [wide_fingerprint(h) for _, h in found]
            ones = [int.from_bytes(bits).bit_count() for bits, _ in wide]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.array([d for d, _ in found], np.uint64).view(np.int64)), pa.array([w[0] for w in wide], pa.binary()),
                 pa.array(ones, pa.int32()), pa.array([w[1] for w in wide], pa.list_(pa.int64())),
                 pa.array([h.view(np.int64) if len(h) <= longest else None for _, h in found], pa.list_(pa.int64()))],
                names=["doc_id", "node", "bits", "ones", "keys", "few"])

    fps = written(rows.mapInArrow(measure, "doc_id long, node long, bits binary, ones int, keys array<long>, few array<long>"), "wide")
    classes = written(fps.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("bits").alias("bits"), F.first("ones").alias("ones"),
                                              F.first("keys").alias("keys"), F.first("few").alias("few")), "classes")
    first = _alike(written(similar_pairs(classes, tile=tile), "candidates"), rows, classes, words, least)
    roots = written(components(first), "roots")
    more = _across_parts(classes, roots, rows, words, least, WIDE_RADIUS, tile)
    more = more.union(_short_links(classes, roots, least, tile))
    roots = written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), "roots")
    linked = classes.join(roots, "node").select("node", "root", "low")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    named = linked.select("node", "root").join(lowest, "root").select("node", "root", "component_id")
    final = written(classes.select("node", "low").join(named, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "low").alias("component_id")), "components")
    return fps.select("doc_id", "node").join(final, "node").select("doc_id", "node", "root", "component_id")


# -- components -------------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge: root is the smallest node reachable.

    Alternates the two star contractions of Kiveris et al. until the edges stay the
    same.  Every round is written to the shared folder; only a count and a checksum of
    the edges reach the driver.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now = written(small.filter("u <> v").distinct(), "edges")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, tile: int = TILE,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links.

    Texts link when their fingerprints differ in at most ``radius`` bits.  Null and
    empty texts have fingerprint zero and are linked like any other; a text shorter
    than a shingle is one shingle.  Repeated rows repeat.  Null ids are never
    smallest: the component of a group with null ids only is null.
    """
    fps = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    roots = written(components(linked_pairs(classes, radius, tile)), "roots")
    linked = (classes.join(roots, classes.fp == roots.node).select("fp", "root", "low"))
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    named = linked.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    # a table on either side of the last join, so that a fingerprint shared by many documents can be split
    final = written(classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")), "components")
    return fps.join(final, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that represent their group of near duplicates: the smallest id of each.

    Groups are those of ``similar_groups``.  Of rows of a group with the same id one stays;
    an id that is repeated with unrelated texts stays once for each group it represents.
    Rows without an id cannot be named as a representative and all stay.
    """
    node = "_node"
    while node in docs.columns:
        node += "_"
    found = written(_groups(docs, words, least, TILE, id_col, text_col), "groups")
    kept = written(found.filter("doc_id = component_id").groupBy("root", "doc_id").agg(F.min("node").alias(node))
                   .select(F.col("doc_id").alias(id_col), node), "kept")
    mixed = written(found.groupBy(F.col("doc_id").alias(id_col)).agg(F.min("node").alias("a"), F.max("node").alias("b"))
                    .filter("a <> b").select(id_col), "mixed")    # ids of several texts; only theirs are read again

    @F.pandas_udf("long")
    def node_of(texts: pd.Series) -> pd.Series:
        found = [shingle_set(("" if t is None else t).encode(), words)[0] for t in texts]
        return pd.Series(np.array(found, np.uint64).view(np.int64))

    one = docs.join(kept.join(mixed, id_col, "left_anti"), id_col, "left_semi").dropDuplicates([id_col])
    several = (docs.join(mixed, id_col, "left_semi").withColumn(node, node_of(F.col(text_col).cast("string")))
               .join(kept, [id_col, node], "left_semi").dropDuplicates([id_col, node]).select(*docs.columns))
    return one.select(*docs.columns).unionByName(several).unionByName(docs.filter(F.col(id_col).isNull()))
