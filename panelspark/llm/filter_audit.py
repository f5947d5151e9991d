"""How five document filters overlap, for every order in which they could run.

A document that fails the set f of filters survives a subset S of them exactly if
f and S share nothing.  Its outcome under all 32 subsets is one 32-bit word, bit S
telling whether it survives S, looked up from a truth table by f.  Counting, bit by
bit, how many words of a group have each bit set gives the survivors of every
subset; all orders, steps and Shapley values follow from these 32 numbers.

The bit counts use carry-save adders: three words of equal weight become one sum
word and one carry word of double weight, for all 32 positions at once.  A row that
stands for n equal rows enters at the weights of the binary digits of n.

Shuffled are facts of about 60 bytes a document, never texts.  Copies of one text
are not gathered: all of them fail filter E but those with the smallest id, which
are looked up by (id, digest), so a text that fills a third of the table is no hot
key.
"""

from __future__ import annotations

import hashlib
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bytes_of
from panelspark.session import written

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
SUBSETS = 1 << len(FILTERS)
HELD_GROUPS = 10_000    # groups a task counts before it hands its counts on

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = b"#$%&*|"
_CONTINUATION = bytes(range(0x80, 0xC0))

# truth table: for each set of failed filters, the word of the subsets it survives
SURVIVAL = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], np.uint32)


def failed_alone(text: bytes) -> int:
    """Bits of the filters A to D that a text fails by itself."""
    words = text.split()    # splits bytes at \x20 and \x09-\x0D
    distinct, points = len(set(words)), len(text) - _removed(text, _CONTINUATION)
    return ((len(words) < 50) | (100 * distinct < 65 * len(words)) << 1
            | (100 * _removed(text, _CAPITALS) > 5 * points) << 2 | (_removed(text, _MARKS) > 0) << 3)


def _removed(text: bytes, members: bytes) -> int:
    return len(text) - len(text.translate(None, members))


def _facts(batches):
    for b in batches:
        texts = bytes_of(b.column("text"))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("part"),
             pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()),
             pa.array([failed_alone(t) for t in texts], pa.int32())], names=["doc_id", "part", "digest", "failed"])


def positional_counts(words: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each of 32 bits is set in ``words``, word i counted ``times[i]`` times."""
    counts, carries, weight, positions = np.zeros(SUBSETS, np.int64), [], 0, np.arange(SUBSETS, dtype=np.uint32)
    while carries or (times >> weight).any():
        level = np.concatenate([*carries, words[(times >> weight) & 1 == 1]])
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c = level[:third], level[third:2 * third], level[2 * third:3 * third]
            both = a ^ b
            carries.append(a & b | both & c)
            level = np.concatenate([both ^ c, level[3 * third:]])
        for word in level:
            counts += ((word >> positions) & np.uint32(1)).astype(np.int64) << weight
        weight += 1
    return counts


def _survivors(batches):
    """Counts of every group of a task: (part, good, toxic, counts)."""
    held: dict = {}

    def rows():
        keys, counts = list(held), list(held.values())
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()),
             pa.array([k[2] for k in keys], pa.bool_()), pa.array(counts, pa.list_(pa.int64()))],
            names=["part", "good", "toxic", "counts"])

    for b in batches:
        if not b.num_rows:
            continue
        parts = b.column("part").dictionary_encode()
        names = parts.dictionary.to_pylist()
        group = (parts.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4
                 + b.column("good").to_numpy(zero_copy_only=False) * 2 + b.column("toxic").to_numpy(zero_copy_only=False))
        words, times = SURVIVAL[b.column("failed").to_numpy()], b.column("times").to_numpy()
        order = np.argsort(group, kind="stable")
        codes, firsts = np.unique(group[order], return_index=True)
        for code, rows_of in zip(codes.tolist(), np.split(order, firsts[1:])):
            key = (names[code >> 2], bool(code & 2), bool(code & 1))
            held[key] = held.get(key, 0) + positional_counts(words[rows_of], times[rows_of])
        if len(held) > HELD_GROUPS:
            yield rows()
            held = {}
    yield rows()


def _steps():
    """(order, step, filter bit, subset before, subset after) of all orders."""
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            yield "".join(order), step, bit, before, before | bit
            before |= bit


def _over_all_orders(alive: np.ndarray, bit: int) -> int:
    """Removals of one filter summed over all orders: each set of earlier filters, times the orders that begin with it."""
    others, total = [1 << i for i in range(len(FILTERS)) if 1 << i != bit], 0
    for size in range(len(others) + 1):
        orders = factorial(size) * factorial(len(others) - size)
        total += orders * sum(int(alive[sum(s)] - alive[sum(s) | bit]) for s in combinations(others, size))
    return total


_REPORT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
           "good_lost long, toxic_lost long, shapley long")


def _report(batches):
    """600 rows from the 32 survivor counts of each part."""
    orders, steps, bits, before, after = (np.array(c) for c in zip(*_steps()))
    everything = SUBSETS - 1
    for b in batches:
        for part, *counts in zip(*(b.column(c).to_pylist() for c in ("part", "alive", "good", "toxic"))):
            alive, good, toxic = (np.array(c, np.int64) for c in counts)
            removed = alive[before] - alive[after]
            over_all = {bit: _over_all_orders(alive, bit) for bit in set(bits.tolist())}
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(steps), pa.string()), pa.array(orders.tolist()), pa.array(steps, pa.int32()),
                 *(pa.array(c, pa.int64()) for c in (
                     alive[after], removed, alive[0] - alive[bits] - removed, alive[everything ^ bits] - alive[everything],
                     good[before] - good[after], toxic[before] - toxic[after], [over_all[bit] for bit in bits.tolist()]))],
                names=[f.split()[0] for f in _REPORT.split(", ")])


def document_failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      part_col: str = "source") -> DataFrame:
    """(doc_id, part, failed, good, toxic, times): the set of failed filters as bits (A lowest), equal rows counted.

    E fails where a smaller id has the same text, removed or not; rows of one id
    do not fail each other, and a null id is neither smaller nor larger.  Null texts are empty texts, and
    so equal to them.  Labels may be absent or repeated: one row with quality 1 (toxic 1) decides.
    """
    facts = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                        F.col(text_col).cast("string").cast("binary").alias("text"))
    facts = written(facts.mapInArrow(_facts, "doc_id long, part string, digest binary, failed int"), "facts")
    rows = facts.groupBy("doc_id", "part", "digest", "failed").agg(F.count(F.lit(1)).alias("times"))
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), *[
        F.coalesce(F.col(c) == 1, F.lit(False)).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
    marks = marks.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    copy = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), F.lit(COPY)).otherwise(0)
    return (rows.join(marks, "doc_id", "left").join(first, ["doc_id", "digest"], "left")
            .select("doc_id", "part", F.col("failed").bitwiseOR(copy).alias("failed"),
                    *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")], "times"))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "source") -> DataFrame:
    """Per part, order of the filters and step: what is kept, removed here, lost by label, and the filter's share.

    Filters: A under 50 words; B distinct words below 65 % of all; C more than 5 % capitals
    A-Z of all code points; D any of ``#$%&*|``; E a copy of a text with a smaller id.
    Null and empty texts have no words: they fail A, and E beside each other.  A null part and the
    part of empty name are one.  Every row counts, repeated ones too; very long texts are read whole.  An empty table gives no
    rows.  Other columns are never read, whatever their names.
    """
    counts = (document_failures(docs, labels, id_col, text_col, part_col).drop("doc_id")
              .mapInArrow(_survivors, "part string, good boolean, toxic boolean, counts array<long>"))
    per_subset = (counts.select("part", "good", "toxic", F.posexplode("counts").alias("subset", "n"))
                  .groupBy("part", "subset").agg(
                      F.sum("n").alias("alive"),
                      F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
                      F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")))
    in_order = F.array_sort(F.collect_list(F.struct("subset", "alive", "good", "toxic")))    # 32 entries a part
    table = per_subset.groupBy("part").agg(in_order.alias("s")).select(
        "part", *[F.col("s")[c].alias(c) for c in ("alive", "good", "toxic")])
    return table.mapInArrow(_report, _REPORT)


SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM docs GROUP BY text),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         concat(CASE WHEN len(words) < 50 THEN 'A' ELSE '' END,
                CASE WHEN 100 * list_unique(words) < 65 * len(words) THEN 'B' ELSE '' END,
                CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN first_id < doc_id THEN 'E' ELSE '' END) AS failed
  FROM docs JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)),
counted AS (SELECT part, good, toxic, failed, count(*) AS n FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
fates AS (
  SELECT part, good, toxic, failed, n, filter_order, step, substr(filter_order, step, 1) AS x,
         coalesce((SELECT min(i) FROM range(1, 6) r(i) WHERE contains(failed, substr(filter_order, i, 1))), 6) AS gone
  FROM counted, steps),
per_step AS (
  SELECT part, filter_order, step, any_value(x) AS x,
         sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN contains(failed, x) AND gone < step THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failed = x THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN gone = step AND good THEN n ELSE 0 END) AS good_lost,
         sum(CASE WHEN gone = step AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM fates GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM per_step
"""
