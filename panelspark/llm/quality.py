"""Quality scores: ridge regression on random Fourier features, calibrated by isotonic regression.

Statistics of a text (``FEATURES``) are standardised and mapped to cosines of
random projections, whose inner products approximate a Gaussian kernel.  Ridge weights
need only the sums of outer products; every partition adds its own up in ``FOLDS`` folds,
and the driver solves one system of fixed size per fold.  Each training row
is scored by the weights that did not see its fold; these margins, counted in
``BINS`` bins, are calibrated by pooling adjacent violators.  The final weights use
all folds.  All labelled training rows are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bytes_of, crc_mod, id_and_text, py_crc_mod
from panelspark.session import written

FEATURES = ("log_bytes", "log_words", "log_lines", "upper", "lower", "digit", "space", "high", "comma_period", "bracket",
            "exclaim", "symbol", "bar", "other", "mean_word", "distinct_words", "distinct_lines", "top_word", "symbol_words",
            "upper_words", "mean_line", "one_char_words")
WIDTH = 192      # random features
SPREAD = 3.0     # kernel width in standard deviations of the statistics
RIDGE = 1.0      # added to the diagonal
FOLDS = 4
BINS = 2000      # of margins between -1 and 2

_GROUPS = ((65, 91), (97, 123), (48, 58))
_CLASS = np.full(256, 9, np.int64)
for _k, (_a, _b) in enumerate(_GROUPS):
    _CLASS[_a:_b] = _k
for _k, _chars in ((3, b" \t\n\r\x0b\x0c"), (5, b",.;:'\"-"), (6, b"()[]{}<>"), (7, b"!?"), (8, b"#$%&*@^_~+=/\\"), (10, b"|")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 4
_SYMBOL = bytes(c if _CLASS[c] in (7, 8, 10) else 32 for c in range(256))
_ONE = np.eye(11)[_CLASS]     # byte -> class indicator


def statistics(text: bytes) -> list[float]:
    """Statistics of a text in the order of FEATURES; all finite, zero shares for an empty text."""
    n = len(text)
    classes = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _ONE
    words, lines = text.split(), text.split(b"\n")
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    m = len(words)
    share = classes / max(n, 1)
    tail = text.translate(_SYMBOL).split()
    return [np.log1p(n), np.log1p(m), np.log1p(len(lines)), share[0], share[1], share[2], share[3], share[4], share[5], share[6],
            share[7], share[8], share[10], share[9], (n - classes[3]) / max(m, 1), len(distinct) / max(m, 1),
            len(set(lines)) / len(lines), max(distinct.values(), default=0) / max(m, 1), len(tail) / max(m, 1),
            sum(map(bytes.isupper, distinct)) / max(len(distinct), 1), np.log1p(n / len(lines)),
            sum(distinct[w] for w in distinct if len(w) == 1) / max(m, 1)]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and stats of every whole text; null counts as empty text."""
    def run(batches):
        for b in batches:
            rows = [statistics(t) for t in bytes_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "stats"])
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, len(FEATURES))


def _expand(x: np.ndarray, model: dict) -> np.ndarray:
    """Random Fourier features of standardised statistics, with a constant."""
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    cosines = np.cos(z @ model["directions"] + model["phases"]) * np.sqrt(2 / WIDTH)
    return np.hstack([cosines, z, np.ones((len(z), 1))])


def _sum_blobs(batches):
    total = None
    for b in batches:
        for x in b.column("sums").to_pylist():
            total = np.frombuffer(x) + (0 if total is None else total)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def _collected(sums: DataFrame, groups: int = 16) -> np.ndarray | None:
    """Adds one array per partition: first in ``groups`` tasks, then those few arrays on the driver."""
    arrays = [np.frombuffer(r["sums"]) for r in sums.repartition(groups).mapInArrow(_sum_blobs, "sums binary").collect()]
    return np.sum(arrays, axis=0) if arrays else None


def fit(stats: DataFrame, labels: DataFrame, seed: int = 7) -> dict:
    """Model from statistics (doc_id, stats) joined to labels (doc_id, quality).

    Labels of the same document are averaged; null labels are ignored.  Without any
    labelled row the model gives every text 0.5; with one class, that class.
    """
    target = labels.filter("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    rows = written(stats.join(target, "doc_id").select("doc_id", "stats", "y"), "training")
    k = len(FEATURES)

    def moments(batches):
        total = np.zeros(1 + 2 * k)
        for b in batches:
            x = _matrix(b.column("stats"))
            total += np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = _collected(rows.select("stats").mapInArrow(moments, "sums binary"))
    if sums is None or not sums[0]:
        return {"empty": True}
    mean = sums[1:1 + k] / sums[0]
    scale = np.sqrt(np.maximum(sums[1 + k:] / sums[0] - mean * mean, 0))
    rng = np.random.default_rng(seed)
    model = {"mean": mean, "scale": np.where(scale > 1e-9, scale, 1), "directions": rng.normal(0, 1 / SPREAD, (k, WIDTH)),
             "phases": rng.uniform(0, 2 * np.pi, WIDTH), "empty": False}
    d = WIDTH + k + 1

    def fold_of(ids):
        return np.array([(py_crc_mod(i, 1 << 32) >> 8) % FOLDS for i in ids], np.int64)

    def equations(batches):
        total = np.zeros((FOLDS, d + 1, d))
        for b in batches:
            z, y, fold = _expand(_matrix(b.column("stats")), model), b.column("y").to_numpy(), fold_of(b.column("doc_id").to_pylist())
            for f in range(FOLDS):
                at = fold == f
                total[f, :d] += z[at].T @ z[at]
                total[f, d] += z[at].T @ y[at]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    total = _collected(rows.mapInArrow(equations, "sums binary")).reshape(FOLDS, d + 1, d)

    def solve(s):
        return np.linalg.solve(s[:d] + RIDGE * np.eye(d), s[d])

    without = np.stack([solve(total.sum(axis=0) - total[f]) for f in range(FOLDS)])
    model["weights"] = solve(total.sum(axis=0))

    def margins(batches):
        for b in batches:
            fold = fold_of(b.column("doc_id").to_pylist())
            m = (_expand(_matrix(b.column("stats")), model) * without[fold]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(_bin(m)), b.column("y")], names=["bin", "y"])

    found = (rows.mapInArrow(margins, "bin long, y double").groupBy("bin")
             .agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect())    # BINS rows at most
    model["levels"] = _isotonic([r["bin"] for r in found], [r["y"] for r in found], [r["n"] for r in found])
    return model


def _bin(margin: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((margin + 1) / 3 * BINS), 0, BINS - 1).astype(np.int64)


def _isotonic(bins: list[int], sums: list[float], counts: list[int]) -> np.ndarray:
    """Non-decreasing level of every bin: the pooled mean from a pool's first to its last bin, linear between two pools."""
    pools: list[list[float]] = []    # sum, count, first bin, last bin
    for b, s, n in zip(bins, sums, counts):
        pools.append([s, n, b, b])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], last]
    return np.interp(np.arange(BINS), [b for p in pools for b in p[2:]], [p[0] / p[1] for p in pools for _ in p[2:]])


def scores(x: np.ndarray, model: dict) -> np.ndarray:
    """Calibrated scores between 0 and 1 of a matrix of statistics."""
    if model["empty"] or not len(x):
        return np.full(len(x), 0.5)
    return np.clip(model["levels"][_bin(_expand(x, model) @ model["weights"])], 0, 1)


def score_stats(stats: DataFrame, model: dict, modulus: int = 4, held: int = 2, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (1 where score >= ``least``) of every row of statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)    # fixed size

    def run(batches):
        for b in batches:
            s = scores(_matrix(b.column("stats")), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (crc_mod("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, least: float = 0.7,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every whole text, learned from the labels of rows whose crc32(doc_id as text) mod ``modulus`` is not ``held``.

    Statistics are taken once and kept in a small table; labels, language, source and
    id are no inputs.  Null and empty texts get the score of an empty text, long texts count whole.  Repeated rows
    repeat; a repeated id gets every label of its id.  Equal margins have equal scores.  Without rows or labels
    nothing is learned and every score is 0.5.  Other columns are not read, whatever their names.
    """
    stats = written(measure(docs, id_col, text_col), "stats")
    return score_stats(stats, fit_held(stats, labels, modulus, held), modulus, held, least)


def fit_held(stats: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2) -> dict:
    return fit(stats.filter(crc_mod("doc_id", modulus) != held), labels)


def keep_good(docs: DataFrame, model: dict, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``least`` or more.

    Rows are independent: repeated ones stay or go together, null and empty texts are scored as empty, long ones
    whole.  Under a model without labels all scores are 0.5, so nothing is kept.  An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            rows = [statistics(t) for t in bytes_of(b.column(b.schema.get_field_index(text_col)))]
            yield b.filter(pa.array(scores(np.array(rows).reshape(-1, len(FEATURES)), shared.value) >= least))

    return docs.mapInArrow(run, docs.schema)
