"""Language identification as a mixture of languages per document.

Training counts hashed byte trigrams per language over all labelled documents; the
table is languages x ``BUCKETS`` whatever the corpus size.  A document is explained
as a mixture of languages: expectation-maximisation on its trigram counts estimates
the proportions.  The language set grows greedily from the best single language and
a further language must raise the log likelihood by more than its penalty.

The log likelihood is concave in the proportions, so the gradient at the current
mixture bounds what any further language can gain.  Where the bound is
below the penalty, as for most documents in one language, no iteration runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bytes_of, crc_mod, id_and_text

BUCKETS = 1 << 16
SMOOTH = 0.1            # added to every count
OVERLAP = 3             # neighbouring trigrams share bytes, so each counts for a third of its evidence
UNDETERMINED = "und"
MAX_LANGUAGES = 1024    # the model is languages x BUCKETS floats; more distinct labels are refused, not dropped
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def trigram_codes(text: bytes) -> np.ndarray:
    """Bucket of every byte trigram of the folded text: a-z and bytes of other scripts, all else one space."""
    folded = b" " + b" ".join(text.translate(_FOLD).split()) + b" "
    b = np.frombuffer(folded, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    return ((b[:-2] * np.uint32(65599 * 65599 % (1 << 32)) + b[1:-1] * np.uint32(65599) + b[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict:
    """Log probabilities per language of all given documents with a language and a text.

    Languages are in alphabetical order.  Without any training row the model has no languages.
    """
    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), bytes_of(b.column("text"))):
                codes = trigram_codes(text)
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                if len(codes) > 2000:
                    counts[lang] += np.bincount(codes, minlength=BUCKETS)
                else:
                    np.add.at(counts[lang], codes, 1)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                              pa.array(c[at])], names=["lang", "bucket", "n"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sums = (rows.filter("lang is not null and text is not null").mapInArrow(run, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang")
            .agg(F.collect_list(F.struct("bucket", "n")).alias("cells")))    # at most BUCKETS cells each
    found = sums.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct languages")
    langs = sorted(r["lang"] for r in found)
    table = np.full((len(langs), BUCKETS), SMOOTH)
    for r in found:
        table[langs.index(r["lang"]), [c["bucket"] for c in r["cells"]]] += [c["n"] for c in r["cells"]]
    return {"langs": langs, "log_p": np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)}


def mixture(codes: np.ndarray, log_p: np.ndarray, rounds: int = 50) -> tuple[list[int], np.ndarray]:
    """Chosen languages and their proportions for one document's trigrams."""
    if len(codes) > 20000:
        counts = np.bincount(codes, minlength=log_p.shape[1])
        kinds = np.flatnonzero(counts)
        counts = counts[kinds].astype(np.float64)
    else:
        kinds, counts = np.unique(codes, return_counts=True)
        counts = counts.astype(np.float64)
    logs = log_p[:, kinds].astype(np.float64)
    total = counts.sum()
    single = logs @ counts
    chosen = [int(single.argmax())]
    shares = np.ones(1)
    top = logs.max(axis=0)
    dens = np.exp(logs - top)                       # languages x kinds, scaled per kind
    penalty = OVERLAP * 0.5 * np.log(total + 1)
    likelihood = single[chosen[0]] - top @ counts   # relative to the best language of every kind
    while len(chosen) < len(log_p):
        mix = shares @ dens[chosen]
        gain = dens @ (counts / np.maximum(mix, 1e-300)) - total
        gain[chosen] = -np.inf
        extra = int(gain.argmax())
        if gain[extra] <= penalty:                  # concave: nothing beyond the gradient can be gained
            break
        trial = [*chosen, extra]
        pi = np.append(shares * 0.9, 0.1)
        d = dens[trial]
        for _ in range(rounds):
            q = np.maximum(pi @ d, 1e-300)
            new = pi * (d @ (counts / q)) / total
            done = np.abs(new - pi).max() < 1e-4
            pi = new
            if done:
                break
        fitted = np.log(np.maximum(pi @ d, 1e-300)) @ counts
        if fitted - likelihood <= penalty:
            break
        chosen, shares, likelihood = trial, pi, fitted
    return chosen, shares


def classify(texts: pa.Array, model: dict) -> list[tuple[str, float, list[str]]]:
    """(language, score, language set) of every text; ``und`` and 0 where a text is null or has no letter."""
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_pylist()
    langs, out = model["langs"], []
    for text, has in zip(bytes_of(texts), letters):
        if not has or not langs:
            out.append((UNDETERMINED, 0.0, []))
            continue
        chosen, shares = mixture(trigram_codes(text), model["log_p"])
        order = sorted(range(len(chosen)), key=lambda k: (-shares[k], langs[chosen[k]]))
        out.append((langs[chosen[order[0]]], float(min(1.0, shares[order[0]])), [langs[chosen[k]] for k in order]))
    return out


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and languages of every whole text.

    ``score`` is the share of the predicted language in the document's mixture;
    ``languages`` is the chosen set, largest share first.  A text that is null or has no
    letter, and any text under a model without languages, gives ``und``, 0 and no
    set.  Ties go to the alphabetically first language.  Rows are independent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)    # languages x BUCKETS floats

    def run(batches):
        for b in batches:
            found = classify(b.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[2] for f in found], pa.list_(pa.string()))], names=["doc_id", "lang_pred", "score", "languages"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, lang_pred string, score double, languages array<string>")


def explained(codes: np.ndarray, chosen: list[int], shares: np.ndarray, log_p: np.ndarray) -> bool:
    """Whether the mixture explains the trigrams no worse than equal chances for every bucket, up to the penalty of a language."""
    if not len(codes):
        return False
    kinds, counts = np.unique(codes, return_counts=True)
    fitted = counts @ np.log(shares @ np.exp(log_p[np.ix_(chosen, kinds)].astype(np.float64)))
    return bool(fitted + OVERLAP * 0.5 * np.log(len(codes) + 1) >= -len(codes) * np.log(log_p.shape[1]))


def verdicts(texts: pa.Array, model: dict, least: float = 0.25) -> list[str]:
    """``kept`` or the first rule that rejects a text: ``no_letter``, ``unexplained`` (by any learned language), ``mixed``."""
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_pylist()
    out = []
    for text, has in zip(bytes_of(texts), letters):
        if not has or not model["langs"]:
            out.append("no_letter")
            continue
        codes = trigram_codes(text)
        chosen, shares = mixture(codes, model["log_p"])
        out.append("unexplained" if not explained(codes, chosen, shares, model["log_p"])
                   else "kept" if shares.max() >= least else "mixed")
    return out


def keep_identified(docs: DataFrame, model: dict, least: float = 0.25, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is identified.

    A text goes if it is null or has no letter, if the learned languages explain its trigrams worse than chance would
    (letter noise, scripts that were not learned), or if its leading language has a share below ``least``.  Rows are
    independent: repeated ones stay or go together.  Long texts count whole.  A model without languages identifies
    nothing.  An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)    # languages x BUCKETS floats

    def run(batches):
        for b in batches:
            found = verdicts(b.column(b.schema.get_field_index(text_col)), shared.value, least)
            yield b.filter(pa.array([f == "kept" for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """The rows that may be learned from: crc32(doc_id as text) mod ``modulus`` is not ``held_out``."""
    return docs.filter(crc_mod("doc_id", modulus) != held_out)
