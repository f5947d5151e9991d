"""Quality and language models against direct solutions of the same problems."""

import random

import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm import lang_mixture, quality


def test_ridge_weights_equal_a_direct_solve(spark):
    rng = random.Random(21)
    docs = spark.createDataFrame([(k, " ".join("".join(rng.choices("abcDE!", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 80))))
                                  for k in range(300)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, k % 3 % 2) for k in range(0, 300, 2)] + [(4, 1)], "doc_id long, quality int")
    stats = quality.measure(docs)
    model = quality.fit(stats, labels)
    target = {r["doc_id"]: r["y"] for r in labels.groupBy("doc_id").agg({"quality": "avg"}).toDF("doc_id", "y").collect()}
    rows = [(r["stats"], target[r["doc_id"]]) for r in stats.collect() if r["doc_id"] in target]
    x, y = np.array([s for s, _ in rows]), np.array([t for _, t in rows])
    assert np.allclose(model["mean"], x.mean(axis=0), atol=1e-9)
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    z = np.hstack([np.cos(z @ model["directions"] + model["phases"]) * np.sqrt(2 / quality.WIDTH), z, np.ones((len(z), 1))])
    # ridge as least squares with rows sqrt(RIDGE) * identity below: no normal equations
    d = z.shape[1]
    direct = np.linalg.lstsq(np.vstack([z, np.sqrt(quality.RIDGE) * np.eye(d)]), np.concatenate([y, np.zeros(d)]), rcond=None)[0]
    assert np.abs(model["weights"] - direct).max() < 1e-9
    assert (np.diff(model["levels"]) >= 0).all()


def test_random_features_approximate_the_gaussian_kernel(spark):
    rng = np.random.default_rng(22)
    k = len(quality.FEATURES)
    x = rng.normal(0, .6, (40, k))
    wide = 200_000
    directions, phases = rng.normal(0, 1 / quality.SPREAD, (k, wide)), rng.uniform(0, 2 * np.pi, wide)
    z = np.cos(x @ directions + phases) * np.sqrt(2 / wide)
    apart = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-apart / (2 * quality.SPREAD ** 2))).max() < 0.02


@pytest.mark.parametrize("seed", range(5))
def test_levels_equal_brute_force_isotonic(seed):
    rng = np.random.default_rng(seed)
    bins = np.sort(rng.choice(quality.BINS, 60, replace=False))
    counts = rng.integers(1, 9, 60)
    sums = rng.binomial(counts, np.linspace(.2, .8, 60)).astype(float)

    def mean(a, b):
        return sums[a:b + 1].sum() / counts[a:b + 1].sum()

    want = [max(min(mean(a, b) for b in range(k, 60)) for a in range(k + 1)) for k in range(60)]
    levels = quality._isotonic(bins.tolist(), sums.tolist(), counts.tolist())
    assert np.abs(levels[bins] - want).max() < 1e-9
    assert (np.diff(levels) >= -1e-12).all() and len(levels) == quality.BINS


def _model(spark, rng):
    alphabet = {"aa": "abcdefg", "bb": "efghijk", "cc": "uvwxyz"}

    def make(lang, n):
        return " ".join("".join(rng.choices(alphabet[lang], k=4)) for _ in range(n))

    rows = [(k, make(lang, 60), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return lang_mixture.train(df), make, df


def test_mixture_equals_a_search_over_all_shares(spark):
    """Shares of the chosen set against a grid, and the set against the penalised best of all subsets."""
    rng = random.Random(23)
    model, make, _ = _model(spark, rng)
    log_p = model["log_p"].astype(np.float64)

    def best(kinds, counts, pair):
        p, q = np.exp(log_p[pair[0], kinds]), np.exp(log_p[pair[1], kinds])
        grid = np.linspace(0, 1, 4001)
        likelihood = [counts @ np.log(np.maximum(s * p + (1 - s) * q, 1e-300)) for s in grid]
        return max(likelihood), grid[int(np.argmax(likelihood))]

    for n, m in ((50, 0), (70, 30), (50, 50), (20, 80), (97, 3)):
        codes = lang_mixture.trigram_codes((make("aa", n) + " " + make("bb", m)).encode())
        chosen, shares = lang_mixture.mixture(codes, model["log_p"])
        kinds, counts = np.unique(codes, return_counts=True)
        penalty = lang_mixture.OVERLAP * .5 * np.log(len(codes) + 1)
        scored = {(k,): counts @ log_p[k, kinds] for k in range(3)}
        scored |= {pair: best(kinds, counts, pair)[0] - penalty for pair in ((0, 1), (0, 2), (1, 2))}
        top = max(scored, key=scored.get)
        assert tuple(sorted(chosen)) == top
        if len(top) == 2:
            share = shares[chosen.index(top[0])]
            assert abs(share - best(kinds, counts, top)[1]) < 0.01


def test_language_rules_reject_by_evidence(spark):
    rng = random.Random(24)
    model, make, df = _model(spark, rng)
    noise = ["".join(rng.choices("0123 lmnopqrst", k=300)) for _ in range(20)]
    texts = [*noise, "привет мир это другой язык " * 5, None, "", "12 !?", make("aa", 60), make("aa", 5) + " " + make("bb", 5)]
    got = lang_mixture.verdicts(pa.array(texts, pa.string()), model)
    assert got == ["unexplained"] * 21 + ["no_letter"] * 3 + ["kept"] * 2
    assert lang_mixture.keep_identified(df, model).count() == df.count()
    assert lang_mixture.verdicts(pa.array(["abc"]), lang_mixture.train(df.limit(0))) == ["no_letter"]


def test_filters_on_odd_tables(spark):
    """Repeated rows, extra columns with the names an operator uses inside, very long texts and empty tables."""
    rng = random.Random(25)
    model, make, df = _model(spark, rng)
    long = "a" * 1_000_000
    rows = [(1, make("aa", 60), "x", 3, None), (1, make("bb", 60), "x", 3, None), (2, None, None, None, None), (3, "", "y", 1, 2.),
            (4, long, "z", 2, 1.)]
    rows += rows[:1]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stats string, score int, lang_pred double")
    kept = lang_mixture.keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] < 4) == [1, 1, 1]
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, quality int")
    fitted = quality.fit_held(quality.measure(df), labels)
    good = quality.keep_good(docs, fitted, least=0)
    assert good.columns == docs.columns and good.count() == 6
    for stage in (lambda d: lang_mixture.keep_identified(d, model), lambda d: quality.keep_good(d, fitted)):
        assert stage(docs.limit(0)).columns == docs.columns and stage(docs.limit(0)).count() == 0
    assert quality.keep_good(docs, {"empty": True}).count() == 0
