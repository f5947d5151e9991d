"""Filter audit, importance resampling and source mixing against brute force, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations, permutations

import duckdb
import numpy as np
import pytest

from panelspark.llm import filter_audit, importance, mixing

WORDS = "the of and river Stone light walks under green paper seven house music cloud é日本 x9".split()
SCHEMA = "doc_id long, text string, source string, part string, digest int, _source int, rank int, size int, words int"


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    rng = random.Random(3)
    texts = [text_of(rng, rng.randrange(1, 140)) for _ in range(80)]
    texts += [texts[0], texts[0], texts[5], None, "", None, " \t\n ", "ALL CAPS HERE " * 30, "a # b " + texts[3], "one\x0btwo\x0cthree",
              "w" * 5000, " ".join(f"word{i}" for i in range(400)), "naïve—dash and “quotes” " * 20, "x" * 49 + " " + "y" * 48 + " z"]
    rows = [(i, t, [None, "", "a", "b", "é", "hot", "hot", "hot"][i % 8]) for i, t in enumerate(texts)]
    return rows + [(3, texts[3], "hot"), (3, texts[3], "hot"), (3, "other text", "a"), (None, texts[0], "b"), (None, None, "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "p", 1, 2, 3, 4, 5) for r in corpus()], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 3 == 0), int(i % 7 == 0)) for i in range(0, 90, 2)] + [(6, 0, 1), (8, None, None), (None, 1, 1), (9999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# --- filter audit ---------------------------------------------------------------------------------

def brute_audit(rows, marks):
    rows = [(i, t or "", s or "") for i, t, s in rows]
    facts = []
    for i, t, part in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {x for x, bad in {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": any(j is not None and i is not None and j < i and u == t for j, u, _ in rows)}.items() if bad}
        facts.append((part, failed, any(m[0] == i and m[1] == 1 for m in marks if i is not None),
                      any(m[0] == i and m[2] == 1 for m in marks if i is not None)))
    out, shapley = {}, Counter()
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                here = [f for f in own if x in f[1] and not f[1] & set(order[:step - 1])]
                shapley[part, x] += len(here)
                out[part, "".join(order), step] = (
                    sum(not f[1] & set(order[:step]) for f in own), len(here), sum(x in f[1] for f in own) - len(here),
                    sum(f[1] == {x} for f in own), sum(f[2] for f in here), sum(f[3] for f in here))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


def test_audit_matches_brute_force(docs, labels):
    got = audit_rows(filter_audit.audit_filters(docs, labels))
    want = brute_audit(corpus(), [tuple(r) for r in labels.collect()])
    assert len(got) == 600 * len({s or "" for _, _, s in corpus()})
    assert got == want


def test_audit_sql_twin(docs, labels):
    ids = docs.filter("doc_id IS NOT NULL")
    con = duckdb.connect()
    con.register("documents", ids.select("doc_id", "text", "source").toPandas())
    con.register("labels", labels.toPandas())
    columns = "part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley"
    want = {r[:3]: r[3:] for r in con.execute(f"SELECT {columns} FROM ({filter_audit.SQL})").fetchall()}
    assert audit_rows(filter_audit.audit_filters(ids, labels)) == want


def test_audit_of_nothing_and_without_labels(docs, labels):
    assert filter_audit.audit_filters(docs.limit(0), labels).count() == 0
    none = filter_audit.audit_filters(docs, labels.limit(0)).selectExpr("sum(good_lost) g", "sum(toxic_lost) t").first()
    assert (none["g"], none["t"]) == (0, 0)


def test_one_text_in_many_rows(spark, labels):
    hot = spark.range(3000).selectExpr("id AS doc_id", "repeat('same words again ', 40) AS text", "'s' AS source")
    got = audit_rows(filter_audit.audit_filters(hot, labels))
    assert got["s", "EABCD", 1][:2] == (1, 2999) and got["s", "BEACD", 1][:2] == (0, 3000)


def test_positional_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 1001):
        words, times = rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(1, 1000, n)
        want = [sum(int(t) for w, t in zip(words, times) if int(w) >> p & 1) for p in range(32)]
        assert filter_audit.positional_counts(words, times).tolist() == want


# --- importance resampling ------------------------------------------------------------------------

def features(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_resample(rows, target, buckets, share=25, least=20):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets
    raw, wanted = Counter(), Counter()
    for _, t, _ in rows:
        raw.update(map(bucket, features(t)))
    for t in target:
        wanted.update(map(bucket, features(t)))
    s_all, t_all = sum(raw.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, t, _ in rows:
        found = features(t)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))))
    able = sorted((r for r in out if r[1] >= 2 * least - 1), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    ranks = {}
    for place, r in enumerate(able[:share * len(able) // 100], 1):
        ranks.setdefault(r, []).append(place)
    return sorted([(*r, ranks[r].pop(0) if ranks.get(r) else None) for r in out], key=str)


@pytest.mark.parametrize("buckets", [10_000, 13])
def test_resample_matches_brute_force(spark, docs, buckets):
    target = ["the river walks under paper", None, "", "Green MUSIC, green music; cloud!", "seven " * 30]
    df = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in importance.resample(docs, df, buckets).collect()), key=str)
    assert got == brute_resample(corpus(), target, buckets)


def test_resample_of_nothing(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(docs.limit(0), none).count() == 0
    assert sorted((tuple(r) for r in importance.resample(docs, none).collect()), key=str) == brute_resample(corpus(), [], 10_000)


def test_small_blocks_and_small_dictionary(monkeypatch):
    """Pairs over the edges of blocks, long words, and a dictionary that starts anew."""
    monkeypatch.setattr(importance, "BLOCK_BYTES", 40)
    monkeypatch.setattr(importance, "DICTIONARY_BYTES", 60)
    rng = random.Random(2)
    texts = [text_of(rng, rng.randrange(0, 60)) for _ in range(30)] + ["", "q" * 200 + " a " + "r" * 90 + " b", "ü" * 30 + "-" + "v" * 48]
    got = [Counter() for _ in texts]
    for doc, found in importance.bucket_runs([t.encode() for t in texts], importance.Scanner(), 997):
        for d, f in zip(doc.tolist(), found.tolist()):
            got[d][f] += 1
    assert got == [Counter(zlib.crc32(f.encode()) % 997 for f in features(t)) for t in texts]


def test_long_text_of_one_word_and_of_many():
    texts = ["z" * 1_000_000, " ".join(f"w{i}" for i in range(200_000))]
    counted = [0, 0]
    for doc, _ in importance.bucket_runs([t.encode() for t in texts], importance.Scanner(), 10_000):
        for d in (0, 1):
            counted[d] += int((doc == d).sum())
    assert counted == [1, 399_999]


def test_joined_crc():
    rng = random.Random(4)
    a = [rng.randbytes(rng.randrange(0, 20)) for _ in range(200)]
    b = [rng.randbytes(rng.randrange(0, 3000)) for _ in range(200)]
    got = importance.joined_crc(np.array([zlib.crc32(x) for x in a], np.uint32), np.array([zlib.crc32(x) for x in b], np.uint32),
                                np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


# --- mixing ---------------------------------------------------------------------------------------

def best_sum(lengths, counts, budget):
    items = [n for n, c in zip(lengths, counts) for _ in range(c)]
    return max(sum(s) for k in range(len(items) + 1) for s in combinations(items, k) if sum(s) <= budget)


def test_subset_sum_is_the_best_of_all_subsets():
    rng = random.Random(6)
    for _ in range(150):
        lengths = rng.sample(range(1, 40), rng.randrange(1, 5))
        counts = [rng.randrange(0, 4) for _ in lengths]
        budget = rng.randrange(0, sum(n * c for n, c in zip(lengths, counts)) + 1)
        for taken in (mixing.subset_sum(lengths, counts, budget), mixing.fit_budget(lengths, counts, budget)):
            assert all(0 <= t <= c for t, c in zip(taken, counts))
            assert sum(n * t for n, t in zip(lengths, taken)) == best_sum(lengths, counts, budget)


def test_large_budgets_are_met_and_keep_the_mix_of_lengths():
    rng = random.Random(7)
    lengths = list(range(1, 3000, 7))
    counts = [rng.randrange(0, 400) for _ in lengths]
    whole = sum(n * c for n, c in zip(lengths, counts))
    for budget in (whole // 3, whole // 2 + 1, whole - 1, whole, 0):
        taken = mixing.fit_budget(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts)) and sum(n * t for n, t in zip(lengths, taken)) == budget
    taken = mixing.fit_budget(lengths, counts, whole // 3)
    assert 0.3 < sum(taken) / sum(counts) < 0.37    # not all from the short or the long ones


def test_documents_longer_than_the_program_is_wide():
    taken = mixing.fit_budget([900, 1000, 1100], [50, 50, 50], 70_000, reserve=500, widest=800)
    left = 70_000 - sum(n * t for n, t in zip([900, 1000, 1100], taken))
    assert 0 <= left < 900


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    fixed, budget = {}, share * sum(sizes.values())
    while len(fixed) < len(names):
        free = [s for s in names if s not in fixed]
        level = (budget - sum(fixed.values())) / sum(weight[s] for s in free)
        over = {s: most * sizes[s] for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= over
    return fixed


def test_mix(docs):
    rows = [r.asDict() for r in mixing.mix_sources(docs).collect()]
    size = Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in corpus())
    assert Counter((r["doc_id"], r["size"]) for r in rows) == size
    sources: dict = {}
    for _, t, s in corpus():
        sources[s] = sources.get(s, 0) + len((t or "").encode().split())
    want = {(sources[s], round(t, 6)) for s, t in brute_targets(sources).items()}
    assert {(r["source_size"], round(r["target"], 6)) for r in rows} == want
    taken: dict = {}
    for r in rows:
        taken.setdefault((r["source_size"], r["target"]), []).append((r["size"], r["taken"]))
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    for (whole, target), own in taken.items():
        sums = {0}
        for size, _ in own:
            sums |= {s + size for s in sums}
        repeats = round(target) // whole
        assert sum(t for _, t in own) == repeats * whole + max(s for s in sums if s <= round(target) - repeats * whole)
    again = mixing.mix_sources(docs.repartition(3, "text")).collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.mix_sources(docs).collect())


def test_targets_of_many_sources(spark):
    rng = random.Random(8)
    for n in (1, 2, 5, 40):
        sizes = {f"s{i}": rng.choice([0, 1, rng.randrange(1, 10 ** rng.randrange(1, 7))]) for i in range(n)} | {None: 55, "": 3}
        df = spark.createDataFrame([(s is None, s or "", v) for s, v in sizes.items()], "_unnamed boolean, _source string, size long")
        got = {None if r["_unnamed"] else r["_source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9) for s in want)


def test_mix_of_nothing_of_empty_texts_and_of_one_hot_length(spark, docs):
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a"), (2, " ", "a")], "doc_id long, text string, source string")
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.mix_sources(blank).collect()} == {(0, 0.0, 0)}
    hot = spark.range(4000).selectExpr("if(id < 2000, 1, id) AS doc_id", "'five words in each text' AS text",
                                       "if(id % 4 = 0, 'a', if(id % 4 = 1, 'b', 'c')) AS source")
    rows = mixing.mix_sources(hot).collect()
    for whole, target in {(r["source_size"], r["target"]) for r in rows}:
        assert 0 <= target - sum(r["taken"] for r in rows if (r["source_size"], r["target"]) == (whole, target)) < 5
