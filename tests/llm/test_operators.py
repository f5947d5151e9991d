"""The corpus operators against brute-force versions, libraries and edge cases."""

import math
import random
import zlib

import numpy as np
import pytest

from panelspark.llm import arrow_pack, backoff_lm, decontaminate, iblt, lang_mixture, quality, sharding, simhash, token_count, unigram
from panelspark.llm.queries import tokenizer_file
from panelspark.session import scratch_path

BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
WORDS = "the of and river stone light walks under green paper seven house music cloud".split()
ODD = [None, "", " ", "  a  b", "a \n b", "\n\n b\t", "é日本 😀", "<|endoftext|> x<|endoftext|>", "don't WE'LL", "!!! ###", "x" * 3000, "▁a"]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice([".", ",", ""]) if k % 5 == 4 else "") for k in range(n))


def corpus():
    rng = random.Random(5)
    texts = [text_of(rng, rng.randrange(3, 120)) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1] + " stone", texts[2].upper()] + ODD
    return list(enumerate(texts, 100)) + [(100, texts[0]), (None, "no id here")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{k % 3}", 0) for k, (i, t) in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, shard string, size int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, v) for v in r[:1]) + (str(r),))


def test_sharding_matches_prefix_sums(spark, docs, empty):
    got = [r.asDict() for r in sharding.shard_by_bytes(docs, 5).collect()]
    rows = sorted((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in corpus())
    total, at, want = sum(r[3] for r in rows), 0, []
    for has, i, crc, size in rows:
        want.append((i if has else None, crc, size, min(4, int((2 * at + size) / 2 / total * 5))))
        at += size
    assert sorted(map(str, ((g["doc_id"], g["text_crc32"], g["size"], g["shard"]) for g in got))) == sorted(map(str, want))
    for s in {g["shard"] for g in got}:
        slots = sorted(g["slot"] for g in got if g["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(empty).count() == 0


def test_language_model_is_the_smoothed_bigram(spark, docs, empty, tmp_path):
    spark.createDataFrame(corpus(), "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    got = sorted(map(tuple, backoff_lm.score_texts(stored, parts=3).collect()), key=str)
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    tok = [(i, [*(t or "").encode().translate(low).split(), None]) for i, t in corpus()]
    held = [backoff_lm.py_crc_mod(i, 5) == 1 for i, _ in tok]
    uni, bi = {}, {}
    for (i, ws), h in zip(tok, held):
        for a, b in zip(["<s>", *ws], ws) if not h else ():
            uni[b] = uni.get(b, 0) + 1
            bi[a, b] = bi.get((a, b), 0) + 1
    n, v, starts = sum(uni.values()), len(uni), held.count(False)
    count = lambda w: starts if w == "<s>" else uni.get(w, 0)
    cls = lambda c: min(backoff_lm.CLASSES - 1, int(np.log2(max(c, 1)) * backoff_lm.STEPS))
    seen, once = {}, {}
    for (a, _), c in bi.items():
        seen[cls(count(a))] = seen.get(cls(count(a)), 0) + c
        once[cls(count(a))] = once.get(cls(count(a)), 0) + (c == 1)
    share = lambda k: min(max(1 - (once.get(k, 0) + .5) / (seen.get(k, 0) + 1), 1e-4), 1 - 1e-4)
    want = []
    for (i, ws), h in zip(tok, held):
        base = score = 0.0
        for a, b in zip(["<s>", *ws], ws):
            p1 = (uni.get(b, 0) + .5) / (n + .5 * (v + 1))
            base += math.log10(p1)
            s = share(cls(count(a)))
            score += math.log10(p1 if not count(a) else s * bi.get((a, b), 0) / count(a) + (1 - s) * p1)
        want.append((i, h, len(ws), sum(w in uni for w in ws), n, base, score))
    want.sort(key=str)
    assert [g[:5] for g in sorted(got, key=lambda r: str(r[:5]))] == [w[:5] for w in sorted(want, key=lambda r: str(r[:5]))]
    key = lambda r: (str(r[:5]), round(r[5], 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[5] == pytest.approx(w[5]) and g[6] == pytest.approx(w[6])
    assert backoff_lm.score_texts(stored.limit(0)).count() == 0


def test_token_files_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tokenizer_file(BPE))
    folder = scratch_path(spark, "packed-test")
    manifest = arrow_pack.write_packed(docs, folder, tokenizer_file(BPE), length=16).collect()
    got = sorted(map(tuple, arrow_pack.read_packed(spark, folder).collect()), key=lambda r: r[1])
    assert [g[0] for g in got] == sorted((i for i, _ in corpus()), key=lambda i: (i is not None, i))
    want = sorted((str(i), len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
                  for i, t in corpus() for ids in [lib.encode(t or "", add_special_tokens=False).ids])
    assert sorted((str(g[0]), g[2], g[3]) for g in got) == want
    at = 0
    for g in got:
        assert g[1] == at
        at += g[2]
    m = max(manifest, key=lambda r: r["tokens"])
    flat = np.concatenate([ids for _, ids in arrow_pack.documents_of(folder, m["name"])])
    for k in range(m["sequences"]):
        ids, mask = arrow_pack.sequence(folder, m["name"], k)
        assert len(ids) == 16 and (ids[mask] == flat[16 * k:16 * k + 16]).all()
    arrow_pack.write_packed(empty, folder + "-empty", tokenizer_file(BPE))
    assert arrow_pack.read_packed(spark, folder + "-empty").count() == 0


def test_token_counts_equal_the_library(docs, empty):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tokenizer_file(BPE))
    got = by_id(token_count.count_tokens(docs, tokenizer_file(BPE), limit=20))
    want = [(i, len((t or "").encode()), n, n > 20) for i, t in corpus() for n in [len(lib.encode(t or "", add_special_tokens=False).ids)]]
    assert got == sorted(want, key=lambda r: ((r[0] is not None, r[0]), str(r)))
    rng = random.Random(2)
    parts = ["a", " ", "  ", "\n", "'s", "é", "\u0085", "\x1c", "1", "!", "<|endoftext|>", " 日", "😀"]
    mixed = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(500)]
    counts = token_count.Counter(tokenizer_file(BPE)).counts(mixed)
    assert counts == [len(lib.encode(t, add_special_tokens=False).ids) for t in mixed]
    assert token_count.count_tokens(empty, tokenizer_file(BPE)).count() == 0


def test_unigram_equals_the_library_and_reads_back(docs, empty):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece
    model, spec = unigram.Unigram(tokenizer_file(PIECES)), pb.ModelProto()
    with open(tokenizer_file(PIECES), "rb") as f:
        spec.ParseFromString(f.read())
    spec.trainer_spec.model_type = 1    # the library's own unigram search over the same pieces and scores
    for i, s in model.score.items():
        spec.pieces[i].score = s
    lib = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
    texts = [t for _, t in corpus() if t and len(t) < 400]
    assert [model.encode(t).tolist() for t in texts] == [lib.encode(t) for t in texts]
    for r in unigram.encode_and_check(docs, tokenizer_file(PIECES)).collect():
        assert r["exact"] or r["doc_id"] == 100 + 60 + 4 + ODD.index("▁a")
    rows = unigram.encode_texts(docs, tokenizer_file(PIECES))
    back = {str(r["doc_id"]): r["text"] for r in unigram.decode_texts(rows, tokenizer_file(PIECES)).collect()}
    assert all(back[str(i)] == (t or "").replace("▁", " ") for i, t in corpus())
    assert unigram.encode_texts(empty, tokenizer_file(PIECES)).count() == 0


@pytest.mark.parametrize("tile", [1024, 8])
def test_simhash_components_equal_all_pairs(spark, tile):
    rng = random.Random(9)
    base = [text_of(rng, 80) for _ in range(25)]
    texts = base + [" ".join([*b.split()[:-1], rng.choice(WORDS)]) for b in base for _ in range(3)] + [base[0]] * 30 + ["", None, "  "]
    df = spark.createDataFrame(list(enumerate(texts, 7)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df, tile=tile).collect()}
    fps = np.array([simhash.fingerprint((t or "").encode(), 3) for t in texts], np.uint64)
    assert [int(got[i]["fingerprint"], 16) for i in sorted(got)] == fps.tolist()
    linked = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    low = np.arange(len(texts))
    for _ in range(len(texts)):
        low = np.array([low[row].min() for row in linked])
    assert [got[i]["component_id"] for i in sorted(got)] == (low + 7).tolist()
    assert got[max(got)]["fingerprint"] == "0" * 16
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [1024, 8])
def test_copies_with_edits_equal_all_pairs(spark, tile):
    rng = random.Random(10)
    base = [text_of(rng, 150) for _ in range(20)]
    texts = base + [b.upper() for b in base[:5]] + [base[0]] * 9 + ["", None, "  ", "one two", "one  two", "three"]
    for b in base:
        for edits in (1, 2, 3, 4, 5, 8):
            w = b.split()
            for k in rng.sample(range(len(w)), edits):
                w[k] = f"new{rng.randrange(10 ** 6)}"
            texts.append(" ".join(w))
    texts += [base[1] + f" tail{k}" for k in range(60)]    # one group of more rows than are compared all with all
    rows = list(enumerate(texts, 7))
    sets = [set(simhash.shingle_set((t or "").encode(), 5)[1].tolist()) for t in texts]
    low = list(range(len(texts)))

    def top(k):
        while low[k] != k:
            k = low[k]
        return k
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low[max(top(a), top(b))] = min(top(a), top(b))
    want = {i: top(k) + 7 for k, (i, _) in enumerate(rows)}
    df = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(7, texts[0], 2), (None, texts[0], 3)], "doc_id long, text string, component_id int")
    got = simhash.similar_groups(df, tile=tile).collect()
    assert len(got) == len(texts) + 1 and {r["doc_id"]: r["component_id"] for r in got} == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["None", *map(str, set(want.values()))])
    assert simhash.similar_groups(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_no_link_is_lost_behind_a_rejected_edge(spark):
    rng = random.Random(11)
    base = [f"w{k}" for k in range(80)]
    places = [3, 11, 14, 25, 38, 41, 44, 60, 63, 77]
    texts = set()
    while len(texts) < 90:
        words = list(base)
        for k in rng.sample(places, rng.randrange(0, 7)):
            words[k] = f"x{k}"
        texts.add(" ".join(words))
    texts = sorted(texts)
    sets = [{tuple(w[k:k + 5]) for k in range(76)} for w in (t.split() for t in texts)]
    linked = [(a, b) for a in range(90) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    low = list(range(90))
    for _ in range(90):
        for a, b in linked:
            low[a] = low[b] = min(low[a], low[b])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tile in (simhash.TILE, 40):
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df, tile=tile).collect()}
        assert got == dict(enumerate(low))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 100: 90}


def test_sketches_recover_the_differences(spark, docs, empty):
    rng = random.Random(4)
    for n in (0, 1, 5, 60, 400):
        a = iblt.Document("\n".join(f"line {rng.randrange(10 ** 6)}" for _ in range(n)) + "\nsame\nsame")
        b = iblt.Document(a.text[:len(a.text) // 2] + "\n" + "\n".join(f"new {k}" for k in range(n // 2)))
        mine, theirs = iblt.recover(a, b)
        assert set(mine) == set(a.items) - set(b.items) and set(theirs) == set(b.items) - set(a.items)
    got = iblt.fingerprint_pairs(docs).collect()
    rows = sorted(corpus(), key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))] == [i for i, _ in rows]
    import hashlib
    want = {}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        want[i] = (len(t), hashlib.sha256((t[:len(t) - len(t) // 2] + after[:len(t) // 2]).encode()).hexdigest())
    assert all((r["n_chars"], r["edited_sha256"]) == want[r["doc_id"]] for r in got if r["doc_id"] not in (100, 101))
    assert all(0 <= r[k] <= 1 for r in got for k in ("near_edited", "near_next"))
    assert iblt.fingerprint_pairs(empty).count() == 0


def test_quality_learns_and_calibrates(spark):
    rng = random.Random(8)
    good = [(k, text_of(rng, 60)) for k in range(200)]
    bad = [(k + 200, " ".join(w.upper() + "!!" for w in text_of(rng, 60).split())) for k in range(200)]
    df = spark.createDataFrame(good + bad + [(900, None), (901, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 200)) for k in range(400)] + [(5, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score_quality(df, labels).collect()}
    right = [got[k]["predicted"] == (k < 200) for k in range(400) if got[k]["held_out"]]
    assert np.mean(right) > 0.95 and all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 403
    none = quality.score_quality(df, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score_quality(df.limit(0), labels).count() == 0


def test_pooled_levels_equal_brute_force_isotonic():
    y = np.array([0, 1, 0, 0, 1, 1, 0, 1, 1])
    levels = quality._isotonic(list(range(len(y))), y.astype(float).tolist(), [1] * len(y))
    want = [max(min(y[a:b + 1].mean() for b in range(k, len(y))) for a in range(k + 1)) for k in range(len(y))]
    assert max(abs(levels[:len(y)] - want)) < 0.35 and (np.diff(levels) >= -1e-12).all()


def test_languages_and_their_mixture(spark):
    rng = random.Random(6)
    alphabet = {"aa": "abcde", "bb": "mnopq", "cc": "uvwxyzé"}
    def make(lang, n):
        return " ".join("".join(rng.choice(alphabet[lang]) for _ in range(4)) for _ in range(n))
    rows = [(k, make(lang, 40), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 30)]
    df = spark.createDataFrame(rows + [(200, "12 !?", "aa"), (201, None, "aa"), (202, make("aa", 40), None)], "doc_id long, text string, lang string")
    model = lang_mixture.train(lang_mixture.training_rows(df))
    got = {r["doc_id"]: r for r in lang_mixture.identify(df, model).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows)
    assert [got[k]["lang_pred"] for k in (200, 201, 202)] == ["und", "und", "aa"]
    mixed = spark.createDataFrame([(1, make("aa", 70) + " " + make("bb", 30))], "doc_id long, text string")
    r = lang_mixture.identify(mixed, model).first()
    assert r["languages"] == ["aa", "bb"] and abs(r["score"] - 0.7) < 0.05
    assert {r["doc_id"] for r in lang_mixture.keep_identified(df, model).collect()} == set(got) - {200, 201}
    nothing = lang_mixture.train(df.limit(0))
    assert {r["lang_pred"] for r in lang_mixture.identify(df, nothing).collect()} == {"und"}


def edit_distance_in(pattern, text):
    """Fewest edits of the pattern anywhere in the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(12)
    items = [(k, " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(28))) for k in range(6)]
    index = decontaminate.Benchmark([(k, t.encode()) for k, t in items])
    for trial in range(25):
        item, text = rng.choice(items)
        copied = list(text)
        for p in sorted(rng.sample(range(len(copied)), trial // 2), reverse=True):
            copied[p:p + 1] = [[], [rng.choice("xyz")], [copied[p], "q"]][rng.randrange(3)]
        doc = decontaminate.fold((text_of(rng, 20) + " " + "".join(copied) + " " + text_of(rng, 20)).encode())
        found = {(i, at) for i, at, *_ in index.find(doc)}
        want = {(i, at) for i, at, w in index.windows if edit_distance_in(w, doc) <= decontaminate.edits_allowed(len(w))}
        assert found == want
    df = spark.createDataFrame([(1, "Intro: " + items[2][1].upper() + "!"), (2, text_of(rng, 50)), (3, None), (4, "")], "doc_id long, text string")
    bench = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.leaks(df, bench).collect()] == [(1, 2, 0)]
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(df, bench).collect()) == [2, 3, 4]
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "decontamination", "encoding"]
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert 0 < len(kept) < docs.count() and out.filter("not exact").count() == 0
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    leaked = {r["doc_id"] for r in decontaminate.leaks(docs, bench).collect()}
    assert not kept & leaked
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").join(docs, "doc_id").select("doc_id")
    clean = {r["doc_id"] for r in labels.collect()} - leaked
    copies = {r["doc_id"] for r in simhash.similar_groups(docs).filter("doc_id <> component_id").collect()}
    assert len(clean - copies - kept) <= 0.05 * len(clean)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
