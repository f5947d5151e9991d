"""Ids that are repeated with unrelated texts."""

import random

from panelspark.llm import simhash


def _text(rng):
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(40))


def test_every_group_of_a_repeated_id_keeps_its_own_text(spark):
    rng = random.Random(5)
    a, b, c, d = (_text(rng) for _ in range(4))
    near = a + " onemore"
    df = spark.createDataFrame(
        [(5, a, "A"), (9, a, "A"), (5, near, "A"), (5, b, "B"), (7, b, "B"), (5, b, "B"),    # 5 stands for two groups
         (3, c, "C"), (6, c, "C"), (6, d, "D"),                                                # 6 lost one group and stands for another
         (None, d, "none")], "doc_id long, text string, group string")
    kept = [(r["doc_id"], r["group"]) for r in simhash.keep_one(df).collect()]
    assert sorted(kept, key=str) == sorted([(5, "A"), (5, "B"), (3, "C"), (6, "D"), (None, "none")], key=str)


def test_a_column_named_like_an_own_one(spark):
    rng = random.Random(6)
    a, b = _text(rng), _text(rng)
    for value in ("text", 7):
        df = spark.createDataFrame([(5, a, value), (5, b, value), (7, b, value)], f"doc_id long, text string, _node {'string' if value == 'text' else 'int'}")
        got = simhash.keep_one(df)
        assert got.columns == df.columns
        assert sorted((r["doc_id"], r["text"] == a, r["_node"]) for r in got.collect()) == [(5, False, value), (5, True, value)]


def test_templates_below_the_threshold_cost_no_edges(spark):
    """A large family of texts that share most shingles but are not alike: every pair is checked, none leaves its tile."""
    import numpy as np
    rng = random.Random(7)
    base = _text(rng).split() * 3
    texts = []
    for _ in range(150):
        words = list(base)
        for k in rng.sample(range(len(words)), 6):
            words[k] = "".join(rng.choices("klmnop", k=6))
        texts.append(" ".join(words).encode())
    sets = [simhash.shingle_set(t, 5) for t in texts]
    wide = [simhash.wide_fingerprint(h)[0] for _, h in sets]
    node = np.array([d for d, _ in sets], np.uint64).view(np.int64)
    bits = np.frombuffer(b"".join(wide), "<u8").reshape(-1, simhash.WIDE)
    alike = {(i, j) for i in range(150) for j in range(i + 1, 150)
             if len(np.intersect1d(sets[i][1], sets[j][1])) >= 0.6 * len(np.union1d(sets[i][1], sets[j][1]))}

    import pyarrow as pa
    hashes = pa.array([h.view(np.int64) for _, h in sets], pa.list_(pa.int64()))
    def batch(at, end):
        n = end - at
        return pa.RecordBatch.from_arrays(
            [pa.array([1] * n), pa.array(node[at:end]), pa.array([0] * n), pa.array([w for w in wide[at:end]], pa.binary()),
             pa.array(node[at:end]), hashes.slice(at, n)], names=["pair", "node", "tile", "bits", "part", "hashes"])

    def edges(least):
        out = [b for b in simhash._checked_links(512, least)(iter([batch(0, 70), batch(70, 150)]))]
        place = {n: i for i, n in enumerate(node.tolist())}
        return {tuple(sorted((place[a], place[b]))) for b_ in out for a, b in zip(b_.column("a").to_pylist(), b_.column("b").to_pylist())}

    assert not edges(0.95)
    found = edges(0.6)
    assert found <= alike and len(found) < 150

    def groups(links):
        root = list(range(150))
        for _ in range(150):
            for i, j in links:
                root[i] = root[j] = min(root[i], root[j])
        return root
    assert groups(found) == groups(alike)
    assert simhash._apart(bits, np.zeros(150, int)).shape == (150, 150)
