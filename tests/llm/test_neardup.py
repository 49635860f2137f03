import random

import numpy as np
import pytest
from docgraph.llm import graph, neardup, sketch, vectors

from .helpers import odd, thue_morse


def shingles(text, words):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(texts, words, percent):
    sets = {i: shingles(t, words) for i, t in texts.items()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def run(spark, texts, **kw):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, **kw).collect()}


def family(rng, n, size, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(size)] = f"x{rng.randrange(5000)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_against_brute_force(spark, words, percent):
    rng = random.Random(words)
    texts = [t for size, n in ((8, 12), (30, 25), (120, 40), (400, 15)) for t in family(rng, n, size, max(1, size // 25))]
    texts += ["", " \n", "one", "ONE", "two words", "Two\tWORDS", "a b c", "a b c d"] + texts[:4]
    rng.shuffle(texts)
    texts = {i * 7: t for i, t in enumerate(texts)}
    assert run(spark, texts, words=words, percent=percent) == brute(texts, words, percent)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 9_000)
    rng = random.Random(4)
    texts = dict(enumerate(family(rng, 60, 100, 6)))
    assert run(spark, texts) == brute(texts, 5, 80)


def test_words_of_equal_sums_are_no_equal_words(spark):
    one, two = thue_morse(1024)
    texts = {k: t for k, t in enumerate([one, two, *thue_morse(512), *thue_morse(4096), one + " a b c d e", two + " a b c d e", one.upper()])}
    assert run(spark, texts) == brute(texts, 5, 80)


def test_long_chains_of_neighbours(spark, monkeypatch):
    """Each text is near the next one only: few are near a group's center, the others are compared with each other."""
    monkeypatch.setattr(neardup, "BLOCK", 6_000)
    rng = random.Random(11)
    words = [f"w{rng.randrange(9000)}" for _ in range(400)]
    texts = {(i * 37) % 101: " ".join(words[2 * i : 2 * i + 60]) for i in range(101)}
    assert run(spark, texts, words=3, percent=85) == brute(texts, 3, 85)


def test_recall_of_planted_pairs(spark):
    """Pairs at the threshold and above, of few and of many words: none may be lost (the chance of one is below 1e-4)."""
    rng = random.Random(12)
    texts, pairs = {}, []
    for k in range(300):
        words = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice([12, 40, 150]))]
        texts[2 * k], texts[2 * k + 1] = " ".join(words), " ".join(words[: max(6, len(words) - len(words) // 12)])
        a, b = shingles(texts[2 * k], 5), shingles(texts[2 * k + 1], 5)
        if 100 * len(a & b) >= 80 * len(a | b):
            pairs.append((2 * k, 2 * k + 1))
    got = run(spark, texts)
    assert len(pairs) > 100 and all(got[b][1] == a for a, b in pairs)


def test_odd_rows(spark):
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_duplicates(odd(spark)).collect())
    assert got == [(0, 0, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (5, 4, False), (6, 6, True), (7, 7, True), (8, 8, True)]
    assert neardup.near_duplicates(odd(spark).limit(0)).count() == 0
    assert neardup.drop_near_duplicates(odd(spark)).count() == 8


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for n, shared in ((40, 30), (3, 2), (2000, 1500)):
        a = rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
        one, two = np.unique(a[:n]), np.unique(a[n - shared :])
        s = sketch.sketches(np.concatenate([one, two]), np.array([0, len(one), len(one) + len(two)]), 2000)
        assert (s != np.uint64(2**64 - 1)).all()
        assert abs((s[0] == s[1]).mean() - shared / (2 * n - shared)) < 0.06


def test_overlaps_by_bits_and_by_merging():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 200, rng.integers(0, 80)).astype(np.uint64)) for _ in range(20)]
    left, right = np.triu_indices(20, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(left, right)]
    assert neardup.overlaps(sets, left, right).tolist() == want
    assert neardup.overlaps(sets, left[:5], right[:5]).tolist() == want[:5]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, cosine):
    valid = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    up, links = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in valid:
        for b in valid:
            if a < b and len(valid[a]) == len(valid[b]) and valid[a] @ valid[b] / np.sqrt((valid[a] @ valid[a]) * (valid[b] @ valid[b])) >= cosine:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (links[i], root(i), root(i) == i) for i in up}


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 50)
    monkeypatch.setattr(vectors, "LEAF", 16)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    rows = [(i, (centers[i % 12] + rng.normal(size=16) * (0.1 if i % 5 else 0.4)).tolist()) for i in range(400)]
    rows += [(1000 + k, v) for k, v in enumerate([rows[3][1], rows[3][1], [2 * x for x in rows[7][1]], None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 0.0], [1.0, 0.01], [1e300] * 16, [1e-300] * 16])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumnRenamed("x", "y")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    want = brute_vectors([r for r in rows if r[0] not in (1011, 1012)], 0.95)
    assert {k: v for k, v in got.items() if k not in (1011, 1012)} == want
    assert got[1011][0] == 1 and got[1012] == (1, 1011, False)  # squares that would overflow or vanish


def test_odd_vectors(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, id long")
    got = sorted((r.vec_id or 0, r.component_id or 0, r.kept) for r in vectors.near_vectors(df).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 2, True)]
    assert vectors.near_vectors(df.limit(0)).count() == 0
