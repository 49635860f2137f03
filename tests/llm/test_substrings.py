import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from docgraph.llm import common, induced, substrings

from .helpers import odd


def naive(text):
    return sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_suffix_array(letters):
    rng = random.Random(letters)
    for n in (0, 1, 2, 3, 10, 60, 150):
        for times in (1, 4):
            text = [rng.randrange(1, letters + 1) for _ in range(n)] * times + [0]
            assert induced.suffix_array(np.array(text)).tolist() == naive(text)


def test_both_inductions_agree():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 5, 3000), 0)
    small, left = induced.classify(text)
    size = np.bincount(text)
    a, b = (f(text, small, size, left) for f in (induced._induce_by_bucket, induced._induce_one_by_one))
    assert a.tolist() == b.tolist()


def test_common_prefixes():
    text = np.array([1, 2, 1, 2, 1, 2, 3, 1, 2, 0])
    array = induced.suffix_array(text)
    got = induced.common_prefixes(np.concatenate([text.astype(np.uint8), np.full(40, 9, np.uint8)]), array, 3)
    for r in range(1, len(array)):
        a, b = text[array[r] :].tolist(), text[array[r - 1] :].tolist()
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert got[array[r]] == min(3, k)


def passages(rng, n):
    return "".join(rng.choice("abcdefgh é") for _ in range(n))


def run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in substrings.remove_repeats(df, **kw).collect()}


def check(spark, texts):
    got = run(spark, texts)
    want = substrings.brute({i: t.encode() for i, t in texts.items()})
    assert {i: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for i, v in got.items()} == want


def test_planted_repeats_against_brute_force(spark):
    rng = random.Random(8)
    shared = [passages(rng, n) for n in (90, 99, 100, 101, 130, 400, 1500)]
    texts = {}
    for i in range(60):
        parts = [passages(rng, rng.randrange(0, 200)) + rng.choice(shared) for _ in range(rng.randrange(0, 5))]
        texts[i * 3] = "".join(parts)
    texts[500], texts[501], texts[502] = texts[3], texts[3], "x" * 350  # copies, and a string that repeats itself
    texts[503] = "ab" * 200 + passages(rng, 120) + "ab" * 120
    edited = list(shared[-1])
    for at in (200, 330, 700, 705, 1100):
        edited[at] = "Z"
    texts[504], texts[505] = "".join(edited), "".join(edited[50:900])
    check(spark, texts)


def test_many_copies_of_one_passage(spark):
    rng = random.Random(9)
    one = passages(rng, 260)
    check(spark, {i: passages(rng, 60) + one + passages(rng, 60) for i in range(300)})


@pytest.mark.parametrize("held", [20, 1 << 18])
def test_hot_grams_against_brute_force(spark, monkeypatch, held):
    """Every gram that a sample holds is hot; tasks combine few or many fingerprints at once."""
    monkeypatch.setattr(substrings, "HOT_IN_SAMPLE", 1)
    monkeypatch.setattr(substrings, "HELD", held)
    monkeypatch.setattr(substrings, "MEET", held)
    rng = random.Random(13)
    one, two = passages(rng, 260), list(passages(rng, 700))
    texts = {i: passages(rng, 60) + one + passages(rng, 60) for i in range(120)}
    for i in range(200, 260):  # near copies
        two[rng.randrange(700)] = "Q"
        texts[i] = "".join(two)
    texts[300], texts[301] = "ab" * 400, "xyz" + "ab" * 90
    check(spark, texts)


def test_grams_do_not_depend_on_the_batch():
    rng = random.Random(14)
    one, lead = passages(rng, 500).encode(), passages(rng, 70_000).encode()
    alone = substrings.winnow(np.frombuffer(one, np.uint8), np.array([0, len(one)]), 100, 24)
    after = substrings.winnow(np.frombuffer(lead + one, np.uint8), np.array([0, len(lead), len(lead) + len(one)]), 100, 24)
    last = after[1] == 1
    assert alone[2].tolist() == after[2][last].tolist()
    assert (alone[0] + len(lead)).tolist() == after[0][last].tolist() and [alone[k].tolist() for k in (3, 4)] == [after[k][last].tolist() for k in (3, 4)]
    assert common.SHORT >= 2 * substrings.LENGTH


def test_odd_rows(spark):
    rows = substrings.remove_repeats(odd(spark)).collect()
    assert len(rows) == 10
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_removed) for r in rows)
    # with no key comes first; of the same text 4 precedes 5, whose equal rows are alike
    assert [g for g in got if g[0] == 5] == [(5, 1470, 1470)] * 2
    assert [g for g in got if g[0] in (1, 2)] == [(1, 0, 0), (2, 0, 0)]
    assert substrings.remove_repeats(odd(spark).limit(0)).count() == 0


def test_repeated_keys(spark):
    rng = random.Random(10)
    one = passages(rng, 150)
    df = spark.createDataFrame([(1, "q" + one), (1, "r" + one), (1, "r" + one)], "doc_id long, text string")
    got = Counter((r.kept[:1], r.n_removed) for r in substrings.remove_repeats(df).collect())
    size = len(one.encode())
    # documents of one key stand in the order of their texts' hashes; equal rows get equal results
    r_first = hashlib.md5(("r" + one).encode()).hexdigest()[:15] < hashlib.md5(("q" + one).encode()).hexdigest()[:15]
    assert got == Counter({(b"q", size): 1, (b"r", 0): 2} if r_first else {(b"q", 0): 1, (b"r", size): 2})


def test_op2(spark, sf):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.op2(spark, sf).collect()} == substrings.brute(texts)
