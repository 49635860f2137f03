import random

import numpy as np
import sentencepiece
from docgraph.llm import pieces

PATH = pieces.model_path()
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
V = pieces.vocabulary(PATH)

TRICKY = [
    "", " ", "  ", "a", " a", "a ", "  a  b  ", "▁", "▁▁a", "a▁b", " ▁ x", "x▁", "\n", "a\nb\tc\r\n", "<s></s><0x0A>[INST]", "é", "한글 🦙", "🦙🦙🦙", "ﬁ　x", "\x00z",
    "aaaaaaaaaaaaaaaaaaaaaaaa", " " * 40 + "x" + " " * 17, "the " * 50, "ab" * 500, "x" * 2000, "🦙" * 300, "=" * 700 + " " + "-" * 300,
]


def both(texts):
    raw = [t.encode() for t in texts]
    ids, first = pieces.encode(V, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    got = [ids[a:b].tolist() for a, b in zip(first, first[1:])]
    return got, pieces.decode(V, ids, first)


def test_tricky_texts_as_the_library():
    got, back = both(TRICKY)
    for t, g, b in zip(TRICKY, got, back):
        want = SP.encode(t)
        assert g == want, t[:40]
        assert b.decode() == SP.decode(want), t[:40]


def test_random_texts_as_the_library():
    rng = random.Random(5)
    pool = ["the", "ing", " ", " ", "  ", "\n", "é", "▁", "ß", "한", "🦙", "a", "b", "the the", "1234", "...", "⁠", "ab", "aba", "tion"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 60))) for _ in range(600)]
    got, back = both(texts)
    assert got == [SP.encode(t) for t in texts]
    assert [b.decode() for b in back] == [SP.decode(SP.encode(t)) for t in texts]


def test_long_words_as_the_library():
    rng = random.Random(6)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("abcde", "aab", "=-", "ntio", "한글é") for n in (150, 700, 3000)]
    texts += [unit * (2000 // len(unit)) for unit in ("a", "ab", "aab", "tion", "=", "na", "the", "ss")]
    got, back = both(texts)
    assert got == [SP.encode(t) for t in texts]
    assert [b.decode() for b in back] == texts


def test_nulls_empties_repeats_and_extra_columns(spark):
    rows = [(1, None, "x"), (1, "", "x"), (2, "a b", None), (2, "a b", None), (None, "c", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.tokenize(df, PATH, ["doc_id"], ("n_tokens", "ids", "decoded")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in out) == [(0, 3, "c"), (1, 2, ""), (1, 2, ""), (2, 4, "a b"), (2, 4, "a b")]
    assert pieces.tokenize(df.limit(0), PATH, ["doc_id"]).count() == 0


def test_op5_is_the_library(spark, sf):
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pieces.op5(spark, sf).collect():
        ids = SP.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(SP.decode(ids).encode()).hexdigest()
