"""Quality rules, mixing, formatting, classifier, shards, lines and the pipeline on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from docgraph.llm import chat, classifier, linedup, mixing, quality, sharding
from pyspark.sql import functions as F

from .helpers import ODD, SCHEMA, odd, same, thue_morse

# ---- quality rules


def good_and_bad(spark, n=1500):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(9000)}" for _ in range(60)]
        bad = i % 5 == 0
        rows.append((i, " ".join(w + "$" if bad else w for w in words), "en" if i % 3 else None, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")


def test_cutoffs_reject_bad_and_keep_good(spark):
    df = good_and_bad(spark, 6000)
    got = quality.judge(df.drop("quality"), df.select("doc_id", "quality")).join(df.select(F.col("doc_id").alias("__key"), "quality"), "__key")
    by = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert by == {(0, False): 1200, (1, True): 4800}


def test_too_few_labels_certify_nothing(spark):
    df = good_and_bad(spark, 300)
    assert quality.judge(df.drop("quality"), df.select("doc_id", "quality")).where("not kept").count() == 0


def test_binomial_tail(spark):
    cases = [(0, 50, 0.01), (3, 200, 0.05), (40, 1000, 0.05), (0, 100_000, 0.01), (900, 100_000, 0.01)]
    for k, n, p in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).head().x
        term = total = n * math.log(1 - p)
        for i in range(1, k + 1):
            term += math.log((n - i + 1) / i) + math.log(p / (1 - p))
            total = max(total, term) + math.log1p(math.exp(-abs(total - term)))
        assert got == pytest.approx(math.exp(total), rel=1e-9)


def test_repeated_words(spark):
    rng = random.Random(2)
    texts = ["", "a", "a a a", "a b c", "a b c a b c", "a a a a", "x a b c y a b c z"] + [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(60)]

    def brute(t):
        w = t.split()
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        return len({j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality.figures(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_odd_quality(spark):
    labels = spark.createDataFrame([(4, 1), (None, 1), (99, None)], "doc_id long, quality int")
    rows = quality.judge(odd(spark), labels).collect()
    assert len(rows) == 10 and not any(r.kept for r in rows)  # all are short or repeat themselves
    assert {r["__key"]: (r.n_words, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows if r["__key"] in (1, 2, 3, 4, 6)} == {1: (0, 0, 0, True), 2: (0, 0, 0, True), 3: (0, 0, 0, True), 4: (300, 29, 300, True), 6: (60_000, 0, 60_000, True)}
    assert quality.keep_good(odd(spark), labels).count() == 0
    assert quality.judge(odd(spark).limit(0), labels.limit(0)).count() == 0


# ---- mixing


def waterfill(size, weight, epochs):
    """Clamp and reshare until none is above."""
    total, capped = sum(size.values()), set()
    while True:
        free = [s for s in size if s not in capped]
        left, w = total - sum(epochs * size[s] for s in capped), sum(weight[s] for s in free)
        target = {s: epochs * size[s] if s in capped else left * weight[s] / w for s in size}
        over = {s for s in free if target[s] > epochs * size[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rng = random.Random(seed)
    names = [None, "a", "B", "ä", "z9", "", "q", "r"]
    rows = [(i, rng.choice(names) if rng.random() < 0.6 else "a", rng.randrange(0, 400)) for i in range(800)]
    df = spark.createDataFrame(rows, "key long, source string, size long")
    got = mixing.mix(df).collect()
    size, taken = defaultdict(int), defaultdict(int)
    for _, s, n in rows:
        size[s] += n
    order = sorted((s for s in size if s is not None)) + [None]
    want = waterfill(size, {s: k % 3 + 1 for k, s in enumerate(order)}, 3)
    for r in got:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source] and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))


def test_mixed_rows_hold_the_words_taken(spark):
    docs = odd(spark)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and {r.taken for r in out.collect()} == {1}
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
    want = defaultdict(int)
    for r in mixing.mix(docs.select(F.col("doc_id").alias("key"), "source", mixing.n_words(F.col("text")).alias("size"))).collect():
        want[r.key] += r.taken
    assert words == {k: n for k, n in want.items() if n}
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, "a", 0)], "key long, source string, size long")).head().taken == 0


def test_mix_with_ties(spark):
    df = spark.createDataFrame([(1, "a", 5)] * 6 + [(2, "b", 1)], "key long, source string, size long")
    got = mixing.mix(df).collect()
    assert len(got) == 7 and sum(r.taken for r in got if r.source == "a") == 28


@pytest.mark.parametrize("sizes", [[2, 3], [1 + i * 7919 % 23 for i in range(2500)]])
def test_sources_rounded_to_a_whole_turn(spark, sizes):
    """A rest as large as the source takes it whole; each source is two documents if it has the words."""
    texts = [(s, n) for s, size in enumerate(sizes) for n in ([size // 2, size - size // 2] if size > 3 else [size])]
    frame = pd.DataFrame([(i, " ".join(["w"] * n), f"s{s:05d}", 2 * n) for i, (s, n) in enumerate(texts)], columns=["doc_id", "text", "source", "n_chars"])
    docs = spark.createDataFrame(frame)
    took = mixing.mix(docs.select(F.col("doc_id").alias("key"), "source", mixing.n_words(F.col("text")).alias("size"))).cache()
    if len(sizes) == 2:
        same(took.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken"), mixing.SQL, documents=frame)
    by = took.groupBy("source").agg(F.sum("size").alias("size"), F.max("source_size").alias("of"), F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert len(by) == len(sizes) and all(r.of == r.size and r.target > 0 and abs(r.taken - r.target) <= 0.5 for r in by)
    words = {r.doc_id: r.n for r in mixing.mixed(docs).groupBy("doc_id").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert words == {r.key: r.taken for r in took.where("taken > 0").collect()}


def test_mix_with_clashing_columns(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2], 5 + k, 77, "s", "x", 1, 2, "t") for k in range(8)], "key long, source string, size long, bucket long, s string, stop string, rest long, nth long, Taken string")
    plain = {r.key: (r.source_size, r.target, r.taken) for r in mixing.mix(df.select("key", "source", "size")).collect()}
    out = mixing.mix(df)
    assert out.columns == ["key", "source", "size", "bucket", "s", "stop", "rest", "nth", "Taken_", *mixing.ADDED]
    for r in out.collect():
        assert (r.bucket, r.s, r.stop, r.rest, r.nth, r.Taken_) == (77, "s", "x", 1, 2, "t") and (r.source_size, r.target, r.taken) == plain[r.key]


# ---- chat formatting

TRICKY = ["", "</s>", "<⁠/s>", "[INST] x [/INST]", "<|turn|>user<|text|>", "<<s>", "⁠", "a\nb", "<|te⁠xt|>", "<⁠⁠|turn|>", "[/INST]</s><s>"]


def test_round_trip(spark):
    rows = [(c, t, ["user", "assistant", "</s>", None][t % 4], x) for c, x in enumerate(TRICKY) for t in range(5)] + [(99, 0, "user", None), (None, 1, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    by = defaultdict(list)
    for c, _, r, x in rows:
        by[c].append((r or "", x or ""))
    assert {r.conv_id: [(t.role, t.text) for t in r.back] for r in out} == dict(by)
    for r in out:
        assert r.formatted.count("</s>") == r.formatted.count("<|turn|>") == r.formatted.count("<|text|>") == len(by[r.conv_id]) and "[INST]" not in r.formatted
        said = [r.formatted[s.start : s.stop] for s in r.loss_spans]
        assert len(said) == sum(x[0] == "assistant" for x in by[r.conv_id])


def test_layouts(spark):
    a = spark.createDataFrame([(1, "p", "r")], "id long, prompt string, response string")
    b = spark.createDataFrame([(1, "do", None, "done"), (2, "do", "this", None)], "id long, instruction string, input string, output string")
    c = spark.createDataFrame([(1, [("human", "h"), ("gpt", "g")])], "id long, conversations array<struct<from:string,value:string>>")
    d = spark.createDataFrame([(1, [("system", "s"), ("user", None)])], "id long, messages array<struct<role:string,content:string>>")
    turns = lambda df: [[(t.role, t.text) for t in r.turns] for r in chat.canonical(df).orderBy("conv_id").collect()]
    assert turns(a) == [[("user", "p"), ("assistant", "r")]]
    assert turns(b) == [[("user", "do"), ("assistant", "done")], [("user", "do\nthis"), ("assistant", "")]]
    assert turns(c) == [[("user", "h"), ("assistant", "g")]] and turns(d) == [[("system", "s"), ("user", "")]]
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical(a.withColumn("more", F.lit(1)))
    e = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a")], "conv_id int, turn smallint, role string, text string")
    assert turns(e) == [[("user", "a"), ("assistant", "b")]] and turns(a.withColumn("id", F.col("id").cast("int"))) == turns(a)
    assert turns(a.withColumn("turns", F.lit(1)).select("id", "prompt", "response")) == turns(a)
    assert chat.fingerprint(a.schema) == chat.fingerprint(a.select("response", "id", "prompt").schema)
    assert chat.format_chats(a.limit(0)).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", "y", 2)], "conv_id long, turn long, role string, text string, turns string, formatted long")
    assert chat.format_chats(df, ["conv_id", "turn", "role", "text"]).count() == 1


# ---- classifier


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = classifier.op6(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert np.mean([r.predicted == r.quality for r in got]) > 0.93 and all(0 <= r.score <= 1 for r in got)


def test_odd_classifier(spark):
    labels = spark.createDataFrame([(4, 1), (8, 0), (8, None), (None, 1)], "doc_id long, quality int")
    model = classifier.fit(odd(spark), labels)
    got = classifier.score(odd(spark), model, ["doc_id", "id"]).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    empty = classifier.fit(odd(spark), labels.limit(0))
    assert {r.score for r in classifier.score(odd(spark), empty, ["doc_id"]).collect()} == {0.5}
    assert classifier.score(odd(spark).limit(0), model, ["doc_id"]).count() == 0


def test_scores_by_plain_averages(spark):
    """Scores from the model's vectors, a document at a time."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = classifier.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()} | {-1: "", -2: None, -3: "one one  one\ttwo", -4: " \n"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    buckets = {}
    for r in classifier.score(df, model, ["doc_id"]).collect():
        words = re.findall("[^ \t\n\v\f\r]+", texts[r.doc_id] or "")
        found = []
        for k, w in enumerate(words):
            if w not in buckets:
                raw = np.frombuffer(w.encode(), np.uint8)
                buckets[w] = classifier.word_features(raw, np.array([0, len(raw)]))[0].tolist()
            found += buckets[w] + [classifier.REPEAT] * (classifier.WEIGHT if k and words[k - 1] == w else 0)
        hidden = model.vectors[found].astype(np.float64).mean(axis=0) if found else np.zeros(classifier.DIM)
        logit = hidden @ model.output.astype(np.float64) + model.bias
        p = np.exp(logit - logit.max())
        assert r.score == pytest.approx(p[1] / p.sum(), abs=1e-4)


def test_repeats_and_features():
    data = np.frombuffer(b"a a b b ba a aa", np.uint8)
    _, _, which, first = classifier.distinct_words(data, np.array([0, 8, 11, 11, 15]))
    assert classifier.repeats(which, first).tolist() == [2, 0, 0, 0]
    bucket, start = classifier.word_features(np.frombuffer(b"abcd", np.uint8), np.array([0, 1, 4]))
    assert np.diff(start).tolist() == [1 + 1, 1 + 3 + 2 + 1] and len(bucket) == 9


# ---- shards


def test_hilbert_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        size = 1 << bits
        points = {}
        for i in range(size**dims):
            p = tuple(i // size**k % size for k in range(dims))
            points[sharding.hilbert_index(p, bits)] = p
        assert sorted(points) == list(range(size**dims))
        assert all(sum(abs(a - b) for a, b in zip(points[i], points[i + 1])) == 1 for i in range(size**dims - 1))


def shards(rows, n=8):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    counts = [len(by.get(s, [])) for s in range(n)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_op7(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sharding.op7(spark, sf).collect()
    shards(rows)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    assert len(rows) == len(texts)


def test_shards_by_a_plain_sort(spark):
    """Shard and slot of every document, by sorting all of them by the curve; copies stand side by side."""
    sf, dims = "/root/testdata/sf0.01", ["lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    edges = {d: sharding.cuts(docs, d) for d in dims}
    rows = docs.collect()
    cell = {r.doc_id: sharding.hilbert_index(tuple(0 if r[d] is None else sum(r[d] >= e for e in edges[d]) for d in dims), sharding.BITS) for r in rows}
    text = {r.doc_id: hashlib.md5((r.text or "").encode()).hexdigest() for r in rows}
    led = {}
    for i in sorted(text):
        led.setdefault(text[i], cell[i])
    order = sorted(text, key=lambda i: (led[text[i]], text[i], i))
    base, longer = divmod(len(order), 8)
    want = [(s, k) for s in range(8) for k in range(base + (s < longer))]
    got = sharding.op7(spark, sf).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == dict(zip(order, want))
    parted = defaultdict(set)
    for r in got:
        parted[text[r.doc_id]].add(r.shard)
    assert sum(len(v) > 1 for v in parted.values()) <= 7 < sum(v > 1 for v in Counter(text.values()).values())


def test_hot_groups_of_copies(spark):
    rows = [(i, "x" if i % 3 else None, f"t{0 if i % 2 else i // 8}") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("shard", F.lit("own"))
    got = sharding.shard(df, "doc_id", ["lang"], group="text").collect()
    shards(got)
    assert len(got) == 9000 and {r.shard_ for r in got} == {"own"}
    order = [r.text for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert 1 + sum(a != b for a, b in zip(order, order[1:])) == len(set(order))


@pytest.mark.parametrize("n", [0, 1, 5, 8, 9, 1003])
def test_shard_counts(spark, n):
    df = spark.createDataFrame([(i % 400, "x" if i % 3 else None, i % 7, "s") for i in range(n)], "doc_id long, lang string, n_chars long, shards string")
    rows = sharding.shard(df, "doc_id", ["lang", "n_chars"]).collect()
    assert len(rows) == n
    shards(rows)


def test_shards_prune(spark):
    df = spark.createDataFrame([(i, "abcd"[i % 4], (i * 37) % 1000) for i in range(4000)], "doc_id long, lang string, n_chars long")
    spans = sharding.shard(df, "doc_id", ["lang", "n_chars"]).groupBy("shard").agg((F.max("n_chars") - F.min("n_chars")).alias("w"), F.count_distinct("lang").alias("l")).collect()
    assert np.mean([r.w for r in spans]) < 700 and np.mean([r.l for r in spans]) < 3


def test_odd_shards(spark):
    rows = sharding.shard(odd(spark), "doc_id", ["lang", "source", "n_chars"]).collect()
    assert len(rows) == 10
    shards(rows)


# ---- lines


def near(a, b):
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_lines(texts):
    """Lines that hold a word go if they equal an earlier one, or are long enough and within one edit of such a one."""
    lines = [(i, n, x) for i in sorted(texts) if texts[i] is not None for n, x in enumerate(texts[i].split("\n")) if x.strip(" \t\n\v\f\r")]
    gone, seen = defaultdict(set), {}
    for i, n, x in lines:
        if x in seen or len(x) >= linedup.MIN_CHARS and any(len(y) >= linedup.MIN_CHARS and near(x, y) for y in seen):
            gone[i].add(n)
        seen[x] = True
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) if gone[i] else t for i, t in texts.items()}


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé ß🦙xyz") for _ in range(n)) for n in (19, 20, 21, 22, 33, 40, 41, 64, 120) for _ in range(2)]

    def edit(x):
        at, how = rng.randrange(len(x) + 1), rng.randrange(4)
        return [x[:at] + "q" + x[at:], x[:at] + x[at + 1 :], x[:at] + "Z" + x[at + 1 :], x][how]

    texts = {}
    for i in range(80):
        lines = [rng.choice(["", "short", rng.choice(base), edit(rng.choice(base)), edit(edit(rng.choice(base)))]) for _ in range(rng.randrange(6))]
        texts[i * 2] = "\n".join(lines)
    texts[900], texts[901], texts[902] = None, "", "a" * 30 + "\n" + "a" * 31 + "\n" + "a" * 33
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in linedup.dedup_lines(df).collect()}
    assert got == brute_lines(texts)


def test_lines_of_repeated_keys(spark):
    many, other = [f"a line of the first text, number {'abcdefghij'[i] * 5}" for i in range(9)], "only one line of some length here"
    near = [x.replace("first", "firsts") for x in many]
    df = spark.createDataFrame([(1, "\n".join(many)), (2, "\n".join(near)), (2, other), (2, None)], "doc_id long, text string")
    got = linedup.dedup_lines(df).collect()
    assert len(got) == 4 and "\n".join(many) in [r.text for r in got] and sorted(r.n_removed for r in got if r.doc_id == 2 and r.text is None) == [0]


def test_short_lines_and_blank_ones(spark):
    texts = {1: "yes\n\n \t\nno", 2: "yes\n\nyet", 3: "yes", 4: " \t\nNo"}
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linedup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: (texts[1], 4, 0), 2: ("\nyet", 3, 1), 3: ("", 1, 1), 4: (texts[4], 2, 0)}


@pytest.mark.parametrize("size", [512, 1024, 4096])
def test_lines_of_equal_sums_are_no_equal_lines(spark, size):
    one, two = thue_morse(size)
    df = spark.createDataFrame([(1, one), (2, two), (3, two + "q"), (4, one[:-1] + "q")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in linedup.dedup_lines(df).collect()} == {1: 0, 2: 0, 3: 1, 4: 1}


def test_lines_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a\na", 7, "x", 5, "g")], "doc_id long, text string, n_lines long, N_removed string, __gone long, id string")
    out = linedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "n_lines_", "N_removed_", "__gone", "id", "n_lines", "n_removed"]
    assert tuple(out.head()) == (1, "a", 7, "x", 5, "g", 2, 1)


def test_very_common_line(spark):
    df = spark.createDataFrame([(i, f"own line number {i * 7919:08d} of this text here\nthe very common line that all texts hold{'!' * (i % 2)}") for i in range(500)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in linedup.dedup_lines(df).collect()}
    assert sum("common" in t for t in got.values()) == 1 and all(f"{i * 7919:08d} of" in t for i, t in got.items())


def test_odd_lines(spark):
    out = linedup.dedup_lines(odd(spark))
    rows = {(r.doc_id, r.n_removed): r for r in out.collect()}
    assert out.count() == 10 and rows[(4, 29)].text.count("one two") == 1 and rows[(5, 30)].text.strip() == ""
    assert rows[(1, 0)].text is None and rows[(2, 0)].n_lines == 1
    assert linedup.dedup_lines(odd(spark).limit(0)).count() == 0


# ---- pipeline


def test_pipeline_against_brute_force(spark, sf):
    """Each stage on the rows of the one before, held against plain models of the rules."""
    import sentencepiece
    from docgraph.llm import pieces

    from .test_neardup import brute

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("size", F.lit(1))
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    step = [docs]
    for _, f in corpus_pipeline.STAGES:
        step.append(f(spark, step[-1], sf).cache())
    kept, lined, near_, mixed_, tokens = step[1:]
    assert all(s.columns == corpus_pipeline.COLUMNS for s in step[1:5])
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    same(kept.select("doc_id", F.lit(True).alias("kept")), f"select doc_id, kept from ({quality.SQL}) where kept", documents=docs.toPandas(), labels=labels)
    assert text(lined) == brute_lines(text(kept))
    whole = text(lined)
    groups = brute(whole, 5, 80)
    assert text(near_) == {i: t for i, t in whole.items() if groups[i][2]}
    same(mixing.mix(near_.select(F.col("doc_id").alias("key"), "source", mixing.n_words(F.col("text")).alias("size"))).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken"), mixing.SQL, documents=near_.toPandas())
    words = Counter()
    for r in mixed_.collect():
        words[r.doc_id] += len(r.text.split())
    took = mixing.mix(near_.select(F.col("doc_id").alias("key"), "source", mixing.n_words(F.col("text")).alias("size"))).where("taken > 0")
    assert words == {r.key: r.taken for r in took.collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = Counter((r.doc_id, tuple(sp.encode(r.text, add_bos=True, add_eos=True)), hashlib.sha256(sp.decode(sp.encode(r.text)).encode()).hexdigest()) for r in mixed_.collect())
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in tokens.collect()) == want


def test_pipeline_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_pipeline_odd_and_empty(spark, tmp_path):
    for name, frame in (("odd", odd(spark)), ("empty", odd(spark).limit(0))):
        frame.drop("id", "n", "taken").write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() == 0
    rows = {name: f(spark, odd(spark), str(tmp_path / "odd")).collect() for name, f in corpus_pipeline.STAGES[1:]}
    assert len(rows["line_dedup"]) == len(rows["sentencepiece"]) == len(ODD) and SCHEMA
    assert Counter(r.doc_id for r in rows["near_dedup"]) == Counter([None, 1, 2, 3, 4, 6, 7, 8])
    assert {r.doc_id for r in rows["mix_sources"]} <= {None, 4, 5, 6, 7, 8} and all(r.text for r in rows["mix_sources"])
    assert {r.doc_id: r.n_tokens for r in rows["sentencepiece"] if r.doc_id in (1, 2)} == {1: 2, 2: 2}
