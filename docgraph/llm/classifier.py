"""Quality classifier: hashed word and character n-gram vectors averaged per document, softmax, numpy SGD."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat_words, map_arrow, mix64, read, segment_index, string_buffers, sub_batches, word_hashes

BITS = 17
DIM = 16
GRAMS = (3, 4, 5)  # in UTF-8 bytes, within a word and its edge marks
#: A departure from plain words and n-grams: one more bucket for any word that repeats the word before it (a word
#: bigram whose words are alike, whichever they are), and how often each counts. Without it, held-out documents of
#: nothing but repeated words that training has not met pass as good (AUC 0.88 at sf0.1; with it 1.00).
REPEAT, WEIGHT = 1 << BITS, 8
SAMPLE = 2000  # labelled documents of each class that are learned from, at most; those of least seeded hash
EPOCHS = 12
RATE = 2.0
SEED = 7


def word_features(kept: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of words laid end to end, and each word's offset in them: itself, then its n-grams."""
    n = len(word_at) - 1
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    edged = np.insert(kept, np.repeat(word_at, np.r_[1, np.full(n - 1, 2), 1] if n > 1 else [1, 1]), np.tile(np.frombuffer(b"<>", np.uint8), n))
    at = word_at + 2 * np.arange(n + 1)
    of = segment_index(at)
    wide = edged.astype(np.uint64)
    found, owner = [(mix64(word_hashes(kept, word_at)) >> np.uint64(64 - BITS)).astype(np.int64)], [np.arange(n)]
    for size in GRAMS:
        m = len(edged) - size + 1
        if m <= 0:
            continue
        gram = np.full(m, size, dtype=np.uint64)
        for k in range(size):
            gram = gram << np.uint64(8) | wide[k : k + m]
        inside = of[size - 1 :] == of[:m]
        found.append((mix64(gram[inside]) >> np.uint64(64 - BITS)).astype(np.int64))
        owner.append(of[:m][inside])
    bucket, word = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(word, kind="stable")
    return bucket[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n))])


def distinct_words(data: np.ndarray, offsets: np.ndarray):
    """Distinct words of a batch (bytes, offsets), the number of each word's, and each text's first word."""
    kept, word_at, first = flat_words(data, offsets)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(word_at) - 1, [None, pa.py_buffer(word_at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(kept))])
    coded = words.dictionary_encode()
    return *string_buffers(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False), first


def repeats(which: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text, the number of words that equal the word before."""
    same = np.zeros(len(which) + 1, dtype=np.int64)
    same[2:] = np.cumsum(which[1:] == which[:-1])[: max(0, len(which) - 1)] if len(which) > 1 else 0
    full = first[1:] > first[:-1]
    return np.where(full, same[first[1:]] - same[np.minimum(first[:-1] + 1, len(which))], 0)


@dataclass
class Model:
    vectors: np.ndarray  # (buckets, DIM)
    output: np.ndarray  # (DIM, 2)
    bias: np.ndarray

    def margins(self) -> np.ndarray:
        """Class 1's logit less class 0's, of each bucket: the mean of vectors goes through the output linearly."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64)


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent, a document at a time; ``features`` are its distinct buckets and their shares."""
    rng = np.random.default_rng(seed)
    vectors = (rng.random(((1 << BITS) + 1, DIM), dtype=np.float32) - 0.5) * np.float32(2 / DIM)
    output, bias = np.zeros((DIM, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    step, steps = 0, max(1, epochs * len(features))
    for _ in range(epochs):
        for i in rng.permutation(len(features)):
            bucket, share = features[i]
            now = np.float32(rate * (1 - step / steps))
            step += 1
            own = vectors[bucket]
            hidden = share @ own
            logit = hidden @ output + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = output @ p
            output -= now * np.outer(hidden, p)
            bias -= now * np.float32(0.1) * p
            vectors[bucket] = own - now * np.outer(share, back)
    return Model(vectors, output, bias)


def _featurise(batches):
    for batch in sub_batches(batches):
        data, offsets = string_buffers(batch.column(batch.schema.get_field_index("text")))
        raw, at, which, first = distinct_words(data, offsets)
        bucket, start = word_features(raw, at)
        ids, shares = [], []
        for a, b, again in zip(first, first[1:], repeats(which, first)):
            words, times = np.unique(which[a:b], return_counts=True)
            size = start[words + 1] - start[words]
            took = np.concatenate([bucket[start[w] : start[w + 1]] for w in words.tolist()]) if len(words) else np.zeros(0, np.int64)
            own, inverse = np.unique(took, return_inverse=True)
            weight = np.bincount(inverse, weights=np.repeat(times, size), minlength=len(own))
            if again:
                own, weight = np.append(own, REPEAT), np.append(weight, WEIGHT * again)
            ids.append(own.astype(np.int32))
            shares.append((weight / max(1.0, weight.sum())).astype(np.float32))
        label = batch.column(batch.schema.get_field_index("label"))
        key = batch.column(batch.schema.get_field_index("h"))
        yield pa.RecordBatch.from_pydict({"h": key, "label": label, "bucket": pa.array(ids, pa.list_(pa.int32())), "share": pa.array(shares, pa.list_(pa.float32()))})


def _train(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("h", kind="stable")
    model = train([(b.astype(np.int64), s.astype(np.float32)) for b, s in zip(rows.bucket, rows.share)], rows.label.to_numpy())
    return pd.DataFrame({"model": [pickle.dumps(model)]})


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE, seed: int = SEED) -> Model:
    """Learn from at most ``sample`` labelled documents of each class, chosen by a seeded hash of the key.

    Whole texts are turned to buckets where they lie; the bounded sample of them meets in one task, which learns. Null
    labels and unlabelled documents teach nothing; a class without rows, or no row at all, gives a model that scores
    by what it has (1/2 without any).
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("label"))
    marks = marks.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("k").cast("string"))))
    chosen = marks.where("label = 0").orderBy("h").limit(sample).unionByName(marks.where("label = 1").orderBy("h").limit(sample))
    # at most 2 * sample rows, whatever the input
    texts = docs.select(F.col(key).alias("k"), "text").join(F.broadcast(chosen), "k").select("h", "label", "text")
    rows = map_arrow(texts, _featurise, "h string, label int, bucket array<int>, share array<float>")
    got = rows.groupBy().applyInPandas(_train, "model binary").collect()
    return pickle.loads(got[0].model) if got else train([], np.zeros(0, np.int64))


def _score(batches, margin: np.ndarray, bias: float, keep: list[str]):
    for batch in sub_batches(batches):
        data, offsets = string_buffers(batch.column(batch.schema.get_field_index("text")))
        raw, at, which, first = distinct_words(data, offsets)
        bucket, start = word_features(raw, at)
        upto = np.concatenate([[0.0], np.cumsum(margin[bucket])])
        total = np.concatenate([[0.0], np.cumsum((upto[start[1:]] - upto[start[:-1]])[which])])
        count = np.concatenate([[0], np.cumsum(np.diff(start)[which])])
        again = WEIGHT * repeats(which, first)
        mean = (total[first[1:]] - total[first[:-1]] + margin[REPEAT] * again) / np.maximum(1, count[first[1:]] - count[first[:-1]] + again)
        score = 1 / (1 + np.exp(-(mean + bias)))
        yield pa.RecordBatch.from_pydict({**{c: batch.column(batch.schema.get_field_index(c)) for c in keep}, "score": pa.array(score.round(9))})


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``score``, the chance of class 1 by the whole text; null and empty texts get the bias.

    One pass, no shuffle; the model travels as one number a bucket, half a megabyte whatever the input. Equal texts, and
    so repeated rows, score alike but for rounding; texts of any length are read whole; an empty table gives none.
    """
    margin, bias = model.margins().astype(np.float32), float(model.bias[1] - model.bias[0])
    names = list(dict.fromkeys([*keep, "text"]))
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], "score double"])
    return map_arrow(docs.select(*[docs[f"`{c}`"] for c in names]), lambda it: _score(it, margin, bias, keep), schema)


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def op6(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
