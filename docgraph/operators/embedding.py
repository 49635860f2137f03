"""Embedding of chunks with a content-hash cache. The model is a plug; the default needs no files and no network."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.functions.text import cache_key, hash16, trim_tokens
from docgraph.runtime import visible

# What some models want before a question.
PREFIXES = {"arctic": "query: ", "stella": "Instruct: Given a web search query, retrieve relevant passages that answer the query.\nQuery: ", "qwen": "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery:"}


@dataclass(frozen=True)
class HashingEmbedder:
    """Signed hashed words, normalised: the same text gives the same vector on every machine. It has no window: texts
    are trimmed only if ``max_tokens`` is given."""

    dim: int = 64
    name: str = "hashing"
    max_tokens: int | None = None

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def config(self) -> dict:
        return {"dim": self.dim, "name": self.name, "max_tokens": self.max_tokens}

    @classmethod
    def from_config(cls, config: dict) -> HashingEmbedder:
        return cls(**config)

    @property
    def key(self) -> str:
        return f"{self.name}/{self.dim}/{self.max_tokens}"


EMBEDDERS: dict[str, Callable[..., object]] = {"hashing": HashingEmbedder}


def load_embedder(name: str, **options):
    if name not in EMBEDDERS:
        raise ValueError(f"no embedder {name!r}: register one in EMBEDDERS")
    return EMBEDDERS[name](**options)


def embed_query(embedder, query: str) -> list[float]:
    if not query or not query.strip():
        raise ValueError("an empty query has no embedding")
    prefix = next((p for n, p in PREFIXES.items() if n in embedder.name.lower()), "")
    return [float(x) for x in embedder.encode([prefix + query])[0]]


def embed(df: DataFrame, embedder, text: str = "document") -> DataFrame:
    """``df`` with ``embedding`` of its text, trimmed if the embedder has a limit (``max_tokens``, None for none); the
    embedder is made once a task and gets whole Arrow batches."""
    visible(df.sparkSession)

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embedder.encode(texts.fillna("").tolist())))

    whole = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn("embedding", encode(whole if embedder.max_tokens is None else trim_tokens(whole, embedder.max_tokens)))


def dimensions(df: DataFrame) -> DataFrame:
    """(vectors, dimensions, consistent)."""
    n = F.count_distinct(F.size("embedding"))
    return df.agg(F.count("embedding").alias("vectors"), n.alias("dimensions"), (n <= 1).alias("consistent"))


class EmbeddingCache:
    """Parquet table (cache_key, embedding, put_at); of a key that was put again the last embedding counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            stored = self.spark.read.parquet(self.path)
            return stored.groupBy("cache_key").agg(F.max_by("embedding", "put_at").alias("embedding"))
        return self.spark.createDataFrame([], "cache_key string, embedding array<float>")

    def lookup(self, keyed: DataFrame) -> DataFrame:
        """``keyed`` (with cache_key) and its embedding, null where missing."""
        return keyed.join(self.table(), "cache_key", "left")

    def misses(self, keyed: DataFrame) -> DataFrame:
        return keyed.join(self.table().select("cache_key"), "cache_key", "left_anti")

    def put(self, rows: DataFrame) -> None:
        rows.select("cache_key", "embedding", F.lit(time.time_ns()).alias("put_at")).write.mode("append").parquet(self.path)


def embed_cached(df: DataFrame, embedder, cache: EmbeddingCache, text: str = "document") -> DataFrame:
    """``df`` with embeddings, of which only texts that the cache lacks are encoded, each distinct one once."""
    content = F.col("content_hash") if "content_hash" in df.columns else hash16(F.col(text))
    keyed = df.withColumn("cache_key", cache_key(embedder.key, content))
    missing = cache.misses(keyed.where("cache_key is not null")).dropDuplicates(["cache_key"])
    cache.put(embed(missing.select("cache_key", text), embedder, text))
    return cache.lookup(keyed)
