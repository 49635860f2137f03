"""The store and the embedding cache as they are filled, asked and emptied: orders as chunks, documents as texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docgraph.operators.embedding import EmbeddingCache, HashingEmbedder, embed, embed_cached
from docgraph.operators.store import ChunkStore
from docgraph.runtime import checkpoint_folder

from .registry import query, table


def _path(spark, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _chunks(spark, sf_dir, document: str):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit(document).alias("document"), F.col("o_orderstatus").alias("status"))


def _filled(spark, sf_dir) -> ChunkStore:
    """A store that got the orders of one status first, in batches, and all orders after that."""
    store = ChunkStore(spark, _path(spark, "store")).setup(reset=True)
    store.add(_chunks(spark, sf_dir, "first").where("status = 'F'"), batch_size=100)
    store.add(_chunks(spark, sf_dir, "second"))
    return store


KEPT = "select cast(o_orderkey as varchar) as id, case when o_orderstatus = 'F' then 'first' else 'second' end as document, o_orderstatus as status from orders"


@query(KEPT)
def store_add(spark, sf_dir):
    """What is stored stays; only new ids are added."""
    return _filled(spark, sf_dir).chunks().select("id", "document", "status")


@query(f"select * from ({KEPT}) where id in ('1', '5', '17')")
def store_get(spark, sf_dir):
    """Lookup by id; an id that is not there gives nothing."""
    return _filled(spark, sf_dir).get(["17", "1", "none", "5"]).select("id", "document", "status")


@query(
    """select 'set up' as step, 0 as n, false as collection, true as healthy union all select 'filled', count(*), true, true from orders
    union all select 'reset', 0, false, true union all select 'not set up', 0, false, false"""
)
def store_states(spark, sf_dir):
    """Number of chunks, whether the collection is there, and health, from an empty store to one that was reset."""
    path = _path(spark, "store")
    spark.createDataFrame([("x",)], "x string").write.parquet(f"{path}/other")  # the folder is there, the collection is not
    store = ChunkStore(spark, path)
    found = [("not set up", store.health())]
    found.append(("set up", store.setup().health()))
    store.add(_chunks(spark, sf_dir, "text"))
    found.append(("filled", store.health()))
    found.append(("reset", store.setup(reset=True).health()))
    return spark.createDataFrame([(step, h["count"], h["collection"], h["healthy"]) for step, h in found], "step string, n long, collection boolean, healthy boolean")


@query("select doc_id, text is not null as same from documents")
def embed_through_cache(spark, sf_dir):
    """Embeddings of all documents by way of a cache that holds the English ones, against those made directly; a null
    text has no key and so none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("document"))
    cache, embedder = EmbeddingCache(spark, _path(spark, "cache")), HashingEmbedder()
    embed_cached(docs.where("lang = 'en'"), embedder, cache)
    through = embed_cached(docs, embedder, cache).withColumnRenamed("embedding", "kept")
    return embed(through, embedder).select("doc_id", F.col("kept").eqNullSafe(F.col("embedding")).alias("same"))
