"""A collection of chunks with vectors as a Parquet table: writing, lookup, exact search."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from docgraph.functions.vectors import distance
from docgraph.operators.graph import cut
from docgraph.runtime import visible

#: Chunk fields that hold JSON text in the flat form of a store and are parsed on the way back.
NESTED = {"ref_ids": "map<string,array<string>>", "referenced_by": "array<string>", "status_codes": "array<string>", "tags": "array<string>"}

OPERATORS = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
}


def where(filters: Mapping | None) -> Column:
    """A filter mapping as a predicate: scalars mean equality, several keys mean all of them."""
    found = F.lit(True)
    for name, value in (filters or {}).items():
        if name in ("$and", "$or"):
            parts = [where(v) for v in value]
            part = parts[0]
            for p in parts[1:]:
                part = part & p if name == "$and" else part | p
        elif isinstance(value, Mapping):
            part = F.lit(True)
            for op, v in value.items():
                if op not in OPERATORS:
                    raise ValueError(f"unknown operator {op}")
                part = part & OPERATORS[op](F.col(name), v)
        else:
            part = F.col(name) == value
        found = found & part
    return found


def top_k(chunks: DataFrame, query: list[float], limit: int, filters: Mapping | None = None, key: str = "id", vector: str = "embedding") -> DataFrame:
    """The ``limit`` nearest rows by cosine distance, ranked from 1; ties go by key. Filters hold before the ranking."""
    q = F.array(*[F.lit(float(x)) for x in query])
    found = chunks.where(where(filters)).withColumn("distance", distance(F.col(vector), q)).where("distance is not null")
    best = found.orderBy("distance", key).limit(limit)
    return best.withColumn("rank", F.row_number().over(W.Window.orderBy("distance", key)))


MOST_QUERIES = 20_000
#: Distances that a task holds at once.
MOST_CELLS = 4_000_000


def top_k_many(chunks: DataFrame, queries: DataFrame, limit: int, key: str = "id", vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """(query_key, key, distance, rank) of the nearest rows for a stated set of query vectors.

    The matrix of up to MOST_QUERIES queries goes to every task, each Arrow batch is multiplied with it, and only the
    batch's own best ``limit`` per query leave the task. More queries are searched in blocks of that size, one pass over
    all rows each; a block's result is kept before the next one starts, so that one matrix is held at a time.
    """
    rank = F.row_number().over(W.Window.partitionBy(query_key).orderBy("distance", key))
    first = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= limit)
    near = lambda block: first(_nearest(chunks, queries, block, limit, key, vector, query_key))
    rows = queries.select(query_key, "vector").toLocalIterator()
    block, after = list(islice(rows, MOST_QUERIES)), list(islice(rows, MOST_QUERIES))
    if not after:
        return near(block)
    kept = []
    while block:
        kept.append(cut(near(block).drop("rank")))
        block, after = after, list(islice(rows, MOST_QUERIES))
    return first(reduce(DataFrame.union, kept))  # a query key that is there twice may stand in two blocks


def _nearest(chunks: DataFrame, queries: DataFrame, rows: list, limit: int, key: str, vector: str, query_key: str) -> DataFrame:
    """(query_key, key, distance): the best ``limit`` rows of each Arrow batch for each of the query rows."""
    names = [r[0] for r in rows]
    kind, of = queries.schema[query_key].dataType.simpleString(), chunks.schema[key].dataType.simpleString()
    schema = f"`{query_key}` {kind}, `{key}` {of}, distance double"
    if not names:
        return chunks.sparkSession.createDataFrame([], schema)
    matrix = np.array([r[1] for r in rows], dtype=np.float64)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def near(batches):
        for batch in batches:
            lists = batch.column(1)
            keep = np.asarray(lists.is_valid())
            ids = batch.column(0).filter(pa.array(keep))
            lists = lists.filter(pa.array(keep))
            if not len(ids):
                continue
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            size = np.linalg.norm(x, axis=1)
            order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")  # ties go by key
            unit, none = (x / np.where(size > 0, size, 1)[:, None])[order], size[order] == 0
            step = max(1, MOST_CELLS // len(ids))
            for first in range(0, len(names), step):
                far = 1 - unit @ matrix[first : first + step].T
                far[none] = np.inf
                best = np.argsort(far, axis=0, kind="stable")[:limit]
                at = np.tile(np.arange(far.shape[1]), (len(best), 1))
                value = far[best, at].ravel()
                fine = np.isfinite(value)
                yield pa.RecordBatch.from_arrays([pa.array([names[first + i] for i in at.ravel()[fine]]), ids.take(pa.array(order[best].ravel()[fine])), pa.array(value[fine])], names=[query_key, key, "distance"])

    visible(chunks.sparkSession)
    return chunks.select(key, vector).mapInArrow(near, schema)


def flatten_metadata(df: DataFrame, keep: tuple[str, ...] = ("id", "document", "embedding")) -> DataFrame:
    """Nested metadata as JSON text; scalars stay."""
    out = {}
    for f in df.schema.fields:
        if f.name not in keep and f.dataType.typeName() in ("array", "map", "struct"):
            out[f.name] = F.to_json(F.col(f.name))
    return df.withColumns(out) if out else df


def restore_metadata(df: DataFrame) -> DataFrame:
    """The four known nested fields parsed back; other JSON text stays text."""
    out = {c: F.from_json(F.col(c), kind) for c, kind in NESTED.items() if c in df.columns and df.schema[c].dataType.typeName() == "string"}
    return df.withColumns(out) if out else df


def round_trips(df: DataFrame) -> DataFrame:
    """One row: whether flattening and restoring gives every row back."""
    names = [c for c in NESTED if c in df.columns]
    back = restore_metadata(flatten_metadata(df.select("id", *names))).select(F.col("id"), *[F.col(c).alias(f"b_{c}") for c in names])
    text = lambda c: F.to_json(F.col(c)) if c.removeprefix("b_") in names else F.col(c)
    same = F.lit(True)
    for c in names:
        same = same & text(c).eqNullSafe(text(f"b_{c}"))
    return df.select("id", *names).join(back, "id").agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("round_trips"))


class ChunkStore:
    """Chunks (id, document, embedding and metadata columns) under ``path/name``; inserts append, reads prune columns."""

    def __init__(self, spark: SparkSession, path: str, name: str = "chunks", model: str = "hashing", device: str = "cpu"):
        self.spark, self.path, self.name, self.model, self.device = spark, path.rstrip("/"), name, model, device
        self.ready = False

    @property
    def table(self) -> str:
        return f"{self.path}/{self.name}"

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def exists(self) -> bool:
        fs, path = self._fs(self.table)
        return fs.exists(path)

    def setup(self, reset: bool = False) -> ChunkStore:
        """Open the collection; ``reset`` drops what it holds."""
        if reset:
            self.clear()
        self.ready = True
        return self

    def _open(self) -> None:
        if not self.ready:
            raise RuntimeError("the store is not set up: call setup() first")

    def add(self, chunks: DataFrame, batch_size: int | None = None) -> None:
        """Append, in ranges of the id, so that lookups read few row groups; rows whose id is stored already are skipped."""
        self._open()
        if self.exists():
            chunks = chunks.join(self.chunks().select("id"), "id", "left_anti")
        conf, name = chunks.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = conf.get(name)
        try:
            if batch_size:
                conf.set(name, str(batch_size))
            chunks.repartitionByRange("id").sortWithinPartitions("id").write.mode("append").parquet(self.table)
        finally:
            conf.set(name, before)

    def chunks(self) -> DataFrame:
        self._open()
        return self.spark.read.parquet(self.table)

    def clear(self) -> None:
        fs, path = self._fs(self.table)
        fs.delete(path, True)

    def count(self) -> int:
        return self.chunks().count() if self.exists() else 0

    def info(self) -> dict:
        self._open()
        return {"name": self.name, "count": self.count(), "metadata": {"hnsw:space": "cosine"}, "model": self.model, "device": self.device}

    def health(self, embedder=..., cache=...) -> dict:
        """Whether the path, the collection, the embedder (by a trial) and the cache are there; the latter two if asked."""
        found = {"path": False, "collection": False, "count": 0, "errors": []}
        try:
            fs, path = self._fs(self.path)
            found["path"] = fs.exists(path)
            if not self.ready:
                found["errors"].append("not set up")
            else:
                found["count"], found["collection"] = self.count(), self.exists()
            if embedder is not ...:
                found["embedding_model"] = embedder is not None and len(embedder.encode(["test"])) > 0
                if not found["embedding_model"]:
                    found["errors"].append("no embedder" if embedder is None else "the embedder gives nothing")
            if cache is not ...:
                found["embedding_cache"] = cache is not None
                if cache is None:
                    found["errors"].append("no embedding cache")
        except Exception as e:  # whatever is broken is what the report is for
            found["errors"].append(str(e))
        return found | {"healthy": not found["errors"]}

    def get(self, ids: list[str]) -> DataFrame:
        """Chunks by id, pushed down as an IN filter; unknown ids give nothing."""
        return self.chunks().where(F.col("id").isin(list(ids)))

    def search(self, query: list[float], limit: int = 5, filters: Mapping | None = None) -> DataFrame:
        return top_k(self.chunks(), query, limit, filters)
