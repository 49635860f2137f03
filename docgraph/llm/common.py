"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from docgraph.runtime import checkpoint_folder, visible

#: A word is a run of anything but space and the ASCII controls 9 to 13.
WORD = "[^\\x20\\x09-\\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

BATCH_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores if it comes in fewer pieces than there are, as small files of one row group do."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame, small: bool = False) -> DataFrame:
    """Materialise in the cluster's shared checkpoint folder, cutting lineage.

    A ``small`` table, of a few dozen bytes for each of some documents, is dealt to an eighth as many files as shuffles
    have tasks: every round of an iteration else leaves as many little files as large tables need. Dealing it is a
    shuffle of its own, so that the stage before it keeps all its tasks.
    """
    checkpoint_folder(df.sparkSession)
    if small:
        df = df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
    return df.checkpoint(eager=True)


ARROW_BYTES = 4 << 20


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` in record batches of a few MB, so that a task's memory does not follow the length of its texts."""
    visible(df.sparkSession).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.mapInArrow(function, schema)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it again."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a ``shared_table`` that nothing reads any more."""
    spark = df.sparkSession
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_names(df: DataFrame, taken: list[str]) -> DataFrame:
    """``df`` with an underscore after each column name that is in ``taken``, as many as make it free (case counts not)."""
    used, out = {c.lower() for c in [*df.columns, *taken]}, []
    for c in df.columns:
        name = c
        if c.lower() in {t.lower() for t in taken}:
            while name.lower() in used:
                name += "_"
            used.add(name.lower())
        out.append(F.col(f"`{c}`").alias(name))
    return df.select(*out)


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds a column for each name in ``sums``: the sum of the column named there over all rows before each, by ``order``.

    Rows are dealt to tasks by ranges of the order and summed there; only one total a task is summed over all. So no
    task holds more than its range, whatever the number of rows; ``order`` must tell nearly all rows apart.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    totals = placed.groupBy("__range").agg(*[F.sum(value).alias(f"__all_{name}") for name, value in sums.items()])  # a row a task
    before = W.Window.orderBy("__range").rowsBetween(W.Window.unboundedPreceding, -1)
    totals = totals.select("__range", *[F.coalesce(F.sum(f"__all_{name}").over(before), F.lit(0)).alias(f"__from_{name}") for name in sums])
    within = W.Window.partitionBy("__range").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, -1)
    out = placed.withColumns({f"__in_{name}": F.coalesce(F.sum(value).over(within), F.lit(0)) for name, value in sums.items()})
    out = out.join(F.broadcast(totals), "__range").withColumns({name: F.col(f"__from_{name}") + F.col(f"__in_{name}") for name in sums})
    return out.drop("__range", *[f"__{part}_{name}" for name in sums for part in ("from", "in")])


#: A key is hot if it has more rows than this, or than this share of all rows: so there are at most MOST_HOT hot keys.
HOT_ROWS, MOST_HOT = 1000, 10_000


def join_hot(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` inner joined with ``facts`` (one row a key, with its number of rows in ``size``), ``total`` rows in all.

    Rows of hot keys stay where they are and meet a broadcast of at most MOST_HOT facts; only the others are shuffled.
    """
    most = max(HOT_ROWS, total // MOST_HOT)
    hot = facts.where(F.col(size) > most)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(F.col(size) <= most), key)
    return rest.unionByName(rows.join(F.broadcast(hot), key))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.transform(F.array(value), body)[0]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sub_batches(batches, text: str = "text", most: int = BATCH_BYTES):
    """Slice record batches so that each holds about ``most`` bytes of text (a longer single row stands alone)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        lengths = np.asarray(column.is_valid()) * np.diff(string_buffers(column)[1])
        at = np.cumsum(lengths) // most
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(edges, edges[1:]):
            if stop > start:
                yield batch.slice(start, stop - start)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, with offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()[-3:]
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def flat_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False):
    """Bytes of all words end to end, the words' offsets in them, and each text's first word."""
    space = _SPACE[data]
    before = np.ones(len(data) + 1, dtype=bool)
    before[1:] = space
    before[offsets] = True
    starts = np.flatnonzero(~space & before[:-1])
    kept = data[~space]
    if lower:
        kept = _LOWER[kept]
    place = np.cumsum(~space)
    word_at = np.empty(len(starts) + 1, dtype=np.int64)
    word_at[:-1] = place[starts] - 1
    word_at[-1] = len(kept)
    return kept, word_at, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each span of bytes [start, stop), as two columns, alike wherever equal bytes stand.

    Spans of up to SHORT bytes are mixed eight bytes at a time, all together; longer ones are digested one by one.
    """
    size = stop - start
    one = mix64(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    two = mix64(one + np.uint64(0xD1342543DE82EF95))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    go = np.flatnonzero((size > 0) & (size <= SHORT))
    at = 0
    while len(go):
        block = eight[start[go] + at]
        left = size[go] - at
        part = left < 8
        if part.any():
            block[part] &= (np.uint64(1) << (8 * left[part]).astype(np.uint64)) - np.uint64(1)
        one[go] = mix64(one[go] ^ block)
        two[go] = mix64(two[go] + mix64(block ^ np.uint64(0x2545F4914F6CDD1D)))
        at += 8
        go = go[left > 8]
    for i in np.flatnonzero(size > SHORT).tolist():
        got = hashlib.blake2b(data[start[i] : stop[i]].tobytes(), digest_size=16).digest()
        one[i], two[i] = int.from_bytes(got[:8], "little"), int.from_bytes(got[8:], "little")
    return one, two


SHORT = 256


def word_hashes(kept: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    return span_digests(kept, word_at[:-1], word_at[1:])[0]


def segment_index(first: np.ndarray) -> np.ndarray:
    """For offsets of segments, the number of the segment of each item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


BUCKETS = 1 << 20


def _bucket(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS))


def maybe_in(df: DataFrame, column: str, keys: DataFrame, anti: bool = False, also: str | None = None) -> DataFrame:
    """Rows of ``df`` whose key may be among ``keys`` (one column), or with ``anti`` those whose key is surely not (and
    those where the boolean column ``also`` holds).

    Only hash buckets are compared, at most 2**20 of them whatever the input, so they can always be broadcast: most of
    a wide table is set aside before an exact join shuffles the rest.
    """
    found = keys.select(_bucket(F.col(keys.columns[0])).alias("__bucket")).distinct()
    if also:
        marked = df.withColumn("__b", _bucket(F.col(column))).join(F.broadcast(found.withColumn("__hit", F.lit(True))), F.col("__b") == F.col("__bucket"), "left")
        return marked.where(F.col(also) | F.col("__hit").isNull()).drop("__b", "__bucket", "__hit")
    how = "left_anti" if anti else "left_semi"
    return df.withColumn("__bucket", _bucket(F.col(column))).join(F.broadcast(found), "__bucket", how).drop("__bucket")
