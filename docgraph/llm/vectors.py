"""Embedding near-dedup: an epsilon grid order join on leading principal dimensions."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.runtime import visible

from .common import cut, map_arrow
from .graph import components
from .neardup import Forest

COSINE = 0.95
LEADING = 6  # principal dimensions of the grid
BOXED = 16  # principal dimensions of the boxes that prove intervals apart
BLOCK = 4096  # vectors of an interval of the order that one task joins with another interval
SUPER = 1024  # intervals whose box goes to the driver as one: about 300 bytes for each four million vectors
LEAF = 256


def _matrix(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors as float64; None for those that are null, empty, zero, or hold nulls or non-finite components."""
    out = []
    lists = column if isinstance(column, pa.Array) else column.combine_chunks()
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    holes = ~np.asarray(lists.values.is_valid())
    valid = np.asarray(lists.is_valid())
    for ok, a, b in zip(valid, offsets, offsets[1:]):
        v = values[a:b]
        out.append(v if ok and b > a and not holes[a:b].any() and np.isfinite(v).all() and v.any() else None)
    return out


def _classes(batches):
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("id"))
        vectors = _matrix(batch.column(batch.schema.get_field_index("vector")))
        raw = [None if v is None else v.tobytes() for v in vectors]
        digest = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
        yield pa.RecordBatch.from_pydict({"id": ids, "class": pa.array(digest, pa.binary()), "dim": pa.array([0 if v is None else len(v) for v in vectors], pa.int32()), "vector": pa.array(raw, pa.binary())})


def _units(raw) -> np.ndarray:
    x = np.stack([np.frombuffer(r, dtype=np.float64) for r in raw])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(batches):
    for batch in batches:
        if batch.num_rows:
            x = _units(batch.column(0).to_pylist())
            sums = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).reshape(-1)])
            yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(sums), dtype=np.int32)), "value": pa.array(sums)})


def principal(reps: DataFrame, dim: int, leading: int) -> np.ndarray:
    """(dim, leading) axes of most variance; dim * (dim + 1) + 1 numbers reach the driver, whatever the input."""
    rows = map_arrow(reps.select("vector"), _moments, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros(1 + dim + dim * dim)
    for r in rows:
        sums[r.place] = r.value
    mean = sums[1 : 1 + dim] / max(1, sums[0])
    spread = sums[1 + dim :].reshape(dim, dim) / max(1, sums[0]) - np.outer(mean, mean)
    return np.linalg.eigh(spread)[1][:, ::-1][:, : min(leading, dim)]


def apart(low_a, high_a, low_b, high_b, eps: float) -> np.ndarray:
    """Whether boxes are further apart than eps; an orthogonal projection only shortens distances, so this is proof."""
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return (gap * gap).sum(axis=-1) > eps * eps


def near_pairs(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray, same: bool, cosine: float, eps: float):
    """Index pairs with the cosine, by recursion over halves of both sequences until provably apart or small."""
    stack = [(0, len(x), 0, len(y))]
    rough, wide = x.astype(np.float32), y.astype(np.float32)
    least = np.float32(cosine - 2e-7 * (x.shape[1] + 8))  # what single precision can lose of a sum of so many products
    while stack:
        a, b, c, d = stack.pop()
        if a >= b or c >= d or same and d <= a:
            continue
        if apart(p[a:b].min(axis=0), p[a:b].max(axis=0), q[c:d].min(axis=0), q[c:d].max(axis=0), eps):
            continue
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero(rough[a:b] @ wide[c:d].T >= least)
            if len(i) > (b - a) * (d - c) // 8:
                i, j = np.nonzero(x[a:b] @ y[c:d].T >= cosine)
            elif len(i):
                sure = (x[a + i] * y[c + j]).sum(axis=1) >= cosine
                i, j = i[sure], j[sure]
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            stack += [(a, b, c, m), (a, b, m, d)]


def _join(rows: pd.DataFrame, axes: np.ndarray, cosine: float, eps: float) -> pd.DataFrame:
    """Links of one pair of intervals: how many each vector has, and a forest that joins what they join."""
    sides = [g for _, g in rows.groupby("block", sort=True)]
    same = rows.lo.iloc[0] == rows.hi.iloc[0]
    if not same and len(sides) < 2:
        return pd.DataFrame({"id": [], "links": [], "other": []}).astype("int64")
    sides = [s.sort_values(["order", "id"], kind="stable") for s in sides]
    left, right = sides[0], sides[0] if same else sides[1]
    x = _units(left.vector)
    y = x if same else _units(right.vector)
    ids = left.id.tolist() if same else left.id.tolist() + right.id.tolist()
    times = (left.times if same else pd.concat([left.times, right.times])).to_numpy()
    shift = 0 if same else len(x)
    links, forest, found = np.zeros(len(ids), dtype=np.int64), Forest(len(ids)), []
    for i, j in near_pairs(x, x @ axes, y, y @ axes, same, cosine, eps):
        j = j + shift
        np.add.at(links, i, times[j])
        np.add.at(links, j, times[i])
        for a, b in zip(i.tolist(), j.tolist()):
            if forest.join(a, b):
                found.append((ids[a], ids[b]))
    has = np.flatnonzero(links)
    return pd.DataFrame({"id": [ids[k] for k in has] + [a for a, _ in found], "links": [*links[has].tolist(), *([0] * len(found))], "other": [ids[k] for k in has] + [b for _, b in found]}).astype("int64")


def _partners(frames, names: np.ndarray, low: np.ndarray, high: np.ndarray, eps: float):
    """For each box, the later ones that are not apart from it: halves of the sequence are skipped by their boxes."""
    levels = [(low, high)]
    while len(levels[-1][0]) > 1:
        lo, hi = levels[-1]
        if len(lo) % 2:
            lo, hi = np.vstack([lo, lo[-1:]]), np.vstack([hi, hi[-1:]])
        levels.append((np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2])))
    for frame in frames:
        out = []
        for i in frame.id.tolist():
            here = np.zeros(1, dtype=np.int64)
            for depth in range(len(levels) - 1, -1, -1):
                lo, hi = levels[depth]
                here = here[(here < len(lo)) & ((here + 1 << depth) > i)]
                here = here[~apart(low[i], high[i], lo[here], hi[here], eps)]
                if depth:
                    here = np.concatenate([here * 2, here * 2 + 1])
            out += [(names[i], names[i], names[j]) for j in here] + [(names[j], names[i], names[j]) for j in here if j != i]
        yield pd.DataFrame(out, columns=["named", "lo", "hi"]).astype("int64")


def _box_columns(n: int) -> tuple[list[str], list[str]]:
    return [f"low{k}" for k in range(n)], [f"high{k}" for k in range(n)]


def _near_boxes(rows: pd.DataFrame, n: int, eps: float) -> pd.DataFrame:
    """Pairs of intervals that are not apart, of one pair of stretches of SUPER intervals: a row for each of the two."""
    low, high = _box_columns(n)
    rows = rows.sort_values("block", kind="stable")
    left, right = rows[rows.super == rows.lo.iloc[0]], rows[rows.super == rows.hi.iloc[0]]
    other, far, near = right.block.to_numpy(), right[low].to_numpy(), right[high].to_numpy()
    out = []
    for block, a, b in zip(left.block.to_numpy(), left[low].to_numpy(), left[high].to_numpy()):
        found = other[(other >= block) & ~apart(a, b, far, near, eps)]
        out.append(np.stack([np.full(len(found), block), np.full(len(found), block), found], axis=1))
        found = found[found > block]
        out.append(np.stack([found, np.full(len(found), block), found], axis=1))
    return pd.DataFrame(np.concatenate(out), columns=["named", "lo", "hi"]).astype("int64")


def interval_order(reps: DataFrame, dim: int, cosine: float) -> tuple[DataFrame, np.ndarray, float]:
    """Vectors in the grid order with the number of their interval (``block``) and their place in it, the leading axes,
    and the distance that the cosine means."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) * (1 + 1e-9)
    axes = principal(reps, dim, BOXED)
    grid = [f"c{k}" for k in range(min(LEADING, axes.shape[1]))]

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                p = _units(batch.column(batch.schema.get_field_index("vector")).to_pylist()) @ axes
                cells = np.floor(p / max(eps, 1e-6)).astype(np.int64)
                more = {c: pa.array(cells[:, k]) for k, c in enumerate(grid)} | {f"p{k}": pa.array(p[:, k]) for k in range(p.shape[1])}
                yield pa.RecordBatch.from_pydict({**{c: batch.column(i) for i, c in enumerate(batch.schema.names)}, **more})

    kinds = ", ".join([*[f"{c} long" for c in grid], *[f"p{k} double" for k in range(axes.shape[1])]])
    blocks = max(1, -(-reps.count() // BLOCK))
    placed = map_arrow(reps.select("id", "times", "vector"), place, f"id long, times long, vector binary, {kinds}")
    # the grid order: by cell, dimension by dimension; within a cell by the first projection, so that hot cells part
    ordered = placed.repartitionByRange(blocks, *grid, "p0", "id").sortWithinPartitions(*grid, "p0", "id")
    return cut(ordered.withColumn("block", F.spark_partition_id().cast("long")).withColumn("order", F.monotonically_increasing_id())), axes, eps


def interval_pairs(ordered: DataFrame, n: int, eps: float) -> DataFrame:
    """(named, lo, hi): pairs of intervals that are not proved apart, a row for each interval of a pair.

    Boxes of SUPER intervals are compared first; only stretches that are not apart have their intervals' boxes compared.
    """
    spark = visible(ordered.sparkSession)
    low, high = _box_columns(n)
    spans = [f(f"p{k}").alias(c) for names, f in ((low, F.min), (high, F.max)) for k, c in enumerate(names)]
    boxes = cut(ordered.groupBy("block").agg(*spans).withColumn("super", F.floor(F.col("block") / SUPER)), small=True)
    wide = boxes.groupBy("super").agg(*[F.min(c).alias(c) for c in low], *[F.max(c).alias(c) for c in high]).toPandas().sort_values("super")
    names, lows, highs = wide.super.to_numpy(), wide[low].to_numpy(), wide[high].to_numpy()
    stretches = spark.range(len(names)).mapInPandas(lambda it: _partners(it, names, lows, highs, eps), "named long, lo long, hi long")
    met = boxes.join(stretches, F.col("super") == F.col("named")).drop("named")
    return met.groupBy("lo", "hi").applyInPandas(lambda g: _near_boxes(g, n, eps), "named long, lo long, hi long")


def _link(reps: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(id, links, other) of the classes of one dimension."""
    ordered, axes, eps = interval_order(reps, dim, cosine)
    pairs = interval_pairs(ordered, axes.shape[1], eps)
    rows = ordered.select("id", "times", "vector", "block", "order").join(pairs, F.col("block") == F.col("named")).drop("named")
    return rows.groupBy("lo", "hi").applyInPandas(lambda g: _join(g, axes, cosine, eps), "id long, links long, other long")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``df``, whose key is a long.

    Equal vectors are one class with a count. Classes are sorted in the grid order of their leading principal
    dimensions and cut in intervals; pairs of intervals whose boxes are further apart than the distance that the
    cosine means are skipped by proof, all others joined exactly, recursively, with the same proof down to 256 vectors:
    by products in single precision less what that can lose, then in double precision. A task returns a count per
    vector and a forest, not its links, so dense groups cost no more rows than they have vectors. Vectors without any
    structure (all directions alike) leave nothing to skip: then every interval meets every other.

    Null, empty and zero vectors and those that hold nulls or non-finite components are linked with nothing; vectors
    of other dimensions are only compared with their like; rows of one key count as one node; rows with a null key are
    linked with nothing and kept.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    found = cut(map_arrow(rows, _classes, "id long, class binary, dim int, vector binary"))
    full = found.where("dim > 0 and id is not null")
    # the vector is carried by the class's own minimum: equal in all of its rows
    reps = cut(full.groupBy("class", "dim").agg(F.min("id").alias("id"), F.count("*").alias("times"), F.first("vector").alias("vector")))
    links = None
    for dim in sorted(r.dim for r in reps.select("dim").distinct().collect()):
        part = _link(reps.where(F.col("dim") == dim), dim, cosine)
        links = part if links is None else links.union(part)
    if links is None:
        links = df.sparkSession.createDataFrame([], "id long, links long, other long")
    links = cut(links)
    groups = components(links.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    named = reps.select("class", "id", "times").join(counts, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("class", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).cast("long").alias("n_links"), F.coalesce("component", "id").alias("c"))
    out = found.select("id", "class", "dim").join(named, "class", "left")
    linked = F.col("c").isNotNull() & F.col("id").isNotNull()
    out = out.select(F.col("id").alias(key), F.when(linked, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.when(linked, F.col("c")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def op9(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= {COSINE}),
n as (select a, count(*)::bigint as n from l group by a),
r as (
  with recursive reach as (select a, b from l union select reach.a, l.b from reach join l on reach.b = l.a)
  select a, min(b) as b from reach group by a)
select vec_id, coalesce(n.n, 0) as n_links, least(vec_id, coalesce(r.b, vec_id)) as component_id, vec_id = least(vec_id, coalesce(r.b, vec_id)) as kept
from embeddings left join n on n.a = vec_id left join r on r.a = vec_id
"""
