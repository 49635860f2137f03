"""Near-duplicate documents: similarity sketches, banding, exact verification, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, map_arrow, maybe_in, read, string_buffers, sub_batches
from .graph import components
from .sketch import band_keys, set_keys, shingle_sets, sketches

BLOCK = 512_000  # a block's weight, about: its sets' sizes and 1000 for each set
WORDS, PERCENT = 5, 80
#: Rows and bands by least similarity in per cent. A pair at 85 shares none of 28 bands of 5 with a chance of 7e-8, a
#: pair at 80 none of 34 bands of 4 with one of 2e-8.
BANDS = ((85, 5, 28), (0, 4, 34))


def banding(percent: int) -> tuple[int, int]:
    return next((r, b) for least, r, b in BANDS if percent >= least)


def _sketch(batches, words: int, rows: int, bands: int):
    for batch in sub_batches(batches):
        data, offsets = string_buffers(batch.column(batch.schema.get_field_index("text")))
        values, more, at = shingle_sets(data, offsets, words)
        keys = band_keys(sketches(values, at, rows * bands), rows).view(np.int64)
        whole = set_keys(values, more, at).view(np.int64)
        n = np.diff(at)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
        yield pa.RecordBatch.from_pydict({"id": batch.column(batch.schema.get_field_index("id")), "n": pa.array(n), "k1": pa.array(whole[:, 0]), "k2": pa.array(whole[:, 1]), "bands": flat})


def _sets(batches, words: int):
    for batch in sub_batches(batches):
        data, offsets = string_buffers(batch.column(batch.schema.get_field_index("text")))
        values, _, at = shingle_sets(data, offsets, words)
        sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(8 * at), pa.py_buffer(values)])
        yield pa.RecordBatch.from_pydict({"id": batch.column(batch.schema.get_field_index("id")), "items": sets.cast(pa.binary())})


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets, by bit sets over the items that two or more of them hold."""
    if len(left) > 8:
        flat = np.concatenate(sets)
        item, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times > 1)
        width = -(-len(shared) // 64)
        if len(sets) * width <= 8 << 20:  # 64 MB of bits
            place = np.full(len(item), -1)
            place[shared] = np.arange(len(shared))
            place, owner = place[inverse], np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            place, owner = place[place >= 0], owner[place >= 0]
            bits = np.zeros(len(sets) * width, dtype=np.uint64)
            np.bitwise_or.at(bits, owner * width + place // 64, np.uint64(1) << (place % 64).astype(np.uint64))
            bits = bits.reshape(len(sets), width)
            out, step = np.zeros(len(left), dtype=np.int64), max(1, (1 << 20) // max(1, width))
            for i in range(0, len(left), step):
                out[i : i + step] = np.bitwise_count(bits[left[i : i + step]] & bits[right[i : i + step]]).sum(axis=1)
            return out
    return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left.tolist(), right.tolist())], dtype=np.int64)


class Forest:
    """Union-find over places; the least place of a tree is its root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def linked(ids: list, parts: np.ndarray, blocks: np.ndarray, cross: bool, sets: list[np.ndarray], percent: int) -> list[tuple]:
    """Links that join what all pairs of sets of different ``parts`` with the similarity join, less than there are sets.

    With ``cross`` only sets of different ``blocks`` are compared.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    forest, found = Forest(n), []
    for part in np.unique(parts):
        same = np.flatnonzero(parts == part)
        for i in same[1:].tolist():
            forest.join(int(same[0]), i)
    order = np.argsort(size, kind="stable")
    ranked = size[order]
    # a set can only be linked with sets of up to 100 / percent times its size
    upto = np.searchsorted(ranked * percent, ranked * 100, side="right")
    lefts, rights = [], []

    def flush():
        left, right = np.concatenate(lefts), np.concatenate(rights)
        lefts.clear(), rights.clear()
        both = overlaps(sets, left, right)
        good = 100 * both >= percent * (size[left] + size[right] - both)
        for a, b in zip(left[good].tolist(), right[good].tolist()):
            if forest.join(a, b):
                found.append((ids[a], ids[b]))

    held = 0
    for i in range(n):
        mates = order[i + 1 : upto[i]]
        mates = mates[parts[mates] != parts[order[i]]]
        if cross:
            mates = mates[blocks[mates] != blocks[order[i]]]
        if len(mates):
            lefts.append(np.full(len(mates), order[i]))
            rights.append(mates)
            held += len(mates)
        if held > 2_000_000:
            flush()
            held = 0
    if held:
        flush()
    return found


def _runs(batches, names: tuple[str, ...]):
    """(key, rows) of each stretch of a batch whose columns ``names`` are alike; ``rows`` are (column values, set)."""
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        if not batch.num_rows:
            continue
        keys = np.stack([cols[c].to_numpy(zero_copy_only=False) for c in names], axis=1)
        data, offsets = string_buffers(cols["items"])
        offsets, raw = offsets.tolist(), data.tobytes()
        more = {c: cols[c].to_pylist() for c in cols if c not in (*names, "items")}
        edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            yield tuple(keys[a].tolist()), {c: v[a:b] for c, v in more.items()}, [np.frombuffer(raw[offsets[i] : offsets[i + 1]], dtype=np.uint64) for i in range(a, b)]


def _with_center(batches, percent: int):
    """Links of centers with members of their groups. Rows come sorted, the center first: one set is held, no more."""
    key, center = None, []

    def near(a: np.ndarray, b: np.ndarray) -> bool:
        if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= percent * (len(a) + len(b) - both)

    for own, cols, sets in _runs(batches, ("center", "part")):
        if own != key:
            key, center = own, []
        out = []
        for i, member in zip(cols["id"], sets):
            if i == own[0]:
                center.append(member)  # one set, but for keys that repeat with other texts
            elif any(near(c, member) for c in center):
                out.append((own[0], i))
        yield _links(out)


def _verify(batches, percent: int):
    """Rows come sorted by (center, lo, hi); a cell is verified once its last row has come."""
    key, held, sets = None, {"id": [], "part": [], "block": []}, []

    def close():
        if len(sets) < 2:
            return []
        return linked(held["id"], np.array(held["part"]), np.array(held["block"]), key[1] != key[2], sets, percent)

    for own, cols, more in _runs(batches, ("center", "lo", "hi")):
        if own != key:
            if sets:
                yield _links(close())
            key, held, sets = own, {"id": [], "part": [], "block": []}, []
        for c in held:
            held[c] += cols[c]
        sets += more
    yield _links(close())


def _links(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})


def _blocks(weight: Column) -> Column:
    return F.ceil(weight / F.lit(BLOCK)).cast("int")


def _spread(column: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(column), blocks).cast("int")


def near_duplicates(docs: DataFrame, key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``, whose key is a long.

    Documents are linked where their shingle sets have 100 * intersection >= percent * union; a component is all that
    links reach, named by its least key, and only that one is kept.

    Equal sets (by 128 bits of each shingle) are one class from the start, so groups of copies cost a row each and no
    pairs. Sketches of the classes are cut in bands; classes that share a band go to a group named by the least of
    them, its center, once for all bands with the same center. Groups are verified on full sets in two steps:

    1. every member with its center, a pair a member, so a near-copy group of any size costs a row a member;
    2. members that the first step left in different components, all pairs across them. Of a group, those in its
       largest component (the base) and the others are dealt in blocks of bounded weight; a base block meets each block
       of the others, and these meet each other. Where few are left out, a base set travels once.

    Both steps return forests, not pairs. Nothing is capped; pairs are lost only if they share no band (see BANDS). Sets
    are compared by 64 bits a shingle.

    Null or wordless texts have no shingles and are linked with nothing; rows with the same key count as one document;
    rows with a null key are linked with nothing and kept. Empty tables give none.
    """
    rows, bands = banding(percent)
    texts = docs.select(F.col(key).cast("long").alias("id"), "text")
    schema = "id long, n long, k1 long, k2 long, bands array<long>"
    marks = cut(map_arrow(texts, lambda it: _sketch(it, words, rows, bands), schema))
    full = marks.where("n > 0 and id is not null")
    classes = cut(full.groupBy("k1", "k2").agg(F.min("id").alias("rep")), small=True)
    reps = cut(full.join(classes, ["k1", "k2"]).where("id = rep").dropDuplicates(["k1", "k2"]).select("id", "n", "bands"))
    banded = reps.select("id", "n", F.explode("bands").alias("band"))
    met = cut(banded.groupBy("band").agg(F.min("id").alias("center"), F.count("*").alias("size")).where("size > 1"), small=True)
    members = join_hot(banded, met, "band", "size", reps.count() * bands).select("center", "id", "n").distinct()
    members = cut(members, small=True)

    per = members.groupBy("center").agg(F.count("*").alias("size"), F.sum(F.col("n") + 1000).alias("weight"))
    per = cut(per.select("center", "size", _blocks(F.col("weight")).alias("blocks")), small=True)
    total = members.count()
    dealt = join_hot(members.where("id <> center"), per, "center", "size", total).select("center", "id", _spread("id", F.col("blocks")).alias("part"))
    centers = per.select("center", F.col("center").alias("id"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    # the joins below are exact; here most texts are set aside without a shuffle
    sets = map_arrow(maybe_in(texts, "id", members.select("id")), lambda it: _sets(it, words), "id long, items binary")
    to_center = dealt.unionByName(centers).join(sets, "id").withColumn("later", F.col("id") != F.col("center"))
    to_center = to_center.repartition("center", "part").sortWithinPartitions("center", "part", "later").select("center", "part", "id", "items")
    found = cut(map_arrow(to_center, lambda it: _with_center(it, percent), "a long, b long"), small=True)
    stars = cut(components(found), small=True)

    # the center has been compared with all; of the others, those in different components are left
    rest = members.where("id <> center").join(stars, F.col("id") == F.col("node"), "left").select("center", "id", "n", F.coalesce("component", "id").alias("part"))
    rest = cut(rest, small=True)
    parts = rest.groupBy("center", "part").agg(F.count("*").alias("size"), F.sum(F.col("n") + 1000).alias("weight"))
    open_ = parts.groupBy("center").agg(F.sum("size").alias("size"), F.max_by("part", F.struct("weight", "part")).alias("base"), F.max("weight").alias("base_weight"), F.sum("weight").alias("weight"), F.count("*").alias("parts")).where("parts > 1")
    open_ = open_.select("center", "size", "base", _blocks(F.col("base_weight")).alias("base_blocks"), _blocks(F.col("weight") - F.col("base_weight")).alias("other_blocks"))
    cells = join_hot(rest, cut(open_, small=True), "center", "size", total)
    inside = F.col("part") == F.col("base")
    # blocks of the base are numbered -1, -2, ..., those of the others 0, 1, ...
    cells = cells.withColumn("block", F.when(inside, -1 - _spread("id", F.col("base_blocks"))).otherwise(_spread("id", F.col("other_blocks"))))
    others = F.sequence(F.lit(0), F.col("other_blocks") - 1)
    mates = F.when(inside, others).otherwise(F.concat(F.sequence(-F.col("base_blocks"), F.lit(-1)), others))
    cells = cells.withColumn("mate", F.explode(mates)).select("center", F.least("block", "mate").alias("lo"), F.greatest("block", "mate").alias("hi"), "id", "part", "block")
    grouped = cells.join(sets, "id").repartition("center", "lo", "hi").sortWithinPartitions("center", "lo", "hi")
    more = map_arrow(grouped.select("center", "lo", "hi", "id", "part", "block", "items"), lambda it: _verify(it, percent), "a long, b long")
    more = cut(more, small=True)
    groups = stars if more.isEmpty() else components(found.union(more))
    named = classes.join(groups, classes.rep == groups.node, "left").select("k1", "k2", F.coalesce("component", "rep").alias("c"))
    out = marks.select("id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("c")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps: one document of each group."""
    gone = cut(near_duplicates(docs, key, words, percent).where(~F.col("kept")).select(F.col(key).alias("__gone")).distinct())
    sure = maybe_in(docs, key, gone, anti=True)
    return sure.unionByName(maybe_in(docs, key, gone).join(gone, F.col(key) == F.col("__gone"), "left_anti"))


def op8(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), "doc_id", words=3, percent=85)


SQL = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end) as g from w),
n as (select doc_id, count(*)::bigint as n from s group by doc_id),
common as (select g from s group by g having count(*) > 1),
i as (select a.doc_id as a, b.doc_id as b, count(*)::bigint as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id where a.g in (select g from common) group by all),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r as (
  with recursive reach as (select a, b from e union select reach.a, e.b from reach join e on reach.b = e.a)
  select a, min(b) as b from reach group by a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(r.b, w.doc_id)) as component_id,
  w.doc_id = least(w.doc_id, coalesce(r.b, w.doc_id)) as kept
from w left join n using (doc_id) left join r on r.a = w.doc_id
"""
