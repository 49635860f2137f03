"""Sharding along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_ROWS, MOST_HOT, cut, free_names, read, running

BITS = 4


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Place of a grid point on the Hilbert curve, by undoing the axis exchanges from the top bit down."""
    axes, n = list(point), len(point)
    top = 1 << (bits - 1)
    level = top
    while level > 1:
        low = level - 1
        for i in range(n):
            if axes[i] & level:
                axes[0] ^= low
            else:
                swap = (axes[0] ^ axes[i]) & low
                axes[0] ^= swap
                axes[i] ^= swap
        level >>= 1
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    flip, level = 0, top
    while level > 1:
        if axes[-1] & level:
            flip ^= level - 1
        level >>= 1
    axes = [a ^ flip for a in axes]
    index = 0
    for bit in range(bits - 1, -1, -1):
        for a in axes:
            index = index << 1 | (a >> bit & 1)
    return index


def cuts(df: DataFrame, dim: str, bits: int = BITS) -> list:
    """At most 2**bits - 1 ascending values that part the column's rows about evenly.

    Numbers use a mergeable quantile sketch.  Other values are counted first (map-side combined), and those
    at which the running share of rows passes a further step of 1 / 2**bits are returned; no task holds them all.
    """
    cells = 1 << bits
    if isinstance(df.schema[dim].dataType, T.NumericType):
        found = df.select(F.percentile_approx(F.col(dim), [i / cells for i in range(1, cells)], 10_000)).head()[0]
        return sorted({x for x in found or []})
    counts = df.where(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("v")).count()
    counts = running(counts, [F.col("v").asc()], {"before": "count"})
    rows = df.where(F.col(dim).isNotNull()).count()
    firsts = counts.groupBy(F.floor(F.col("before") * cells / F.lit(max(1, rows))).alias("cell")).agg(F.min("v").alias("v")).where("cell > 0")
    return sorted(r.v for r in firsts.select("v").collect())


def _cell(column: Column, edges: list) -> Column:
    passed = [F.when(column >= F.lit(e), 1).otherwise(0) for e in edges]
    return sum(passed[1:], passed[0]) if passed else F.lit(0)


def _together(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` (row, key, group, cell) with the cell of the least key of their group: equal groups come side by side.

    Groups of one row are left alone. Rows of hot groups meet a broadcast of at most MOST_HOT facts; they are spread by
    their keys where the others are joined.
    """
    facts = rows.groupBy("group").agg(F.count("*").alias("size"), F.min(F.struct("key", "cell"))["cell"].alias("led")).where("size > 1")
    facts = cut(facts)
    most = max(HOT_ROWS, total // MOST_HOT)
    hot = facts.where(F.col("size") > most).select(F.col("group").alias("hot"), F.col("led").alias("hot_led"))
    out = rows.join(F.broadcast(hot), F.col("group") == F.col("hot"), "left")
    at = F.when(F.col("hot").isNotNull(), F.concat(F.lit("-"), F.xxhash64("key").cast("string"))).otherwise(F.col("group"))
    cold = facts.where(F.col("size") <= most).select(F.col("group").alias("cold"), "led")
    out = out.withColumn("at", at).join(cold, F.col("at") == F.col("cold"), "left")
    return out.select("row", "key", "group", F.coalesce("hot_led", "led", "cell").alias("cell"))


def shard(df: DataFrame, key: str, dims: list[str], shards: int = 8, bits: int = BITS, group: str | None = None) -> DataFrame:
    """Adds ``shard``, ``slot`` and ``curve_cell`` to the rows of ``df``: the curve order cut in ``shards`` runs whose
    counts are at most one apart.

    Each dimension is quantised to 2**bits cells by its own quantiles, so runs of the curve have narrow ranges
    of every dimension and a reader can skip shards by any of them.  Rows of one cell are ordered by ``group`` (a string
    column, where given), key and then the row itself.  Rows of one group take the cell of the one of least key, so
    they stand side by side and share a shard, but for groups over which a run's end falls: the counts decide that.
    The order is dealt to tasks by ranges, of which only totals are summed, so a cell or group that holds a third of all
    rows is ordered by as many tasks as it has ranges.

    Nulls of a dimension or key count as least, null groups as one; rows that are equal in all columns may swap places;
    an empty table gives an empty result.  Columns of ``df`` named as those added stay, with an underscore after their
    names.
    """
    total = df.count()
    edges = {d: cuts(df, d, bits) for d in dims}
    code = F.lit(0)
    for d in dims:
        code = code * (1 << bits) + F.coalesce(_cell(F.col(f"`{d}`"), edges[d]), F.lit(0))
    size = 1 << bits
    points = []
    for i in range(size ** len(dims)):
        point = tuple(i // size ** (len(dims) - 1 - k) % size for k in range(len(dims)))
        points.append((i, hilbert_index(point, bits)))
    curve = df.sparkSession.createDataFrame(points, "code int, cell int")
    of = F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("")) if group else F.lit("")
    named = free_names(df, ["shard", "slot", "curve_cell"]).columns
    row = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, named)])
    # The curve table has 2**(bits * dims) rows whatever the input: a proven bound.
    placed = df.select(row.alias("row"), F.col(f"`{key}`").alias("key"), of.alias("group"), code.cast("int").alias("code")).join(F.broadcast(curve), "code").drop("code")
    if group:
        placed = _together(placed, total)
    order = [F.col(c).asc_nulls_first() for c in ("cell", "group", "key", "row")]
    out = running(placed.withColumn("one", F.lit(1)), order, {"rank": "one"})
    base, longer = divmod(total, shards)
    edge = longer * (base + 1)
    number = F.when(F.col("rank") < edge, F.expr(f"rank div {base + 1}")).otherwise(longer + F.expr(f"(rank - {edge}) div {max(base, 1)}")).cast("int")
    first = F.least(F.col("shard"), F.lit(longer)) * (base + 1) + F.greatest(F.col("shard") - longer, F.lit(0)) * base
    return out.withColumn("shard", number).select("row.*", "shard", (F.col("rank") - first).cast("long").alias("slot"), F.col("cell").alias("curve_cell"))


def op7(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the ``rows`` law, along a curve over lang, source and n_chars.

    Equal texts stand side by side in the order of the slots. They share a shard unless the end of a run falls inside
    their group: the law fixes the counts, and a group may be larger than a shard.
    """
    docs = read(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", "lang", "source", "n_chars", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("text_md5"))
    out = shard(narrow, "doc_id", ["lang", "source", "n_chars"], group="text_md5")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_cell")
