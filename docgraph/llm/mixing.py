"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import WORD, cut, free_names, n_words, read, running

EPOCHS = 3
SEED = "mix-1"
BROADCAST_ROWS = 10_000
ADDED = ["source_size", "target", "turns", "more", "taken"]


def targets(sizes: DataFrame, epochs: float = EPOCHS) -> DataFrame:
    """Water-filling over (source, source_size, weight): adds ``target``.

    Targets share the total by weight, none above ``epochs`` times its source.  Clamping sources and resharing the
    excess until none is above ends at one water level L with target = min(cap, L * weight).  Sources are sorted by
    cap / weight, the order in which they clamp as the level rises; the first one whose own ratio is at least the
    level that is left after clamping all before it gives L.  One pass over the sources, nothing iterated, and no task
    holds all of them.
    """
    out = sizes.withColumn("cap", F.col("source_size") * F.lit(epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    out = cut(running(out, [F.col("ratio").asc(), F.col("source").asc_nulls_last()], {"cap_before": "cap", "weight_before": "weight"}), small=True)
    size, weight = out.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).head()
    out = out.withColumn("level", (F.lit(size) - F.col("cap_before")) / (F.lit(weight) - F.col("weight_before")))
    first = out.where(F.col("ratio") >= F.col("level")).agg(F.min(F.struct("ratio", "level")).alias("at")).head()["at"]
    return out.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(first["level"] if first else 0.0) * F.col("weight")))


def _place(df: DataFrame, seed: str) -> DataFrame:
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col("key").cast("string")))
    return df.withColumn("h", h).withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))


def plan(docs: DataFrame, sizes: DataFrame | None = None, seed: str = SEED, epochs: int = EPOCHS) -> tuple[DataFrame, DataFrame]:
    """What ``mix`` does with (key, source, size): a row for each source, and ``more`` for the rows of the hash bucket in
    which the rest of its target runs out."""
    rows = cut(_place(docs, seed))
    buckets = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")), small=True)
    total = buckets.groupBy("source").agg(F.sum("size").alias("source_size"))
    if sizes is None:
        total = running(total.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], {"place": "one"})
        total = total.select("source", "source_size", (F.col("place") % 3 + 1).cast("long").alias("weight"))
    else:
        total = total.join(sizes.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goal = targets(total, epochs)
    turns = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("turns", turns).withColumn("rest", F.floor(F.col("target") - F.col("turns") * F.col("source_size") + 0.5).cast("long"))
    # a target at most half a word below a whole turn rounds to that turn
    full = (F.col("rest") >= F.col("source_size")) & (F.col("source_size") > 0)
    goal = goal.withColumns({"turns": F.when(full, F.col("turns") + 1).otherwise(F.col("turns")), "rest": F.when(full, F.lit(0).cast("long")).otherwise(F.col("rest"))})
    goal = goal.select(F.col("source").alias("s"), "source_size", "target", "turns", "rest")
    upto = W.Window.partitionBy("source").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    filled = buckets.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    goal = (
        filled.join(goal, F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size")) | (F.col("rest") == 0) & (F.col("source_size") == 0))
        .groupBy("s", "source_size", "target", "turns", "rest")
        .agg(F.min(F.struct("bucket", "before")).alias("at"))
        .select("s", "source_size", "target", "turns", "rest", F.col("at.bucket").alias("stop"), F.col("at.before").alias("stop_from"))
    )
    goal = cut(goal, small=True)
    order = W.Window.partitionBy("source").orderBy("h", F.col("key").asc_nulls_first(), "size").rowsBetween(W.Window.unboundedPreceding, -1)
    edge = _with(rows, goal).where(F.col("bucket") == F.col("stop")).withColumn("before", F.col("stop_from") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    # rows alike in key, source and size are told apart by number only
    nth = F.row_number().over(W.Window.partitionBy("source", "key", "size").orderBy("before"))
    return goal, cut(edge.select("source", "key", "size", more.alias("more"), nth.alias("nth")), small=True)


def _with(rows: DataFrame, goal: DataFrame) -> DataFrame:
    small = goal.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # one row a source
    return rows.join(F.broadcast(goal) if small else goal, F.col("source").eqNullSafe(F.col("s")), "left")


def mix(docs: DataFrame, sizes: DataFrame | None = None, seed: str = SEED, epochs: int = EPOCHS) -> DataFrame:
    """``docs`` (key, source, size and any others) with source_size, target, turns, more and ``taken``, the words that
    the mix takes of each row: ``size`` for each turn, and ``more``.

    A source is taken whole floor(target / size) times, and a fraction once more: rows in the order of a seeded hash
    until the rest of the target is met, the last of them in part.  The order is cut in 4096 hash buckets; sums per
    (source, bucket) show the one bucket of each source in which the rest runs out, and only its rows are ordered one
    by one, so a source with a third of all rows is never sorted in one task, and only those rows are ever shuffled
    whole.  Weights are 1, 2, 3, repeating by code point order of the sources, null last, unless ``sizes`` (source,
    weight) gives others.

    Null sources form one source; rows of size 0 take 0; repeated rows are rows of their own; a mix of no words takes
    none.  Columns of ``docs`` named as those added stay, with an underscore after their names.
    """
    docs = free_names(docs, ADDED)
    names = docs.columns
    others = [F.col(f"`{c}`") for c in names if c not in ("key", "source", "size")]
    docs = docs.select("key", "source", "size", (F.struct(*others) if others else F.lit(None)).alias("row"))
    goal, edge = plan(docs.select("key", "source", "size"), sizes, seed, epochs)
    joined = _with(_place(docs, seed), goal)
    inside = F.coalesce(F.col("bucket") == F.col("stop"), F.lit(False))
    rest = joined.where(~inside).withColumn("more", F.when(F.col("bucket") < F.col("stop"), F.col("size")).otherwise(0))
    nth = F.row_number().over(W.Window.partitionBy("source", "key", "size").orderBy(F.lit(0)))
    e = edge.select(*[F.col(c).alias(f"e_{c}") for c in ("source", "key", "size", "nth")], "more")
    same = F.col("source").eqNullSafe(F.col("e_source")) & F.col("key").eqNullSafe(F.col("e_key")) & (F.col("size") == F.col("e_size")) & (F.col("nth") == F.col("e_nth"))
    at = joined.where(inside).withColumn("nth", nth).join(e, same).drop("nth", "e_source", "e_key", "e_size", "e_nth")
    out = rest.unionByName(at).withColumn("turns", F.coalesce("turns", F.lit(0)).cast("long")).withColumn("more", F.coalesce("more", F.lit(0)).cast("long"))
    out = out.withColumn("taken", (F.col("turns") * F.col("size") + F.col("more")).cast("long"))
    return out.select(*[F.col(c) if c in ("key", "source", "size") else F.col(f"row.`{c}`").alias(c) for c in names], *ADDED)


def mixed(docs: DataFrame, key: str = "doc_id", seed: str = SEED) -> DataFrame:
    """The rows of the mix itself: each document as often as it is taken, with the columns of ``docs``.

    The one document of each source that is taken in part has its first words then, with single blanks between, and
    ``n_chars`` follows if there is one. A document of no words is in no mix.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = mix(docs.select(row.alias("__row"), F.col(key).alias("key"), "source", n_words(F.col("text")).alias("size")), seed=seed)
    copies = F.col("turns") + F.when(F.col("more") > 0, 1).otherwise(0)
    out = out.where(F.col("taken") > 0).withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    out = out.withColumn("__part", (F.col("__turn") > F.col("turns")) & (F.col("more") < F.col("size")))
    text = F.col("__row")["text"]
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.greatest(F.col("more"), F.lit(1)).cast("int")), " ")
    new = {"text": F.when(F.col("__part"), head).otherwise(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__part"), F.length(head).cast("long")).otherwise(F.col("__row")["n_chars"])
    return out.select(*[new.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])


def op3(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("key"), "source", n_words(F.col("text")).alias("size"))
    out = mix(cut(rows))
    return out.select(F.col("key").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), "taken")


SQL = rf"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('{SEED}|' || doc_id::varchar) as h
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as weight
  from d group by source),
r as (select *, source_size * {EPOCHS} as cap, (source_size * {EPOCHS})::double / weight as ratio from s),
-- clamp the k sources of least ratio, for every k, and keep the first level that clamps no more
l as (
  select a.ratio,
         (select sum(source_size) from r)::bigint - coalesce((select sum(cap) from r b where (b.ratio, coalesce(b.source, chr(1114111))) < (a.ratio, coalesce(a.source, chr(1114111)))), 0)::bigint as words,
         (select sum(weight) from r)::bigint - coalesce((select sum(weight) from r b where (b.ratio, coalesce(b.source, chr(1114111))) < (a.ratio, coalesce(a.source, chr(1114111)))), 0)::bigint as weights
  from r a),
w as (select arg_min(words::double / weights, ratio) as level from l where ratio >= words::double / weights),
t as (select source, source_size, least(cap::double, level * weight) as target from r, w),
u as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as turns from t),
v as (select *, floor(target - turns * source_size + 0.5)::bigint as rest from u)
select d.doc_id, d.size, v.source_size, v.target,
       (v.turns * d.size + greatest(0, least(d.size, v.rest - coalesce(sum(d.size) over (
          partition by d.source order by d.h, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0))))::bigint as taken
from d join v on d.source is not distinct from v.source
"""
