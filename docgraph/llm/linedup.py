"""Line dedup by a deletion-neighbourhood join: lines within one edit of an earlier line go."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, cut, free_names, join_hot, let, map_arrow, maybe_in, mix64, read, running, span_digests, string_buffers, sub_batches
from .rolling import Rolling

MIN_CHARS = 20  # shorter lines only go if they equal an earlier one: one edit makes too many of them alike
NEWLINE = 10


class Lines:
    """Lines of texts that stand end to end, with byte and code point offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        breaks = np.flatnonzero(data == NEWLINE)
        self.data, self.text = data, np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1])
        start = np.concatenate([offsets[:-1], breaks + 1])
        order = np.argsort(self.text, kind="stable")
        order = order[np.lexsort((start[order], self.text[order]))]
        self.text, self.start = self.text[order], start[order]
        last = np.append(self.text[1:] != self.text[:-1], True) if len(self.text) else np.zeros(0, bool)
        self.stop = np.where(last, offsets[self.text + 1], np.append(self.start[1:], 0) - 1)
        first = np.searchsorted(self.text, np.arange(len(offsets) - 1))
        self.number = np.arange(len(self.text)) - first[self.text]
        lead = (data & 0xC0) != 0x80
        self.chars = np.concatenate([[0], np.cumsum(lead)])  # code points before each byte
        self.at = np.append(np.flatnonzero(lead), len(data))  # byte of each code point
        self.length = self.chars[self.stop] - self.chars[self.start]
        said = np.concatenate([[0], np.cumsum(~_SPACE[data])])
        self.said = said[self.stop] > said[self.start]  # whether a word stands in the line
        self.rolling = Rolling(data)

    def keep(self, mask: np.ndarray) -> None:
        for name in ("text", "start", "stop", "number", "length", "said"):
            setattr(self, name, getattr(self, name)[mask])

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        return span_digests(self.data, self.start, self.stop)

    def without_part(self, parts: int) -> np.ndarray:
        """Keys of each line without one of ``parts`` stretches, for its own length and for the length one less.

        Lines within one edit of each other agree in all but one stretch, the stretches being laid by the shorter
        line's length: they have one of these keys in common.
        """
        first = self.chars[self.start]
        out = []
        for less in (0, 1):
            length = self.length - less
            for j in range(parts):
                a, b = length * j // parts, length * (j + 1) // parts
                head = self.rolling.hash(self.start, self.at[first + np.maximum(a, 0)])
                tail = self.rolling.hash(self.at[first + self.length - (length - b)], self.stop)
                salt = mix64((length * parts + j).astype(np.uint64))
                out.append(mix64(mix64(head + salt) * np.uint64(0x9E3779B97F4A7C15) + tail))
        return np.stack(out, axis=1) if len(self.start) else np.zeros((0, 2 * parts), np.uint64)


def _lists(values: np.ndarray, of: np.ndarray) -> pa.Array:
    """A list column of the rows of ``values`` where ``of`` holds, empty lists elsewhere."""
    at = np.concatenate([[0], np.cumsum(of)]).astype(np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(values[of]).view(np.int64).reshape(-1)))


def _scan(batches):
    for batch in sub_batches(batches):
        data, offsets = string_buffers(batch.column(batch.schema.get_field_index("text")))
        lines = Lines(data, offsets)
        lines.keep(lines.said)
        k1, k2 = lines.hashes()
        ids = batch.column(batch.schema.get_field_index("id")).take(pa.array(lines.text))
        yield pa.RecordBatch.from_pydict({"id": ids, "line": pa.array(lines.number), "k1": pa.array(k1.view(np.int64)), "k2": pa.array(k2.view(np.int64)), "halves": _lists(lines.without_part(2), lines.length >= MIN_CHARS)})


def _fetch(batches, parts: int):
    for batch in sub_batches(batches):
        data, offsets = string_buffers(batch.column(batch.schema.get_field_index("text")))
        lines = Lines(data, offsets)
        wanted = batch.column(batch.schema.get_field_index("lines")).to_pylist()
        chosen = np.zeros(len(lines.text), dtype=bool)
        first = np.searchsorted(lines.text, np.arange(len(wanted) + 1))
        for i, numbers in enumerate(wanted):
            own = first[i] + np.array(numbers)
            chosen[own[own < first[i + 1]]] = True  # another text of the same key may have fewer lines
        lines.keep(chosen)
        k1, k2 = lines.hashes()
        raw = data.tobytes()
        ids = batch.column(batch.schema.get_field_index("id")).take(pa.array(lines.text))
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(lines.start.tolist(), lines.stop.tolist())]
        yield pa.RecordBatch.from_pydict({"id": ids, "line": pa.array(lines.number), "k1": pa.array(k1.view(np.int64)), "k2": pa.array(k2.view(np.int64)), "own": pa.array(texts, pa.string()), "parts": _lists(lines.without_part(parts), np.ones(len(lines.text), bool))})


def _variants(batches):
    """Every line whole, and without each of its characters: once by the variant, once by the variant and the place."""
    for batch in sub_batches(batches, "own", 64 << 10):
        data, offsets = string_buffers(batch.column(batch.schema.get_field_index("own")))
        lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        chars = np.searchsorted(lead, offsets)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(chars))
        begin, end = lead[:-1], lead[1:]
        place = (np.arange(len(row)) - chars[:-1][row]).astype(np.uint64)
        keys = []
        for lane in (0, 1):  # 122 bits in all: a line's earliest partner by its key must not be another's
            rolling = Rolling(data, lane)
            head, tail = rolling.hash(offsets[:-1][row], begin), rolling.hash(end, offsets[1:][row])
            joined = rolling.joined(offsets[:-1][row], begin, end, offsets[1:][row])
            whole = rolling.hash(offsets[:-1], offsets[1:])
            spot = mix64(mix64(head + np.uint64(7)) ^ mix64(tail * np.uint64(3) + np.uint64(1)) ^ mix64(place + np.uint64(11)))
            if not lane:
                same = np.append(False, (joined[1:] == joined[:-1]) & (row[1:] == row[:-1])) if len(row) else np.zeros(0, bool)
            keys.append(np.concatenate([whole, joined[~same], spot]).view(np.int64))
        rows = np.concatenate([np.arange(len(whole)), row[~same], row])
        kind = np.concatenate([np.zeros(len(whole)), np.ones((~same).sum()), np.full(len(row), 2)]).astype(np.int8)
        ids = pa.array(rows)
        no = batch.column(batch.schema.get_field_index("no")).take(ids)
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys[0]), "key2": pa.array(keys[1]), "kind": pa.array(kind), "no": no})


def _shared(rows: DataFrame, keys: str) -> DataFrame:
    """Rows that have one of their keys in common with another row."""
    each = rows.select("id", "line", F.explode(keys).alias("key"))
    at = F.xxhash64("id", "line")
    twice = each.groupBy("key").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("size")).where("a <> b")
    twice = cut(twice.select("key", "size"), small=True)
    # most rows have no key of those; the join is exact
    total = twice.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    return join_hot(maybe_in(each, "key", twice.select("key")), twice, "key", "size", total).select("id", "line").distinct()


def doomed_lines(docs: DataFrame, key: str = "doc_id", parts: int = 8) -> DataFrame:
    """(id, line): the lines of ``docs`` that go, lines numbered from 0.

    A line goes if it equals a line that stands earlier, by document key (null first) and then line number, or if both
    have at least MIN_CHARS code points and are within one edit (a code point inserted, deleted or replaced); lines are
    judged on the input, not on what is left. Lines without a word stay. Equal lines, by 128 bits, first shrink to
    their earliest. Two exact filters narrow the rest before variants are made: lines within one edit agree in all but
    one half, and in all but one eighth. Variants that meet at equal hashed keys give each line its earliest possible
    partner by a minimum per key, combined before the shuffle, so a key shared by very many lines costs a row each and
    no pairs; the partner's edit distance is then verified. Ties (repeated rows of one key) count as one place.
    """
    texts = docs.select(F.col(key).cast("long").alias("id"), "text")
    scanned = cut(map_arrow(texts, _scan, "id long, line long, k1 long, k2 long, halves array<long>"))
    first = cut(scanned.groupBy("k1", "k2").agg(F.min(F.struct("id", "line")).alias("first"), F.first("halves").alias("halves")))
    own = first.select("first.id", "first.line", "halves")
    near = cut(_shared(own, "halves"))
    per_doc = near.groupBy("id").agg(F.collect_set("line").alias("lines"))  # at most the lines of one document
    fetched = maybe_in(texts, "id", near.select("id")).join(per_doc, texts.id.eqNullSafe(per_doc.id)).select(texts.id, "text", "lines")
    fetched = map_arrow(fetched, lambda it: _fetch(it, parts), "id long, line long, k1 long, k2 long, own string, parts array<long>")
    fetched = cut(fetched)
    chosen = _shared(fetched, "parts")
    chosen = cut(fetched.join(chosen, fetched.id.eqNullSafe(chosen.id) & (fetched.line == chosen.line), "left_semi"))
    places = running(chosen.select("id", "line").distinct().withColumn("one", F.lit(1)), [F.col("id").asc_nulls_first(), F.col("line").asc()], {"no": "one"})
    places = places.select(F.col("id").alias("p_id"), F.col("line").alias("p_line"), F.col("no").cast("long").alias("no"))
    chosen = cut(chosen.join(places, F.col("id").eqNullSafe(F.col("p_id")) & (F.col("line") == F.col("p_line"))).select("k1", "k2", "no", "own"))
    # read twice below and made twice: that costs less than to keep them
    variants = map_arrow(chosen.select("no", "own"), _variants, "key long, key2 long, kind byte, no long")
    mins = variants.groupBy(F.col("key").alias("k"), F.col("key2").alias("k0")).agg(*[F.min(F.when(F.col("kind") == i, F.col("no"))).alias(f"m{i}") for i in range(3)], F.count("*").alias("n")).where("n > 1")
    partner = F.when(F.col("kind") == 0, F.col("m1")).when(F.col("kind") == 1, F.col("m0")).otherwise(F.col("m2"))
    met = variants.join(mins, (F.col("key") == F.col("k")) & (F.col("key2") == F.col("k0"))).where(partner < F.col("no")).select("no", partner.alias("with"))
    side = chosen.select(F.col("no").alias("with"), F.col("own").alias("other"))
    verified = met.distinct().join(chosen, "no").join(side, "with")
    verified = verified.where(F.levenshtein("own", "other", 1) >= 0).select("k1", "k2").distinct().withColumn("near", F.lit(True))
    classes = first.select("k1", "k2", "first").join(verified, ["k1", "k2"], "left")
    gone = scanned.select("k1", "k2", "id", "line").join(classes, ["k1", "k2"])
    return gone.where(F.coalesce("near", F.lit(False)) | ~F.col("first").eqNullSafe(F.struct("id", "line"))).select("id", "line")


def dedup_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with the lines that go taken out of ``text``, and ``n_lines`` and ``n_removed``.

    Texts without such lines are not shuffled. A null text stays null with no lines; an empty one has one line; texts
    of any length are read whole, and one text's work grows in proportion to its lines. Rows of one key count as one
    document: lines of one number go in all of them. Columns of ``docs`` named n_lines or n_removed stay, with an
    underscore after their names.
    """
    docs = free_names(docs, ["n_lines", "n_removed"])
    gone = doomed_lines(docs.select(key, "text"), key)
    gone = cut(gone.groupBy(F.col("id").alias("gone_id")).agg(F.collect_set("line").alias("gone")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).cast("long").alias("id"))
    out = maybe_in(rows, "id", gone.select("gone_id")).join(gone, F.col("id").eqNullSafe(F.col("gone_id")), "left").select("row", "gone")
    out = out.unionByName(maybe_in(rows, "id", gone.select("gone_id"), anti=True).select("row", F.lit(None).cast("array<bigint>").alias("gone")))
    out = out.withColumn("n_lines", F.coalesce(F.length("row.text") - F.length(F.translate("row.text", "\n", "")) + 1, F.lit(0)).cast("long"))
    out = out.withColumn("n_removed", F.when(F.col("gone").isNull(), 0).otherwise(F.size(F.filter("gone", lambda x: x < F.col("n_lines")))).cast("long"))
    left = F.array_except(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_lines") - 1, F.lit(0).cast("long"))), F.col("gone"))
    kept = let(F.split(F.col("row.text"), "\n"), lambda lines: F.array_join(F.transform(left, lambda i: F.get(lines, i.cast("int"))), "\n"))
    text = F.when(F.col("n_removed") > 0, kept).otherwise(F.col("row.text"))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns], "n_lines", "n_removed")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = f"""
with t as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
a as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as no from t),
l as (select line, min((doc_id, no)) as first from a where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by line),
v as (select line, first, unnest(range(1, length(line) + 1)) as p from l where length(line) >= {MIN_CHARS}),
x as (select line, first, p, hash(substr(line, 1, p - 1) || substr(line, p + 1)) as h from v),
s as (select line, first, min(first) over (partition by h, p) as m from x),
w as (select x.line, x.first, l.line as other, l.first as with_first from x join l on hash(l.line) = x.h where length(l.line) >= {MIN_CHARS}),
near as (
  select line from s where m < first
  union select line from w where with_first < first
  union select other from w where first < with_first),
gone as (
  select doc_id, no from a join l using (line) where (doc_id, no) <> l.first or line in (select line from near))
select t.doc_id, len(ls)::bigint as n_lines,
  coalesce(g.n, 0)::bigint as n_removed,
  sha256(coalesce(case when g.n > 0 then array_to_string(list_filter(ls, lambda y, i: not list_contains(g.nos, i)), chr(10)) else text end, '')) as kept_sha256
from t left join (select doc_id, count(*) as n, list(no) as nos from gone group by doc_id) g using (doc_id)
"""
