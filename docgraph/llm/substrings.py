"""Removal of repeated byte strings with suffix arrays over the places where texts can repeat."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, maybe_in, mix64, read, span_digests, string_buffers, sub_batches
from .induced import common_prefixes, suffix_array

LENGTH = 100  # bytes of a string that counts as repeated
GRAM = 24  # bytes of a fingerprinted gram
BROADCAST_ROWS = 100_000
SHARD = 1 << 20  # bytes of contexts whose suffix array is induced together, at least one gram's
BUCKET = 8 << 20  # bytes of text whose fingerprints meet in one bucket, about
LEAST = -(2**63)
PLACE_BITS = 31  # of a place in a batch: Spark's strings and Arrow's columns of them hold less than 2**31 bytes
STEP = 1 << 15  # places hashed at once, so that they stay in a processor's cache
#: A gram is hot if a sample of the documents has it so often. At most MOST_HOT grams are, the most frequent ones: an
#: array of 8 bytes each goes to every task. This only chooses the plan; any choice gives the same result.
HOT_IN_SAMPLE, MOST_HOT = 16, 100_000
HELD = 1 << 18  # fingerprints of hot grams that a task combines at once


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number; zeros follow the end."""
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def _gram_hash(take, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place on; ``take(k)`` are the eight bytes k after each place."""
    value = np.uint64(0)
    for k in range(0, gram, 8):
        block = take(k)
        if gram - k < 8:
            block = block & np.uint64((1 << 8 * (gram - k)) - 1)
        value = (block ^ (value + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(29)
    return mix64(value)


def winnow(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(place, text, hash, lead, tail) of the grams that are least, leftmost among equals, in some window of ``length``
    bytes; all windows that choose a gram span from ``lead`` bytes before it to ``tail`` bytes after its start.

    Which gram a window chooses depends on the window's bytes alone, so equal windows choose the same one.
    """
    n, width = len(data), length - gram + 1
    if n < length:
        return *(np.zeros(0, np.int64) for _ in range(2)), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(2))
    eight, low = _eight(data), np.uint64((1 << PLACE_BITS) - 1)
    best = np.empty(n - length + 1, dtype=np.uint64)
    for a in range(0, len(best), STEP):
        b = min(len(best), a + STEP)
        least = _gram_hash(lambda k: eight[a + k : b + width - 1 + k], gram)  # noqa: B023
        least = least & ~low | np.arange(a, b + width - 1, dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            least = np.minimum(least[: len(least) - size], least[size:])
            size *= 2
        best[a:b] = np.minimum(least[: b - a], least[width - size :])
    # windows that stay inside a text
    fits = np.zeros(len(best) + 1, dtype=np.int8)
    long_enough = np.diff(offsets) >= length
    np.add.at(fits, offsets[:-1][long_enough], 1)
    np.add.at(fits, (offsets[1:] - length + 1)[long_enough], -1)
    window = np.flatnonzero(np.cumsum(fits[:-1]) > 0)
    chosen = (best[window] & low).astype(np.int64)
    # the leftmost least never moves back from a window to the next, so a gram's windows stand side by side
    first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1])) if len(chosen) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(chosen))[: len(first)] - 1
    place = chosen[first]
    value = _gram_hash(lambda k: eight[place + k], gram) if len(place) else np.zeros(0, np.uint64)
    return place, np.searchsorted(offsets, place, side="right") - 1, value, place - window[first], window[last] + length - place


def _columns(batch, *names):
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


PARTS = 4


def _parts(length: int, gram: int) -> list[tuple[int, int]]:
    """Windows that hold a gram, sorted in PARTS kinds by the bytes before the gram: the least and most of each kind."""
    width = -(-(length - gram) // PARTS)
    return [(j * width, min(length - gram, (j + 1) * width)) for j in range(PARTS)]


def _gram_counts(batches, length: int, gram: int):
    for batch in sub_batches(batches):
        data, offsets = string_buffers(_columns(batch, "text")[0])
        value, times = np.unique(winnow(data, offsets, length, gram)[2], return_counts=True)
        yield pa.RecordBatch.from_pydict({"h": pa.array(value.view(np.int64)), "n": pa.array(times)})


def hot_grams(texts: DataFrame, total: int, length: int, gram: int) -> np.ndarray:
    """Hashes of grams that a sample of the texts, a 64th of a large input, has HOT_IN_SAMPLE times or more, sorted."""
    share = 64 if total >= 1 << 30 else max(8, total >> 24)
    sample = texts.where(F.pmod(F.xxhash64("id", "m"), F.lit(share)) == 0).select("text")
    counts = map_arrow(sample, lambda it: _gram_counts(it, length, gram), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= HOT_IN_SAMPLE).orderBy(F.desc("n"), "h").limit(MOST_HOT).select("h").collect()
    return np.sort(np.array([r.h for r in found], dtype=np.int64).view(np.uint64))


def _earliest(c: dict[str, np.ndarray]) -> tuple[dict, np.ndarray]:
    """Fingerprints in order of gram, context and place, and which of them are the first of their gram and context."""
    order = np.lexsort((c["p"], c["m"], c["i"], c["x"], c["h"]))
    c = {n: v[order] for n, v in c.items()}
    new = np.append(True, (c["h"][1:] != c["h"][:-1]) | (c["x"][1:] != c["x"][:-1])) if len(order) else np.zeros(0, bool)
    return c, new


def _later_than_first(c: dict[str, np.ndarray], new: np.ndarray) -> np.ndarray:
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    return np.flatnonzero(_later(c["i"], c["m"], c["p"], first=first))


def _prints(batches, buckets: int, length: int, gram: int, hot: np.ndarray):
    """Fingerprints packed by bucket: one row for each bucket and slice of texts.

    Of each gram: its hash, that of its context, 16 bits of the hash of what all windows of a kind have in common, the
    document, the place, and the bytes before and after it that its windows span. A bucket is that of the gram's hash,
    or for hot grams (buckets from ``buckets`` on) that of gram and context; of the latter a task first keeps the
    earliest, and the spans of the others go along as they are (buckets below 0).
    """

    def pack(c: dict[str, np.ndarray], bucket: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        c, bucket = {n: v[order] for n, v in c.items()}, bucket[order]
        edge = np.flatnonzero(np.append(True, np.diff(bucket) != 0))
        stop = np.append(edge[1:], len(order))
        cols = {}
        for name in KINDS:
            if name in "imc":
                continue
            raw, width = np.ascontiguousarray(c[name].astype(KINDS[name], copy=False)).tobytes(), np.dtype(KINDS[name]).itemsize
            cols[name] = pa.array([raw[a * width : b * width] for a, b in zip(edge.tolist(), stop.tolist())], pa.binary())
        # documents in order within a bucket: their keys once, and how many grams each has
        head = np.append(True, (c["i"][1:] != c["i"][:-1]) | (c["m"][1:] != c["m"][:-1]))
        head[edge] = True
        first = np.flatnonzero(head)
        cut_at = np.searchsorted(first, np.append(edge, len(order))).tolist()
        for name, values in (("i", c["i"][first]), ("m", c["m"][first]), ("c", np.diff(np.append(first, len(order))).astype(np.uint32))):
            cols[name] = pa.array([values[a:b].tobytes() for a, b in zip(cut_at, cut_at[1:])], pa.binary())
        return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[edge]), **{n: cols[n] for n in KINDS}, "gone": pa.nulls(len(edge), pa.binary())})

    held, size = [], 0

    def flush():
        c = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
        held.clear()
        c, new = _earliest(c)
        gone = _later_than_first(c, new)
        first = {n: v[new] for n, v in c.items()}
        yield pack(first, buckets + (mix64(first["h"] ^ first["x"]) % np.uint64(buckets)).astype(np.int64))
        if len(gone):
            p, l, t = (c[n][gone].astype(np.int64) for n in "plt")
            spans = np.stack([c["i"][gone], c["m"][gone], p - l, p + t], axis=1)
            to = -1 - (mix64(spans[:1, 0].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            none = pa.nulls(1, pa.binary())
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(to), **{n: none for n in KINDS}, "gone": pa.array([spans.tobytes()], pa.binary())})

    for batch in sub_batches(batches, most=1 << 20):
        text, ids, marks = _columns(batch, "text", "id", "m")
        data, offsets = string_buffers(text)
        place, of, value, lead, tail = winnow(data, offsets, length, gram)
        if not len(place):
            continue
        around = span_digests(data, place - lead, place + tail)[1]
        c = {"h": value, "x": mix64(around ^ mix64((lead << 8 | tail).astype(np.uint64)))}
        for j, (least, most) in enumerate(_parts(length, gram)):
            fits = (lead >= least) & (tail >= length - most)
            start, stop = np.where(fits, place - least, place), np.where(fits, place + length - most, place)
            c[f"q{j}"] = (span_digests(data, start, stop)[0] >> np.uint64(48)).astype(np.uint16)
        c |= {"p": (place - offsets[of]).astype(np.uint32), "l": lead.astype(np.uint8), "t": tail.astype(np.uint8)}
        c |= {"i": ids.to_numpy(zero_copy_only=False)[of], "m": marks.to_numpy(zero_copy_only=False)[of]}
        is_hot = hot[np.minimum(np.searchsorted(hot, value), len(hot) - 1)] == value if len(hot) else np.zeros(len(value), bool)
        if is_hot.any():
            held.append({n: v[is_hot] for n, v in c.items()})
            size += int(is_hot.sum())
            c = {n: v[~is_hot] for n, v in c.items()}
        if len(c["h"]):
            yield pack(c, (c["h"] % np.uint64(buckets)).astype(np.int64))
        if size > HELD:
            yield from flush()
            size = 0
    if held:
        yield from flush()


KINDS = {"h": np.uint64, "x": np.uint64, **{f"q{j}": np.uint16 for j in range(PARTS)}, "p": np.uint32, "l": np.uint8, "t": np.uint8, "i": np.int64, "m": np.int64, "c": np.uint32}


def _unpack(part: dict) -> dict[str, np.ndarray]:
    c = {n: np.frombuffer(part[n], dtype=k) for n, k in KINDS.items()}
    times = c.pop("c")
    return c | {"i": np.repeat(c["i"], times), "m": np.repeat(c["m"], times)}


def _later(*keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each row differs from row ``first`` of its group, of which it is no less."""
    return np.logical_or.reduce([k != k[first] for k in keys])


def _rows(ids, marks, start, stop, gram=None, hot: bool = False) -> pa.RecordBatch:
    h = pa.nulls(len(ids), pa.int64()) if gram is None else pa.array(gram)
    return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "m": pa.array(marks, pa.int64()), "a": pa.array(start, pa.int64()), "b": pa.array(stop, pa.int64()), "h": h, "hot": pa.array(np.full(len(ids), hot))})


MEET = 1 << 20


def _meet(batches, buckets: int, length: int, gram: int):
    """Grams that occur again. Occurrences with equal contexts settle as they come: all but the earliest repeat. The
    earliest of each context goes on, with h, where the gram has several contexts, or may have them (hot grams)."""

    kinds = _parts(length, gram)

    def settle(parts: list[dict]):
        """The earliest of each context, after the rows of all others."""
        c, new = _earliest({n: np.concatenate([p[n] for p in parts]) for n in parts[0]})
        gone = _later_than_first(c, new)
        p, l, t = (c[n][gone].astype(np.int64) for n in "plt")
        return {n: v[new] for n, v in c.items()}, _rows(c["i"][gone], c["m"][gone], p - l, p + t)

    def close(c: dict, bucket: int):
        p, l, t = (c[n].astype(np.int64) for n in "plt")
        if bucket >= buckets:
            yield _rows(c["i"], c["m"], p - l, p + t, c["h"].view(np.int64), hot=True)
            return
        # the earliest of each context goes on with the windows of the kinds in which another context is alike
        grams = np.cumsum(np.append(True, c["h"][1:] != c["h"][:-1])) - 1
        on = np.flatnonzero(np.bincount(grams)[grams] > 1)
        if not len(on):
            return
        start, stop = np.full(len(on), 1 << 60), np.full(len(on), -1)
        for j, (least, most) in enumerate(kinds):
            fits = np.flatnonzero((l[on] >= least) & (t[on] >= length - most))
            key = grams[on[fits]] << 16 | c[f"q{j}"][on[fits]]
            _, which, times = np.unique(key, return_inverse=True, return_counts=True)
            alike = fits[times[which] > 1]
            start[alike] = np.minimum(start[alike], p[on[alike]] - np.minimum(l[on[alike]], most))
            stop[alike] = np.maximum(stop[alike], p[on[alike]] + np.minimum(t[on[alike]], length - least))
        go = stop - start >= length
        if go.any():
            yield _rows(c["i"][on[go]], c["m"][on[go]], start[go], stop[go], c["h"][on[go]].view(np.int64))

    def done(parts: list[dict], bucket: int):
        if parts:
            c, gone = settle(parts)
            yield gone
            yield from close(c, bucket)

    key, parts, size = None, [], 0
    for batch in batches:
        cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        for k, bucket in enumerate(cols["bucket"]):
            if bucket < 0:
                spans = np.frombuffer(cols["gone"][k], dtype=np.int64).reshape(-1, 4)
                yield _rows(*spans.T)
                continue
            if bucket != key:
                yield from done(parts, key)
                key, parts, size = bucket, [], 0
            parts.append(_unpack({n: cols[n][k] for n in KINDS}))
            size += len(parts[-1]["h"])
            if size > MEET:
                first, gone = settle(parts)
                yield gone
                parts, size = [first], 0
    yield from done(parts, key)


def _contexts(batches, length: int):
    """The bytes of each span; of hot grams the digest of every window instead. Of equal windows of a batch, the
    earliest goes on, and the others are spans that go (neither bytes nor digest)."""
    kinds = {"h": pa.int64(), "id": pa.int64(), "m": pa.int64(), "a": pa.int64(), "b": pa.int64(), "bytes": pa.binary(), "w1": pa.int64(), "w2": pa.int64()}

    def rows(**cols) -> pa.RecordBatch:
        n = len(cols["id"])
        return pa.RecordBatch.from_pydict({c: pa.array(cols[c], kind) if c in cols else pa.nulls(n, kind) for c, kind in kinds.items()})

    for batch in sub_batches(batches):
        text, ids, marks, wanted = _columns(batch, "text", "id", "m", "spans")
        data, offsets = string_buffers(text)
        raw = data.tobytes()
        out, hot = {c: [] for c in ("h", "id", "m", "a", "b", "bytes")}, []
        for k, (i, m, spans) in enumerate(zip(ids.to_pylist(), marks.to_pylist(), wanted.to_pylist())):
            at = int(offsets[k])
            for s in spans:
                if s["hot"]:
                    hot.append((i, m, at, s["a"], s["b"]))
                    continue
                for c, v in zip(out, (s["h"], i, m, s["a"], s["b"], raw[at + s["a"] : at + s["b"]])):
                    out[c].append(v)
        yield rows(**out)
        if not hot:
            continue
        i, m, at, a, b = np.array(hot, dtype=np.int64).T
        times = b - a - length + 1
        i, m, at = (np.repeat(x, times) for x in (i, m, at))
        start = np.arange(len(i)) - np.repeat(np.cumsum(times) - times - a, times)
        one, two = span_digests(data, at + start, at + start + length)
        c, new = _earliest({"h": one, "x": two, "i": i, "m": m, "p": start})
        gone = _later_than_first(c, new)
        first = np.flatnonzero(new)
        yield rows(id=c["i"][first], m=c["m"][first], a=c["p"][first], b=c["p"][first] + length, w1=c["h"][first].view(np.int64), w2=c["x"][first].view(np.int64))
        # windows side by side go as one span
        order = gone[np.lexsort((c["p"][gone], c["m"][gone], c["i"][gone]))]
        i, m, p = c["i"][order], c["m"][order], c["p"][order]
        apart = np.append(True, (i[1:] != i[:-1]) | (m[1:] != m[:-1]) | (p[1:] > p[:-1] + length)) if len(p) else np.zeros(0, bool)
        head = np.flatnonzero(apart)
        last = np.append(head[1:], len(p))[: len(head)] - 1
        yield rows(id=i[head], m=m[head], a=p[head], b=p[last] + length)


def repeated(texts: list[bytes], keys: tuple[np.ndarray, ...], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of the strings of ``length`` bytes that stand at a lesser place too; a place is the text's keys, the
    last of which counts its start.

    The texts stand in one string, parted by characters less than all bytes. Its suffix array puts equal strings side
    by side, and their common prefixes tell where one run of them ends.
    """
    joined = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes + 1) - 1
    string = np.ones(len(joined) + len(texts) + 1, dtype=np.int64)
    place = np.arange(len(joined)) + owner
    string[place] = joined.astype(np.int64) + 2
    string[-1] = 0
    array = suffix_array(string)
    # a byte of value 254 or 255 is never UTF-8, so bytes + 2 fit in a byte again
    raw = np.concatenate([string.astype(np.uint8), np.zeros(length + 16, dtype=np.uint8)])
    of = np.repeat(np.arange(len(texts) + 1), np.append(sizes + 1, 1))
    left = np.append(ends, 0)[of] - np.arange(len(string))
    whole = left >= length
    prefix = common_prefixes(raw, array, length, whole)
    ranked = array[whole[array]]
    if not len(ranked):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = of[ranked]
    start = ranked - (ends - sizes)[text]
    run = np.cumsum(prefix[ranked] < length)
    run -= run[0]
    parts = [k[text] for k in keys]
    parts[-1] = parts[-1] + start
    order = np.lexsort((*parts[::-1], run))
    run, text, start, parts = run[order], text[order], start[order], [p[order] for p in parts]
    new = np.append(True, run[1:] != run[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    gone = _later(*parts, first=first)
    return text[gone], start[gone]


def _induce(batches, length: int):
    held, size = {"h": [], "id": [], "m": [], "a": [], "bytes": []}, 0

    def settle():
        ids, marks, at = (np.array(held[c], dtype=np.int64) for c in ("id", "m", "a"))
        text, start = repeated(held["bytes"], (ids, marks, at), length)
        order = np.lexsort((start, text))
        text, start = text[order], start[order]
        new = np.append(True, (text[1:] != text[:-1]) | (start[1:] > start[:-1] + length)) if len(text) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(text))[: len(first)] - 1
        return _rows(ids[text[first]], marks[text[first]], at[text[first]] + start[first], at[text[first]] + start[last] + length)

    for batch in batches:
        cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        for k, h in enumerate(cols["h"]):
            if size >= SHARD and h != held["h"][-1]:
                yield settle()
                held, size = {n: [] for n in held}, 0
            for n in held:
                held[n].append(cols[n][k])
            size += len(cols["bytes"][k])
    if size:
        yield settle()


def _remove(batches):
    for batch in sub_batches(batches):
        text, key, spans = _columns(batch, "text", "key", "spans")
        data, offsets = string_buffers(text)
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for k, own in enumerate(spans.to_pylist()):
            raw = data[offsets[k] : offsets[k + 1]]
            turn = np.zeros(len(raw) + 1, dtype=np.int64)
            at = np.array([(s["a"], s["b"]) for s in own], dtype=np.int64).reshape(-1, 2)
            np.add.at(turn, at[:, 0], 1)
            np.add.at(turn, at[:, 1], -1)
            gone = np.cumsum(turn)[:-1] > 0
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int((np.diff(np.append(False, gone).astype(np.int8)) == 1).sum()))
            out["kept"].append(raw[~gone].tobytes())
        yield pa.RecordBatch.from_pydict({"key": key, **{c: pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")}, "kept": pa.array(out["kept"], pa.binary())})


def remove_repeats(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every row of ``docs``, whose key is a long.

    A byte goes if a string of ``length`` bytes over it stands earlier too: in a document of lesser key, or further up
    in its own; strings are judged on the input. Equal texts first shrink to the one of least key. Every window of
    ``length`` bytes has a gram chosen by its bytes alone, so equal windows meet at that gram's hash; only grams that
    occur again go on. Occurrences whose whole context (all windows around the gram) is equal settle by order, their
    equality by 128 bits; what is left, the edges of repeats, is brought together by gram in shards, whose suffix arrays
    are built by induced sorting and whose common prefixes give the repeated windows. No window is missed and nothing is
    capped.

    Grams that very many places have (those a sample shows to be hot) are dealt by gram and context instead, after each
    task has kept the earliest place of each; what is left of them is dealt by single windows, again combined first. So
    no gram needs a task of its own: memory is bounded by MEET fingerprints beside a bucket's distinct contexts, and by
    the contexts of one gram that is not hot, of less than 2 * ``length`` bytes each.

    Null texts count as empty; nulls of the key come first; a key that repeats with another text is a document of its
    own, ordered by the text's hash, and equal rows get equal results. Matches never cross documents.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(whole.cast("binary"))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(LEAST)).alias("id"), whole.alias("text"), digest.alias("digest"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("m"))
    sizes = cut(rows.select("id", "digest", F.octet_length("text").cast("long").alias("n")))
    total = sizes.agg(F.sum("n")).head()[0] or 0
    # where no key repeats with another text, the key alone tells documents apart, and less is shuffled
    if sizes.groupBy("id").agg((F.min("digest") != F.max("digest")).alias("several")).where("several").isEmpty():
        rows = rows.withColumn("m", F.lit(0).cast("long"))
    copied = cut(sizes.where(F.col("n") >= length).groupBy("digest").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").select("digest", "rep"), small=True)
    if copied.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # a row for each text that occurs again
        tagged = rows.join(F.broadcast(copied), "digest", "left")
    else:
        maybe = maybe_in(rows, "digest", copied.select("digest")).join(copied, "digest", "left")
        sure = maybe_in(rows, "digest", copied.select("digest"), anti=True).withColumn("rep", F.lit(None).cast("long"))
        tagged = maybe.select(*sure.columns).unionByName(sure)
    is_copy = F.coalesce(F.col("id") > F.col("rep"), F.lit(False))
    own = tagged.where(~is_copy).select("key", "id", "m", "text")

    buckets = max(24, total // BUCKET)
    hot = hot_grams(own, total, length, gram)
    kinds = "bucket long, " + ", ".join(f"{n} binary" for n in [*KINDS, "gone"])
    packed = map_arrow(own.select("id", "m", "text"), lambda it: _prints(it, buckets, length, gram, hot), kinds)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 4)
    met = map_arrow(packed.repartition(tasks, "bucket").sortWithinPartitions("bucket"), lambda it: _meet(it, buckets, length, gram), "id long, m long, a long, b long, h long, hot boolean")
    met = cut(met)
    asked = met.where("h is not null").distinct().groupBy("id", "m").agg(F.collect_list(F.struct("h", "a", "b", "hot")).alias("spans"))
    texts = maybe_in(own.select("id", "m", "text"), "id", met.where("h is not null").select("id")).dropDuplicates(["id", "m"])
    contexts = map_arrow(texts.join(asked, ["id", "m"]).select("id", "m", "text", "spans"), lambda it: _contexts(it, length), "h long, id long, m long, a long, b long, bytes binary, w1 long, w2 long")
    contexts = cut(contexts)
    shards = contexts.where("bytes is not null").select("h", "id", "m", "a", "bytes").repartition(tasks, "h").sortWithinPartitions("h")
    induced = map_arrow(shards, lambda it: _induce(it, length), "id long, m long, a long, b long, h long, hot boolean")
    spans = met.where("h is null").unionByName(induced).select("id", "m", "a", "b")
    if len(hot):
        windows, at = contexts.where("w1 is not null"), F.struct("id", "m", "a")
        again = windows.groupBy("w1", "w2").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select("w1", "w2", "first")
        spans = spans.union(windows.join(again, ["w1", "w2"]).where(at != F.col("first")).select("id", "m", "a", "b"))
        spans = spans.union(contexts.where("bytes is null and w1 is null").select("id", "m", "a", "b"))
    spans = cut(spans.groupBy("id", "m").agg(F.collect_list(F.struct("a", "b")).alias("spans")), small=True)

    # copies go whole, texts without spans stay whole: neither is shuffled
    mixed = tagged.withColumn("gone", is_copy)
    hit = maybe_in(mixed.where("not gone"), "id", spans.select("id")).join(spans, ["id", "m"], "left")
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    changed = map_arrow(hit.select("key", "text", F.coalesce("spans", none).alias("spans")), _remove, f"key {docs.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")
    rest = maybe_in(mixed, "id", spans.select("id"), anti=True, also="gone")
    size = F.octet_length("text").cast("long")
    alone = rest.select("key", size.alias("n_bytes"), F.when(F.col("gone"), size).otherwise(0).alias("n_removed"), F.col("gone").cast("long").alias("n_spans"), F.when(F.col("gone"), F.lit("")).otherwise(F.col("text")).cast("binary").alias("kept"))
    return changed.unionByName(alone).withColumnRenamed("key", key)


def op2(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute(texts: dict[int, bytes], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The same results by a table of all strings, for tests."""
    seen, out = set(), {}
    for i in sorted(texts):
        raw = texts[i]
        gone = np.zeros(len(raw), dtype=bool)
        for a in range(len(raw) - length + 1):
            s = raw[a : a + length]
            if s in seen:
                gone[a : a + length] = True
            seen.add(s)
        runs = int((np.diff(np.append(False, gone).astype(np.int8)) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out
