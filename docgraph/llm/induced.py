"""Suffix arrays by induced sorting, and capped permuted common prefixes, in numpy."""

from __future__ import annotations

import numpy as np


def classify(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than the next one, and the places of leftmost-smaller ones."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(at[::-1])[::-1] if n > 1 else at
    small = np.ones(n, dtype=bool)  # the last character is the sentinel
    small[: n - 1] = np.append(step, 1)[nearest] > 0
    left = np.zeros(n, dtype=bool)
    left[1:] = small[1:] & ~small[:-1]
    return small, np.flatnonzero(left)


def _induce_by_bucket(text, small, size, seeds):
    """Both induction passes, a bucket at a time: what one bucket induces is appended to others in one step."""
    n, k = len(text), len(size)
    edge = np.concatenate([[0], np.cumsum(size)])
    array = np.full(n, -1, dtype=np.int64)
    # seeds stand at the ends of their buckets, in the order given
    chars = text[seeds]
    order = np.argsort(chars, kind="stable")
    seeds, chars = seeds[order], chars[order]
    times = np.bincount(chars, minlength=k)
    first = np.concatenate([[0], np.cumsum(times)])
    array[edge[1:][chars] - times[chars] + np.arange(len(seeds)) - first[chars]] = seeds
    head, seed_from = edge[:-1].copy(), edge[1:] - times

    def append(found, at, forward):
        chars = text[found]
        if len(found) == 1:
            c = chars[0]
            if forward:
                array[at[c]] = found[0]
                at[c] += 1
            else:
                at[c] -= 1
                array[at[c]] = found[0]
            return
        order = np.argsort(chars, kind="stable")
        found, chars = found[order], chars[order]
        starts = np.flatnonzero(np.append(True, chars[1:] != chars[:-1]))
        count = np.diff(np.append(starts, len(chars)))
        rank = np.arange(len(chars)) - np.repeat(starts, count)
        if forward:
            array[at[chars] + rank] = found
            at[chars[starts]] += count
        else:
            array[at[chars] - 1 - rank] = found
            at[chars[starts]] -= count

    for c in range(k):
        done = edge[c]
        while done < head[c]:
            stop = head[c]
            found = array[done:stop] - 1
            done = stop
            found = found[found >= 0]
            found = found[~small[found]]
            if len(found):
                append(found, head, True)
        if times[c]:
            found = array[seed_from[c] : edge[c + 1]] - 1
            found = found[found >= 0]
            found = found[~small[found]]
            if len(found):
                append(found, head, True)
    for c in range(k):  # the seeds but the sentinel go; the second pass sorts all smaller suffixes anew
        if times[c]:
            array[seed_from[c] : edge[c + 1]] = -1
    tail = edge[1:].copy()
    array[0] = n - 1
    for c in range(k - 1, -1, -1):
        done = edge[c + 1]
        while done > tail[c]:
            stop = tail[c]
            found = array[stop:done][::-1] - 1
            done = stop
            found = found[found >= 0]
            found = found[small[found]]
            if len(found):
                append(found, tail, False)
        if head[c] > edge[c]:
            found = array[edge[c] : head[c]][::-1] - 1
            found = found[found >= 0]
            found = found[small[found]]
            if len(found):
                append(found, tail, False)
    return array


def _induce_one_by_one(text, small, size, seeds):
    """The same passes suffix by suffix, for alphabets about as large as the text."""
    n, k = len(text), len(size)
    t, s = text.tolist(), small.tolist()
    edge = np.concatenate([[0], np.cumsum(size)]).tolist()
    array = [-1] * n
    tail = edge[1:]
    for i in reversed(seeds.tolist()):
        tail[t[i]] -= 1
        array[tail[t[i]]] = i
    head = edge[:-1]
    for i in range(n):
        j = array[i] - 1
        if j >= 0 and not s[j]:
            array[head[t[j]]] = j
            head[t[j]] += 1
    tail = edge[1:]
    for i in range(n - 1, -1, -1):
        j = array[i] - 1
        if j >= 0 and s[j]:
            tail[t[j]] -= 1
            array[tail[t[j]]] = j
    array[0] = n - 1
    return np.array(array, dtype=np.int64)


def _induce(text, small, size, seeds):
    return (_induce_one_by_one if 20 * len(size) > len(text) else _induce_by_bucket)(text, small, size, seeds)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of integers whose last is 0 and the only 0.

    Suffixes are classified, leftmost-smaller substrings are sorted by one induction and named, their string is sorted
    by recursion unless all names differ, and a second induction from their order gives the whole array: linear steps
    on every level, and at most half the length on the next.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    small, left = classify(text)
    size = np.bincount(text)
    if len(left) > 1:
        array = _induce(text, small, size, left)
        marked = np.zeros(n, dtype=bool)
        marked[left] = True
        order = array[marked[array]]
        # a substring runs to the next leftmost-smaller place, that included
        length = np.zeros(n, dtype=np.int64)
        length[left] = np.append(np.diff(left) + 1, 1)
        a, b = order[1:], order[:-1]
        same = length[a] == length[b]
        open_, step = np.flatnonzero(same), 0
        while len(open_):
            differ = text[a[open_] + step] != text[b[open_] + step]
            same[open_[differ]] = False
            step += 1
            open_ = open_[~differ]
            open_ = open_[length[a[open_]] > step]
        name = np.zeros(n, dtype=np.int64)
        name[order] = np.concatenate([[0], np.cumsum(~same)])
        reduced = name[left]
        if name[order[-1]] + 1 < len(left):
            left = left[suffix_array(reduced)]
        else:
            left = order
    return _induce(text, small, size, left)


def common_prefixes(raw: np.ndarray, array: np.ndarray, cap: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """For every place in text order, its common prefix with the suffix before it in the array, up to ``cap`` (PLCP).

    Places that are not ``wanted``, and those whose suffix before is not, get 0.

    All places advance together, eight bytes a step while eight agree and then byte by byte; ``raw`` needs ``cap`` + 8
    bytes of padding.
    """
    n = len(array)
    before = np.full(n, -1, dtype=np.int64)
    before[array[1:]] = array[:-1]
    words = np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=np.ascontiguousarray(raw), strides=(1,))
    out = np.zeros(n, dtype=np.int64)
    open_ = np.flatnonzero(before >= 0 if wanted is None else (before >= 0) & wanted & wanted[before])
    for step in range(0, cap, 8):
        a, b = open_ + step, before[open_] + step
        inside = (a < n) & (b < n)
        open_, a, b = open_[inside], a[inside], b[inside]
        differ = words[a] ^ words[b]
        agree = differ == 0
        part = differ[~agree]
        out[open_[~agree]] = step + np.bitwise_count((part & -part) - np.uint64(1)).astype(np.int64) // 8
        open_ = open_[agree]
        out[open_] = min(cap, step + 8)
    return np.minimum(out, cap)
