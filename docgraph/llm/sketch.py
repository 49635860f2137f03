"""Word shingles and fast similarity sketches of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

from .common import flat_words, mix64, segment_index, span_digests

ROWS, BANDS = 5, 28
SIZE = ROWS * BANDS


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles, end to end, 64 more bits of each, and the texts' offsets.

    A-Z count as a-z. A text with fewer words than a shingle has its whole sequence as one, a text without words none.
    """
    kept, word_at, first = flat_words(data, offsets, lower=True)
    lanes = span_digests(kept, word_at[:-1], word_at[1:])
    n = np.diff(first)
    texts = len(n)
    made = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(made)])
    start = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], made)
    left = np.repeat(first[1:], made) - start  # words from the shingle's first to the text's end
    values = [np.full(len(start), 0x51ED270B, dtype=np.uint64) for _ in lanes]
    for k in range(words):
        inside = left > k
        if not inside.any():
            break
        some = slice(None) if inside.all() else inside
        for value, word in zip(values, lanes):
            value[some] = mix64(value[some] * np.uint64(0x9E3779B97F4A7C15) + word[start[some] + k])
    one, two, sizes = [], [], np.zeros(texts, dtype=np.int64)
    for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
        if b > a:
            own, where = np.unique(values[0][a:b], return_index=True)
            sizes[i] = len(own)
            one.append(own)
            two.append(values[1][a + where])
    flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat(one), flat(two), np.concatenate([[0], np.cumsum(sizes)])


def sketches(values: np.ndarray, at: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Fast similarity sketch of each set: ``size`` coordinates, all filled unless the set is empty.

    Round i < size throws every element into a bin of its own choosing; rounds size..2 size - 1 throw all into bin
    i - size, so that none stays empty. A bin keeps its least (round, hash), and a set stops once all its bins are
    full: large sets after one round, a set of one element after the last. Two sets agree in a coordinate with the
    chance of their Jaccard similarity, with concentration as of independent trials.
    """
    n = len(at) - 1
    none = np.uint64(2**64 - 1)
    out = np.full(n * size, none, dtype=np.uint64)
    count = np.diff(at)
    live = np.flatnonzero(count)
    owner = segment_index(at)
    for i in range(2 * size):
        if not len(live):
            break
        hashed = mix64(values ^ mix64(np.array([i + 1], dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)))
        value = np.uint64(i) << np.uint64(48) | hashed & np.uint64((1 << 48) - 1)
        if i < size:
            place = ((mix64(hashed) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        else:
            place = i - size
        np.minimum.at(out, owner * size + place, value)
        full = (out.reshape(n, size)[live] != none).all(axis=1)
        if full.any():
            live = live[~full]
            stays = np.zeros(n, dtype=bool)
            stays[live] = True
            keep = stays[owner]
            values, owner = values[keep], owner[keep]
    return out.reshape(n, size)


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash of each run of ``rows`` coordinates, other for every band."""
    n, size = sketch.shape
    bands = size // rows
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (n, 1))
    parts = sketch.reshape(n, bands, rows)
    for r in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def set_keys(one: np.ndarray, two: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits of each whole set, of all 128 bits of its items, as two columns."""
    n = len(at) - 1
    out = np.zeros((n, 2), dtype=np.uint64)
    for k, values in enumerate((mix64(one ^ mix64(two)), mix64(two + mix64(one ^ np.uint64(0x9FB21C651E98DF25))))):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        out[:, k] = mix64(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64))
    return out
