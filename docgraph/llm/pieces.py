"""SentencePiece byte-pair encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow, read, string_buffers, sub_batches

SPACE, MARK = 0x20, 0x2581
NONE = np.int32(2**31 - 1)
BATCH = 2 << 20


class Vocabulary:
    """Pieces, and the table of pairs of symbols that make a piece.

    A symbol is a piece or a single character; characters that no piece holds are negative code points.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.n, self.bos, self.eos, self.unk = n, model.bos_id(), model.eos_id(), model.unk_id()
        names = [model.id_to_piece(i) for i in range(n)]
        control = [model.is_control(i) or model.is_unknown(i) for i in range(n)]
        self.byte = np.full(256, self.unk, dtype=np.int32)
        self.bytes: list[bytes] = []
        self.is_byte = np.zeros(n, dtype=bool)
        plain: dict[str, int] = {}
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte[int(name[3:5], 16)] = i
                self.bytes.append(bytes([int(name[3:5], 16)]))
                self.is_byte[i] = True
            elif control[i]:
                self.bytes.append(b"")
            else:
                plain[name] = i
                self.bytes.append(name.replace("▁", " ").encode())
        if any("▁" in name.lstrip("▁") for name in plain):
            raise ValueError("a piece runs over a word's start: words cannot be merged apart")
        scores = {name: model.get_score(i) for name, i in plain.items()}
        rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        symbols = dict(plain)
        for ch in sorted({c for name in plain for c in name} - plain.keys()):
            symbols[ch] = n + len(symbols) - len(plain)
        self.of_char = -np.arange(1, 0x110001, dtype=np.int32)
        for ch, s in symbols.items():
            if len(ch) == 1:
                self.of_char[ord(ch)] = s
        self.of_char[SPACE] = self.of_char[MARK]
        self.char = {s: ord(ch) for ch, s in symbols.items() if s >= n}
        pairs = {}
        for name, i in plain.items():
            for k in range(1, len(name)):
                if (a := symbols.get(name[:k])) is not None and (b := symbols.get(name[k:])) is not None:
                    pairs[(a, b)] = (rank[scores[name]], i)
        self._table(pairs)
        # characters that stand side by side in some piece: no merge ever runs over any other pair of them
        self.beside = np.array(sorted({ord(a) << 21 | ord(b) for name in plain for a, b in zip(name, name[1:])}) or [0], dtype=np.int64)
        sizes = np.array([len(b) for b in self.bytes])
        self.byte_at = np.concatenate([[0], np.cumsum(sizes)])
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)

    def _table(self, pairs: dict) -> None:
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        value = np.array(list(pairs.values()), dtype=np.int32)
        self.bits = max(20, int(4 * len(keys)).bit_length())
        at = self._slot(keys)
        self.key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.rank = np.full(1 << self.bits, NONE, dtype=np.int32)
        self.made = np.zeros(1 << self.bits, dtype=np.int32)
        _, first = np.unique(at, return_index=True)
        self.key[at[first]], self.rank[at[first]], self.made[at[first]] = keys[first], value[first, 0], value[first, 1]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.more_key = np.append(keys[rest], np.int64(2**63 - 1))
        self.more_rank, self.more_made = np.append(value[rest, 0], NONE), np.append(value[rest, 1], 0)
        self.crowded = np.zeros(1 << self.bits, dtype=bool)
        self.crowded[at[rest]] = True

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def never_merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether no piece holds these characters (code points) side by side."""
        pair = np.where(left == SPACE, MARK, left).astype(np.int64) << 21 | np.where(right == SPACE, MARK, right)
        return self.beside[np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)] != pair

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; rank NONE where they make no piece."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        key[(left < 0) | (right < 0)] = -2
        at = self._slot(key)
        hit = self.key[at] == key
        rank = np.where(hit, self.rank[at], NONE)
        made = self.made[at]
        if len(odd := np.flatnonzero(~hit & self.crowded[at])):
            i = np.searchsorted(self.more_key, key[odd])
            same = self.more_key[i] == key[odd]
            rank[odd] = np.where(same, self.more_rank[i], NONE)
            made[odd] = self.more_made[i]
        return rank, made


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _merged_at_once(v: Vocabulary, sym, word, rank, made, at, least) -> np.ndarray:
    """Of the places ``at`` of their words' least pairs, in order, those to merge in one round.

    One by one, the leftmost least pair is merged first, then the next. All of a word may go at once (every other one
    where they overlap) unless that makes a pair on the way that would have come before the next one: then only the
    leftmost goes.
    """
    new_word = np.append(True, word[at[1:]] != word[at[:-1]])
    chained = np.append(False, (at[1:] == at[:-1] + 1) & ~new_word[1:])
    head = np.flatnonzero(~chained)
    odd = (np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))) % 2
    leftmost, at = at[new_word], at[odd == 0]
    n = len(sym)
    first, last = np.append(-1, word)[at], np.append(word, -1)[np.minimum(at + 2, n)]
    merged = np.zeros(n, dtype=bool)
    merged[at] = True
    # the new symbol with the one on its left as it is by then, and with the one on its right as it still is
    left = np.where(merged[np.maximum(at - 2, 0)] & (at >= 2), made[np.maximum(at - 2, 0)], sym[np.maximum(at - 1, 0)])
    before, _ = v.look(left, made[at])
    before[first != word[at]] = NONE
    after, _ = v.look(made[at], sym[np.minimum(at + 2, n - 1)])
    after[last != word[at]] = NONE
    unsafe = word[at[np.minimum(before, after) <= least[at]]]
    if not len(unsafe):
        return at
    at = at[~np.isin(word[at], unsafe)]
    return np.sort(np.concatenate([at, leftmost[np.isin(word[leftmost], unsafe)]]))


def merge_rounds(v: Vocabulary, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of many words at once; ``first`` holds the words' offsets. Returns symbols and offsets.

    Each round finds every word's least pair rank by a segmented minimum, merges its pairs of that rank in all words
    together (see ``_merged_at_once``), closes the gaps, and sets aside words that have no pair left.
    """
    n_words = len(first) - 1
    done: list[tuple[np.ndarray, np.ndarray]] = []  # (symbols, word of each)
    word = np.repeat(np.arange(n_words), np.diff(first))
    sym = sym.astype(np.int32)
    rank, made = np.full(len(sym), NONE, dtype=np.int32), np.zeros(len(sym), dtype=np.int32)
    if len(sym):
        rank[:-1], made[:-1] = v.look(sym[:-1], sym[1:])
        rank[np.flatnonzero(np.diff(word, append=-1))] = NONE
    while len(sym):
        head = np.empty(len(word), dtype=bool)
        head[0] = True
        np.not_equal(word[1:], word[:-1], out=head[1:])
        starts = np.flatnonzero(head)
        least = np.minimum.reduceat(rank, starts)
        over = least == NONE
        if over.any():
            which = np.repeat(over, np.diff(np.append(starts, len(sym))))
            done.append((sym[which], word[which]))
            keep = ~which
            sym, word, rank, made, head = sym[keep], word[keep], rank[keep], made[keep], head[keep]
            if not len(sym):
                break
            starts, least = np.flatnonzero(head), least[~over]
        least = np.repeat(least, np.diff(np.append(starts, len(sym))))
        at = np.flatnonzero(rank == least)
        if len(at) > len(starts):
            at = _merged_at_once(v, sym, word, rank, made, at, least)
        sym[at] = made[at]
        keep = np.ones(len(sym), dtype=bool)
        keep[at + 1] = False
        place = at - np.arange(len(at))  # of each merged symbol, once the gaps are closed
        sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
        touched = np.concatenate([place, place - 1])
        touched = touched[touched >= 0]
        right = np.minimum(touched + 1, len(sym) - 1)
        r, m = v.look(sym[touched], sym[right])
        r[(word[touched] != word[right]) | (touched == right)] = NONE
        rank[touched], made[touched] = r, m
    all_sym = np.concatenate([s for s, _ in done]) if done else np.zeros(0, np.int32)
    all_word = np.concatenate([w for _, w in done]) if done else np.zeros(0, np.int64)
    all_sym = all_sym[np.argsort(all_word, kind="stable")]
    return all_sym, np.concatenate([[0], np.cumsum(np.bincount(all_word, minlength=n_words))])


def to_ids(v: Vocabulary, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols as ids; characters that are no piece become the ids of their bytes."""
    odd = np.flatnonzero((sym < 0) | (sym >= v.n))
    if not len(odd):
        return sym, first
    spelled = {s: [int(v.byte[b]) for b in chr(-s - 1 if s < 0 else v.char[s]).encode("utf-8", "surrogatepass")] for s in np.unique(sym[odd]).tolist()}
    times = np.ones(len(sym), dtype=np.int64)
    times[odd] = [len(spelled[s]) for s in sym[odd].tolist()]
    out = np.repeat(sym, times)
    edge = np.concatenate([[0], np.cumsum(times)])
    for i in odd.tolist():
        out[edge[i] : edge[i + 1]] = spelled[int(sym[i])]
    return out, edge[first]


def encode(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of UTF-8 texts laid end to end, without begin and end ids, and the texts' offsets in them.

    A blank starts every text that is not empty, as the model adds one. No piece runs over the start of a word (a run
    of blanks and what follows), so words are merged apart, and equal words of a batch once.
    """
    full = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][full], np.uint8(SPACE))
    offsets = offsets + np.concatenate([[0], np.cumsum(full)])
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    blank = data == SPACE
    marks = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
    blank[marks] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = blank[:-1]
    if len(marks):  # a mark in the text counts as a blank: its first byte opens a word unless a blank stands before it
        before[marks[marks + 3 < len(data)] + 3] = True
    before[offsets[:-1][full]] = False
    starts = np.flatnonzero(blank & ~before)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = words.dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False)
    raw, at = string_buffers(coded.dictionary)
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    place = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    # words are parted further where no piece runs over two characters, so that few rounds see long ones
    edge = np.zeros(len(chars) + 1, dtype=bool)
    edge[1:-1] = v.never_merge(chars[:-1], chars[1:])
    edge[place[at]] = True
    edge = np.flatnonzero(edge)
    sym, parts = merge_rounds(v, v.of_char[chars], edge)
    ids, parts = to_ids(v, sym, parts)
    first = parts[np.searchsorted(edge, place[at])]
    count = np.diff(first)[which]
    end = np.cumsum(count)
    spread = np.arange(end[-1] if len(end) else 0) - np.repeat(end - count - first[:-1][which], count)
    text_first = np.concatenate([[0], end])[np.searchsorted(starts, offsets)]
    return ids[spread], text_first


def decode(v: Vocabulary, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
    """UTF-8 texts of id sequences: the first blank goes, bytes that are no UTF-8 become U+FFFD."""
    size = np.diff(v.byte_at)[ids]
    end = np.cumsum(size)
    flat = v.flat[np.arange(end[-1] if len(end) else 0) - np.repeat(end - size - v.byte_at[:-1][ids], size)].tobytes()
    edge = np.concatenate([[0], end])[first].tolist()
    out = []
    odd = v.is_byte[ids]
    any_byte = np.concatenate([[0], np.cumsum(odd)])[first]
    for k, (a, b) in enumerate(zip(edge, edge[1:])):
        text = flat[a:b]
        if any_byte[k + 1] > any_byte[k]:
            text = text.decode("utf-8", "replace").encode()
        out.append(text[1:] if text[:1] == b" " else text)
    return out


def tokens(batches, path: str, keep: list[str], outputs: tuple[str, ...]):
    v = vocabulary(path)
    for batch in sub_batches(batches, "text", BATCH):
        data, offsets = string_buffers(batch.column(batch.schema.get_field_index("text")))
        ids, first = encode(v, data, offsets)
        ends = np.repeat(first, 2)[1:-1]
        ids = np.insert(ids, ends, np.tile([v.bos, v.eos], len(first) - 1)) if len(first) > 1 else ids
        first = first + 2 * np.arange(len(first))
        out = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
        raw, at = ids.astype("<u4").tobytes(), (4 * first).tolist()
        if "n_tokens" in outputs:
            out["n_tokens"] = pa.array(np.diff(first))
        if "ids" in outputs:
            out["ids"] = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
        if "ids_sha256" in outputs:
            out["ids_sha256"] = pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:])])
        if {"decoded", "decoded_sha256"} & set(outputs):
            texts = decode(v, ids, first)
            if "decoded" in outputs:
                out["decoded"] = pa.array([t.decode() for t in texts], pa.string())
            if "decoded_sha256" in outputs:
                out["decoded_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in texts])
        yield pa.RecordBatch.from_pydict({c: out[c] for c in [*keep, *outputs]})


TYPES = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "ids_sha256": T.StringType(), "decoded": T.StringType(), "decoded_sha256": T.StringType()}


def tokenize(docs: DataFrame, path: str, keep: list[str], outputs: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the ``outputs`` of its whole ``text``, with begin and end ids.

    One pass, no shuffle; rows come in slices of some MB of text, so a long text stands alone. A null text counts as
    empty (begin and end ids only); repeated rows give equal rows; an empty table gives none.
    """
    schema = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in keep], *[T.StructField(c, TYPES[c]) for c in outputs]])
    names = list(dict.fromkeys([*keep, "text"]))
    return map_arrow(docs.select(*[docs[f"`{c}`"] for c in names]), lambda it: tokens(it, path, keep, outputs), schema)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return tokenize(docs, model_path(), ["doc_id"], ("n_tokens", "ids_sha256", "decoded_sha256"))
