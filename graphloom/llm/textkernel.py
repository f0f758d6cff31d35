"""Words, hashes of words and word runs of many texts at once, on the bytes of Arrow string arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240229).integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, one text after another, and the n + 1 places where texts begin and end."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each longest run of true places that does not pass a text's end."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of each word: what stands between ASCII white space."""
    begin, end = runs(~_SPACE[raw], offsets)
    return begin, end, np.searchsorted(offsets, begin, "right") - 1


def hash_spans(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans have equal hashes, wherever they are."""
    if len(_powers[0]) <= len(raw):
        n = (len(raw) // (1 << 18) + 1) << 18
        for i, base in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _powers[0][: len(raw)])])
    return mix((upto[end] - upto[begin]) * _powers[1][begin] + (end - begin).astype(np.uint64))


def shingles(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` lower-case words, and the text of each.

    A text of fewer words has one shingle of all of them, one without words has none.
    """
    raw, offsets = utf8(pc.utf8_lower(pc.fill_null(texts, "")))
    begin, end, text = words(raw, offsets)
    hashed = hash_spans(raw, begin, end)
    in_text = np.bincount(text, minlength=len(offsets) - 1)
    first = np.cumsum(in_text) - in_text
    n = np.where(in_text >= size, in_text - size + 1, np.minimum(in_text, 1))
    of = np.repeat(np.arange(len(n)), n)
    at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    last = (first + in_text)[of] - 1
    padded = np.append(hashed, np.uint64(0))
    out = np.zeros(len(of), np.uint64)
    for j in range(size):
        place = at + j
        out = mix(out + np.where(place <= last, padded[np.minimum(place, len(hashed))], np.uint64(j)) + np.uint64(_BASE))
    return out, of


def numbered(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How many equal values stand before each value in its group."""
    key = mix(values ^ mix(group.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    index = np.arange(len(key))
    begin = np.maximum.accumulate(np.where(same, 0, index))
    out = np.empty(len(key), np.int64)
    out[order] = index - begin
    return out
