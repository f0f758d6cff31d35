"""Byte-level BPE ids of whole texts, encoded once for each distinct chunk.

The vocabulary's pre-tokenizer never joins what stands before a single space
with what follows it, if there is no other white space beside it. A text is
therefore cut before such spaces, and each distinct chunk is encoded once by
the ``tokenizers`` library. Texts with white space beside a space are encoded
whole. The ids are those of encoding the whole text.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from graphloom.llm.textkernel import hash_spans, mix, utf8

END_ID = 2
#: Bytes of text that are encoded at once; slots for chunks, and how many are remembered.
SLICE_BYTES, SLOTS, REMEMBERED = 4 << 20, 1 << 21, 1_200_000
_SPACE_LAST = r"(?:^|[\s\v\x{1c}-\x{1f}\x{85}\p{Z}])$"
_BESIDE_SPACE = r" [\s\v\x{1c}-\x{1f}\x{85}\p{Z}]|[\s\v\x{1c}-\x{1f}\x{85}\p{Z}] "


def vocabulary_path() -> str:
    """The default vocabulary file; every operator takes another as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``values[s:s+n]`` over all pairs."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    return values[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task would keep it from the others."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row. After each, memory that its work has freed goes back to the system."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(size):
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + most, "right")))
        yield at, end
        give_back()
        at = end


class _Places:
    """An open-addressing table of 128-bit keys, searched for many keys at once."""

    def __init__(self, slots: int) -> None:
        self.mask = slots - 1
        self.key = np.zeros((2, slots), np.uint64)
        self.place = np.full(slots, -1, np.int32)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The places of keys, -1 for keys that are absent."""
        out, open_ = np.full(len(a), -1, np.int64), np.arange(len(a))
        slot = (a & np.uint64(self.mask)).astype(np.int64)
        while len(open_):
            place, at = self.place[slot], slot
            hit = (place >= 0) & (self.key[0, at] == a[open_]) & (self.key[1, at] == b[open_])
            out[open_[hit]] = place[hit]
            on = (place >= 0) & ~hit
            open_, slot = open_[on], (slot[on] + 1) & self.mask
        return out

    def add(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> None:
        """Enter keys that are absent and differ."""
        open_ = np.arange(len(a))
        slot = (a & np.uint64(self.mask)).astype(np.int64)
        while len(open_):
            free = self.place[slot] < 0
            self.place[slot[free]] = place[open_[free]]
            own = free & (self.place[slot] == place[open_])
            self.key[0, slot[own]], self.key[1, slot[own]] = a[open_[own]], b[open_[own]]
            open_, slot = open_[~own], (slot[~own] + 1) & self.mask


class ChunkEncoder:
    """Encodes Arrow string arrays; one is made in each Python worker."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token.encode()) if i in added else len(token)
        self._forget()

    def _forget(self) -> None:
        self.places = _Places(SLOTS)
        self.at, self.n, self.entries = np.zeros(1024, np.int64), np.zeros(1024, np.int32), 0
        self.ids, self.used = np.zeros(4096, np.int32), 0

    def _store(self, n: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Keep the ids of new entries, which have ``n`` ids each."""
        begin, end = self.entries, self.entries + len(n)
        while len(self.at) < end:
            self.at, self.n = np.concatenate([self.at, self.at]), np.concatenate([self.n, self.n])
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, self.ids])
        self.n[begin:end] = n
        self.at[begin:end] = self.used + np.cumsum(n) - n
        self.ids[self.used : self.used + len(flat)] = flat
        self.used, self.entries = self.used + len(flat), end
        return np.arange(begin, end)

    def _learn(self, words: pa.Array, before: str) -> np.ndarray:
        """Entries of new words; spaced words that end in no white space are encoded as one text, which the ids' byte lengths take apart again."""
        out = np.zeros(len(words), np.int64)
        apart = pc.match_substring_regex(words, _SPACE_LAST).to_numpy(zero_copy_only=False).astype(bool) if before else np.ones(len(words), bool)
        if apart.any():
            found = [e.ids for e in self.tokenizer.encode_batch_fast([before + w for w in words.filter(pa.array(apart)).to_pylist()], add_special_tokens=False)]
            out[apart] = self._store(np.fromiter(map(len, found), np.int64, len(found)), np.fromiter((i for ids in found for i in ids), np.int32))
        joined = words.filter(pa.array(~apart))
        if len(joined):
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(joined)], pa.int32()), joined), " ")[0].as_py()
            ids = np.array(self.tokenizer.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, np.int32)
            ends = np.cumsum(pc.binary_length(joined).to_numpy().astype(np.int64) + 1)
            upto = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
            out[~apart] = self._store(np.diff(upto, prepend=0), ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each; null is empty."""
        texts = pc.fill_null(texts, "")
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        whole = pc.match_substring_regex(texts, _BESIDE_SPACE).to_numpy(zero_copy_only=False).astype(bool)
        plain = texts.filter(pa.array(~whole)) if whole.any() else texts
        ids, n = self._encode_chunks(plain)
        if not whole.any():
            return ids, n
        rest = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)]
        counts = np.zeros(len(texts), np.int64)
        counts[~whole], counts[whole] = n, [len(x) for x in rest]
        both = np.concatenate([ids, *rest])
        starts = np.zeros(len(texts), np.int64)
        starts[~whole], starts[whole] = np.cumsum(n) - n, len(ids) + np.cumsum(counts[whole]) - counts[whole]
        return gather(both, starts, counts), counts

    def _entries(self, chunks: pa.Array, hashed: list[np.ndarray], wanted: np.ndarray, before: str) -> np.ndarray:
        """The entry of each wanted chunk with ``before`` in front of it; 0 for the others."""
        kinds = np.flatnonzero(wanted)
        a, b = (mix(h[kinds] + np.uint64(len(before))) for h in hashed)
        found = self.places.find(a, b)
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = self._learn(chunks.take(pa.array(kinds[new])), before)
            self.places.add(a[new], b[new], found[new])
        out = np.zeros(len(chunks), np.int64)
        out[kinds] = found
        return out

    def _encode_chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        code = coded.indices.to_numpy()
        begin = offsets[:-1][np.diff(offsets) > 0]
        first = code[begin]
        if self.entries > REMEMBERED:
            self._forget()
        raw, bounds = utf8(coded.dictionary)
        hashed = [hash_spans(raw, bounds[:-1], bounds[1:]), hash_spans(raw ^ 0x5A, bounds[:-1], bounds[1:])]
        opening = np.bincount(first, minlength=len(coded.dictionary))
        spaced = self._entries(coded.dictionary, hashed, np.bincount(code, minlength=len(coded.dictionary)) > opening, " ")
        alone = self._entries(coded.dictionary, hashed, opening > 0, "")[first]
        at, n = self.at[spaced][code], self.n[spaced].astype(np.int64)[code]
        at[begin], n[begin] = self.at[alone], self.n[alone]
        before = np.concatenate([[0], np.cumsum(n)])
        return gather(self.ids, at, n), before[offsets[1:]] - before[offsets[:-1]]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def forget_encoders() -> None:
    """Drop this process's encoders: other kernels call it first, as Spark hands them workers that have encoded before."""
    _encoders.clear()
    give_back()


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The end id appended to each document."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1
