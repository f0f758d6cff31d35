"""Operator 6: SentencePiece encoding with seeded merge-dropout, and decoding.

A text is cut before each run of spaces; no piece of a merge-type vocabulary
reaches over such a place. Within a part, the agenda of candidate merges is
worked off by score, leftmost first; when a candidate's turn comes, a keyed hash
of the text, the part's place in it, the candidate's place and its two pieces
decides whether it is skipped. Every occurrence of a word draws for itself, and
the same text is always cut in the same way.

All parts of a slice of texts are worked off side by side. Occurrences of one
word share the work for as long as their draws agree: they begin as one state,
which splits where some skip a candidate and others do not. Long parts, as of
scripts without spaces, have a heap each, so that the time does not grow with
the square of a part's length; both ways cut alike.

Characters without a piece become bytes, as in the vocabulary's own encoding;
U+2581, which stands for a space in pieces, always does, so that decoding
gives every text back. With a dropout of 0 the ids are the library's own.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.store import by_bytes
from graphloom.llm.subwords import gather, slices
from graphloom.llm.textkernel import hash_spans, mix, utf8

DROPOUT, SEED = 0.1, 17
SLICE_BYTES = 6 << 20
#: Parts of more characters than this have a heap of their own.
LONG = 64
_SPACE = 0x2581
_NEVER, _MASK = np.int32(2**31 - 1), 2**64 - 1
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def model_path() -> str:
    """The default vocabulary file; every function takes another as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class MergeModel:
    """A merge-type vocabulary as arrays: characters, and the pairs of pieces that merge."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        n = self.size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i))]
        known = {pieces[i]: i for i in plain}
        scores = np.array([self.library.get_score(i) for i in range(n)])
        order = np.unique(-scores, return_inverse=True)[1]
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            if self.library.is_byte(i):
                self.byte_id[int(pieces[i][3:-1], 16)] = i
        self.of_char = np.full(0x110000, -1, np.int32)
        pairs: dict[int, int] = {}
        for piece, i in known.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
            for cut in range(1, len(piece)):
                if (a := known.get(piece[:cut])) is not None and (b := known.get(piece[cut:])) is not None:
                    pairs[a * n + b] = i
        self.pair = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pair.tolist()], np.int32)
        self.rank = order[self.merged].astype(np.int32)
        self.by_pair: dict[int, tuple[int, int]] = {}
        self.bytes_of = [b""] * n
        spelled = set(plain)
        for i, piece in enumerate(pieces):
            if self.library.is_byte(i):
                self.bytes_of[i] = bytes([int(piece[3:-1], 16)])
            elif i in spelled:
                self.bytes_of[i] = piece.replace(chr(_SPACE), " ").encode()

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of pairs in the table, -1 for none."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (a < self.size) & (b < self.size), at, -1)

    def segment(self, chars: np.ndarray, row: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Work off the agendas of words of one length (rows of ``chars``) for occurrences, given by word and key.

        Returns the symbols left of each state, their number, and the state of each occurrence. Symbols of ``size`` and
        more are characters without a piece.
        """
        width = chars.shape[1]
        symbols, begins = chars.copy(), np.broadcast_to(np.arange(width, dtype=np.int32), chars.shape).copy()
        ranks, intos = np.full(chars.shape, _NEVER), np.zeros(chars.shape, np.int32)
        if width > 1:
            ranks[:, :-1], intos[:, :-1] = self._agenda(chars[:, :-1], chars[:, 1:])
        count, bar = np.full(len(chars), width), _bar(dropout)
        state, final, number, made = row.copy(), np.zeros(len(row), np.int64), 0, []  # made: (symbols, count) of finished states
        occurrence = np.arange(len(row))
        while len(symbols):
            best = ranks.argmin(1)
            live = ranks[np.arange(len(best)), best] != _NEVER
            if not live.all():
                new = np.cumsum(~live) - 1 + number
                done = ~live[state]
                final[occurrence[done]] = new[state[done]]
                made.append((symbols[~live], count[~live]))
                number += int((~live).sum())
                occurrence, state = occurrence[~done], (np.cumsum(live) - 1)[state[~done]]
                symbols, begins, ranks, intos, count, best = (x[live] for x in (symbols, begins, ranks, intos, count, best))
                if not len(symbols):
                    break
            at = np.arange(len(best))
            merging = at
            if dropout > 0:
                skip = _draw(keys[occurrence], begins[at, best][state], symbols[at, best][state], symbols[at, best + 1][state]) < bar
                skipped = np.bincount(state[skip], minlength=len(best))
                whole = np.bincount(state, minlength=len(best))
                ranks_skipped = np.flatnonzero(skipped == whole)
                ranks[ranks_skipped, best[ranks_skipped]] = _NEVER
                merging = np.flatnonzero(skipped < whole)
                split = np.flatnonzero((skipped > 0) & (skipped < whole))
                if len(split):
                    to = np.zeros(len(best), np.int64)
                    to[split] = len(best) + np.arange(len(split))
                    moved = skip & (to[state] > 0)
                    state[moved] = to[state[moved]]
                    symbols, begins, ranks, intos, count = (np.concatenate([x, x[split]]) for x in (symbols, begins, ranks, intos, count))
                    ranks[to[split], best[split]] = _NEVER
            self._merge(symbols, begins, ranks, intos, count, merging, best[merging])
        if not made:
            return chars[:0], np.zeros(0, np.int64), final
        return np.concatenate([x for x, _ in made]), np.concatenate([x for _, x in made]), final

    def _agenda(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of candidate merges; a pair that is no candidate never has its turn."""
        at = self.find(a, b)
        return np.where(at >= 0, self.rank[at], _NEVER), self.merged[at]

    def _merge(self, symbols: np.ndarray, begins: np.ndarray, ranks: np.ndarray, intos: np.ndarray, count: np.ndarray, rows: np.ndarray, best: np.ndarray) -> None:
        """Carry out one merge in each of ``rows``, at ``best``."""
        width, at = symbols.shape[1], np.arange(len(rows))
        after = np.arange(width)[None, :] > best[:, None]
        own = symbols[rows]
        own[at, best] = intos[rows, best]
        for table, part, none in ((symbols, own, 0), (begins, begins[rows], 0), (ranks, ranks[rows], _NEVER), (intos, intos[rows], 0)):
            moved = np.concatenate([part[:, 1:], np.full((len(rows), 1), none, part.dtype)], 1)
            table[rows] = np.where(after, moved, part)
        count[rows] -= 1
        for side in (best - 1, best):
            inside = (side >= 0) & (side < count[rows] - 1)
            r, j = rows[inside], side[inside]
            ranks[r, j], intos[r, j] = self._agenda(symbols[r, j], symbols[r, j + 1])
            beyond = (side >= 0) & ~inside
            ranks[rows[beyond], side[beyond]] = _NEVER

    def segment_long(self, chars: np.ndarray, key: int, dropout: float) -> np.ndarray:
        """The same for one occurrence of a long word, by a heap of candidates and linked symbols."""
        if not self.by_pair:
            self.by_pair = dict(zip(self.pair.tolist(), zip(self.rank.tolist(), self.merged.tolist(), strict=True), strict=True))
        n, size, bar, pairs = len(chars), self.size, int(_bar(dropout)), self.by_pair
        rank, into = self._agenda(chars[:-1], chars[1:])
        good = rank != _NEVER
        if dropout > 0:
            good &= _draw(np.full(n - 1, key, np.uint64), np.arange(n - 1), chars[:-1], chars[1:]) >= np.uint64(bar)
        first = np.flatnonzero(good)
        symbol, after, before = chars.tolist(), [*range(1, n), -1], list(range(-1, n - 1))
        heap = list(zip(rank[first].tolist(), first.tolist(), chars[first].tolist(), chars[first + 1].tolist(), into[first].tolist(), strict=True))
        heapq.heapify(heap)
        while heap:
            _, at, a, b, made = heapq.heappop(heap)
            right = after[at]
            if symbol[at] != a or right < 0 or symbol[right] != b:
                continue
            symbol[at], symbol[right] = made, -1
            after[at] = after[right]
            if after[at] >= 0:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and (to := after[left]) >= 0:
                    c, d = symbol[left], symbol[to]
                    found = pairs.get(c * size + d) if c < size and d < size else None
                    if found and (dropout <= 0 or _draw_one(key, left, c, d) >= bar):
                        heapq.heappush(heap, (found[0], left, c, d, found[1]))
        return np.array([x for x in symbol if x >= 0], np.int32)

    def encode_parts(self, words: pa.Array, word: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, number) of each occurrence of ``words`` (with their spaces), given by its word's place and its key."""
        raw, offsets = utf8(words)
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        code = _codepoints(raw, at)
        known = self.of_char[np.where(code == _SPACE, 0, code)]
        known = np.where(code == 0x20, self.of_char[_SPACE], np.where(known >= 0, known, self.size + code)).astype(np.int32)
        known[code == _SPACE] = self.size + _SPACE
        first = np.searchsorted(at, offsets[:-1])
        length = np.searchsorted(at, offsets[1:]) - first
        order = np.argsort(word, kind="stable")  # a word's occurrences side by side
        bounds = np.searchsorted(word[order], np.arange(len(length) + 1))
        starts, numbers, made, used = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64), [], 0
        for width in np.unique(length).tolist():
            of_width = np.flatnonzero(length == width)
            if width > LONG:
                for w in of_width.tolist():
                    for o in order[bounds[w] : bounds[w + 1]].tolist():
                        flat, count = self._expand(self.segment_long(known[first[w] : first[w] + width], int(keys[o]), dropout), None)
                        starts[o], numbers[o] = used, len(flat)
                        made.append(flat)
                        used += len(flat)
                continue
            for block in np.array_split(of_width, max(1, len(of_width) * width >> 18)):
                many = bounds[block + 1] - bounds[block]
                own = order[np.arange(many.sum()) + np.repeat(bounds[block] - (np.cumsum(many) - many), many)]
                symbol, count, state = self.segment(known[first[block][:, None] + np.arange(width)], np.repeat(np.arange(len(block)), many), keys[own], dropout)
                flat, count = self._expand(symbol[np.arange(width)[None, :] < count[:, None]], count)
                begin = used + np.cumsum(count) - count
                starts[own], numbers[own] = begin[state], count[state]
                made.append(flat)
                used += len(flat)
        return np.concatenate(made) if made else np.zeros(0, np.int32), starts, numbers

    def _expand(self, flat: np.ndarray, count: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Characters without a piece as the ids of their bytes; ``count`` tells how many symbols belong together."""
        odd = np.flatnonzero(flat >= self.size)
        if not len(odd):
            return flat, count
        own = np.ones(len(flat), np.int64)
        spelled = [np.frombuffer(chr(c).encode(), np.uint8) for c in (flat[odd] - self.size).tolist()]
        own[odd] = list(map(len, spelled))
        out = np.repeat(flat, own)
        out[np.repeat(flat >= self.size, own)] = self.byte_id[np.concatenate(spelled)]
        if count is None:
            return out, None
        row = np.repeat(np.arange(len(count)), count)
        return out, np.bincount(row, own, len(count)).astype(np.int64)

    def encode(self, texts: pa.Array, dropout: float = DROPOUT, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each; null and empty texts have none."""
        raw, offsets = utf8(texts)
        text_key = hash_spans(raw, offsets[:-1], offsets[1:])
        filled = np.diff(offsets) > 0
        raw = np.insert(raw, offsets[:-1][filled], 0x20)  # the space that the library puts before a text
        offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        space = raw == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[offsets[:-1][filled]] = True
        begins = np.flatnonzero(begins)
        of = np.searchsorted(offsets, begins, "right") - 1
        bounds = np.append(begins, len(raw)).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(begins), pa.py_buffer(bounds), pa.py_buffer(raw))
        coded = parts.dictionary_encode()
        word = coded.indices.to_numpy().astype(np.int64)
        place = np.arange(len(of)) - np.searchsorted(of, of)
        keys = mix(text_key[of] + place.astype(np.uint64) * _A + mix(np.array([seed], np.uint64))[0])
        if dropout > 0:
            ids, starts, numbers = self.encode_parts(coded.dictionary, word, keys, dropout)
        else:
            n = len(coded.dictionary)
            ids, starts, numbers = self.encode_parts(coded.dictionary, np.arange(n), np.zeros(n, np.uint64), 0)
            starts, numbers = starts[word], numbers[word]
        return gather(ids, starts, numbers), np.bincount(of, numbers, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text whose ids these are."""
        joined = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return joined[1:].decode()


def _codepoints(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The characters that begin at bytes ``at``."""
    padded = np.concatenate([raw, np.zeros(4, np.uint8)]).astype(np.int64)
    a, b, c, d = (padded[at + i] for i in range(4))
    b, c, d = b & 63, c & 63, d & 63
    return np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b, np.where(a < 0xF0, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d)))


def _bar(dropout: float) -> np.uint64:
    """Draws below this skip their candidate."""
    return np.uint64(min(int(dropout * 2**64), 2**64 - 1))


def _draw(key: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The draws of candidates, given by their occurrence's key, their place in the part and their two pieces."""
    return mix(mix(key + place.astype(np.uint64) * _A) + a.astype(np.uint64) * _B + b.astype(np.uint64) * _C)


def _draw_one(key: int, place: int, a: int, b: int) -> int:
    """``_draw`` of one candidate."""
    x = (key + place * int(_A)) & _MASK
    for more in (a * int(_B) + b * int(_C), 0):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
        x = ((x ^ (x >> 31)) + more) & _MASK
    return x


_models: dict[str, MergeModel] = {}


def model(path: str) -> MergeModel:
    """This process's model of a vocabulary file."""
    if path not in _models:
        _models[path] = MergeModel(path)
    return _models[path]


def encode_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(id, ids) of each row; a null or empty text has no ids, repeated rows are cut alike, other columns play no part."""
    return _encoded(documents, id_col, text_col, path, dropout, seed, digest=False)


def encoding_digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(id, n_ids, ids_crc32, lossless) of each row, where the ids' decoding is held against the text."""
    return _encoded(documents, id_col, text_col, path, dropout, seed, digest=True)


def _encoded(documents, id_col, text_col, path, dropout, seed, digest) -> DataFrame:
    path = path or model_path()
    head = T.StructField(id_col, documents.schema[id_col].dataType)
    rest = [T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("lossless", T.BooleanType())] if digest else [T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    schema = T.StructType([head, *rest])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for at, end in slices(batch.column(1), SLICE_BYTES):
                part = batch.slice(at, end - at)
                ids, n = own.encode(part.column(1), dropout, seed)
                ends = np.cumsum(n)
                if digest:
                    raw = ids.astype("<u4")
                    texts = part.column(1).to_pylist()
                    bounds = list(zip((ends - n).tolist(), ends.tolist(), strict=True))
                    columns = [pa.array(n, pa.int64()), pa.array([zlib.crc32(raw[a:b]) for a, b in bounds], pa.int64()), pa.array([own.decode(ids[a:b]) == (t or "") for t, (a, b) in zip(texts, bounds, strict=True)])]
                else:
                    columns = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema.names)

    return by_bytes(documents.select(id_col, text_col), SLICE_BYTES).mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text) of encoded rows; null ids are none and give the empty text."""
    path = path or model_path()
    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()], pa.string())], schema.names)

    return by_bytes(encoded.select(F.col(id_col), F.col(ids_col))).mapInArrow(decode, schema)
