"""Operator 4: best-fit packing by patterns of lengths.

Documents become pieces of at most ``max_length`` tokens. The histogram of the
pieces' lengths has at most ``max_length`` entries whatever the corpus is, so
the plan is made on the driver: all patterns of up to three lengths that fill
a sequence exactly are enumerated, their repeat counts are fitted to the
histogram by non-negative least squares and rounded down, and what is left over
is packed best fit decreasing, on counts. Of a few shares of the fitted repeats
the one with the fewest sequences counts, the largest of those. A piece's place follows from its rank
among the pieces of its length. Ranks are counted in salted groups, so that a
length which a third of all pieces have is no hot key.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.store import by_bytes, staged
from graphloom.llm.subwords import END_ID, ChunkEncoder, encoder, slices, vocabulary_path, with_end

MAX_LENGTH = 1024
#: Shares of the fitted repeats that are tried: whole patterns waste nothing, but use up the short pieces that fill the other sequences.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25, 0.0)
#: Bytes of text that a worker cuts at once: what the encoder holds beside its chunks is some 30 times that.
SLICE_BYTES = 1 << 20


@dataclass
class Plan:
    """Slots of each length: of rank ``low`` and up, ``each`` to a sequence from ``first`` on, from ``offset`` on."""

    length: np.ndarray
    low: np.ndarray
    each: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, given their lengths and ranks (from 0) among those of their length."""
        span = int(max(self.low.max(initial=0), rank.max(initial=0))) + 1
        if span < 2**62 // (int(self.length.max(initial=0)) + 1):
            at = np.searchsorted(self.length * span + self.low, length * span + rank, "right") - 1
        else:
            raise OverflowError("too many pieces of one length")
        copy, slot = np.divmod(rank - self.low[at], self.each[at])
        return self.first[at] + copy, self.offset[at] + slot * length


def exact_patterns(most: int) -> np.ndarray:
    """All patterns of one to three lengths with sum ``most``, as rows a >= b >= c with 0 for none."""
    a = np.arange(1, most + 1)
    rows = []
    for c in range(most // 3 + 1):
        b = np.arange(max(c, 1) if c else 0, (most - c) // 2 + 1)
        rows.append(np.stack([most - c - b, b, np.full(len(b), c)], 1))
    found = np.concatenate(rows)
    return found[(found[:, 0] >= found[:, 1]) & np.isin(found[:, 0], a)]


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares of the patterns' repeats against the histogram, longer lengths weighing more.

    Accelerated projected gradient; a pattern has three entries at most, so neither matrix is formed.
    """
    most = len(histogram) - 1
    weight = np.arange(most + 1) / most
    scale = max(float(histogram.max()), 1.0)
    target = histogram / scale

    def forward(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(patterns[:, j], x, most + 1) for j in range(3))
        out[0] = 0
        return out

    def backward(r: np.ndarray) -> np.ndarray:
        r = r * (np.arange(most + 1) > 0)
        return r[patterns[:, 0]] + r[patterns[:, 1]] + r[patterns[:, 2]]

    v = np.ones(len(patterns)) / np.sqrt(len(patterns))
    for _ in range(12):
        v = backward(weight**2 * forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(patterns))
    momentum = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - backward(weight**2 * (forward(y) - target)) / (1.05 * norm))
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = new + (momentum - 1) / after * (new - x)
        x, momentum = new, after
    made = forward(x)
    room = np.where(made > target, target / np.maximum(made, 1e-300), 1.0)
    room[0] = 1.0
    return x * room[patterns].min(1) * scale


def best_fit(left: np.ndarray, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on counts: (lengths, repeats) of the sequences that hold the pieces counted in ``left``."""
    open_: list[Counter] = [Counter() for _ in range(most + 1)]  # by free space
    free = np.zeros(most + 1, bool)
    for length in range(most, 0, -1):
        count = int(left[length])
        while count:
            fits = np.flatnonzero(free[length:])
            if not len(fits):
                per = most // length
                for n, repeats in ((per, count // per), (count % per, 1)):
                    if n and repeats:
                        open_[most - n * length][(length,) * n] += repeats
                        free[most - n * length] = True
                break
            space = length + int(fits[0])
            pattern, repeats = next(iter(open_[space].items()))
            used = min(count, repeats)
            if used == repeats:
                del open_[space][pattern]
                free[space] = bool(open_[space])
            else:
                open_[space][pattern] -= used
            open_[space - length][(*pattern, length)] += used
            free[space - length] = True
            count -= used
    return [(pattern, repeats) for bins in open_ for pattern, repeats in bins.items()]


def make_plan(histogram: dict[int, int], most: int = MAX_LENGTH) -> Plan:
    """The packing of pieces whose lengths (1 to ``most``) are counted in ``histogram``."""
    counts = np.zeros(most + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    patterns = exact_patterns(most)
    patterns = patterns[(counts[patterns] > 0)[:, 0] & ((counts[patterns] > 0) | (patterns == 0)).all(1)]
    fitted = fit_repeats(patterns, counts.astype(float)) if len(patterns) else np.zeros(0)
    fewest = None
    for share in SHARES:
        repeats = np.floor(fitted * share).astype(np.int64)
        used = sum(np.bincount(patterns[:, j], repeats, most + 1).astype(np.int64) for j in range(3)) if len(patterns) else 0
        left = counts - used
        left[0] = 0
        rest = best_fit(left, most)
        if fewest is None or repeats.sum() + sum(n for _, n in rest) < fewest:
            fewest = repeats.sum() + sum(n for _, n in rest)
            chosen = [(tuple(x for x in patterns[i].tolist() if x), int(repeats[i])) for i in np.flatnonzero(repeats).tolist()] + rest
    slots, used, first = [], Counter(), 0
    for pattern, repeats in chosen:
        offset = 0
        for length, each in sorted(Counter(pattern).items(), reverse=True):
            slots.append((length, used[length], each, first, offset))
            used[length] += each * repeats
            offset += each * length
        first += repeats
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    return Plan(*table.T.copy(), sequences=first)


def cut(n: int, most: int = MAX_LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens; the first is the shorter one."""
    rest = n % most
    return ([(0, rest)] if rest else []) + [(s, most) for s in range(rest, n, most)]


def cut_batch(coder: ChunkEncoder, batch: pa.RecordBatch, names: list[str], most: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The pieces of a batch's documents (id, text), by slices of ``SLICE_BYTES``."""
    for at, end in slices(batch.column(1), SLICE_BYTES):
        ids, counts = with_end(*coder.encode(batch.column(1).slice(at, end - at)), end_id)
        ends = np.cumsum(counts)
        made = [(row, k, s, n, ends[row] - counts[row] + s) for row, total in enumerate(counts.tolist()) for k, (s, n) in enumerate(cut(total, most))]
        rows, piece, start, length, place = map(list, zip(*made, strict=True))
        raw = ids.astype("<u4")
        columns = [batch.column(0).slice(at, end - at).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(raw[p : p + n]) for p, n in zip(place, length, strict=True)], pa.int64())]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ids, pa.int32())))
        yield pa.RecordBatch.from_arrays(columns, names)


def pieces(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, most: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: id, piece, start, length, ids_crc32, and their ids on request.

    A null text is an empty one: a single piece that holds the end id.
    """
    path = vocabulary or vocabulary_path()
    fields = [T.StructField(id_col, documents.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            yield from cut_batch(coder, batch, [f.name for f in fields], most, end_id, with_ids)

    return by_bytes(documents.select(id_col, text_col)).mapInArrow(encode, T.StructType(fields))


def pack(table: DataFrame, order: list[str], most: int = MAX_LENGTH) -> DataFrame:
    """``table`` (a stored one: it is read twice) with sequence_id and offset for each row of its ``length`` column.

    ``order`` names the columns that tell rows apart; which of several equal rows gets which place is left open.
    """
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = make_plan(histogram, most)
    salts = max(1, round(sum(histogram.values()) ** 0.5))
    salted = table.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = salted.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order))).join(before.drop("_n"), ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.coalesce("_before", F.lit(0)) + F.col("_row") - 1).select(*table.columns, "_rank")
    schema = T.StructType([*table.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at, n = table.columns.index("length"), len(table.columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                sequence, offset = plan.place(batch.column(at).to_numpy(), batch.column(n).to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, most: int = MAX_LENGTH) -> DataFrame:
    """Every document's pieces with their places in the packed sequences.

    Null and empty texts are packed as their end id; an empty table gives no rows; repeated rows are packed
    as often as they occur; other columns play no part, whatever their names.
    """
    cut_up = staged(pieces(documents, id_col, text_col, vocabulary, most), "pieces")
    return pack(cut_up, [id_col, "piece", "ids_crc32"], most)


def packed_sequences(documents: DataFrame, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, most: int = MAX_LENGTH) -> DataFrame:
    """The packed sequences themselves: sequence_id, input_ids, and where each document's piece begins.

    Ids must be unique here. A sequence has at most ``most`` tokens, so its group is bounded.
    """
    ids = pieces(documents, id_col, text_col, vocabulary, most, with_ids=True).select(id_col, "piece", "ids")
    parts = placed.select(id_col, "piece", "sequence_id", "offset").join(ids, [id_col, "piece"])
    grouped = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", id_col, "piece", "ids"))).alias("parts"))
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("input_ids"), F.col("parts.offset").alias("offsets"), F.col(f"parts.{id_col}").alias("document_ids"))
