"""Operator 12: near-duplicates by SimHash and pivot distance tables.

A text's fingerprint has 64 bits: of the XXH64 hashes of its word shingles,
repeats included, a bit is 1 if it is set in over half. Texts of fingerprints
that differ in ``RADIUS`` bits or fewer are linked, and links make components.

Equal fingerprints are one node from the start. Each node gets a row of the
distance table: its Hamming distances to ``PIVOTS`` reference fingerprints.
The distance of two fingerprints is never below the difference of their
distances to a reference, so that pairs whose rows differ by more than the
radius anywhere are discarded; only survivors are compared bit by bit.

Pairs come from buckets, not from all rows: cut into ``PARTS`` parts, two
fingerprints within the radius agree in at least ``PARTS - RADIUS`` of them,
so that all such choices of parts are tried as keys and no link is lost. Within
a bucket, members are sorted by their first distance and meet only those in a
window of the radius. A bucket of more than ``BLOCK`` members is cut into
square blocks that are tasks' work each: its size changes nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.columns import named
from graphloom.llm.components import components
from graphloom.llm.store import by_bytes, staged
from graphloom.llm.subwords import forget_encoders, gather, slices
from graphloom.llm.textkernel import mix, utf8, words

WORDS, SEED, RADIUS, PARTS, PIVOTS = 3, 42, 3, 5, 32
#: Members of a block's side on average; pairs that are compared at once.
BLOCK, AT_ONCE = 4096, 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
REFERENCES = mix(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _masks(parts: int, agree: int) -> list[int]:
    """The bits of every choice of ``agree`` parts of 64 bits, parts as equal as can be."""
    bounds = [64 * i // parts for i in range(parts + 1)]
    whole = [sum(1 << b for b in range(i, j)) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    return [sum(chosen) for chosen in combinations(whole, agree)]


def fingerprints(texts: pa.Array, size: int = WORDS, seed: int = SEED) -> np.ndarray:
    """A 64-bit fingerprint of each text; 0 for texts without words."""
    raw, offsets = utf8(texts)
    raw = _LOWER[raw]
    begin, end, text = words(raw, offsets)
    length, n = end - begin, len(offsets) - 1
    at = np.cumsum(length + 1) - (length + 1)  # words again, with one space after each
    spaced = np.full(int((length + 1).sum()), ord(" "), np.uint8)
    spaced[np.repeat(at - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))] = gather(raw, begin, length)
    in_text = np.bincount(text, minlength=n)
    many = np.where(in_text >= size, in_text - size + 1, np.minimum(in_text, 1))
    of = np.repeat(np.arange(n), many)
    first = (np.cumsum(in_text) - in_text)[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    last = first + np.minimum(in_text[of], size) - 1
    data, digest = spaced.tobytes(), xxhash.xxh64_intdigest
    hashed = np.array([digest(data[i:j], seed) for i, j in zip(at[first].tolist(), (at + length)[last].tolist(), strict=True)], np.uint64)
    out = np.zeros(n, np.uint64)
    filled = np.flatnonzero(many)
    if len(filled):
        ones = np.zeros((len(filled), 64), np.int64)
        opens = (np.cumsum(many) - many)[filled]
        for k in range(0, 64, 8):  # eight bits at a time, so that a long text's bits take no more than its hashes
            byte = (hashed >> np.uint64(56 - k)).astype(np.uint8)
            ones[:, k : k + 8] = np.add.reduceat(np.unpackbits(byte[:, None], axis=1), opens, axis=0, dtype=np.int64)
        bits = 2 * ones > many[filled][:, None]
        out[filled] = np.packbits(bits, axis=1).view(">u8").reshape(-1)
    return out


def distances(prints: np.ndarray) -> np.ndarray:
    """The distance table's rows: Hamming distances to the references, a byte each."""
    return np.bitwise_count(prints[:, None] ^ REFERENCES[None, :]).astype(np.uint8)


def _signed(documents: DataFrame, id_col: str, text_col: str, size: int, seed: int) -> DataFrame:
    """(id, print) of every row."""
    source = documents.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"))
    schema = T.StructType([source.schema.fields[0], T.StructField("print", T.LongType())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in batches:
            for i, j in slices(batch.column(1), 1 << 20):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints(part.column(1), size, seed).view(np.int64))], schema.names)

    return by_bytes(source).mapInArrow(sign, schema)


def _tabled(nodes: DataFrame) -> DataFrame:
    """(print, table) of the distinct fingerprints: the distance table, a row for each."""
    schema = T.StructType([T.StructField("print", T.LongType()), T.StructField("table", T.BinaryType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = distances(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeBinaryArray.from_buffers(pa.binary(PIVOTS), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())], schema.names)

    return nodes.select("print").mapInArrow(measure, schema)


def close_pairs(place: np.ndarray, high: np.ndarray, low: np.ndarray, prints: np.ndarray, table: np.ndarray, part: np.ndarray, masks: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of one place whose fingerprints are within the radius.

    ``place`` numbers the blocks; ``high`` and ``low`` mark a row as of the block's first and second side (both in a
    block on the diagonal). A pair that agrees in an earlier choice of parts as well is that bucket's, not this one's.
    """
    order = np.lexsort((table[:, 0], place))
    ranked = place[order].astype(np.int64) * 256 + table[order, 0]
    many = np.searchsorted(ranked, ranked + radius, "right") - np.arange(len(order)) - 1
    ends, at, found = np.cumsum(many), 0, []
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        n = many[at:to]
        left = np.repeat(np.arange(at, to), n)
        right = order[left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)]
        left = order[left]
        good = high[left] & low[right] | low[left] & high[right]
        left, right = left[good], right[good]
        for k in range(1, PIVOTS, 4):  # each few references leave less for the next
            apart = table[left, k : k + 4].astype(np.int16) - table[right, k : k + 4]
            good = (np.abs(apart) <= radius).all(1)
            left, right = left[good], right[good]
        differ = prints[left] ^ prints[right]
        good = np.bitwise_count(differ) <= radius
        for k, mask in enumerate(masks.tolist()):
            good &= (part[left] <= k) | (differ & np.uint64(mask) != 0)
        found.append((left[good], right[good]))
        at = to
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _links(nodes: DataFrame, radius: int, parts: int, block: int) -> DataFrame:
    """(a, b) of all fingerprints that are linked, in any order, each pair once."""
    chosen = _masks(parts, parts - radius)
    masks = np.array(chosen, np.uint64)
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("print").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)])
    members = nodes.select("print", "table", F.explode(keys).alias("at")).select("at.part", "at.key", "print", "table")
    sizes = members.groupBy("part", "key").agg(F.count("*").alias("size")).where("size > 1")
    wide = F.ceil(F.col("size") / block).cast("int")
    rows = members.join(sizes, ["part", "key"]).withColumn("wide", wide).withColumn("own", F.pmod(F.xxhash64("print"), F.col("wide")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
    rows = rows.select("part", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "print", "table")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        held: list[pa.RecordBatch] = []

        def pairs(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(rows).combine_chunks()
            part, key, i, j, own, prints = (whole.column(c).to_numpy() for c in range(6))
            at = np.stack([part, key, i, j])
            place = np.cumsum(np.append(False, (at[:, 1:] != at[:, :-1]).any(0)))
            table = np.frombuffer(b"".join(whole.column(6).to_pylist()), np.uint8).reshape(-1, PIVOTS)
            a, b = close_pairs(place, own == i, own == j, prints.view(np.uint64), table, part, masks, radius)
            return pa.RecordBatch.from_arrays([pa.array(prints[a]), pa.array(prints[b])], schema.names)

        for batch in batches:
            if not len(batch):
                continue
            at = np.stack([batch.column(c).to_numpy() for c in range(4)])
            new = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0))
            if held and any(held[-1].column(c)[-1].as_py() != at[c, 0] for c in range(4)):
                yield pairs(held)
                held = []
            if len(new):  # the last block may go on in the next batch
                cut = int(new[-1]) + 1
                yield pairs([*held, batch.slice(0, cut)])
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield pairs(held)

    return by_bytes(rows.repartition("part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j")).mapInArrow(compare, schema)


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, seed: int = SEED, radius: int = RADIUS, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """The fingerprint and the component of every row: id, fingerprint (hex) and component_id, the smallest id reachable.

    A null text is empty; texts without words have fingerprint 0 and are linked like any other. A text of fewer than
    ``size`` words is one shingle. Ids may be null or repeat, and rows may: each gives a row; a component whose ids are all null
    has a null component_id. Other columns play no part. An empty table gives no rows.
    """
    if not 0 <= radius < parts:
        raise ValueError("there must be more parts than bits that may differ")
    signed = staged(_signed(documents, id_col, text_col, size, seed), "prints")
    nodes = staged(signed.groupBy("print").agg(F.min("id").alias("id")), "nodes")
    links = _links(staged(_tabled(nodes), "distances"), radius, parts, block)
    joined = nodes.join(components(staged(links, "links")), F.col("print") == F.col("node"), "left").select("print", "id", F.coalesce("component", "print").alias("component"))
    lowest = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    classes = joined.select("print", "component").join(lowest, "component").select("print", "component_id")
    return signed.join(classes, "print").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
