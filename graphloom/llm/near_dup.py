"""Operator 8: near-duplicates by DartMinHash.

A text is the multiset of its five-word shingles; a shingle's weight is how
often it occurs, and similarity is the weighted Jaccard index. Each unit of
weight is a region on which hashed darts fall as a Poisson process over ranks
from 0 upwards, the same darts wherever that unit occurs. A text looks only at
ranks that give it about k ln k + 2k darts and keeps the earliest dart of each
of k coordinates: the time is the text's length plus k ln k, not their
product. Two texts keep the same dart with probability equal to their
similarity.

Texts that agree in a band of coordinates are candidates, and every pair of
candidates is compared unless links join the two already. Buckets are first
compared as stars, around the member that shares most buckets with others.
In a bucket that still holds several classes, members outside its largest class
are then compared with all members of other classes, in square blocks of at
most about ``BLOCK`` members a side: a task gets the two sides' sketches, not
pairs. A sketch holds the parities of a text's units in ``BITS`` cells; the
number of cells in which two sketches differ is never above the size of the
texts' symmetric difference, so that it bounds their similarity from above, and
pairs whose bound is below the threshold are left out without loss. No size of
a bucket changes what is compared. Every link is checked against the texts.
Equal texts are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import columns
from graphloom.llm.components import components
from graphloom.llm.store import by_bytes, staged
from graphloom.llm.subwords import forget_encoders, slices
from graphloom.llm.textkernel import mix, numbered, shingles

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 8
#: Members of a block's side, on average at most; cells of a sketch.
BLOCK, BITS = 512, 4096
_STEP, _DART, _COPY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)
_NONE = np.uint64(2**64 - 1)


def units(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """One hash for each unit of weight of each text's shingles, and the text of each."""
    hashed, text = shingles(texts, words)
    return mix(hashed + numbered(hashed, text).astype(np.uint64) * _COPY), text


def _throw(unit: np.ndarray, text: np.ndarray, most: np.ndarray, kept: np.ndarray, k: int) -> None:
    """Throw the darts of all units with ranks of at most ``most[text]``; ``kept`` holds the earliest of each text's coordinates."""
    rank, thrown = np.zeros(len(unit)), 0
    while len(unit):
        many = max(1, min(64, (1 << 16) // len(unit)))
        seed = mix(unit[:, None] + (np.arange(thrown, thrown + many, dtype=np.uint64) * _STEP)[None, :])
        ranks = rank[:, None] + np.cumsum(-np.log1p((seed >> np.uint64(11)) * -(2.0**-53)), axis=1)
        row, column = np.nonzero(ranks <= most[text][:, None])
        dart = mix(seed[row, column] ^ _DART)
        coordinate = ((dart >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        order = ranks[row, column].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)
        np.minimum.at(kept, text[row] * k + coordinate.astype(np.int64), order | (dart & np.uint64(0xFFFFFFFF)))
        rank, thrown = ranks[:, -1], thrown + many
        live = rank <= most[text]
        unit, text, rank = unit[live], text[live], rank[live]


def signatures(texts: pa.Array, k: int = BANDS * ROWS, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The kept dart of each of ``k`` coordinates (n x k), and whether the text has words at all."""
    unit, text = units(texts, words)
    weight = np.bincount(text, minlength=len(texts))
    kept = np.full(len(texts) * k, _NONE, np.uint64)
    most = k * (np.log(k) + 2) / np.maximum(weight, 1)
    while len(unit):
        _throw(unit, text, most, kept, k)
        lacking = (kept.reshape(-1, k) == _NONE).any(1)
        again = lacking[text]
        unit, text = unit[again], text[again]
        most = np.where(lacking, 2 * most, most)
    return kept.reshape(-1, k) & np.uint64(0xFFFFFFFF), weight > 0


def band_keys(kept: np.ndarray, bands: int) -> np.ndarray:
    """One key for each band of coordinates; keys of different bands differ."""
    parts = kept.reshape(len(kept), bands, -1)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]) * _COPY
    for j in range(parts.shape[2]):
        key = mix(key * _STEP + parts[:, :, j] + np.uint64(1))
    return key.astype(np.int64)


def similarities(a: pa.Array, b: pa.Array, words: int = WORDS) -> np.ndarray:
    """The weighted Jaccard index of each pair of texts; 0 if neither has words."""
    (ua, ta), (ub, tb) = units(a, words), units(b, words)
    pair = np.concatenate([ta, tb])
    key = mix(np.concatenate([ua, ub]) ^ mix(pair.astype(np.uint64) + _STEP))
    order = np.argsort(key)
    both = pair[order][1:][key[order][1:] == key[order][:-1]]
    shared = np.bincount(both, minlength=len(a)).astype(float)
    return shared / np.maximum(np.bincount(pair, minlength=len(a)) - shared, 1)


def _signed(nodes: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    schema = T.StructType([*[f for f in nodes.schema.fields if f.name != "text"], T.StructField("keys", T.ArrayType(T.LongType()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in batches:
            for at, end in slices(batch.column(batch.num_columns - 1), 2 << 20):
                part = batch.slice(at, end - at)
                kept, any_words = signatures(part.column(part.num_columns - 1), bands * rows, words)
                keys = band_keys(kept, bands)[any_words]
                ends = np.concatenate([[0], np.cumsum(any_words * bands)])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.reshape(-1)))], schema.names)

    return by_bytes(nodes).mapInArrow(sign, schema)


def _linked(pairs: DataFrame, held: DataFrame, threshold: float, words: int) -> DataFrame:
    """Those of the pairs (a, b) whose texts, in ``held`` by node, are similar enough."""
    pairs = staged(pairs.distinct(), "pairs")
    full = pairs.join(held.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(held.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in batches:
            for at, end in slices(batch.column(2), 2 << 20):
                part = batch.slice(at, end - at)
                good = similarities(part.column(2), part.column(3), words) >= threshold
                yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(good)) for i in (0, 1)], ["a", "b"])

    return staged(by_bytes(full.select("a", "b", "text_a", "text_b")).mapInArrow(check, pairs.select("a", "b").schema), "verified")


def _stars(buckets: DataFrame) -> DataFrame:
    """Pairs of each bucket's (key) central member with its others; members of one component already are left out."""
    centre = buckets.groupBy("key").agg(F.max(F.struct("shared", "node", "component")).alias("centre"))
    far = buckets.join(centre, "key").where(F.col("component") != F.col("centre.component"))
    return far.select(F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b"))


def _blocks(rest: DataFrame, drawn: DataFrame, block: int) -> DataFrame:
    """(key, i, j, centre, node, component, sketch): the sides of each bucket's blocks; members outside its largest class are centres, all are partners."""
    parts = rest.groupBy("key", "component").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("largest"), F.sum("n").alias("all"))
    rows = rest.join(sizes, "key").withColumn("outside", F.col("component") != F.col("largest.component"))
    rows = rows.withColumn("wide", F.ceil(F.col("all") / block)).withColumn("high", F.ceil((F.col("all") - F.col("largest.n")) / block))
    mark, spread = F.xxhash64("node"), F.transform
    centres = spread(F.sequence(F.lit(0), F.col("wide") - 1), lambda i: F.struct(F.lit(True).alias("centre"), i.cast("int").alias("i"), F.pmod(mark, F.col("high")).cast("int").alias("j")))
    partners = spread(F.sequence(F.lit(0), F.col("high") - 1), lambda j: F.struct(F.lit(False).alias("centre"), F.pmod(mark, F.col("wide")).cast("int").alias("i"), j.cast("int").alias("j")))
    placed = rows.select("key", "node", "component", F.explode(F.when(F.col("outside"), F.concat(centres, partners)).otherwise(partners)).alias("place"))
    return placed.select("key", "place.i", "place.j", "place.centre", "node", "component").join(drawn, "node").select("key", "i", "j", "centre", "node", "component", "sketch")


def sketches(texts: pa.Array, words: int = WORDS) -> np.ndarray:
    """A row of 64-bit words for each text: the number of its units, then the parities of their numbers in ``BITS`` cells."""
    out = np.zeros((len(texts), 1 + BITS // 64), np.uint64)
    for at in range(0, len(texts), 1024):
        unit, text = units(texts.slice(at, 1024), words)
        n = min(1024, len(texts) - at)
        cell = (mix(unit ^ _DART) % np.uint64(BITS)).astype(np.int64)
        odd = (np.bincount(text * BITS + cell, minlength=n * BITS) & 1).astype(np.uint8)
        out[at : at + n, 0] = np.bincount(text, minlength=n)
        out[at : at + n, 1:] = np.packbits(odd.reshape(n, BITS), axis=1).view(np.uint64)
    return out


def most_alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """No less than the similarity of each pair of sketched texts."""
    size_a, size_b = a[:, 0].astype(np.int64), b[:, 0].astype(np.int64)
    apart = np.maximum(np.bitwise_count(a[:, 1:] ^ b[:, 1:]).sum(1, dtype=np.int64), np.abs(size_a - size_b))
    return (size_a + size_b - apart) / np.maximum(size_a + size_b + apart, 1)


def _fixed(column: pa.Array) -> np.ndarray:
    """A binary column whose values have one length, a multiple of 8, as rows of 64-bit words."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(len(column), -1).view(np.uint64)


def alike(sides: pa.Table, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Rows (centre, partner) of one block and different components that may be similar enough; rows are sorted by block."""
    column = {n: sides.column(n).combine_chunks() for n in sides.column_names}
    column = {n: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for n, c in column.items()}
    place = np.stack([column[n].to_numpy().astype(np.int64) for n in ("key", "i", "j")])
    group = np.cumsum(np.append(False, (place[:, 1:] != place[:, :-1]).any(0)))
    centre = column["centre"].to_numpy(zero_copy_only=False).astype(bool)
    component, sketch = _fixed(column["component"]), _fixed(column["sketch"])
    a, b = np.flatnonzero(centre), np.flatnonzero(~centre)
    many_b = np.bincount(group[b], minlength=group[-1] + 1)
    first_b = np.cumsum(many_b) - many_b
    per = many_b[group[a]]  # a centre's pairs are those with all partners of its block
    ends, at, found = np.cumsum(per), 0, [(a[:0], b[:0])]
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 15), "right")))
        n = per[at:to]
        left = np.repeat(a[at:to], n)
        right = b[np.arange(len(left)) + np.repeat(first_b[group[a[at:to]]] - (np.cumsum(n) - n), n)]
        apart = (component[left] != component[right]).any(1)
        left, right = left[apart], right[apart]
        close = most_alike(sketch[left], sketch[right]) >= threshold
        found.append((left[close], right[close]))
        at = to
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _candidates(blocks: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes in different components that their sketches let be similar enough."""
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        held: list[pa.RecordBatch] = []

        def pairs(sides: pa.Table) -> pa.RecordBatch:
            left, right = alike(sides, threshold)
            return pa.RecordBatch.from_arrays([sides.column("node").take(pa.array(x)).combine_chunks() for x in (left, right)], schema.names)

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            place = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            new = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0))
            cut = int(new[-1]) + 1 if len(new) else 0  # the last block may go on in the next batch
            if not cut and len(held) > 1 and any(held[-2].column(i)[-1].as_py() != place[i, 0] for i in range(3)):
                cut = -1
            if cut:
                whole, held = [*held[:-1], *([batch.slice(0, cut)] if cut > 0 else [])], [batch.slice(cut) if cut > 0 else batch]
                yield pairs(pa.Table.from_batches(whole))
        if held:
            yield pairs(pa.Table.from_batches(held))

    dealt = by_bytes(blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"))
    found = dealt.mapInArrow(compare, schema)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _sketched(held: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, sketch) of the nodes, whose texts are in ``held``."""
    schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("sketch", T.BinaryType())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in batches:
            for at, end in slices(batch.column(1), 2 << 20):
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([row.tobytes() for row in sketches(part.column(1), words)], pa.binary())], schema.names)

    return by_bytes(held.join(nodes, "node", "left_semi").select("node", "text")).mapInArrow(sketch, schema)


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, with_node: bool = False) -> DataFrame:
    """The class of every row: id and class_id, the smallest id of the class.

    Equal texts are in one class, with null as the empty text. Texts without words are alike only if they are
    equal. Ids may be null or repeated; a class whose ids are all null has a null class_id. Other columns play
    no part. An empty table gives no rows.
    """
    text = F.coalesce(columns.named(text_col), F.lit(""))
    source = documents.select(columns.named(id_col).alias("id"), F.unhex(F.md5(text)).alias("node"), text.alias("text"))
    signed = staged(_signed(source, bands, rows, words), "signatures")
    nodes = signed.groupBy("node").agg(F.min("id").alias("id"), F.first("keys").alias("keys"))
    members = nodes.select("node", "keys", F.explode("keys").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = staged(members.select("node", "key").join(sizes, "key"), "buckets")
    # Candidates grow with the corpus, so that their list is never broadcast: the texts are shuffled once.
    # Copies are combined where they are read, so that no task gets all rows of one text.
    candidates = buckets.select("node").distinct().hint("merge")
    held = staged(source.groupBy("node").agg(F.first("text").alias("text")).join(candidates, "node", "left_semi"), "texts")
    shared = buckets.groupBy("node").agg(F.sum("size").alias("shared"))
    apart = buckets.join(shared, "node").withColumn("component", F.col("node"))
    named = components(_linked(_stars(apart), held, threshold, words))
    joined = buckets.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = joined.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    rest = staged(joined.join(split, "key", "left_semi").select("key", "node", "component"), "rest")
    drawn = staged(_sketched(held, rest.select("node").distinct(), words), "sketches")
    more = _linked(_candidates(_blocks(rest, drawn, block), threshold), held, threshold, words)
    for end in ("a", "b"):  # links between classes, by the classes' names
        more = more.join(named.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    merged = components(more).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    named = named.join(merged, "component", "left").select("node", F.coalesce("whole", "component").alias("component")).union(merged.join(named, "component", "left_anti").select("component", "whole"))

    class_of = nodes.select("node", "id").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = class_of.groupBy("component").agg(F.min("id").alias("class_id"))
    classes = class_of.select("node", "component").join(lowest, "component")
    return signed.select("id", "node").join(classes, "node").select(F.col("id").alias(id_col), "class_id", *(["node", "component"] if with_node else []))


def drop_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class of near-duplicates: that of the smallest id (null last), of its smallest text hash if that id repeats.

    Of rows equal in id and text any one stays. Other columns are kept, whatever their names; null texts are empty. An
    empty table gives no rows.
    """
    return _firsts(columns.numbered(documents), columns.place(documents, id_col), columns.place(documents, text_col), options).toDF(*documents.columns)


def _firsts(documents: DataFrame, id_col: str, text_col: str, options: dict) -> DataFrame:
    """``drop_near_duplicates`` of numbered columns, whose names are none of those added here."""
    node = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    classed = near_duplicates(documents, id_col, text_col, with_node=True, **options)
    first = classed.groupBy("component").agg(F.min(F.struct(F.col(id_col).isNull().alias("lacks"), F.col(id_col).alias("id"), F.col("node"))).alias("kept"))
    first = first.select(F.col("kept.id").alias("_kept_id"), F.col("kept.node").alias("_kept_node"))
    rows = documents.withColumn("_node", node)
    kept = rows.join(first, (F.col("_node") == F.col("_kept_node")) & F.col(id_col).eqNullSafe(F.col("_kept_id")), "left_semi")
    return kept.dropDuplicates(["_node"]).select(*documents.columns)
