"""Operator 7: token ids as Simple-8b files.

A word of 64 bits holds a selector (4 bits) and as many ids of one width as
its 60 bits take. Ids are coded in blocks of ``BLOCK_IDS``, and a file keeps
the place of each block's first word: all blocks are coded, and decoded, side
by side. An id of 60 bits or more is an escape: its word holds a place in the
list of such ids at the file's end.

A file is: ``MAGIC``, ids in a block (u32), numbers of ids, blocks, words and
escapes (u64), the blocks' first words (u64 each), words, escapes; all little
endian. Spark's own writer commits the files as rows of a table, so a lost
executor or a second attempt of a task leaves no half-written file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.store import by_bytes, new_path
from graphloom.llm.subwords import END_ID, encoder, slices, vocabulary_path, with_end

MAGIC, HEAD = b"GLS8", struct.Struct("<4sIQQQQ")
BLOCK_IDS, FILE_IDS = 1024, 1 << 20
#: Selector 0 is the escape; selector s holds COUNT[s] ids of WIDTH[s] bits.
COUNT = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def encode_file(ids: np.ndarray) -> bytes:
    """The file of an array of unsigned ids."""
    ids = np.asarray(ids, np.uint64)
    blocks = -(-len(ids) // BLOCK_IDS)
    held = np.zeros((blocks, BLOCK_IDS), np.uint64)
    held.reshape(-1)[: len(ids)] = ids
    top = int(held.max(initial=0))
    if top < 2**24:
        bits = np.frexp(held.astype(np.float32))[1].astype(np.int8)
    else:
        bits = np.frexp(held.astype(np.float64))[1].astype(np.int8)
        bits[held >= np.uint64(2**52)] = 60
        bits[held >= np.uint64(2**60)] = 64
    widest = int(bits.max(initial=0))
    always = int(np.flatnonzero(WIDTH[1:] >= widest)[0]) + 1 if widest <= 60 else len(COUNT)
    selector = np.full((blocks, BLOCK_IDS), always if widest <= 60 else 0, np.int8)
    place, back = np.arange(BLOCK_IDS, dtype=np.int16), np.ascontiguousarray(bits[:, ::-1])
    far = np.int16(2 * BLOCK_IDS)
    for s in range(always - 1, 0, -1):
        narrow = back <= WIDTH[s]
        if (np.count_nonzero(narrow) / max(narrow.size, 1)) ** COUNT[s] < 1e-3:  # too few places, if any, would use it
            continue
        if COUNT[s] == 1:
            selector[narrow[:, ::-1]] = s
            continue
        stop = np.minimum.accumulate(np.where(narrow, far, place[::-1]), axis=1)[:, ::-1]
        np.copyto(selector, np.int8(s), where=stop - place >= COUNT[s])
    at, steps = np.zeros(blocks, np.int64), []
    row = np.arange(blocks)
    length = np.full(blocks, BLOCK_IDS)
    if blocks:
        length[-1] = len(ids) - BLOCK_IDS * (blocks - 1)
    while (live := at < length).any():
        s = selector[row, np.minimum(at, BLOCK_IDS - 1)]
        steps.append((live, at, s))
        at = np.where(live, at + COUNT[s], at)
    if steps:
        live, start, chosen = (np.stack(x, 1) for x in zip(*steps, strict=True))
        words_in = live.sum(1)
        start, chosen = (start + BLOCK_IDS * row[:, None])[live], chosen[live]
    else:
        words_in, start, chosen = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)
    flat = np.concatenate([held.reshape(-1), np.zeros(64, np.uint64)])
    in_block = start % BLOCK_IDS
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen).tolist():
        of = np.flatnonzero(chosen == s)
        if s == 0:
            escapes = flat[start[of]]
            words[of] |= np.arange(len(of), dtype=np.uint64)
            continue
        for j in range(COUNT[s]):
            value = flat[start[of] + j]
            value[in_block[of] + j >= BLOCK_IDS] = 0  # past the block's end
            words[of] |= value << np.uint64(j * WIDTH[s])
    if not (chosen == 0).any():
        escapes = np.zeros(0, np.uint64)
    first = np.cumsum(words_in) - words_in
    return HEAD.pack(MAGIC, BLOCK_IDS, len(ids), blocks, len(words), len(escapes)) + first.astype("<u8").tobytes() + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()


def decode_file(data: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The ids of a file, or of its blocks from ``first_block`` to before ``last_block``."""
    magic, per, n, blocks, n_words, n_escapes = HEAD.unpack_from(data)
    if magic != MAGIC or len(data) != HEAD.size + 8 * (blocks + n_words + n_escapes):
        raise ValueError("not a whole file of coded ids")
    first = np.frombuffer(data, "<u8", blocks, HEAD.size).astype(np.int64)
    words = np.frombuffer(data, "<u8", n_words, HEAD.size + 8 * blocks)
    escapes = np.frombuffer(data, "<u8", n_escapes, HEAD.size + 8 * (blocks + n_words))
    last_block = blocks if last_block is None else min(last_block, blocks)
    if first_block >= last_block:
        return np.zeros(0, np.uint64)
    bounds = np.append(first, n_words)[first_block : last_block + 1]
    words = words[bounds[0] : bounds[-1]]
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNT[selector]
    upto = np.cumsum(count)
    block = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    begins = np.concatenate([[0], upto])[bounds[:-1] - bounds[0]]
    place = upto - count - begins[block] + per * block  # a block's last word may have places past its end
    total = min(n, per * last_block) - per * first_block
    out = np.zeros(per * (last_block - first_block) + 64, np.uint64)
    stop = np.minimum(per * (block + 1), total)
    for s in np.unique(selector).tolist():
        of = np.flatnonzero(selector == s)
        payload = words[of] & np.uint64(2**60 - 1)
        if s == 0:
            out[place[of]] = escapes[payload.astype(np.int64)]
            continue
        for j in range(COUNT[s]):
            value = (payload >> np.uint64(j * WIDTH[s])) & np.uint64(2 ** int(WIDTH[s]) - 1)
            inside = place[of] + j < stop[of]
            out[place[of][inside] + j] = value[inside]
    return out[:total]


def write_ids(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, vocabulary: str | None = None, end_id: int = END_ID) -> str:
    """Write all documents' ids, each with the end id, in ascending order of ``id_col``; returns the folder.

    Rows: part and file number, ids before the file in its part, the file, and its documents with their
    lengths. Null ids come first and equal ids in the order of their texts' hashes; a null text is an empty one;
    repeated rows are written as often as they occur; a document is never split over two files.
    """
    coded, path = vocabulary or vocabulary_path(), path or new_path(documents.sparkSession, "ids")
    id_type = documents.schema[id_col].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("file", T.IntegerType()), T.StructField("ids_before", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("document_ids", T.ArrayType(id_type)), T.StructField("lengths", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, file, before = encoder(coded), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal file, before, held
            names = pa.concat_arrays([x for x, _, _ in held])
            ids, counts = (np.concatenate([x[i] for x in held]) for i in (1, 2))
            ends = pa.array([0, len(names)], pa.int32())
            columns = [pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([encode_file(ids)], pa.binary()), pa.ListArray.from_arrays(ends, names), pa.array([encode_file(counts)], pa.binary())]
            file, before, held = file + 1, before + len(ids), []
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            for at, end in slices(batch.column(1)):
                ids, counts = with_end(*coder.encode(batch.column(1).slice(at, end - at)), end_id)
                held.append((batch.column(0).slice(at, end - at), ids, counts))
                if sum(len(x) for _, x, _ in held) >= FILE_IDS:
                    yield flush()
        if held:
            yield flush()

    order = F.xxhash64(text_col)  # the partitioner samples its keys on the driver: no texts
    ordered = documents.select(id_col, text_col).repartitionByRange(F.col(id_col), order).sortWithinPartitions(F.col(id_col), order)
    by_bytes(ordered).mapInArrow(encode, schema).write.option("compression", "zstd").parquet(path)
    return path


def read_ids(spark, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The documents of written files, decoded: id, start, n_tokens, ids_crc32, and their ids on request."""
    files = spark.read.parquet(path)
    sizes = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # a row for each part
    base, upto = {}, 0
    for part in sorted(sizes):
        base[part], upto = upto, upto + sizes[part]
    fields = [T.StructField(id_col, files.schema["document_ids"].dataType.elementType), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType(), False)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                part, before, data, names, counts = (batch.column(i).slice(row, 1) for i in range(5))
                ids, n = decode_file(data[0].as_py()), decode_file(counts[0].as_py()).astype(np.int64)
                ends = np.cumsum(n)
                raw = ids.astype("<u4")
                start = base[part[0].as_py()] + before[0].as_py() + ends - n
                columns = [names.flatten(), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array([zlib.crc32(raw[e - k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return by_bytes(files.select("part", "ids_before", "data", "document_ids", "lengths")).mapInArrow(decode, T.StructType(fields))
