"""Operator 2: substring deduplication by runs of sentences.

Texts are cut into sentences, and those at clause marks: a piece ends with a
stop, comma, colon or semicolon and the white space after it, with a line, or
with the text. From each piece on, the shortest run of ``RUN`` pieces or more
with ``LEAST_WORDS`` words or more is hashed; the hashes are joined over the
whole corpus. The first occurrence of a run, by id, then text, then place,
stays; pieces that any other occurrence covers are removed. Upper and lower case
and outer white space do not tell two pieces apart. Pieces are cut that small so
that a passage which begins and ends within sentences still holds a whole run;
the number of words keeps short lines that many texts share from being runs.

The first occurrence is a partial aggregate, so that a run of a third of all
rows is one row a task after it; the join with it is left to adaptive execution,
which broadcasts a small side and splits a hot run's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.columns import numbered, place
from graphloom.llm.store import by_bytes, staged
from graphloom.llm.subwords import forget_encoders, slices
from graphloom.llm.textkernel import hash_spans, mix, runs, utf8, words

RUN, LEAST_WORDS = 2, 20
PIECE = r"(?s).+?(?:[.!?,:;][ \t\r\n]+|\n[ \t\r\n]*|\z)"
_BLANK, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True
_STOP[list(b".!?,:;")] = True
_BASE = 0xB5AD4ECEDA1CE2A9
_INVERSE = np.uint64(pow(_BASE, -1, 2**64))


def piece_begins(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, text) of the pieces that ``PIECE`` finds, on bytes: each goes on to the next one or to the text's end."""
    blank = _BLANK[raw]
    first, last = runs(blank, offsets)
    text = np.searchsorted(offsets, first, "right") - 1
    feeds = np.concatenate([[0], np.cumsum(raw == 10)])
    leading = first == offsets[text]
    fed = feeds[last] > feeds[first + leading]  # a piece begins with one character at least
    stopped = ~leading & _STOP[raw[np.maximum(first - 1, 0)]]
    breaks = (fed | stopped) & (last < offsets[text + 1])
    first, last, text, fed = first[breaks], last[breaks], text[breaks], fed[breaks]
    before = np.where(np.append(True, text[1:] != text[:-1])[: len(text)], offsets[text], np.append(0, last[:-1])[: len(text)])
    if (lone := (before == first - 1) & ~fed).any():  # a stop that is the first character ends nothing
        keep, at = np.ones(len(text), bool), -1
        bad = np.isin(text, text[lone])
        for i in np.flatnonzero(bad).tolist():
            begin = last[at] if at >= 0 and text[at] == text[i] else offsets[text[i]]
            if begin == first[i] - 1 and not fed[i]:
                keep[i] = False
            else:
                at = i
        first, last, text = first[keep], last[keep], text[keep]
    filled = np.flatnonzero(np.diff(offsets) > 0)
    begin = np.concatenate([offsets[filled], last])
    of = np.concatenate([filled, text])
    order = np.argsort(begin, kind="stable")
    return begin[order], of[order]


def piece_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of the pieces without outer white space."""
    begin, of = piece_begins(raw, offsets)
    blank = _BLANK[raw]
    inner = np.searchsorted(_visible := np.flatnonzero(~blank), np.append(begin[1:], len(raw))[: len(begin)]) - 1
    stop = np.minimum(np.append(begin[1:], len(raw))[: len(begin)], offsets[of + 1])
    end = np.where(inner >= 0, _visible[np.maximum(inner, 0)] + 1, begin) if len(_visible) else begin
    head = np.searchsorted(_visible, begin)
    start = np.where(head < len(_visible), _visible[np.minimum(head, max(len(_visible) - 1, 0))], stop) if len(_visible) else stop
    start = np.minimum(start, stop)
    return start, np.maximum(np.minimum(end, stop), start), of


def run_ends(of: np.ndarray, n_words: np.ndarray, run: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first piece, piece after the last) of each run; pieces are given by their text and their number of words."""
    upto = np.concatenate([[0], np.cumsum(n_words)])
    end = np.maximum(np.searchsorted(upto, upto[:-1] + least_words), np.arange(len(of)) + run)
    whole = end <= np.searchsorted(of, of, "right")
    return np.flatnonzero(whole), end[whole]


def _over(hashed: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash for each run of hashes."""
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashed), _BASE, np.uint64)]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashed), _INVERSE, np.uint64)]))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * power[:-1])])
    return mix((upto[end] - upto[begin]) * back[begin] + (end - begin).astype(np.uint64))


def _runs(documents: DataFrame, id_col: str, text_col: str, run: int, least_words: int) -> DataFrame:
    """(id, text_hash, place, last, h1, h2) of each run: where its first and last piece stand, and two hashes of its lower-case pieces."""
    source = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    schema = T.StructType([*source.schema.fields[:2], *[T.StructField(n, T.IntegerType()) for n in ("place", "last")], T.StructField("h1", T.LongType()), T.StructField("h2", T.IntegerType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in batches:
            for at, end in slices(batch.column(2), 2 << 20):
                part = batch.slice(at, end - at)
                raw, offsets = utf8(pc.utf8_lower(pc.fill_null(part.column(2), "")))
                start, stop, of = piece_bounds(raw, offsets)
                word = words(raw, offsets)[0]
                first, after = run_ends(of, np.searchsorted(word, stop) - np.searchsorted(word, start), run, least_words)
                hashed = hash_spans(raw, start, stop)
                h1, h2 = _over(hashed, first, after), _over(mix(hashed ^ np.uint64(0x5851F42D4C957F2D)), first, after)
                text = of[first]
                head = np.searchsorted(of, text)
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(first - head, pa.int32()), pa.array(after - 1 - head, pa.int32()), pa.array(h1.view(np.int64)), pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32))], schema.names)

    return by_bytes(source).mapInArrow(find, schema)


def repeated_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, text_hash, runs): for each document with any, the first and last places of its runs that occurred before."""
    all_runs = _runs(documents, id_col, text_col, run, least_words)
    firsts = all_runs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "text_hash", "place")).alias("first")).where("n > 1")
    firsts = staged(firsts.select("h1", "h2", "first"), "firsts")
    later = all_runs.join(firsts, ["h1", "h2"]).where(~F.struct("id", "text_hash", "place").eqNullSafe(F.col("first")))
    return later.groupBy("id", "text_hash").agg(F.collect_set(F.struct("place", "last")).alias("runs"))


def _without(texts: pa.Array, gone: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts less the pieces of their runs in ``gone`` (lists of first and last places, or null), and how many pieces that are."""
    raw, offsets = utf8(texts)
    begin, of = piece_begins(raw, offsets)
    first = np.searchsorted(begin, offsets[:-1])
    head, listed = first[pc.list_parent_indices(gone).to_numpy()], gone.flatten()
    place, last = (head + listed.field(i).to_numpy() for i in (0, 1))
    edge = np.bincount(place, minlength=len(begin) + 1) - np.bincount(last + 1, minlength=len(begin) + 1)
    drop = np.cumsum(edge)[: len(begin)] > 0
    left = np.repeat(~drop, np.diff(np.append(begin, len(raw))))
    size = np.concatenate([[0], np.cumsum(left)])[offsets]
    out = pa.StringArray.from_buffers(len(texts), pa.py_buffer(size.astype(np.int32)), pa.py_buffer(raw[left].tobytes()))
    return pc.if_else(pc.is_valid(gone), out, texts), np.bincount(of, drop, len(texts)).astype(np.int64)


def drop_repeated_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, least_words: int = LEAST_WORDS, removed_col: str | None = None) -> DataFrame:
    """``documents`` with each text less its repeated pieces, and the number of those in ``removed_col`` on request.

    Every row stays, also one whose text becomes empty; null texts stay null; texts of fewer pieces than ``run`` or
    of fewer words than ``least_words`` have no runs and stay as they are. Rows equal in id and text are one
    document: they are changed alike. A null id comes before all others. Other columns are kept, whatever their names.
    """
    left = _dropped(numbered(documents), place(documents, id_col), place(documents, text_col), run, least_words, "removed" if removed_col else None)
    return left.toDF(*documents.columns, *([removed_col] if removed_col else []))


def _dropped(documents: DataFrame, id_col: str, text_col: str, run: int, least_words: int, removed_col: str | None) -> DataFrame:
    """``drop_repeated_spans`` of numbered columns, whose names are none of those added here."""
    found = repeated_runs(documents, id_col, text_col, run, least_words).select(F.col("id").alias("_span_id"), F.col("text_hash").alias("_span_hash"), F.col("runs").alias("_span_runs"))
    joined = documents.join(found, F.col(id_col).eqNullSafe(F.col("_span_id")) & (F.xxhash64(text_col) == F.col("_span_hash")), "left")
    at, n = documents.columns.index(text_col), len(documents.columns)
    schema = T.StructType([*documents.schema.fields, *([T.StructField(removed_col, T.LongType())] if removed_col else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in batches:
            for begin, end in slices(batch.column(at), 2 << 20):
                part = batch.slice(begin, end - begin)
                columns, removed = list(part.columns[:n]), np.zeros(len(part), np.int64)
                if part.column(n).null_count < len(part):
                    columns[at], removed = _without(columns[at].cast(pa.string()), part.column(n))
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(removed)] if removed_col else [])], schema.names)

    return by_bytes(joined.select(*documents.columns, "_span_runs")).mapInArrow(cut, schema)


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '(?s).+?(?:[.!?,:;][ \t\r\n]+|\n[ \t\r\n]*|\z)') AS s FROM documents
), normal AS (
  SELECT doc_id, text, s, list_transform(s, lambda x: lower(trim(x, chr(32) || chr(9) || chr(13) || chr(10)))) AS k FROM pieces
), counted AS (
  SELECT doc_id, k, unnest(range(1, len(k) + 1)) AS place, unnest(list_transform(k, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))) AS n FROM normal
), added AS (
  SELECT doc_id, k, place, n, sum(n) OVER (PARTITION BY doc_id ORDER BY place) AS upto FROM counted
), listed AS (
  SELECT doc_id, list(upto ORDER BY place) AS sums FROM added GROUP BY doc_id
), ends AS (
  SELECT doc_id, k, place, greatest(place + 1, len(list_filter(sums, lambda x: x < upto - n + 20)) + 1) AS last FROM added JOIN listed USING (doc_id)
), ranked AS (
  SELECT doc_id, place, last, row_number() OVER (PARTITION BY k[place : last] ORDER BY doc_id, place) AS nth FROM ends WHERE last <= len(k)
), covered AS (
  SELECT doc_id, list(DISTINCT place) AS places
  FROM (SELECT doc_id, unnest(range(place, last + 1)) AS place FROM ranked WHERE nth > 1) GROUP BY doc_id
)
SELECT n.doc_id,
       CASE WHEN c.places IS NULL THEN n.text
            ELSE array_to_string(list_filter(n.s, lambda x, i: NOT list_contains(c.places, i)), '') END AS text,
       coalesce(len(c.places), 0)::BIGINT AS n_removed
FROM normal n LEFT JOIN covered c USING (doc_id)
"""
