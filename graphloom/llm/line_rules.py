"""Operator 9: quality rules with the frequency of lines across documents.

One pass over the texts gives each document's base figures and its distinct
normalised lines (lower case, white space alike) as hashes. Lines are counted
by distinct documents of each host; a line above its host's limit is
boilerplate. A document that loses more than ``DEPLETED`` of its words with
its boilerplate is rejected. The limit is a share of the host's documents; a
line of ``LEAST`` documents or fewer is never frequent, which says something only
on hosts of fewer than ``LEAST / SHARE`` documents: on a host of four or more, a
line that more than three of them have is boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import columns
from graphloom.llm.store import by_bytes, staged
from graphloom.llm.subwords import slices
from graphloom.llm.textkernel import hash_spans, mix, numbered, utf8, words

SHARE, LEAST, DEPLETED = 0.01, 3, 0.5
FEW_WORDS, REPEAT_PERCENT = 50, 50
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BASE = 0xD6E8FEB86659FD93
_INVERSE = np.uint64(pow(_BASE, -1, 2**64))


def _line_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of each line; a text has one line more than it has line feeds."""
    feeds = np.flatnonzero(raw == 10)
    text = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, feeds, "right") - 1])
    begin = np.concatenate([offsets[:-1], feeds + 1])
    order = np.lexsort((begin, text))
    begin, text = begin[order], text[order]
    end = np.append(begin[1:] - 1, 0)
    last = np.append(text[1:] != text[:-1], True)
    end[last] = offsets[1:][text[last]]
    return begin, end, text


def figures(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base figures of each text."""
    raw, offsets = utf8(texts)
    n = len(offsets) - 1
    begin, end, text = words(raw, offsets)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
    n_words = np.bincount(text, minlength=n)
    line, stop, of = _line_bounds(raw, offsets)
    filled = np.searchsorted(begin, stop) > np.searchsorted(begin, line)
    line, stop, of = line[filled], stop[filled], of[filled]
    again = numbered(hash_spans(raw, line, stop), of) > 0

    hashed = hash_spans(raw, begin, end)
    at = np.flatnonzero(text[2:] == text[:-2]) if len(text) > 2 else np.zeros(0, np.int64)
    window = mix(mix(mix(hashed[at]) + hashed[at + 1]) + hashed[at + 2]) ^ mix(text[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(window)
    same = window[order][1:] == window[order][:-1]
    twice = at[order[np.append(same, False) | np.append(False, same)]] if len(at) else at
    edge = np.zeros(len(text) + 4, np.int64)
    edge += np.bincount(twice, minlength=len(edge)) - np.bincount(twice + 3, minlength=len(edge))
    covered = np.cumsum(edge)[: len(text)] > 0
    return {
        "n_words": n_words,
        "word_chars": np.bincount(text, chars[end] - chars[begin], n).astype(np.int64),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.bincount(of, again, n).astype(np.int64),
        "n_repeat_words": np.bincount(text, covered, n).astype(np.int64),
    }


def normal_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, words, begin) of each line that has a word; the hash is of its lower-case words in their order."""
    raw, offsets = utf8(pc.utf8_lower(pc.fill_null(texts, "")))
    begin, end, _ = words(raw, offsets)
    hashed = hash_spans(raw, begin, end)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashed), _BASE, np.uint64)]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashed), _INVERSE, np.uint64)]))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * power[:-1])])
    line, stop, text = _line_bounds(raw, offsets)
    first, last = np.searchsorted(begin, line), np.searchsorted(begin, stop)
    filled = last > first
    first, last = first[filled], last[filled]
    return mix((upto[last] - upto[first]) * back[first] + (last - first).astype(np.uint64)), text[filled], last - first, np.flatnonzero(filled)


def _measured(documents: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """A row for each document, with a key of its own, its figures and its distinct lines (hash, words)."""
    source = documents.select(columns.named(id_col).alias("id"), F.coalesce(columns.named(host_col).cast("string"), F.lit("")).alias("host"), columns.named(text_col).alias("text"))
    line = T.StructType([T.StructField("hash", T.LongType()), T.StructField("words", T.LongType())])
    schema = T.StructType([T.StructField("key", T.LongType()), *source.schema.fields[:2], *[T.StructField(f, T.LongType()) for f in FIGURES], T.StructField("lines", T.ArrayType(line))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, end in slices(batch.column(2), 2 << 20):
                part = batch.slice(at, end - at)
                hashed, text, n, _ = normal_lines(part.column(2))
                mixed = mix(hashed ^ mix(text.astype(np.uint64) + np.uint64(1)))
                _, one, which = np.unique(mixed, return_index=True, return_inverse=True)
                total = np.bincount(which, n, len(one)).astype(np.int64)
                order = np.argsort(text[one], kind="stable")
                one, total = one[order], total[order]
                ends = np.concatenate([[0], np.cumsum(np.bincount(text[one], minlength=len(part)))])
                lines = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(hashed[one].astype(np.int64)), pa.array(total)], ["hash", "words"]))
                found = figures(part.column(2))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(key, key + len(part))), part.column(0), part.column(1), *[pa.array(found[f], pa.int64()) for f in FIGURES], lines], schema.names)
                key += len(part)

    return by_bytes(source).mapInArrow(measure, schema)


def frequent_lines(measured: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(host, hash) of the lines in more of the host's documents than its limit."""
    counts = measured.select("host", F.explode("lines").alias("line")).groupBy("host", F.col("line.hash").alias("hash")).agg(F.count("*").alias("documents")).where(F.col("documents") > least)
    hosts = measured.groupBy("host").agg(F.count("*").alias("size"))
    return counts.join(hosts, "host").where(F.col("documents") > F.col("size") * share).select("host", "hash")


def line_rules(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = SHARE, least: int = LEAST, depleted: float = DEPLETED) -> DataFrame:
    """A row for each row of ``documents``: id, base figures, words lost with frequent lines, base_failed, kept.

    A null text has no words and fails the base rules; rows with a null host are one host; repeated rows count
    as documents of their own; other columns play no part. An empty table gives no rows.
    """
    measured = staged(_measured(documents, id_col, text_col, host_col), "lines")
    frequent = staged(frequent_lines(measured, share, least), "frequent")
    lines = measured.select("key", "host", F.explode("lines").alias("line")).select("key", "host", "line.hash", "line.words")
    lost = lines.join(frequent, ["host", "hash"]).groupBy("key").agg(F.sum("words").alias("n_frequent_words"))
    joined = measured.drop("lines", "host").join(lost, "key", "left").withColumn("n_frequent_words", F.coalesce("n_frequent_words", F.lit(0)))
    failed = (F.col("n_words") < FEW_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    kept = ~failed & (F.col("n_frequent_words") <= depleted * F.col("n_words"))
    return joined.select(F.col("id").alias(id_col), *FIGURES, "n_frequent_words", failed.alias("base_failed"), kept.alias("kept"))


def remove_frequent_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``documents`` with each text less its frequent lines.

    Null texts stay null; ids may be null or repeat, as rows are told apart by id, host and text; a null host is one host. Other
    columns are kept, whatever their names. An empty table gives no rows.
    """
    plain, text = columns.numbered(documents), columns.place(documents, text_col)
    mark = F.struct(F.col(columns.place(documents, id_col)), F.coalesce(F.col(columns.place(documents, host_col)).cast("string"), F.lit("")), F.xxhash64(text))
    marked = plain.withColumn("mark", mark)
    measured = staged(_measured(marked.select("mark", text, columns.place(documents, host_col)), "mark", text, columns.place(documents, host_col)), "lines")
    lines = measured.select("id", "host", F.explode("lines").alias("line")).select("id", "host", "line.hash").distinct()
    gone = lines.join(frequent_lines(measured, share, least), ["host", "hash"]).groupBy("id").agg(F.collect_set("hash").alias("gone"))
    joined = marked.join(gone, F.col("mark").eqNullSafe(F.col("id")), "left").select(*plain.columns, "gone")
    names, at = plain.columns, documents.columns.index(text_col)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column(at), batch.column(batch.num_columns - 1)
            out = texts.to_pylist()
            for row in np.flatnonzero(pc.is_valid(gone).to_numpy(zero_copy_only=False)).tolist():
                hashed, _, _, which = normal_lines(texts.slice(row, 1))
                drop = set(which[np.isin(hashed.astype(np.int64), gone[row].values.to_numpy())].tolist())
                out[row] = "\n".join(line for i, line in enumerate(out[row].split("\n")) if i not in drop)
            yield pa.RecordBatch.from_arrays([pa.array(out, texts.type) if i == at else batch.column(i) for i in range(batch.num_columns - 1)], names)

    return by_bytes(joined).mapInArrow(strip, plain.schema).toDF(*documents.columns)


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS l
  FROM documents
), lines AS (
  SELECT doc_id, host, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS norm, line
  FROM (SELECT doc_id, host, unnest(l) AS line FROM base)
), filled AS (
  SELECT * FROM lines WHERE len(norm) > 0
), dup AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM filled GROUP BY doc_id
), per_doc AS (
  SELECT doc_id, host, norm, sum(len(norm)) AS words FROM filled GROUP BY ALL
), frequent AS (
  SELECT p.host, p.norm FROM per_doc p
  JOIN (SELECT host, count(*) AS size FROM base GROUP BY host) s USING (host)
  GROUP BY p.host, p.norm, s.size HAVING count(*) > 3 AND count(*) > s.size * 0.01::DOUBLE
), lost AS (
  SELECT p.doc_id, sum(p.words)::BIGINT AS n_frequent_words FROM per_doc p JOIN frequent USING (host, norm) GROUP BY p.doc_id
), windows AS (
  SELECT doc_id, i, w[i : i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT i + step)::BIGINT AS n_repeat_words
  FROM twice, (SELECT unnest([0, 1, 2]) AS step) GROUP BY doc_id
), figures AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_frequent_words, 0)::BIGINT AS n_frequent_words
  FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_frequent_words <= 0.5::DOUBLE * n_words AS kept
FROM figures
"""
