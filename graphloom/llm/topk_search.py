"""Operator 3: exact top-k search, a term at a time.

Rows are sparse: term numbers and whole-number weights. A task turns a block of
rows into postings, takes the terms one after another, and scatters each
query's weight times the posting's weights into a dense array of scores, which
fits the processor's cache. The best k of a block are selected by partition and
merged over blocks and tasks. Queries are sent in blocks of ``QUERY_BLOCK``, a
pass over the corpus for each, so that what is broadcast has a fixed bound.
Ties go to the smaller id. Rows that share an id are one item, which scores as
the best of them, whether they are asked for or found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.store import new_path

QUERY_BLOCK, QUERIES_AT_ONCE, ROWS_AT_ONCE = 8192, 128, 1024


class Postings:
    """Rows by term: for each term the rows that have it, and their weights."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        order = np.lexsort((row, term))
        self.row, self.weight = row[order], weight[order]
        self.terms, first = np.unique(term[order], return_index=True)
        self.bounds = np.append(first, len(row))

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i, term in enumerate(self.terms.tolist()):
            part = slice(self.bounds[i], self.bounds[i + 1])
            yield term, self.row[part], self.weight[part]


def accumulate(queries: Postings, n_queries: int, rows: Postings, n_rows: int) -> np.ndarray:
    """Inner products of all queries with all rows."""
    scores = np.zeros((n_queries, n_rows), np.int64)
    of = {term: (q, w) for term, q, w in queries}
    for term, row, weight in rows:
        if term in of:
            q, w = of[term]
            if len(row) == n_rows and len(q) == n_queries:
                scores += w[:, None] * weight[None, :]
            else:
                scores[np.ix_(q, row)] += w[:, None] * weight[None, :]
    return scores


def best_of(scores: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k best rows but its own; ``ids`` ascend."""
    if len(ids) and (first := np.append(True, ids[1:] != ids[:-1])).sum() < len(ids):
        scores, ids = np.maximum.reduceat(scores, np.flatnonzero(first), axis=1), ids[first]
    own = query_ids[:, None] == ids[None, :]
    lowest = -(2**62)
    scores = np.where(own, lowest, scores)
    if scores.shape[1] > k:
        bar = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        query, column = np.nonzero((scores >= bar[:, None]) & ~own)
    else:
        query, column = np.nonzero(~own)
    return first_of(query_ids[query], ids[column], scores[query, column], k)


def first_of(query: np.ndarray, row_id: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, an id counting once."""
    order = np.lexsort((-value, row_id, query))
    query, row_id, value = query[order], row_id[order], value[order]
    once = np.append(True, (query[1:] != query[:-1]) | (row_id[1:] != row_id[:-1]))[: len(query)]
    query, row_id, value = query[once], row_id[once], value[once]
    order = np.lexsort((row_id, -value, query))
    query, row_id, value = query[order], row_id[order], value[order]
    begin = np.maximum.accumulate(np.where(np.append(True, query[1:] != query[:-1])[: len(query)], np.arange(len(query)), 0))
    keep = np.arange(len(query)) - begin < k
    return query[keep], row_id[keep], value[keep]


def _sparse(terms: list, weights: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = [len(t) for t in terms]
    flat = lambda x: np.concatenate([np.asarray(v, np.int64) for v in x]) if x else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(n)), n), flat(terms), flat(weights)


def top_k(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """(query_id, rank, id, score) of each query's ``k`` highest inner products with ``rows``, its own id left out.

    Both frames have ``id_col`` (long), ``terms`` (array of int) and ``weights`` (array of long). Absent terms weigh 0,
    and rows that share no term with a query score 0 and count like others. A query with fewer other rows than ``k``
    gets all of them; no rows or no queries give none. Rows with a null id take no part; other columns play none.
    """
    rows, queries = rows.where(F.col(id_col).isNotNull()), queries.where(F.col(id_col).isNotNull())
    spark = rows.sparkSession
    asked = queries.count()
    blocks = max(1, -(-asked // (QUERY_BLOCK // 2)))
    path = new_path(spark, "topk")
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])
    for block in range(blocks):
        held = queries.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == block).select(id_col, "terms", "weights").orderBy(id_col).collect()
        sent = spark.sparkContext.broadcast(([r[0] for r in held], *_sparse([r[1] for r in held], [r[2] for r in held])))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, row, term, weight = sent.value
            names = np.array(names, np.int64)
            groups = []
            for at in range(0, len(names), QUERIES_AT_ONCE):
                own = (row >= at) & (row < at + QUERIES_AT_ONCE)
                groups.append((names[at : at + QUERIES_AT_ONCE], Postings(row[own] - at, term[own], weight[own])))
            best = [[np.zeros(0, np.int64)] * 3 for _ in groups]
            for batch in batches:
                for at in range(0, len(batch), ROWS_AT_ONCE):
                    part = batch.slice(at, ROWS_AT_ONCE)
                    part = part.take(pa.compute.sort_indices(part.column(0)))
                    ids, terms = part.column(0).to_numpy(), part.column(1)
                    n = np.diff(terms.offsets.to_numpy())
                    postings = Postings(np.repeat(np.arange(len(ids)), n), terms.flatten().to_numpy().astype(np.int64), part.column(2).flatten().to_numpy())
                    for i, (query_ids, query) in enumerate(groups):
                        new = best_of(accumulate(query, len(query_ids), postings, len(ids)), ids, query_ids, k)
                        best[i] = list(first_of(*(np.concatenate(pair) for pair in zip(best[i], new, strict=True)), k))
            for query, row_id, value in best:
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(row_id), pa.array(value)], schema.names)

        if held:
            rows.select(id_col, "terms", "weights").mapInArrow(search, schema).write.mode("append").parquet(path)
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = spark.read.schema(schema).parquet(path).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def whole_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Dense vectors as sparse rows of floor(scale * x); vectors that are null or hold null, NaN or infinity are left out."""
    whole = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.col(id_col).isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    weights = F.transform("v", lambda x: F.floor(x * scale).cast("long"))
    numbered = F.filter(F.transform(weights, lambda w, i: F.struct(i.alias("t"), w.alias("w"))), lambda s: s["w"] != 0)
    return embeddings.select(F.col(id_col).cast("long").alias("id"), whole.alias("v")).where(good).select("id", numbered.alias("s")).select("id", F.col("s.t").alias("terms"), F.col("s.w").alias("weights"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         max(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
  GROUP BY q.vec_id, c.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
