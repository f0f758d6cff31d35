"""Operator 10: quality by votes of nearest labelled texts in a latent-semantic space.

A text's terms are hashed words (lower case), hashed trigrams of its characters'
kinds (runs of letters or digits count once, each symbol is a kind of its own)
and how much of it repeats; words and trigrams have shares of their own.
The space is the leading right singular vectors of the labelled sample's
weighted term matrix. The labelled vectors are at most ``SAMPLE`` rows, however
large the corpus is, so they are broadcast; every document's cosine with all of
them is computed in blocks, and its nearest neighbours vote with weights that
grow with similarity and undo the sample's stratification.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import columns
from graphloom.llm.line_rules import figures
from graphloom.llm.store import by_bytes
from graphloom.llm.subwords import forget_encoders, slices
from graphloom.llm.textkernel import hash_spans, mix, numbered, utf8, words

#: Labelled rows that are used at most, half of each label; dimensions; neighbours; the power of a similarity.
SAMPLE, DIMENSIONS, NEIGHBOURS, POWER = 4096, 32, 25, 8
#: What all words of a text weigh, against 1 for all its trigrams.
WORD_WEIGHT = 0.1
ACCEPT = 0.7
HASHED, WORDS, REPEATS = 4096, 8192, 4
TERMS = HASHED + WORDS + REPEATS
_KIND = np.zeros(256, np.uint8)
for _code in range(256):
    _char = chr(_code)
    _KIND[_code] = 1 if "a" <= _char <= "z" or _code >= 128 else 2 if "A" <= _char <= "Z" else 3 if "0" <= _char <= "9" else 4 if _code <= 32 and _char != "\n" else 5 + _code % 59


def term_shares(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, share) of every term of every text; a text's trigrams have shares that add up to 1, its words to ``WORD_WEIGHT``."""
    raw, offsets = utf8(texts)
    n = len(offsets) - 1
    kind = _KIND[raw]
    text = np.repeat(np.arange(n), np.diff(offsets))
    change = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] > 4) | (text[1:] != text[:-1]))[: len(kind)]
    kind, text = kind[change].astype(np.uint64), text[change]
    whole = np.flatnonzero(text[2:] == text[:-2]) if len(text) > 2 else np.zeros(0, np.int64)
    term = (mix(kind[whole] + kind[whole + 1] * np.uint64(64) + kind[whole + 2] * np.uint64(4096)) % np.uint64(HASHED)).astype(np.int64)
    keys, counts = np.unique(text[whole] * HASHED + term, return_counts=True)
    of, term = np.divmod(keys, HASHED)
    share = counts / np.bincount(text[whole], minlength=n)[of]

    low, low_offsets = utf8(pc.utf8_lower(pc.fill_null(texts, "")))
    begin, end, owner = words(low, low_offsets)
    keys, counts = np.unique(owner * WORDS + (hash_spans(low, begin, end) % np.uint64(WORDS)).astype(np.int64), return_counts=True)
    of_word, word = np.divmod(keys, WORDS)
    word_share = WORD_WEIGHT * counts / np.maximum(np.bincount(owner, minlength=n), 1)[of_word]
    begin, end, owner = words(raw, offsets)
    hashed = hash_spans(raw, begin, end)
    n_words = np.maximum(np.bincount(owner, minlength=n), 1)
    doubled = np.append(False, (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1]))[: len(hashed)]
    found = figures(texts)
    repeats = [
        np.bincount(owner, doubled, n) / n_words,
        found["n_repeat_words"] / n_words,
        found["n_dup_lines"] / n_words,
        np.bincount(owner, numbered(hashed, owner) == 0, n) / n_words,
    ]
    rows = np.arange(n)
    return np.concatenate([of, of_word, *[rows] * REPEATS]), np.concatenate([term, HASHED + word, *[np.full(n, HASHED + WORDS + i) for i in range(REPEATS)]]), np.concatenate([share, word_share, *repeats])


def term_matrix(texts: pa.Array) -> np.ndarray:
    of, term, share = term_shares(texts)
    out = np.zeros((len(texts), TERMS), np.float32)
    out[of, term] = np.sqrt(share)
    return out


@dataclass
class Model:
    """What a score needs: at most ``SAMPLE`` labelled vectors, and the projection into their space."""

    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray

    def embed(self, terms: np.ndarray) -> np.ndarray:
        out = terms @ self.project
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def score(self, texts: pa.Array, block: int = 512) -> np.ndarray:
        """Weighted share of label 1 among the nearest neighbours; 0 for a text without terms or a model without rows."""
        out = np.zeros(len(texts))
        if not len(self.vectors):
            return out
        for at in range(0, len(texts), block):
            near = self.embed(term_matrix(texts.slice(at, block))) @ self.vectors.T
            k = min(NEIGHBOURS, near.shape[1])
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64) ** POWER * self.weights[best]
            total = vote.sum(1)
            out[at : at + block] = np.where(total > 0, (vote * self.labels[best]).sum(1) / np.where(total > 0, total, 1), 0)
        return np.clip(out, 0, 1)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> Model:
    """The model of a labelled sample: of each label the ``sample`` / 2 rows whose ids hash lowest.

    Rows that ``held_out`` names are never used. If an id is labelled more than once, the lowest label counts; null
    labels do not; a labelled id without a document gives no row.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.min(label_col).alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = [known.where(F.col("label") == label).orderBy(F.xxhash64(id_col), id_col).limit(sample // 2) for label in (0, 1)]
    sampled = chosen[0].union(chosen[1]).withColumnRenamed(id_col, "label_id")
    texts = documents.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(sampled), "label_id")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                matrix = term_matrix(part.column(2))
                rows, columns = np.nonzero(matrix)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(part)))]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(ends, pa.array(columns, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(matrix[rows, columns]))], ["label_id", "label", "term", "weight"])

    schema = T.StructType([T.StructField("label_id", documents.schema[id_col].dataType), T.StructField("label", known.schema["label"].dataType), T.StructField("term", T.ArrayType(T.IntegerType())), T.StructField("weight", T.ArrayType(T.FloatType()))])
    found = by_bytes(texts.select("label_id", "label", "text")).mapInArrow(terms, schema).dropDuplicates(["label_id"]).orderBy("label_id").limit(sample).toArrow()
    y, n = found.column("label").to_numpy().astype(np.float64), len(found)
    if not n:
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, y)
    ends = np.concatenate([[0], np.cumsum(np.concatenate([c.value_lengths().to_numpy() for c in found.column("term").chunks]))])
    term, weight = (np.concatenate([c.flatten().to_numpy() for c in found.column(name).chunks]) for name in ("term", "weight"))
    idf = (np.log((1 + n) / (1 + np.bincount(term[weight > 0], minlength=TERMS))) + 1).astype(np.float32)
    weight = weight * idf[term]

    def blocks(size: int = 256) -> Iterator[np.ndarray]:
        """The sample's matrix, some rows at a time: whole it has 200 MB."""
        for at in range(0, n, size):
            own = ends[at : at + size + 1]
            out = np.zeros((len(own) - 1, TERMS), np.float32)
            out[np.repeat(np.arange(len(out)), np.diff(own)), term[own[0] : own[-1]]] = weight[own[0] : own[-1]]
            yield out

    def turned(basis: np.ndarray) -> np.ndarray:
        """The matrix's transpose times itself times the basis."""
        return sum((block.T @ (block @ basis) for block in blocks()), np.zeros_like(basis))

    basis = turned(np.random.default_rng(0).standard_normal((TERMS, min(TERMS, dimensions + 16)), np.float32))
    for _ in range(4):  # subspace iteration: the range of the leading singular vectors
        basis = turned(np.linalg.qr(basis)[0])
    basis = np.linalg.qr(basis)[0]
    placed = np.concatenate([block @ basis for block in blocks()])
    leading = (basis @ np.linalg.svd(placed, full_matrices=False)[2].T)[:, :dimensions]
    vectors = np.concatenate([block @ leading for block in blocks()])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    used = {label: max(1, int((y == label).sum())) for label in (0, 1)}
    model = Model((leading * idf[:, None]).astype(np.float32), vectors.astype(np.float32), y, np.array([sizes[label] / used[label] for label in y]))
    return model


def score(documents: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``documents`` with a score (0 to 1) in ``score_col``; null texts are empty ones and score 0.

    Other columns are kept, whatever their names. Neighbours that tie for the last places are taken in any order.
    """
    plain = columns.numbered(documents)
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])
    at = documents.columns.index(text_col)
    packed = io.BytesIO()
    np.savez(packed, project=model.project, vectors=model.vectors, labels=model.labels, weights=model.weights)
    sent = documents.sparkSession.sparkContext.broadcast(packed.getvalue())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        own = Model(**np.load(io.BytesIO(sent.value)))
        for batch in batches:
            for begin, end in slices(batch.column(at), 2 << 20):
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.score(part.column(at)))], schema.names)

    return by_bytes(plain).mapInArrow(apply, schema).toDF(*documents.columns, score_col)


def classify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """A row for each row of ``documents``: id, held_out, score, predicted. Other columns play no part."""
    scored = score(documents.select(F.col(id_col), F.col(text_col)), model, text_col)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
