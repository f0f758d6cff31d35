"""Texts as passages, tokens and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STOPS = r"[.!?]+\s+|[.!?]+$|\n[ \t]*\n"


def pack_lines(texts: DataFrame, id_col: str, text_col: str, max_tokens: int = 480) -> DataFrame:
    """(id, passage, n_words, text): non-blank lines, stripped, packed in order while their words fit ``max_tokens``.

    A line that would overflow begins a new passage; a line longer than the limit has one of its own. Null texts have
    no passages. The fold runs within a row: no shuffle.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text_col, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")
    start = F.struct(F.array().cast("array<struct<n:int,t:string>>").alias("done"), F.lit(0).alias("n"), F.lit("").alias("t"))

    def add(state: Column, line: Column) -> Column:
        words = F.size(F.split(line, r"\s+"))
        full = (state["n"] > 0) & (state["n"] + words > max_tokens)
        closed = F.struct(F.array_append(state["done"], F.struct(state["n"].alias("n"), state["t"].alias("t"))).alias("done"), words.alias("n"), line.alias("t"))
        longer = F.struct(state["done"].alias("done"), (state["n"] + words).alias("n"), F.when(state["n"] == 0, line).otherwise(F.concat(state["t"], F.lit("\n"), line)).alias("t"))
        return F.when(full, closed).otherwise(longer)

    def close(state: Column) -> Column:
        return F.when(state["n"] > 0, F.array_append(state["done"], F.struct(state["n"].alias("n"), state["t"].alias("t")))).otherwise(state["done"])

    packed = texts.select(id_col, F.posexplode(F.aggregate(lines, start, add, close)).alias("passage", "p"))
    return packed.select(id_col, "passage", F.col("p.n").alias("n_words"), F.col("p.t").alias("text"))


def word_tokens(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, token, start): words between white space, and where they begin."""
    found = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(r"\s*\S+"), F.lit(0))
    starts = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,token:string>>").alias("out")), _token, lambda s: s["out"])
    return texts.select(id_col, F.posexplode(starts).alias("pos", "t")).select(id_col, "pos", F.col("t.token").alias("token"), F.col("t.start").alias("start"))


def _token(state: Column, piece: Column) -> Column:
    token = F.regexp_extract(piece, r"\S+", 0)
    start = state["at"] + F.length(piece) - F.length(token)
    return F.struct((state["at"] + F.length(piece)).alias("at"), F.array_append(state["out"], F.struct(start.alias("start"), token.alias("token"))).alias("out"))


def sentence_breaks(text: Column) -> Column:
    """Where sentences end: the last stop before white space or the end, and blank lines; and the end of the text."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).*?(?:{_STOPS}|\z)"), F.lit(0))
    upto = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), _break, lambda s: s["out"])
    return F.array_sort(F.array_distinct(F.concat(upto, F.array(F.length(text)))))


def _break(state: Column, piece: Column) -> Column:
    stopped = F.length(F.regexp_replace(piece, r"\s+$", ""))
    end = state["at"] + F.when(piece.rlike(r"(?s)\n[ \t]*\n$") & ~piece.rlike(r"(?s)[.!?]\s+$"), stopped).otherwise(stopped - 1)
    return F.struct((state["at"] + F.length(piece)).alias("at"), F.when(F.length(piece) > 0, F.array_append(state["out"], end.cast("int"))).otherwise(state["out"]).alias("out"))


def sentence_ids(tokens: DataFrame, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``tokens`` (id, pos, token, start) with sentence_id, the number of sentence ends before the token."""
    ends = texts.select(id_col, sentence_breaks(F.col(text_col)).alias("_breaks"))
    return tokens.join(ends, id_col).withColumn("sentence_id", F.size(F.filter("_breaks", lambda b: b < F.col("start")))).drop("_breaks")


def equal_blocks(sizes: DataFrame, id_col: str, n_col: str, per_block: int = 48) -> DataFrame:
    """(id, pos, block): positions 0 to n - 1 in ceil(n / per_block) blocks with bounds at floor(i n / blocks)."""
    blocks = F.ceil(F.col(n_col) / per_block).cast("long")
    listed = sizes.where(F.col(n_col) > 0).select(id_col, F.col(n_col).alias("_n"), blocks.alias("_k"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_col) - 1)).alias("pos"))
    return listed.select(id_col, "pos", (F.floor(((F.col("pos") + 1) * F.col("_k") - 1) / F.col("_n"))).cast("int").alias("block"))


def blocks_of_lengths(lengths: DataFrame, id_col: str, lengths_col: str) -> DataFrame:
    """(id, pos, block) for explicit block lengths."""
    listed = lengths.select(id_col, F.posexplode(lengths_col).alias("block", "_n"), F.col(lengths_col).alias("_all"))
    first = F.aggregate(F.slice("_all", 1, F.col("block")), F.lit(0).cast("long"), lambda a, v: a + v)
    return listed.where("_n > 0").select(id_col, "block", F.explode(F.sequence(first, first + F.col("_n") - 1)).alias("pos")).select(id_col, "pos", "block")
