"""Operator 5: shards by extendible hashing.

Rows hash to bits. A bucket is a prefix of bits; the directory, indexed by the
longest prefix in use, names the bucket of each prefix. A bucket that is larger
than the byte limit splits on its next bit, all others stay. Sizes are summed
once by long prefixes, and the splits are worked out on those sums, which are
few; rows whose long prefix is still too large go another ``STEP`` bits deep.
DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.store import staged

MAX_BYTES = 32 << 20
BITS, STEP, SALTS = 60, 6, 1024


def _prefix(hashed: Column, depth: Column | int) -> Column:
    """The first ``depth`` of the hash's ``BITS`` bits, as a number."""
    return F.call_function("shiftright", hashed, (F.lit(BITS) - depth).cast("int"))


def _directory(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(bits, depth): for each prefix of ``high`` bits the depth of its bucket; null if it has to go deeper.

    A bucket is the shortest prefix, of ``low`` bits at least, whose rows fit the limit or are one row.
    """
    leaves = staged(rows.groupBy(_prefix(F.col("hashed"), high).alias("bits")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows")), "leaves")
    spread = leaves.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("prefix", F.call_function("shiftright", "bits", (F.lit(high) - F.col("depth")).cast("int")))
    fits = spread.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_rows").alias("n_rows")).where((F.col("n_bytes") <= limit) | (F.col("n_rows") == 1))
    found = spread.select("bits", "depth", "prefix").join(fits.select("depth", "prefix"), ["depth", "prefix"]).groupBy("bits").agg(F.min("depth").alias("depth"))
    return leaves.select("bits").join(found, "bits", "left")


def hash_bits(*keys: str) -> Column:
    """The first ``BITS`` bits of the MD5 of the keys as text, joined by bars; null keys are left out."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), 1, BITS // 4), 16, 10).cast("long")


def _pieces(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` (a stored table) whose equal hashes exceed the limit, with the piece of each: as many in each as fit, one at least.

    Ranks are counted in salted groups by the rows' places in their files, so that no hash is one task's work.
    """
    placed = rows.withColumn("salt", F.pmod(F.xxhash64("_metadata.file_path", "_metadata.row_index"), F.lit(SALTS))).withColumn("at", F.struct("_metadata.file_path", "_metadata.row_index"))
    groups = placed.groupBy("hashed", "salt").agg(F.count("*").alias("n"), F.max("n_bytes").alias("most"))
    whole = Window.partitionBy("hashed")  # SALTS rows at most
    groups = groups.select("hashed", "salt", (F.sum("n").over(whole.orderBy("salt")) - F.col("n")).alias("before"), F.greatest(F.lit(1), F.floor(F.lit(limit) / F.max("most").over(whole))).alias("per"))
    ranked = placed.withColumn("row", F.row_number().over(Window.partitionBy("hashed", "salt").orderBy("at"))).join(groups, ["hashed", "salt"])
    return ranked.withColumn("piece", F.floor((F.col("before") + F.col("row") - 1) / F.col("per"))).select(*rows.columns, F.lit(BITS).alias("depth"), "piece")


def extendible_shards(table: DataFrame, keys: list[str], size: Column, limit: int = MAX_BYTES) -> DataFrame:
    """(keys..., n_bytes, shard, depth, piece): the shard of each row of ``table``.

    ``keys`` spread the rows, and ``size`` gives a row's bytes (null counts 0). A shard is named by its prefix, as
    bits. A row larger than the limit has a shard of its own. Rows equal in all keys have equal hashes: if such rows
    alone are larger than the limit, their bucket is cut into pieces 0, 1, ... in turn; all other rows have piece 0.
    An empty table gives no rows.
    """
    rows = staged(table.select(*keys, F.coalesce(size.cast("long"), F.lit(0)).alias("n_bytes"), hash_bits(*keys).alias("hashed")), "rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, high, left, done = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + STEP), rows, None
    while True:
        directory = staged(_directory(left, low, high, limit), "directory")
        placed = left.withColumn("bits", _prefix(F.col("hashed"), high)).join(directory, "bits")
        part = placed.where("depth IS NOT NULL").select(*rows.columns, "depth").withColumn("piece", F.lit(0).cast("long"))
        done = part if done is None else done.unionByName(part)
        if not directory.where("depth IS NULL").limit(1).count():
            break
        left = staged(placed.where("depth IS NULL").select(*rows.columns), "deeper")
        if high == BITS:
            done = done.unionByName(_pieces(left, limit))
            break
        low, high = high, min(BITS, high + STEP)
    shard = F.lpad(F.conv(_prefix(F.col("hashed"), F.col("depth")).cast("string"), 10, 2), F.greatest(F.col("depth"), F.lit(0)), "0")
    return done.select(*keys, "n_bytes", F.when(F.col("depth") == 0, "").otherwise(shard).alias("shard"), "depth", "piece")


#: The query's limit: small enough that the test tables fill many shards, of several depths.
QUERY_BYTES = 256 << 10

ORACLE_SQL = f"""
WITH rows AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         ('0x' || md5(concat_ws('|', doc_id::VARCHAR, md5(coalesce(text, ''))))[1:15])::BIGINT AS hashed
  FROM documents
), spread AS (
  SELECT doc_id, n_bytes, hashed, depth, hashed >> (60 - depth) AS prefix FROM rows, (SELECT unnest(range(0, 61))::INTEGER AS depth)
), fits AS (
  SELECT depth, prefix FROM spread GROUP BY depth, prefix HAVING sum(n_bytes) <= {QUERY_BYTES} OR count(*) = 1
), placed AS (
  SELECT doc_id, n_bytes, hashed, min(depth) AS depth FROM spread JOIN fits USING (depth, prefix) GROUP BY ALL
)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(hashed >> (60 - depth)), depth, '0') END AS shard, depth, 0::BIGINT AS piece
FROM placed
"""
