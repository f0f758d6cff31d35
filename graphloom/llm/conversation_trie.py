"""Operator 13: the prefix trie of conversations, merged family first.

A family is the conversations of one base id. Their turns come together by
that id, as digests and word counts only, sorted, so that a family's trie is
built while its rows stream by: each conversation is rebuilt from the base's
first turns and its own, and walks down the trie by a chain of hashes. What is
shuffled for the global merge is a row for each family node with its members.

Sums over subtrees need no walk by depth. A node belongs to its smallest
member; a conversation owns its path from some depth on. A subtree's childless
nodes are its members that own a childless node, and its saved tokens are its
members' words between the subtree's top and the depth from which they own
their path, as each distinct node is owned once. Both are sums over members,
again family first: the few facts about conversations go back to the families
by base id, and only sums for each family node meet the others'.

The list of a node's ended conversations is hashed in the end. As one node may
have any number of them, they are range-partitioned, joined to long pieces
where they are, and the pieces fed to the hash in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.columns import named
from graphloom.llm.store import by_bytes, staged

FAMILY, KEPT = 20, 4
#: Entries of a family's trie that a task holds before it hands them on, characters of a piece of ids, rows of a batch.
HELD, PIECE, ROWS = 100_000, 1 << 16, 10_000
ROOT = bytes(16)
_NODES = T.StructType([
    T.StructField("base", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("parent", T.BinaryType()), T.StructField("depth", T.LongType()),
    T.StructField("words", T.LongType()), T.StructField("upto", T.LongType()), T.StructField("members", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())),
])
_ARROW = pa.schema([("base", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()), ("upto", pa.int64()), ("members", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, family: int) -> DataFrame:
    """(base, conv, kept, turn, digest, words): turns without their texts."""
    conv, role, text = named(conv_col).cast("long"), F.coalesce(named(role_col).cast("string"), F.lit("")), F.coalesce(named(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where(named(conv_col).isNotNull()).select(conv.alias("conv"), named(turn_col).alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    return rows.select((F.col("conv") - F.col("conv") % family).alias("base"), "conv", (F.crc32(F.col("conv").cast("string")) % KEPT).alias("kept"), "turn", "digest", "words")


class _Trie:
    """The trie of the family whose rows stream by, handed on whenever it has ``HELD`` entries."""

    def __init__(self) -> None:
        self.base = self.conv = None
        self.nodes: dict[bytes, list] = {}
        self.entries, self.rows = 0, []

    def visit(self, digest: bytes | None, words: int) -> None:
        """The current conversation goes one turn deeper; without a digest it enters the root."""
        if digest is None:
            self.node, self.parent, self.depth, self.upto = ROOT, None, 0, 0
        else:
            self.parent, self.depth, self.upto = self.node, self.depth + 1, self.upto + words
            self.node = hashlib.blake2b(self.node + digest, digest_size=16).digest()
        found = self.nodes.get(self.node)
        if found is None:
            found = self.nodes[self.node] = [self.base, self.node, self.parent, self.depth, words, self.upto, [], []]
        found[6].append(self.conv)
        self.entries += 1
        if self.entries >= HELD:
            last, self.nodes = self.nodes.pop(self.node), self.nodes
            self.hand_on()
            self.nodes[self.node] = last  # the conversation may end here

    def hand_on(self) -> None:
        self.rows.extend(self.nodes.values())
        self.nodes, self.entries = {}, 0

    def end(self) -> None:
        """The current conversation has no more turns."""
        if self.conv is not None:
            while self.behind:  # the base's turns that a conversation without later turns of its own still gets
                self.visit(*self.behind.pop(0))
            self.nodes[self.node][7].append(self.conv)

    def begin(self, base: int, conv: int, kept: int) -> None:
        self.end()
        if base != self.base:
            self.hand_on()
            self.base, self.first = base, []  # the first turns of the base conversation
        self.conv, self.skip = conv, 0 if conv == base else kept
        self.behind = [] if conv == base else self.first[:kept]
        self.visit(None, 0)

    def turn(self, digest: bytes, words: int) -> None:
        if self.conv == self.base and len(self.first) < KEPT - 1:
            self.first.append((digest, words))
        if self.skip:
            self.skip -= 1
            return
        while self.behind:
            self.visit(*self.behind.pop(0))
        self.visit(digest, words)


def _families(turns: DataFrame) -> DataFrame:
    """The nodes of all families' tries. A long family may give a node more than once, each time with other members."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _Trie()

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            for base, conv, kept, digest, words in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if conv != trie.conv:
                    trie.begin(base, conv, kept)
                trie.turn(digest, words)
                if len(trie.rows) >= ROWS:
                    yield batch_of(trie.rows)
                    trie.rows = []
        trie.end()
        trie.hand_on()
        if trie.rows:
            yield batch_of(trie.rows)

    # the base conversation first, as the others begin with its turns
    dealt = turns.repartition("base").sortWithinPartitions("base", F.col("conv") != F.col("base"), "conv", F.asc_nulls_first("turn"), "digest")
    return by_bytes(dealt.select("base", "conv", "kept", "digest", "words")).mapInArrow(build, _NODES)


def _end_hashes(families: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes at which conversations end."""
    ends = families.where(F.size("ends") > 0).select("node", F.explode("ends").alias("conv"))
    pieces = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("first", T.LongType()), T.StructField("piece", T.StringType())])
    hashes = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("ends_sha256", T.StringType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def piece(node: bytes, run: list[int]) -> tuple:
            return node, run[0], ",".join(map(str, run))

        out, now, run, size = [], None, [], 0
        for batch in batches:
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if run and (node != now or size >= PIECE):
                    out.append(piece(now, run))
                    run, size = [], 0
                now = node
                run.append(conv)
                size += len(str(conv)) + 1
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], pieces.names)
                out = []
        if run:
            out.append(piece(now, run))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], pieces.names)

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, digest = [], None, None
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != now:
                    if digest is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], hashes.names)
                out = []
        if digest is not None:
            out.append((now, digest.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], hashes.names)

    joined = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(join, pieces)
    return by_bytes(joined.repartition("node").sortWithinPartitions("node", "first").select("node", "piece")).mapInArrow(feed, hashes)


def family_nodes(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = FAMILY) -> DataFrame:
    """(base, node, parent, depth, words, upto, members, ends): the written family tries, whose members say which conversations pass a node."""
    return staged(_families(_turns(conversations, conv_col, turn_col, role_col, text_col, family)), "families")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = FAMILY) -> DataFrame:
    """A row for each distinct prefix of rebuilt conversations.

    node, parent (hashes; null above the root), depth, conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256; the prefix is the first ``depth`` rebuilt turns of conversation ``conv_id``.

    Turns are ordered by number, null first, ties by a digest of role and text; repeated rows are turns of their own.
    A null role or text is empty; rows without a conversation id are no turns. Other columns play no part.
    A conversation of any length is walked as a stream. An empty table gives no rows, not even a root.
    """
    families = family_nodes(conversations, conv_col, turn_col, role_col, text_col, family)
    merged = families.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.first("upto").alias("upto"),
        F.sum(F.size("members")).cast("long").alias("n_convs"), F.min(F.array_min("members")).alias("conv_id"),
    )
    merged = staged(merged, "nodes")
    children = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = staged(merged.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "counted")

    owned = nodes.groupBy(F.col("conv_id").alias("conv")).agg(F.min(F.col("upto") - F.col("words")).alias("before"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    ended = families.select("base", F.explode("ends").alias("conv"), "upto")
    facts = ended.join(owned, "conv", "left").select("base", "conv", F.coalesce("before", "upto").alias("before"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"))
    told = facts.groupBy("base").agg(F.map_from_entries(F.collect_list(F.struct("conv", F.struct("before", "leaf")))).alias("facts"))  # a family has few conversations
    above = F.col("upto") - F.col("words")
    zero = F.lit(0).cast("long")
    leaves = F.aggregate("members", zero, lambda s, m: s + F.col("facts")[m]["leaf"])
    saved = F.aggregate("members", zero, lambda s, m: s + F.greatest(zero, F.col("facts")[m]["before"] - above))
    sums = families.join(told, "base").select("node", leaves.alias("leaves"), saved.alias("saved")).groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    over = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(sums, "node").join(_end_hashes(families), "node", "left").join(over, "parent", "left")
    return whole.select("node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


_ROUND = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END"
ORACLE_SQL = (
    "WITH x0 AS (SELECT i, i::BIGINT AS x FROM range(256) r(i)), "
    + ", ".join(f"x{k + 1} AS (SELECT i, {_ROUND} AS x FROM x{k})" for k in range(8))
    + r""", crc AS (SELECT list(x ORDER BY i) AS t FROM x8),
own AS (
  SELECT conv_id, list({'k': md5(length(r) || ':' || r || t), 'w': len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT} ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || t)) AS l
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id
), kept AS (
  SELECT conv_id, l, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 4)::BIGINT AS h
  FROM own, crc
), rebuilt AS (
  SELECT c.conv_id, CASE WHEN b.l IS NULL THEN c.l[c.h + 1 :] ELSE list_concat(b.l[1 : c.h], c.l[c.h + 1 :]) END AS l
  FROM kept c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
), steps AS (
  SELECT conv_id, d, md5(array_to_string(list_transform(l[1 : d], lambda x: x.k), '') || d) AS node, CASE WHEN d > 0 THEN md5(array_to_string(list_transform(l[1 : d - 1], lambda x: x.k), '') || (d - 1)) END AS parent,
         CASE WHEN d > 0 THEN l[d].w ELSE 0 END AS w, d = len(l) AS ended
  FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(d) AS d, any_value(w) AS w, count(*) AS n, min(conv_id) AS c, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS e FROM steps GROUP BY node
), counted AS (
  SELECT n.*, coalesce(k.k, 0) AS k, p.c AS pc FROM nodes n LEFT JOIN (SELECT parent, count(*) AS k FROM nodes WHERE d > 0 GROUP BY parent) k ON k.parent = n.node LEFT JOIN nodes p ON p.node = n.parent
), under AS (
  SELECT DISTINCT a.node AS top, b.node AS node FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND a.d <= b.d
), sums AS (
  SELECT top, count(*) FILTER (k = 0) AS leaves, sum((n - 1) * w) AS saved FROM under JOIN counted USING (node) GROUP BY top
)
SELECT c AS conv_id, d::BIGINT AS depth, pc AS parent_conv_id, n::BIGINT AS n_convs, k::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, e AS ends_sha256
FROM counted JOIN sums ON top = node
"""
)
