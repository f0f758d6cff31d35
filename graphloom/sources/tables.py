"""Graphs from tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.graph import Graph, edges_from_pairs
from graphloom.storage import staged


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def part_graph(spark: SparkSession, folder: str) -> Graph:
    """Parts that were returned from one order: weight is the sum of the products of their quantities over 2500."""
    part = table(spark, folder, "part")
    brand = F.regexp_replace("p_brand", "Brand#", "").cast("int")
    nodes = part.select(F.col("p_partkey").alias("node_id"), (brand % 5).alias("y"), F.array(F.col("p_size") / 50.0, (F.col("p_retailprice") - 900.0) / 100.0, brand / 25.0).alias("x"))
    lines = table(spark, folder, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    other = lines.select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("q").alias("qd"))
    pairs = lines.select("l_orderkey", F.col("l_partkey").alias("src"), "q").join(other, "l_orderkey").where("src < dst")
    return Graph(nodes, pairs.groupBy("src", "dst").agg((F.sum(F.col("q") * F.col("qd")) / 2500.0).alias("w")))


#: Rows that a task compares with a block at once.
SLICE = 512


def cosines(vectors: DataFrame, id_col: str, vector_col: str, k: int, block: int = 4096) -> DataFrame:
    """(query, key, p): each vector's k largest cosines, rounded to 9 places, with other vectors; ties stay.

    Exhaustive, so the work is quadratic; vectors are sent to the tasks in blocks of ``block`` rows, and each task
    keeps only what can still be among the k largest of a query. A task holds the cosines of a block with ``SLICE`` rows at a
    time, however many rows it reads. A block's finds are written before the next block is sent.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda v: v.cast("double")).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = staged(rows.repartition(tasks), "vectors")  # a small file is much work
    n = rows.count()
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("key", T.LongType()), T.StructField("p", T.DoubleType())])
    found = None
    blocks = max(1, -(-n // block))
    for b in range(blocks):
        held = rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        if not held:
            continue
        sent = spark.sparkContext.broadcast((np.array([r["id"] for r in held]), np.array([r["v"] for r in held])))

        def nearest(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, own = sent.value
            own = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
            best = np.full((len(ids), max(k, 1)), -np.inf)
            for batch in batches:
                for at in range(0, len(batch), SLICE):
                    part = batch.slice(at, SLICE)
                    keys = part.column(0).to_numpy()
                    theirs = part.column(1).flatten().to_numpy().reshape(len(keys), -1)
                    theirs = theirs / np.maximum(np.linalg.norm(theirs, axis=1, keepdims=True), 1e-12)
                    p = own @ theirs.T
                    np.round(p, 9, out=p)
                    p[ids[:, None] == keys[None, :]] = -np.inf
                    both = np.hstack([best, p])
                    both.partition(p.shape[1], axis=1)
                    best = both[:, p.shape[1] :].copy()
                    q, c = np.nonzero((p >= best.min(1)[:, None]) & np.isfinite(p))
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(keys[c]), pa.array(p[q, c])], schema.names)

        part = staged(rows.mapInArrow(nearest, schema), "cosines")
        sent.destroy()
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], schema) if found is None else found


def embedding_graph(spark: SparkSession, folder: str, k: int = 8) -> Graph:
    """Nearest neighbours by cosine among ``embeddings``, both directions averaged; labels are the table's."""
    from graphloom.operators.attention import adjacency, top_k

    vectors = table(spark, folder, "embeddings")
    near = cosines(vectors, "vec_id", "embedding", k).withColumn("passage_id", F.lit(0).cast("long"))
    nodes = vectors.select(F.col("vec_id").alias("node_id"), F.col("label").alias("y"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return Graph(nodes, adjacency(top_k(near, k)))


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """Attention of users to kinds of events in four layers of days: (passage_id, layer, query, key, p), p a count."""
    kinds = F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"]))
    events = table(spark, folder, "events")
    return events.groupBy((F.dayofmonth("ts") % 4).cast("int").alias("layer"), F.col("user_id").alias("query"), (F.array_position(kinds, F.col("event_type")) - 1).alias("key")).agg(F.count("*").cast("double").alias("p")).withColumn("passage_id", F.lit(0).cast("long"))


def stored_graph(spark: SparkSession, folder: str) -> Graph:
    """A graph stored as nodes (node_id, feat_0.., label) and edges (src, dst): undirected, of weight 1, without loops.

    Feature columns are found by their prefix and ordered by number; an edge to an unknown node is an error.
    """
    nodes, edges = table(spark, folder, "nodes"), table(spark, folder, "edges")
    if missing := {"node_id", "label"} - set(nodes.columns) or {"src", "dst"} - set(edges.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    names = sorted((c for c in nodes.columns if c.startswith("feat_")), key=lambda c: int(c[5:]))
    built = Graph(nodes.select("node_id", F.col("label").cast("int").alias("y"), F.array(*[F.col(c).cast("double") for c in names]).alias("x")), edges_from_pairs(edges))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).join(nodes, "node_id", "left_anti")
    if ends.limit(1).count():
        raise ValueError("an edge names an unknown node")
    return built


def labelled_block(graph: Graph, first: int) -> Graph:
    """The subgraph of the nodes from ``first`` on: in some sets the nodes before it have no labels."""
    from graphloom.graph import induced

    return induced(graph, graph.nodes.where(F.col("node_id") >= first))


def largest_sample(graph: Graph, n: int, seed: int = 0, tries: int = 16) -> Graph:
    """The largest component of a hashed sample of the largest component's nodes, with both labels in it.

    The sample begins with ``n`` nodes and doubles until its largest component has two labels, ``tries`` times at most.
    """
    from graphloom.functions.hashing import uniform
    from graphloom.graph import induced
    from graphloom.operators.components import largest_component

    def kept(part: Graph) -> Graph:
        return Graph(staged(part.nodes, "nodes"), staged(part.edges, "edges"))

    graph = kept(graph)
    whole = kept(induced(graph, largest_component(graph)))
    total = whole.nodes.count()
    for turn in range(tries):
        share = min(1.0, n * 2**turn / max(total, 1))
        drawn = kept(induced(whole, whole.nodes.where(uniform(seed, "node_id") < share)))
        found = kept(induced(drawn, largest_component(drawn)))
        labels = found.nodes.agg(F.count_distinct("y")).first()[0]
        if share >= 1 or labels > 1:
            break
    if labels < 2:
        raise ValueError("the largest component has one label only")
    return found


def joined_passages(attention: DataFrame, passage_col: str = "passage_id") -> DataFrame:
    """(src, dst, w, passage): the tokens of all passages as one graph of separate blocks, each after those of the passages before."""
    from graphloom.plans.ranking import running_total

    sizes = attention.groupBy(passage_col).agg((F.max(F.greatest("query", "key")) + 1).alias("n"))
    offsets = running_total(sizes, "n", F.asc(passage_col))
    joined = attention.join(offsets, passage_col)
    return joined.select((F.col("before") + F.col("query")).alias("src"), (F.col("before") + F.col("key")).alias("dst"), F.col("p").alias("w"), F.col(passage_col).alias("passage"))


def read_points(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Points that a ladder or a report has written: JSON lines or CSV with a head line."""
    return spark.read.option("header", True).option("inferSchema", True).format(kind).load(path)


def merged_settings(*layers: dict) -> dict:
    """Settings of which later layers win; those that are tables themselves are merged the same way."""
    out: dict = {}
    for layer in layers:
        for name, value in layer.items():
            out[name] = merged_settings(out[name], value) if isinstance(value, dict) and isinstance(out.get(name), dict) else value
    return out


LOADERS: dict[str, Callable[[SparkSession, str], Graph]] = {"part": part_graph, "embedding": embedding_graph, "stored": stored_graph}


def load(spark: SparkSession, name: str, folder: str) -> Graph:
    """A graph by the name of its loader; an unknown name is a KeyError."""
    return LOADERS[name](spark, folder)
