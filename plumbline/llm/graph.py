"""Connected components of an undirected graph by alternating star operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.scratch import Scratch


#: Parts that each node's neighbours are dealt to.
SALTS = 8
#: Edges up to which one task finds the components: their number is counted first.
ONE_TASK = 1 << 20


def find_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of the nodes 0..n-1 reaches over the edges (a, b)."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    return np.array([root(x) for x in range(n)], dtype=np.int64)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each batch -> a star for each of the batch's components."""
    for batch in batches:
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        roots = find_roots(index[: len(a)], index[len(a) :], len(nodes))
        child = np.flatnonzero(roots != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[roots[child]])], names=["v", "u"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges -> every node with its root."""
    rows = [b for b in batches if b.num_rows]
    if rows:
        table = pa.Table.from_batches(rows)
        a, b = (table.column(k).to_numpy() for k in (0, 1))
        nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        roots = find_roots(index[: len(a)], index[len(a) :], len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[roots])], names=["node", "root"])


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 50, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) of every node that an edge touches; root is the smallest node that it reaches.

    edges: two columns of longs, without nulls; self-loops and repeated edges
    change nothing, and no edges give no rows. Edges are first cut down to a
    star for each component of a batch. If that leaves `one_task` of them at
    most, a task finds the roots; else each round links every node to
    the smallest of its neighbourhood, once for its larger and once for its
    smaller neighbours, until nothing changes: the number of rounds grows with
    the logarithm of the longest path, and no task needs more than a hash table
    of its own keys. Each round is a written table.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v != u")
    now = scratch.keep(pairs.mapInArrow(_forest, "v long, u long").distinct(), "edges")
    if now.count() <= one_task:
        return scratch.keep(now.repartition(1).mapInArrow(_whole, "node long, root long"), "roots")
    seen = None
    for _ in range(most_rounds):
        both = now.select("v", "u").union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        # every larger neighbour of a node goes to the smallest of its neighbourhood
        # a hub's neighbours are spread over SALTS parts, each of which gets the hub's smallest neighbour
        salted = both.where("u > v").withColumn("s", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
        every = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        large = salted.join(every, ["v", "s"]).select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # every node goes with its smaller neighbours to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(least, "v")
            .select(F.explode(F.array(F.struct(F.col("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
            .select("e.v", "e.u")
            .where("v != u")
            .distinct()
        )
        after = scratch.keep(small, "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.union(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
