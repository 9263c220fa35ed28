"""Connected components of an edge list, as alternating star contractions.

Each round is two grouped minima joined back to the edges, so a hub's edges
are pre-aggregated before they are shuffled and the joins can be split where a
hub is hot.  A round's edges are written to the shared folder.  Once a count
shows that few edges are left, one task finishes them; its size is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeloom.plans.shared import written

#: Edges up to which one task finishes a graph (16 bytes each); more are contracted by rounds over the cluster.
ONE_TASK_EDGES = 1_000_000


def least_reachable(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of an edge list in order, and the smallest node that each is connected with."""
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = at[: len(i)], at[len(i) :]
    label = np.arange(len(nodes))
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            break
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, label[label]):
            label = label[label]
    return nodes, nodes[label]


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    nodes, component = least_reachable(table.column(0).to_numpy(), table.column(1).to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(component)], ["node", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list; ``component`` is its smallest reachable node.

    Null ends and self-loops are ignored (a node that has only those is not returned); repeated edges count
    once; an empty list gives an empty table.  RuntimeError if ``max_rounds`` do not suffice.
    """
    now = edges.select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v")).where("u > v").distinct()
    now = written(now, "edges")
    before = None
    for _ in range(max_rounds):
        if now.count() <= one_task_edges:
            return now.coalesce(1).mapInArrow(_finished, "node long, component long")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: every larger neighbour of a node points to the smallest node of its neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: the smaller neighbours of a node point to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
