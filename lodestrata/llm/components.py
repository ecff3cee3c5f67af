"""Connected components of a table of edges, by alternating large and small stars.

Every round links each node's larger neighbours to its least neighbour, then each node's smaller neighbours to the least
of them; a logarithmic number of rounds leaves stars whose centre is the least node of the component. Rounds are cut off
in the shared folder. Nothing but two numbers a round comes to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


class Forest:
    """Union-find over 0 .. n - 1; the root of a set is its least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _contract(batches):
    """A task's edges as stars, as many as it has nodes at most."""
    for batch in batches:
        nodes, at = np.unique(np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()]), return_inverse=True)
        forest = Forest(len(nodes))
        half = batch.num_rows
        for i, j in zip(at[:half].tolist(), at[half:].tolist(), strict=True):
            forest.join(i, j)
        root = np.array([forest.find(i) for i in range(len(nodes))], dtype=np.int64)
        far = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["x", "y"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the least node it is connected with) of every node that has an edge; edges: two long columns."""
    a, b = edges.columns
    pairs = edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where("x > y")
    now = cut(pairs.mapInArrow(_contract, "x long, y long").distinct())
    state = None
    for _ in range(most_rounds):
        both = now.select(F.col("x").alias("u"), F.col("y").alias("v")).union(now.select(F.col("y").alias("u"), F.col("x").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).union(low.select("x", F.col("m").alias("y")))
        now = cut(small.distinct())
        before, state = state, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).head())
        if state == before:
            break
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("x").alias("node"), F.col("y").alias("root")).union(now.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
