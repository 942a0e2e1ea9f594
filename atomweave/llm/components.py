"""Connected components of an edge table by alternating large and small stars, each round a written table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) with the same components as the edges (a, b); roots are the smallest nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        new = new[label]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _local(batches):
    """Contracts the edges of each Arrow batch of a task."""
    import pyarrow as pa

    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(a, b)], ["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge in edges (a long, b long); component is the smallest node reachable.

    Self loops and repeated edges change nothing. An empty table gives an empty one.
    """
    state = written(edges.select("a", "b").where("a <> b").mapInArrow(lean(_local), "a long, b long").distinct(), "components")

    def mark(e: DataFrame):
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    seen = mark(state)
    if not seen[0]:
        return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(rounds):
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(state.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        state = written(small, "components")
        now = mark(state)
        if now == seen:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
    raise RuntimeError("components did not converge")
