"""Connected components of an edge table, by contraction: every task joins up the edges it holds, and what tasks say of the same node is the next, smaller graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tasks import settled

#: Edges that a task joins up at once.
BLOCK = 1_000_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the smallest node that these edges reach from each."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        low, high = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        if (low == high).all():
            return nodes, nodes[up]
        np.minimum.at(up, high, low)
        while (up[up] != up).any():
            up = up[up]


def _forest(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, root): the components of each task's edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nodes, roots = joined(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])

        for x in batches:
            held.append((x.column("a").to_numpy(), x.column("b").to_numpy()))
            if sum(len(a) for a, _ in held) >= BLOCK:
                yield flush()
        if held:
            yield flush()

    return edges.mapInArrow(run, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b): returns (node, component), component being the smallest node that links reach.

    Nodes without an edge are not listed; nulls and self-links are ignored; repeated edges count once.
    In each round every task joins up its edges, each node takes the smallest of the roots that tasks give it, and the
    edges between that root and the others are the next round's. Of ids in random order, as hashes are, each round
    drops the nodes that are no task's root, a constant share at least.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    rounds = []
    while True:
        forest = settled(_forest(e))
        rounds.append(settled(forest.groupBy("node").agg(F.min("root").alias("up"), F.max("root").alias("other"))))
        torn = rounds[-1].where("up <> other")
        if torn.isEmpty():
            break
        e = forest.join(torn.select("node", "up"), "node").where("root <> up").select(F.col("root").alias("a"), F.col("up").alias("b")).distinct()
    out = rounds.pop().select("node", "up")
    while rounds:
        above = out.select(F.col("node").alias("up"), F.col("up").alias("top"))
        out = rounds.pop().select("node", "up").join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
    return settled(out.withColumnRenamed("up", "component"))
