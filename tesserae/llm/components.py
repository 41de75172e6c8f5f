"""Connected components of a graph given by its edges, without bringing the graph to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, streamed

#: Edges that one task may hold after each partition has been cut to a forest; more go through star rounds.
ONE_TASK = 1_000_000
#: Nodes that a partition holds before it hands on its forest and starts afresh.
HELD_NODES = 1_000_000


class Forest:
    """Union by least node."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _labels(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    forest, schema = Forest(), None

    def out() -> pa.RecordBatch:
        rows = [(x, forest.find(x)) for x in list(forest.parent)]
        rows = [r for r in rows if most is None or r[0] != r[1]]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        if most is not None and len(forest.parent) > most:
            yield out()
            forest = Forest()
    if forest.parent:
        yield out()


def reduced(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of a forest with the same components within each partition."""
    return streamed(edges, lambda batches: _labels(batches, HELD_NODES), edges.schema)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star round: neighbours of a node move to its least neighbour."""
    both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.withColumn("m", F.least("a", F.min("b").over(Window.partitionBy("a"))))
    moved = least.where("b > a").select(
        F.col("b").alias("a"),
        F.col("m").alias("b"),
    ) if large else least.select("b", "m").toDF("a", "b").union(least.select("a", "m").toDF("a", "b"))
    return moved.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node of the edges and the least node of its component. edges: (a, b) of one orderable type.

    Partitions are cut to forests first. What is left goes to one task if it is at most ONE_TASK edges, as counted;
    more goes through star rounds until it is, or nothing changes: then it is the answer itself.
    """
    edges = stored(reduced(edges.select("a", "b")))
    while edges.count() > ONE_TASK:
        moved = stored(_star(_star(edges, True), False))
        if moved.exceptAll(edges).isEmpty() and edges.exceptAll(moved).isEmpty():
            return moved.union(moved.select("b", "b").distinct())
        edges = moved
    return streamed(edges.coalesce(1), lambda batches: _labels(batches, None), edges.schema)
