"""Connected components by alternating large-star and small-star steps.

Edges are first contracted inside each partition by union-find, in tables of
bounded size, so that few steps remain.  No node's neighbours are gathered: a
step takes a minimum for each node (combined before the shuffle) and joins it
back, nodes of very many edges by broadcast (``join_counted``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrules.llm.common import join_counted

#: nodes that a partition's contraction holds at once
MOST_NODES = 1_000_000


class Sets:
    """Union-find over integers; the smallest member is the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = Sets()

    def pairs() -> Iterator[pa.RecordBatch]:
        found = [(x, r) for x in list(sets.up) if (r := sets.find(x)) != x]
        for k in range(0, len(found), 50_000):
            both = np.array(found[k : k + 50_000], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            sets.join(a, b)
        if len(sets.up) > MOST_NODES:
            yield from pairs()
            sets = Sets()
    yield from pairs()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges with m, the least neighbour of ``a`` or ``a`` itself."""
    least = edges.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return join_counted(edges, "a", least.withColumn("m", F.least("k", "m"))).select("a", "b", "m")


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 50) -> DataFrame:
    """(node, root) for every node of an edge; the root is the smallest node of the component."""
    now = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    now = now.mapInArrow(_contract, "a long, b long").checkpoint()  # a > b from here on
    state = _state(now)
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a node that is its own least keeps its edges to larger ones
        large = large.where("a <> b").distinct().checkpoint()
        small = _with_least(large)
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        small = small.select("e.a", "e.b").where("a <> b").distinct()
        now = small.checkpoint()
        before, state = state, _state(now)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
    raise RuntimeError("components did not settle")
