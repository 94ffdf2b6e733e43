"""Connected components of an edge table by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest reachable node) for every node of edges (a, b); loops are ignored.

    Each round writes its edges to the shared folder, so a lost executor costs at most a round. Rounds grow with the
    logarithm of the longest path. No edges give no rows.
    """
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        state = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == mark or not state[0]:
            break
        mark = state
        # Large star: every node points its larger neighbours to the smallest node it knows.
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        large = e.join(least, "b").select("a", F.col("m").alias("b")).distinct()
        # Small star: every node points itself and its smaller neighbours to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(moved.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


class Forest:
    """Union-find over positions 0 to n - 1 in a task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
