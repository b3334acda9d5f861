"""Connected components of a link table, by alternating large-star and
small-star steps (Kiveris et al. 2014).  Every step is a join and an
aggregation; nothing is gathered on the driver but a few numbers a round.  A
node with a large share of the links is joined by broadcast (see
``spread_join``), so that its links stay in the tasks that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, spread_join, stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has a link to another node;
    the component is its smallest node.

    Links with a null end and links of a node to itself say nothing; repeated
    and mirrored links count once.  An empty table gives an empty table.
    """
    x, y = F.col(a), F.col(b)
    edges = stored(links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == before or state[0] == 0:
            break
        before, n = state, state[0]
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        large = stored(
            spread_join(both, least, "u", "n", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            # a node that is not the least of its own neighbours points at their least as well
            .union(least.where("m < u").select("u", F.col("m").alias("v")))
            .distinct()
        )
        fewer = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = spread_join(large, fewer, "u", "n", n).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.union(fewer.select("u", F.col("m").alias("v"))).distinct())
        drop_stored(edges, least, large, fewer)
        edges = after
    # a component's members each have one link, to its least
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


class Forest:
    """Links of a few thousand rows inside one task, as a forest."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
